"""Small cases worked out by hand, one for each rule."""

import random
import re

import pytest

from pilespan.config import PileupConfig, Region
from pilespan.operators import bases, coverage, islands, positions, pileup, reads, reports
from pilespan.operators.annotate import annotate
from pilespan.operators.cigar import aligned_pairs
from pilespan.plans.pileups import dna_annotated
from pilespan.plans.pileups import pileup as run
from pilespan.sources.fasta import lengths, reference_bases
from pyspark.sql import functions as F

REFERENCE = "ACGTACGTACAAAAAAGTTT"
LOOSE = PileupConfig(min_read_quality=0, min_read_length=0, min_base_quality=0)
READ = "sample string, read_id string, region string, start0 long, flag int, mapq int, cigar string, seq string, quals array<int>, has_sa boolean, qlen long"


def a_read(read_id="r", start0=0, flag=0, mapq=60, cigar="4M", seq=None, quals=None, has_sa=False, region="chrT", sample="s"):
    n = sum(int(x) for x, op in re.findall(r"(\d+)([MIS=X])", cigar or ""))
    seq = seq or "A" * n
    return (sample, read_id, region, start0, flag, mapq, cigar, seq, quals, has_sa, len(seq))


def frame(spark, rows, schema=READ):
    return spark.createDataFrame(rows, schema)


def reference(spark, seq=REFERENCE, region="chrT"):
    return reference_bases(spark.createDataFrame([(region, 0, seq)], "region string, start0 long, seq string"))


def test_read_flags(spark):
    flags = [0, 16, 99, 147, 83, 163, 77, 141, 512, 256, 2048, 1024, 65, 97, 73]
    kept = reads.filter_reads(frame(spark, [a_read(flag=f) for f in flags]), LOOSE)
    assert sorted(r.flag for r in kept.collect()) == [0, 16, 83, 99, 147, 163]


def test_read_thresholds(spark):
    rows = [a_read("a", mapq=20, cigar="30M"), a_read("b", mapq=19, cigar="30M"), a_read("c", mapq=20, cigar="29M"), a_read("d", mapq=20, cigar="30M", has_sa=True), a_read("e", cigar=None, seq="A" * 40)]
    df = frame(spark, rows)
    assert [r.read_id for r in reads.filter_reads(df, PileupConfig()).collect()] == ["a"]
    told = {r.read_id: r.reason for r in reads.discard_reasons(df, PileupConfig()).collect()}
    assert told == {"a": None, "b": "mapping quality", "c": "read length", "d": "chimeric", "e": "no alignment"}


@pytest.mark.parametrize(
    "cigar,start,mode,expected",
    [
        ("1S3M1I2M2D2M", 2, "compat", [(2, 1), (3, 2), (4, 3), (5, 5), (6, 6), (9, 7), (10, 8)]),
        ("2M3N2M", 0, "compat", [(0, 0), (1, 1), (5, 2), (6, 3)]),
        ("4M2X4M", 0, "compat", [(0, 0), (1, 1), (2, 2), (3, 3)]),
        ("3H5M", 0, "compat", []),
        ("4M2X1M", 0, "full", [(i, i) for i in range(7)]),
        ("3H2M", 0, "full", [(0, 0), (1, 1)]),
        ("0M2M", 0, "compat", [(0, 0), (1, 1)]),
    ],
)
def test_cigar(spark, cigar, start, mode, expected):
    rows = aligned_pairs(frame(spark, [a_read(start0=start, cigar=cigar)]), mode).select("pos0", "qpos").collect()
    assert sorted(map(tuple, rows)) == expected


def walk(start, cigar):
    """Bases of a read by a plain walk, for the property test."""
    out, p, q = [], start, 0
    for n, op in re.findall(r"(\d+)(.)", cigar):
        for _ in range(int(n)):
            if op in "HP=X":
                return out
            if op == "M":
                out.append((p, q))
            p, q = p + (op in "MDN"), q + (op in "MIS")
    return out


def test_random_cigars(spark):
    rng = random.Random(7)
    cases = {str(i): (rng.randrange(50), "".join(f"{rng.randrange(1, 9)}{rng.choice('MMMMIDNSHP=X')}" for _ in range(rng.randrange(1, 8)))) for i in range(300)}
    got = {}
    for r in aligned_pairs(frame(spark, [a_read(i, start0=s, cigar=c) for i, (s, c) in cases.items()])).collect():
        got.setdefault(r.read_id, []).append((r.pos0, r.qpos))
    for i, (s, c) in cases.items():
        assert sorted(got.get(i, [])) == walk(s, c), c


def test_base_rules(spark):
    df = spark.createDataFrame([(q, 10, 30, "A") for q in range(10)] + [(5, 10, 29, "A"), (5, 10, 30, "N")], "qpos long, qlen long, qual int, base string")
    config = PileupConfig(min_base_position=2, max_base_position=3)
    assert sorted(r.qpos for r in bases.filter_bases(df, config).collect()) == [2, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("strand,expected", [(1, "+--+"), (2, "-++-"), (0, "-+-+")])
def test_read_strand(spark, strand, expected):
    df = spark.createDataFrame([(99,), (83,), (131,), (147,)], "flag int")
    got = "".join(r.s for r in df.select("flag", reads.read_strand(strand).alias("s")).collect())
    assert got == expected


@pytest.mark.parametrize("plus,minus,expected", [(7, 3, "+"), (2, 1, "*"), (1, 4, "-"), (0, 0, "*")])
def test_vote(spark, plus, minus, expected):
    row = spark.range(1).select(pileup.strand_vote(F.lit(plus), F.lit(minus), PileupConfig()).alias("v")).first()
    assert row.v == expected


def column(spark, letters, config, ref="A"):
    """The site of bases given as text, upper case on the plus strand."""
    rows = [a_read(str(i), flag=0 if c.isupper() else 16, cigar="1M", seq=c.upper(), quals=[30]) for i, c in enumerate(letters)]
    out = run(frame(spark, rows), reference(spark, ref), config).collect()
    return out[0] if out else None


def strands(**more):
    return PileupConfig(min_read_quality=0, min_read_length=0, min_base_quality=0, strand=2, **more)


def test_minus_column(spark):
    row = column(spark, "Agggg", strands())  # read strand 2: forward is minus
    assert (row.strand, row.reference) in {("1", "A"), ("0", "T")}
    plain, kept = column(spark, "aGGGG", strands()), column(spark, "aGGGG", strands(strand_correction=True))
    assert (plain.reference, plain.strand, plain.coverage, plain.base_count, plain.all_subs, plain.frequency, plain.edits_no) == ("T", "0", 5, [0, 4, 0, 1], ["TC"], 0.8, 4)
    assert (kept.coverage, kept.base_count, kept.all_subs, kept.frequency, kept.edits_no) == (4, [0, 4, 0, 0], ["TC"], 1.0, 4)


def test_column_rules(spark):
    letters = "A" * 10 + "GGG" + "T"
    row = column(spark, letters, LOOSE)
    assert (row.base_count, row.all_subs, round(row.frequency, 2)) == ([10, 0, 3, 1], ["AG", "AT"], 0.23)
    less = lambda **kw: column(spark, letters, PileupConfig(min_read_quality=0, min_read_length=0, min_base_quality=0, **kw))
    assert less(min_edits_per_nucleotide=2) is None
    assert less(max_editing_nucleotides=2) is None
    assert less(max_editing_nucleotides=3) is not None
    assert less(min_edits=5) is None and less(min_edits=4) is not None
    assert less(min_column_length=15) is None
    assert column(spark, "AAA", PileupConfig(min_read_quality=0, min_read_length=0, min_base_quality=0, strict=True)) is None


def test_mean_quality_uses_the_mapping_threshold(spark):
    def at(quals):
        rows = [a_read(str(i), cigar="1M", quals=[q]) for i, q in enumerate(quals)]
        return run(frame(spark, rows), reference(spark, "A"), PileupConfig(min_read_length=0, min_base_quality=0)).count()

    assert at([20, 20]) == 1 and at([20, 19]) == 0


def test_missing_qualities_are_30(spark):
    row = run(frame(spark, [a_read(cigar="1M")]), reference(spark, "A"), LOOSE).first()
    assert row.mean_q == 30.0


def test_homopolymers(spark):
    def runs(*pieces):
        rows, at = [], 0
        for p in pieces:
            rows.append(("chrT", at, p))
            at += len(p)
        chunks = spark.createDataFrame(rows, "region string, start0 long, seq string")
        return sorted(map(tuple, islands.homopolymer_runs(chunks, lengths(chunks)).collect()))

    assert runs(REFERENCE) == [("chrT", 10, 16, 6, "a")]
    assert runs(REFERENCE[:12], REFERENCE[12:13], REFERENCE[13:]) == [("chrT", 10, 16, 6, "a")]
    assert runs("CAAAAA") == [] and runs("nnnnnnA") == [("chrT", 0, 6, 6, "n")]


@pytest.mark.parametrize("kind,strand,expected", [("D", "+", {101, 102, 103, 104}), ("A", "+", {96, 97, 98, 99}), ("D", "-", {96, 97, 98, 99}), ("A", "-", {101, 102, 103, 104})])
def test_splice(spark, kind, strand, expected):
    sites = spark.createDataFrame([("chrT", 100, kind, strand)], "region string, coordinate long, kind string, strand string")
    assert {r.pos0 for r in positions.splice_positions(sites, 4).collect()} == expected


def test_targets(spark):
    rows = spark.createDataFrame([("chr1", 4), ("1", 5), ("chr1", 6), ("chr2", 9)], "region string, pos0 long")
    raw = spark.createDataFrame([("Region", "Position", "x"), ("chr1", "5", "6"), ("chr1", "7", "A")], "region string, start string, end string")
    at = positions.interval_positions(positions.target_intervals(raw))
    assert sorted(map(tuple, positions.restrict(rows, at).collect())) == [("1", 5), ("chr1", 4), ("chr1", 6), ("chr2", 9)]
    one = positions.interval_positions(positions.target_intervals(raw.where("start = '5'")))
    assert sorted(map(tuple, positions.restrict(rows, one).collect())) == [("1", 5), ("chr1", 4), ("chr2", 9)]
    assert positions.restrict(rows, at.limit(0)).count() == 4


def test_islands(spark):
    df = spark.createDataFrame([("chr1", p) for p in (1, 2, 3, 3, 5, 6)] + [("chr2", 6)] + [("chr3", p) for p in range(65530, 65545)], "region string, position long")
    assert sorted(map(tuple, islands.positions_to_intervals(df).collect())) == [("chr1", 1, 3), ("chr1", 5, 6), ("chr2", 6, 6), ("chr3", 65530, 65544)]


SITE = "region string, position long, reference string, strand string, coverage long, mean_q double, base_count array<bigint>, all_subs array<string>, frequency double"


def test_annotate(spark):
    rna = spark.createDataFrame([("chr1", 100, "T", "0", 5, 30.0, [0, 4, 0, 1], ["TC"], 0.8), ("chr1", 101, "A", "1", 5, 30.0, [5, 0, 0, 0], [], 0.0)], SITE)
    dna = spark.createDataFrame([("1", 100, "A", "*", 10, 31.0, [8, 0, 2, 0], ["AG"], 0.2), ("1", 999, "A", "*", 10, 31.0, [8, 0, 2, 0], ["AG"], 0.2)], SITE)
    first, second = annotate(rna, dna).orderBy("position").collect()
    assert (first.g_coverage, first.g_base_count, first.g_all_subs, first.g_frequency) == (10, [0, 2, 0, 8], ["TC"], 0.2)
    assert second.g_coverage is None and second.g_all_subs is None
    assert [r.position for r in annotate(rna, dna, homozygous_only=True).collect()] == [101]


def test_dna_chain(spark):
    rna = run(frame(spark, [a_read(cigar="4M", seq="ACGA")]), reference(spark), LOOSE)
    out = dna_annotated(rna, frame(spark, [a_read("d", cigar="6M", seq="ACGTAC")]), reference(spark), LOOSE).orderBy("position").collect()
    assert [(r.position, r.g_coverage) for r in out] == [(1, 1), (2, 1), (3, 1), (4, 1)] and out[3].all_subs == ["TA"] and out[3].g_all_subs == []


def depths(spark, rows):
    return spark.createDataFrame(rows, "region string, position long, depth long")


def test_intervals(spark):
    got = coverage.greedy_intervals(depths(spark, [("c", p, 2) for p in range(1, 5)]), 2).orderBy("start").collect()
    assert [(r.start, r.end, int(r.weight), r.width, r.reason) for r in got] == [(1, 2, 16, 1, "WEIGHT"), (3, 4, 16, 1, "END_OF_CHROMOSOME")]
    wide = coverage.greedy_intervals(depths(spark, [("c", 1, 1), ("c", 3_000_002, 1), ("c", 3_000_003, 1), ("d", 1, 1)]), 1, total=1000).orderBy("region", "start").collect()
    assert [(r.region, r.start, r.end, r.reason) for r in wide] == [("c", 1, 3000002, "MAX_WIDTH"), ("c", 3000003, 3000003, "END_OF_CHROMOSOME"), ("d", 1, 1, "END_OF_CHROMOSOME")]
    assert coverage.greedy_intervals(depths(spark, []), 2).count() == 0


def test_intervals_keep_all_weight(spark):
    rng = random.Random(3)
    rows = [(c, p, rng.choice([1, 2, 5, 3_000_000])) for c in "ab" for p in sorted(rng.sample(range(10**6), 400))]
    total = sum(d**3 for _, _, d in rows)
    got = coverage.greedy_intervals(depths(spark, rows), 7).orderBy("region", "start").collect()
    assert sum(int(r.weight) for r in got) == total
    expected = []
    for c in "ab":
        s = e = None
        w = 0
        for _, p, d in (r for r in rows if r[0] == c):
            if s is not None and (w >= total // 7 or e - s > 3_000_000):
                expected.append((c, s, e, w))
                s, w = None, 0
            s, e, w = p if s is None else s, p, w + d**3
        expected.append((c, s, e, w))
    assert [(r.region, r.start, r.end, int(r.weight)) for r in got] == expected


def test_fixed_intervals(spark):
    sizes = spark.createDataFrame([("chr1", 25), ("chrM", 300)], "region string, length long")
    got = coverage.fixed_intervals(sizes, 10).orderBy("region", "start").collect()
    assert [tuple(r) for r in got[:3]] == [("chr1", 1, 10), ("chr1", 11, 20), ("chr1", 21, 25)] and got[3].end == 3 and len(got) == 103


def test_regions():
    assert Region.parse("chr1") == Region("chr1") and Region.parse("chr1:5-10") == Region("chr1", 5, 10)
    for bad in ("chr1:5", "chr1:5-5", "chr1:10-5", "", "chr1:a-b"):
        with pytest.raises(ValueError):
            Region.parse(bad)


def test_config():
    for bad in (dict(dna=True), dict(create_homopolymers=True), dict(strand=3), dict(strand_mode="x"), dict(cigar_mode="x")):
        with pytest.raises(ValueError):
            PileupConfig(**bad)
    with pytest.raises(ValueError):
        PileupConfig().for_files()
    assert PileupConfig(reads="/a/b.bam", region=Region("chr1", 2, 3)).default_output() == "b_chr1_2_3_pileup_table.gz"


def test_regions_partition_the_whole(spark):
    rng = random.Random(5)
    rows = [a_read(str(i), start0=rng.randrange(0, 12), cigar="6M", seq="".join(rng.choice("ACGT") for _ in range(6))) for i in range(60)]
    df, ref = frame(spark, rows), reference(spark)
    key = lambda r: (r.position, r.coverage, tuple(r.base_count))
    whole = sorted(key(r) for r in run(df, ref, LOOSE).collect())
    parts = [key(r) for a, b in ((1, 7), (8, 20)) for r in run(df, ref, PileupConfig(min_read_quality=0, min_read_length=0, min_base_quality=0, region=Region("T", a, b))).collect()]
    assert sorted(parts) == whole and all(sum(c) == n for _, n, c in whole)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(key(r) for r in run(df, ref, LOOSE).collect()) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_reports(spark):
    parts = spark.createDataFrame([("a", 3600), ("a", 61), ("b", 5)], "sample string, seconds long")
    assert sorted(map(tuple, reports.runtime_by_sample(parts).collect())) == [("a", 3661, "01:01:01"), ("b", 5, "00:00:05")]
    events = spark.sql("select 1 as id, 'x' as content, timestamp'2024-01-01 00:00:00' as start, timestamp'2024-01-01 00:00:05' as end, 'g' as `group`")
    text = reports.timeline(events).first().events
    assert '"content":"x"' in text and "2024-01-01 00:00:05" in reports.timeline_html(text)
