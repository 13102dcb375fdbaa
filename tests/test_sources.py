"""Readers and sinks, by round trips over small files."""

import gzip
import io
import random
import struct
import zlib

import pytest

from pilespan.config import PileupConfig, Region
from pilespan.operators import positions
from pilespan.operators import reads as read_ops
from pilespan.plans import bridge
from pilespan.plans.pileups import pileup
from pilespan.plans.queries import QUERIES
from pilespan.sources import alignments, fasta, sinks, tables
from pyspark.sql import functions as F


def test_sizes(spark, tmp_path):
    (tmp_path / "x.fai").write_text("chr2\t20\t6\nchr1\t10\t30\nchr2\t20\t6\n")
    got = tables.read_sizes(spark, str(tmp_path / "x.fai")).orderBy("ord").collect()
    assert [tuple(r) for r in got] == [("chr2", 20, 0), ("chr1", 10, 1)]


def test_targets_and_homopolymers(spark, tmp_path):
    with gzip.open(tmp_path / "t.bed.gz", "wt") as f:
        f.write("Region\tPosition\tRef\nchr1\t5\t7\nchr1\t9\nchr2\t4\tA\n")
    got = sorted(map(tuple, tables.read_targets(spark, str(tmp_path / "t.bed.gz")).collect()))
    assert got == [("chr1", 4, 7), ("chr1", 8, 9), ("chr2", 3, 4)]
    (tmp_path / "h.txt").write_text("#Chromosome\tStart\tEnd\tLength\tSymbol\nchr1\t10\t16\t6\ta\n")
    assert [tuple(r) for r in tables.read_homopolymers(spark, str(tmp_path / "h.txt")).collect()] == [("chr1", 10, 16, 6, "a")]


def test_splice_coverage_samples(spark, tmp_path):
    (tmp_path / "s.txt").write_text("chr1 100 x D +\nchr1\t200  y A -\nbad line\n")
    sites = tables.read_splice_sites(spark, str(tmp_path / "s.txt"))
    assert positions.splice_positions(sites, 2).where("region = 'chr1'").count() == 4
    (tmp_path / "c.cov").write_text("chr1\t1\t3\nchr1\t2\t0\n")
    assert [tuple(r) for r in tables.read_coverage(spark, str(tmp_path / "c.cov")).collect()] == [("chr1", 1, 3)]
    (tmp_path / "l.txt").write_text("/a/b.c/one.bam\n\ntwo.x.bam\n")
    assert sorted(r.sample for r in tables.read_samples(spark, str(tmp_path / "l.txt")).collect()) == ["one", "two.x"]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">chr1 first\nACGT\nAC\n>chr2\nGG\n\nTTT\n")
    chunks = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert sorted(map(tuple, chunks.collect())) == [("chr1", 0, "ACGT"), ("chr1", 4, "AC"), ("chr2", 0, "GG"), ("chr2", 2, "TTT")]
    assert sorted(map(tuple, fasta.lengths(chunks).collect())) == [("chr1", 6), ("chr2", 5)]
    bases = fasta.reference_bases(chunks)
    assert "".join(r.base for r in bases.where("region = 'chr1'").orderBy("pos0").collect()) == "ACGTAC"
    assert "".join(r.seq for r in fasta.chunked(bases, 4).where("region = 'chr2'").orderBy("start0").collect()) == "GGTTT"


def test_fasta_of_many_files_and_splits(spark, tmp_path):
    """Files of different sizes in splits of a few lines, which Spark packs by size and not in the files' order."""
    rng = random.Random(1)
    expected = {}
    (tmp_path / "genome").mkdir()
    for n, size in enumerate([3000, 150, 1200, 40]):
        lines = []
        for c in "ab":
            seq = "".join(rng.choice("ACGTN") for _ in range(size + rng.randrange(60)))
            expected[f"chr{n}{c}"] = seq
            lines += [f">chr{n}{c} x", *(seq[i : i + 60] for i in range(0, len(seq), 60))]
        (tmp_path / f"genome/{n}.fa").write_text("\n".join(lines) + "\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        chunks = fasta.read_fasta(spark, f"{tmp_path}/genome")
        got = {}
        for r in chunks.collect():
            got.setdefault(r.region, {})[r.start0] = r.seq
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {k: "".join(v[p] for p in sorted(v)) for k, v in got.items()} == expected
    assert all(expected[k][p : p + len(s)] == s for k, v in got.items() for p, s in v.items())


def test_pieces(spark, tmp_path):
    seq = "".join(random.Random(2).choice("ACGT") for _ in range(103))
    chunks = spark.createDataFrame([("chr1", i, seq[i : i + 7]) for i in range(0, 103, 7)] + [("2", 0, "GGG")], "region string, start0 long, seq string")
    got = {(r.region, r.piece): r.seq for r in fasta.pieces(chunks, 10).collect()}
    assert got == {("2", 0): "GGG"} | {("chr1", n): seq[10 * n : 10 * n + 10] for n in range(11)}


def test_reads_near_positions(spark):
    """What near() drops touches no position; it leaves chromosomes without positions and long reads alone."""
    rows = [("a", "chr1", 100, "50M"), ("b", "chr1", 16380, "10M"), ("c", "chr1", 40000, "50M"), ("d", "chr1", 5, "10M30000N10M"), ("e", "chr2", 9, "5M")]
    reads = spark.createDataFrame(rows, "read_id string, region string, start0 long, cigar string")
    at = spark.createDataFrame([("1", 16385)], "region string, pos0 long")
    assert sorted(r.read_id for r in positions.near(reads, at).collect()) == ["a", "b", "d", "e"]
    assert positions.near(reads, at).columns == reads.columns and positions.near(reads, None) is reads


def test_fetch_reaches_the_scan(spark, tmp_path):
    rows = [(str(i), "chr1" if i % 2 else "2", 10 * i, 0, 60, "20M", "A" * 20, None, False) for i in range(300)]
    reads = spark.createDataFrame(rows, alignments.READS)
    alignments.write_parquet(reads, str(tmp_path / "reads"), 4)
    stored = alignments.read_parquet(spark, str(tmp_path / "reads"))
    got = read_ops.fetch(stored, Region("1", 1001, 1100))
    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", kept)
    assert "In(region, [1,chr1])" in plan and "LessThan(start0,1100)" in plan and "GreaterThanOrEqual(end0,1001)" in plan
    expected = {r[0] for r in rows if r[1] == "chr1" and r[2] < 1100 and r[2] + 20 > 1000}
    assert {r.read_id for r in got.collect()} == expected


def bgzf(data, block):
    """BGZF blocks of the data, and for each block (place in the data, place in the file)."""
    out, places = b"", []
    for at in range(0, len(data), block):
        places.append((at, len(out)))
        part = data[at : at + block]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000"), places


def test_bam_in_parts(spark, tmp_path):
    """A file with an index is read in parts that hold each record once, and a region reads its parts only."""
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10**6) + struct.pack("<i", 5) + b"chr2\0" + struct.pack("<i", 10**6)
    rng, starts = random.Random(3), []
    for n in range(2000):
        ref, pos = n // 1000, (n % 1000) * 900
        starts.append((ref, pos, len(data)))
        seq = "".join(rng.choice("ACGT") for _ in range(30))
        data += bam_record(f"r{n}", ref, pos, 0, 60, [(30, "M")], seq, [rng.randrange(40) for _ in range(30)])
    packed, places = bgzf(data, 3000)
    (tmp_path / "x.bam").write_bytes(packed)

    def virtual(at):
        begin, place = max(p for p in places if p[0] <= at)
        return place << 16 | at - begin

    index = b"BAI\x01" + struct.pack("<i", 2)
    for ref in range(2):
        windows = [next((virtual(at) for r, p, at in starts if r == ref and p + 30 > w << 14), 0) for w in range(900 * 1000 >> 14)]
        index += struct.pack("<i", 0) + struct.pack("<i", len(windows)) + struct.pack(f"<{len(windows)}Q", *windows)
    whole = alignments.read_bam(spark, str(tmp_path / "x.bam")).orderBy("region", "start0").collect()
    (tmp_path / "x.bam.bai").write_bytes(index)
    parts = alignments.read_bam(spark, f"file://{tmp_path}/x.bam", split_bytes=10000)
    assert parts.rdd.getNumPartitions() > 5 and parts.orderBy("region", "start0").collect() == whole and len(whole) == 2000
    reader = alignments.BamReader([str(tmp_path / "x.bam")], 10000, ("2", 500_000, 520_000))
    some = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(reader.partitions()) < 3 and len(some) < 100 and {r["read_id"] for r in some} >= {r.read_id for r in whole if r.region == "chr2" and 499_970 < r.start0 < 520_000}
    assert alignments.BamReader([str(tmp_path / "x.bam")], 10000, ("chr9", 1, 2)).partitions() == []


def test_sam(spark, tmp_path):
    lines = ["@HD\tVN:1.6", "r1\t16\tchr1\t3\t60\t2S3M\t*\t0\t0\tACGTA\tIIII!\tNM:i:0", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*", "r3\t0\tchr1\t1\t9\t2M\t*\t0\t0\tGG\tII\tSA:Z:x"]
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    one, two, three = alignments.read_sam(spark, str(tmp_path / "x.sam"), "s").orderBy("read_id").collect()
    assert (one.start0, one.flag, one.mapq, one.cigar, one.seq, one.quals, one.has_sa, one.qlen, one.sample) == (2, 16, 60, "2S3M", "ACGTA", [40, 40, 40, 40, 0], False, 5, "s")
    assert two.cigar is None and two.quals is None and three.has_sa


def bam_record(name, ref, pos, flag, mapq, cigar, seq, quals, tags=b""):
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar)
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + bytes(quals) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    out = io.BytesIO()
    out.write(b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 50))
    out.write(bam_record("r1", 0, 2, 16, 60, [(2, "S"), (3, "M")], "ACGTA", [40, 40, 40, 40, 0], b"NMC\x01"))
    out.write(bam_record("r2", -1, -1, 4, 0, [], "ACG", [255] * 3))
    out.write(bam_record("r3", 0, 0, 0, 9, [(2, "M")], "GG", [40, 40], b"XXBc\x02\0\0\0\x01\x02XYZabc\0SAZx\0"))
    with open(tmp_path / "x.bam", "wb") as f:  # two gzip members, as BGZF has
        data = out.getvalue()
        f.write(gzip.compress(data[:40]) + gzip.compress(data[40:]))
    one, two, three = alignments.read_bam(spark, str(tmp_path / "x.bam"), "s").orderBy("read_id").collect()
    assert (one.region, one.start0, one.flag, one.mapq, one.cigar, one.seq, one.quals, one.has_sa, one.qlen) == ("chr1", 2, 16, 60, "2S3M", "ACGTA", [40, 40, 40, 40, 0], False, 5)
    assert two.region is None and two.cigar is None and two.quals is None and three.has_sa
    with pytest.raises(ValueError):
        next(alignments.decode_bam(io.BytesIO(zlib.compress(b"x"))))


SITE = "region string, position long, reference string, strand string, coverage long, mean_q double, base_count array<bigint>, all_subs array<string>, frequency double"


def test_table_round_trip(spark, tmp_path):
    rows = [("chr2", 7, "A", "1", 8, 30.125, [5, 0, 3, 0], ["AG"], 0.375), ("chr1", 9, "T", "2", 1, 20.0, [0, 0, 0, 1], [], 0.0)]
    sites = spark.createDataFrame(rows, SITE)
    text = {r["Region"]: r for r in sinks.table_text(sites).collect()}
    assert list(text["chr2"]) == ["chr2", "7", "A", "1", "8", "30.12", "[5, 0, 3, 0]", "AG", "0.38", "-", "-", "-", "-", "-"]
    assert text["chr1"]["AllSubs"] == "-"
    sinks.write_table(sites, str(tmp_path / "t.gz"))
    back = {r.region: r for r in tables.read_sites(spark, str(tmp_path / "t.gz")).collect()}
    assert back["chr2"].base_count == [5, 0, 3, 0] and back["chr2"].all_subs == ["AG"] and back["chr1"].all_subs == [] and back["chr2"].g_coverage is None and back["chr2"].g_all_subs is None
    sinks.write_table(sites, str(tmp_path / "t.gz"), header=False, append=True)
    assert tables.read_sites(spark, str(tmp_path / "t.gz")).count() == 4


def test_order_and_index(spark, tmp_path):
    sites = spark.createDataFrame([("chr1", 5), ("chr2", 9), ("2", 3), ("chr1", 1), ("odd", 1)], "region string, position long")
    sizes = spark.createDataFrame([("chr2", 0), ("chr1", 1)], "region string, ord int")
    assert [tuple(r) for r in sinks.ordered(sites, sizes).collect()] == [("2", 3), ("chr2", 9), ("chr1", 1), ("chr1", 5), ("odd", 1)]
    sinks.write_indexed(sites, sizes, str(tmp_path / "i"), 2)
    assert spark.read.parquet(str(tmp_path / "i")).where("region = 'chr1' and position = 5").count() == 1


def test_bed_and_intervals(spark, tmp_path):
    sinks.write_bed(spark.createDataFrame([("chr1", 1, 3)], "region string, start long, end long"), str(tmp_path / "b"))
    assert [tuple(r) for r in tables.read_targets(spark, str(tmp_path / "b")).collect()] == [("chr1", 0, 3)]
    runs = spark.createDataFrame([("chr1", 10, 16, 6, "a")], "region string, start0 long, end0 long, length long, symbol string")
    sinks.write_homopolymers(runs, str(tmp_path / "h"))
    assert [tuple(r) for r in tables.read_homopolymers(spark, str(tmp_path / "h")).collect()] == [("chr1", 10, 16, 6, "a")]


def test_stream_is_the_batch(spark, tmp_path):
    from pilespan.streaming.pileups import stream_sites

    schema = "sample string, read_id string, region string, start0 long, flag int, mapq int, cigar string, seq string, quals array<int>, has_sa boolean, qlen long"
    rows = [("s", str(i), "chrT", i % 5, 0, 60, "4M", "ACGT", None, False, 4) for i in range(20)]
    reads = spark.createDataFrame(rows, schema)
    reference = fasta.reference_bases(spark.createDataFrame([("chrT", 0, "ACGTACGTA")], "region string, start0 long, seq string"))
    config = PileupConfig(min_read_length=0)
    for n in range(2):
        reads.where(F.col("read_id").cast("int") % 2 == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_sites(stream, reference, config).writeStream.outputMode("complete").format("memory").queryName("sites").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda df: sorted((r.position, r.coverage, tuple(r.base_count)) for r in df.collect())
    assert key(spark.table("sites")) == key(pileup(reads, reference, config))


def test_sam_lines_of_many_reads(spark, tmp_path):
    """Lines are made inside the row: no read waits for others in memory, and two reads may have one id."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.union(orders).write.parquet(str(tmp_path / "orders.parquet"))
    assert spark.read.parquet(str(tmp_path / "orders.parquet")).groupBy("o_orderkey").count().where("count = 2").count() == orders.count()
    reads = bridge.make_reads(spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("c")))
    plan = bridge.sam_lines(reads)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan
    from_files, from_tables = (QUERIES[q](spark, str(tmp_path)) for q in ("pileup_from_files", "pileup_basic"))
    got, expected = sorted(map(tuple, from_files.collect())), sorted(map(tuple, from_tables.select(*from_files.columns).collect()))
    assert got == expected and max(r[from_files.columns.index("coverage")] for r in got) > 1
