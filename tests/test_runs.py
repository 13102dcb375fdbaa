"""Runs from files to files, through the command line."""

import pytest

from pilespan.__main__ import OPTIONS, main, parser
from pilespan.config import PileupConfig
from pilespan.sources import tables


@pytest.fixture
def files(tmp_path):
    sam = ["@HD\tVN:1.6"]
    for i in range(6):
        sam.append(f"r{i}\t{16 if i % 2 else 0}\tchr1\t{1 + i}\t60\t8M\t*\t0\t0\tACGTACGT\tIIIIIIII")
    (tmp_path / "one.sam").write_text("\n".join(sam) + "\n")
    (tmp_path / "two.sam").write_text("\n".join(sam[:3]) + "\n")
    (tmp_path / "x.fa").write_text(">chr1\nACGTAAAAAACGTACGT\n")
    (tmp_path / "x.fai").write_text("chr1\t17\t6\t17\t18\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/one.sam\n{tmp_path}/two.sam\n")
    return tmp_path


def test_every_field_is_an_option():
    fields = {f for _, f, _ in OPTIONS}
    assert set(PileupConfig.__dataclass_fields__) == fields
    assert {PileupConfig(strand_mode=m).strand_mode for m in ("1", "2", 1, "confidence")} == {"confidence"}
    with pytest.raises(SystemExit):
        parser().parse_args([])


def test_chain(spark, files):
    d = str(files)
    base = ["pileup", "-f", f"{d}/one.sam", "-r", f"{d}/x.fa", "-mrl", "1", "-Z", f"{d}/x.fai"]
    main([*base, "-o", f"{d}/rna.gz"], spark)
    rna = tables.read_sites(spark, f"{d}/rna.gz").orderBy("position").collect()
    assert [r.position for r in rna] == list(range(1, 14)) and rna[0].coverage == 1 and rna[5].coverage == 6
    main([*base, "-m", f"{d}/homo", "-c", "-o", f"{d}/no_homo"], spark)
    assert [r.position for r in tables.read_sites(spark, f"{d}/no_homo").orderBy("position").collect()] == [1, 2, 3, 4, 11, 12, 13]
    main([*base, "-g", "chr1:3-5", "-o", f"{d}/part"], spark)
    assert [r.position for r in tables.read_sites(spark, f"{d}/part").orderBy("position").collect()] == [3, 4, 5]
    main(["bed", "-i", f"{d}/no_homo", "-o", f"{d}/bed"], spark)
    assert sorted(map(tuple, tables.read_targets(spark, f"{d}/bed").collect())) == [("chr1", 0, 4), ("chr1", 10, 13)]
    main(["pileup", "-f", f"{d}/two.sam", "-r", f"{d}/x.fa", "-mrl", "1", "-N", "-B", f"{d}/bed", "-o", f"{d}/dna"], spark)
    dna = tables.read_sites(spark, f"{d}/dna").collect()
    assert {r.strand for r in dna} == {"*"} and {r.position for r in dna} == {1, 2, 3, 4}
    main(["annotate", "-r", f"{d}/rna.gz", "-d", f"{d}/dna", "-R", f"{d}/x.fai", "-o", f"{d}/both"], spark)
    assert {r.position for r in tables.read_sites(spark, f"{d}/both").where("g_coverage is not null").collect()} == {1, 2, 3, 4}


def test_coverage_and_intervals(spark, files):
    d = str(files)
    main(["coverage", "-i", f"{d}/one.sam", "-o", f"{d}/cov"], spark)
    got = tables.read_coverage(spark, f"{d}/cov").orderBy("position").collect()
    assert [r.depth for r in got] == [1, 2, 3, 4, 5, 6, 6, 6, 5, 4, 3, 2, 1]
    main(["intervals", "-G", f"{d}/cov", "--size", "3", "-o", f"{d}/plan"], spark)
    rows = [r.value.split("\t") for r in spark.read.text(f"{d}/plan").collect()]
    assert sum(int(r[3]) for r in rows) == sum(r.depth**3 for r in got)


def test_samples(spark, files):
    d = str(files)
    main(["pileup", "-F", f"{d}/list.txt", "-r", f"{d}/x.fa", "-mrl", "1", "-o", f"{d}/many"], spark)
    assert tables.read_sites(spark, f"{d}/many/one").count() == 13 and tables.read_sites(spark, f"{d}/many/two").count() == 9


def test_intervals_restart_and_reports(spark, files):
    d = str(files)
    main(["coverage", "-i", f"{d}/one.sam", "-o", f"{d}/covs/one"], spark)
    args = ["pileup", "-f", f"{d}/one.sam", "-r", f"{d}/x.fa", "-mrl", "1", "-D", f"{d}/covs/one", "-n", "3", "-V", "-o", f"{d}/parts"]
    main(args, spark)
    parts = sorted(p.name for p in (files / "parts").iterdir())
    assert len(parts) > 1 and all(p.startswith("chr1_") for p in parts)
    whole = sorted((r.position, r.coverage) for p in parts for r in tables.read_sites(spark, f"{d}/parts/{p}").collect())
    assert [x for x, _ in whole] == list(range(1, 14)) and [c for _, c in whole] == [1, 2, 3, 4, 5, 6, 6, 6, 5, 4, 3, 2, 1]
    told = {(r.what, r.reason): r.n for r in spark.read.json(f"{d}/parts.run/discarded").collect()}
    assert told["read", None] == 6 and told["base", None] == 48 and told["site", None] == 13
    times = spark.read.json(f"{d}/parts.run/times").collect()
    assert sorted(r.content for r in times) == parts and spark.read.json(f"{d}/parts.run/groups").count() == len(parts)
    assert spark.read.json(f"{d}/parts.run/intervals").count() == len(parts) and spark.read.json(f"{d}/parts.run/files").count() == 3
    assert spark.read.json(spark.read.text(f"{d}/parts.run/timeline").rdd.map(lambda r: r.value)).count() == len(parts)
    (files / "parts" / parts[0] / "_SUCCESS").unlink()
    before = {p: sorted(x.name for x in (files / "parts" / p).glob("part-*")) for p in parts}
    main([*args, "-R"], spark)
    after = {p: sorted(x.name for x in (files / "parts" / p).glob("part-*")) for p in parts}
    assert [p for p in parts if before[p] != after[p]] == parts[:1]  # the others stay as they were


def test_excluded_regions_and_strand_mode(spark, files):
    d = str(files)
    main(["pileup", "-f", f"{d}/one.sam", "-r", f"{d}/x.fa", "-mrl", "1", "-x", "chrM,1", "-T", "1", "-o", f"{d}/none"], spark)
    assert tables.read_sites(spark, f"{d}/none").count() == 0
