"""Runs from files to files, as a configuration says."""

from __future__ import annotations

import os
import time
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PileupConfig, Region
from ..operators import bases as base_ops
from ..operators import pileup as pile_ops
from ..operators import positions as at
from ..operators import reads as read_ops
from ..operators import reports
from ..operators.annotate import annotate
from ..operators.cigar import aligned_pairs, pick_bases
from ..operators.coverage import depth, greedy_intervals
from ..operators.islands import homopolymer_runs, positions_to_intervals
from ..sources import alignments, fasta, sinks, tables
from .pileups import column_sites, kept_bases, pileup


def load_reads(spark: SparkSession, path: str, sample: str | None = None, region: Region | None = None) -> DataFrame:
    """Reads of a .sam, .sam.gz or .bam file, or of canonical Parquet; of an indexed file at least those of the region."""
    if path.endswith((".sam", ".sam.gz")):
        return alignments.read_sam(spark, path, sample)
    if path.endswith(".bam"):
        return alignments.read_bam(spark, path, sample, region)
    rows = alignments.read_parquet(spark, path)
    return rows if sample is None else rows.withColumn("sample", F.lit(sample))


def samples_reads(spark: SparkSession, samples_file: str) -> DataFrame:
    """Reads of all samples of a list; the list names files, so it is short."""
    parts = [load_reads(spark, r["path"], r["sample"]) for r in tables.read_samples(spark, samples_file).collect()]
    if not parts:
        raise ValueError("the list names no sample")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def side_inputs(spark: SparkSession, config: PileupConfig, chunks: DataFrame) -> tuple[DataFrame | None, tuple[DataFrame, ...]]:
    """(targets, excluded) that the configuration names; homopolymers are created first if it says so."""
    excluded = []
    if config.splicing_file:
        excluded.append(at.splice_positions(tables.read_splice_sites(spark, config.splicing_file), config.splicing_span))
    if config.homopolymer_file:
        if config.create_homopolymers:
            sinks.write_homopolymers(homopolymer_runs(chunks, fasta.lengths(chunks), config.homopolymer_span), config.homopolymer_file)
        excluded.append(at.interval_positions(tables.read_homopolymers(spark, config.homopolymer_file)))
    targets = at.interval_positions(tables.read_targets(spark, config.target_file)) if config.target_file else None
    return targets, tuple(excluded)


def run_pileup(spark: SparkSession, config: PileupConfig) -> DataFrame:
    """The table of sites of a run over files; written to config.output if that is given.

    With a samples file each sample's table goes to a folder of its own below the output, and with a depth file
    each interval's; these parts are written one after the other. With restart, parts that were finished before stay
    as they are. The side files of report() lie in <output>.run, and with verbose also why reads, bases
    and sites were dropped.
    """
    if not config.samples_file:
        config.for_files()
    chunks = fasta.read_fasta(spark, config.reference)
    reads = samples_reads(spark, config.samples_file) if config.samples_file else load_reads(spark, config.reads, "sample", config.region)
    if config.exclude_regions:
        names = [n for r in config.exclude_regions for n in (r.removeprefix("chr"), "chr" + r.removeprefix("chr"))]
        reads = reads.where(~F.col("region").isin(names))
    targets, excluded = side_inputs(spark, config, chunks)
    reference = fasta.pieces(chunks)
    sites = pileup(reads, reference, config, targets, excluded)
    if config.debug:
        sites.explain("formatted")
    if not config.output:
        return sites
    sizes = tables.read_sizes(spark, config.sizes_file) if config.sizes_file else None
    order = (lambda df: sinks.ordered(df, sizes)) if sizes is not None else (lambda df: df)
    samples = [r["sample"] for r in tables.read_samples(spark, config.samples_file).collect()] if config.samples_file else []
    intervals = run_intervals(spark, config, config.size).collect() if config.coverage_file and config.size else []  # bounded by size and the widest interval
    parts: list[tuple[str, DataFrame]] = [(x, sites.where(F.col("sample") == x)) for x in samples]
    for r in intervals:
        own = replace(config, region=Region(r["region"], r["start"], r["end"]))
        parts.append((f"{r['region']}_{r['start']}_{r['end']}", pileup(reads, reference, own, targets, excluded)))
    done = []
    for name, rows in parts or [("", sites)]:
        path = f"{config.output}/{name}" if name else config.output
        if config.restart and finished(spark, path):
            continue
        began = time.time()
        sinks.write_table(order(rows), path, not config.remove_header, config.append)
        done.append((name or os.path.basename(config.output), began, time.time()))
    report(spark, config, done, [(r["region"], r["start"], r["end"]) for r in intervals])
    if config.verbose:
        discards(reads, reference, config, targets, excluded).write.mode("overwrite").option("ignoreNullFields", False).json(f"{config.output}.run/discarded")
    return sites


def with_coverage_dir(config: PileupConfig) -> PileupConfig:
    """config with the depth files of coverage_dir as its depth file, if it names none: a folder is read as one table."""
    return replace(config, coverage_file=config.coverage_dir) if config.coverage_dir and not config.coverage_file else config


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a part was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def report(spark: SparkSession, config: PileupConfig, parts: list[tuple[str, float, float]], intervals: list[tuple]) -> None:
    """A run's side files, below <output>.run: files (its inputs), intervals, times (a row a part), groups (time by sample) and
    timeline (one JSON array of events). The rows are a run's parts, so they are few."""
    folder = f"{config.output}.run"
    inputs = [(k, str(v)) for k, v in vars(config).items() if k in ("reads", "reference", "samples_file", "target_file", "homopolymer_file", "splicing_file", "coverage_file", "sizes_file") and v]
    spark.createDataFrame(inputs, "kind string, path string").coalesce(1).write.mode("overwrite").json(f"{folder}/files")
    if intervals:
        spark.createDataFrame(intervals, "region string, start long, end long").coalesce(1).write.mode("overwrite").json(f"{folder}/intervals")
    at_ = lambda t: datetime.fromtimestamp(t, timezone.utc)
    rows = spark.createDataFrame([(i, name, at_(a), at_(b), b - a) for i, (name, a, b) in enumerate(parts)], "id long, content string, start timestamp, end timestamp, seconds double")
    rows.coalesce(1).write.mode("append" if config.restart else "overwrite").json(f"{folder}/times")
    reports.runtime_by_sample(rows.select(F.col("content").alias("sample"), "seconds")).coalesce(1).write.mode("overwrite").json(f"{folder}/groups")
    reports.timeline(rows.withColumn("group", F.col("content"))).coalesce(1).write.mode("overwrite").text(f"{folder}/timeline")


def discards(reads: DataFrame, reference: DataFrame, config: PileupConfig, targets: DataFrame | None = None, excluded: tuple[DataFrame, ...] = (), pick=pick_bases) -> DataFrame:
    """(what, reason, n): how many reads, bases and sites each rule is the first to drop; a null reason counts what is kept."""
    own = read_ops.fetch(reads, config.region)
    told = read_ops.discard_reasons(own, config).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("read").alias("what"), "reason", "n")
    pairs = pick(aligned_pairs(at.near(read_ops.filter_reads(own, config), targets), config.cigar_mode))
    bases = base_ops.discard_reasons(pairs, config).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("base").alias("what"), "reason", "n")
    columns = column_sites(kept_bases(reads, config, pick, targets), reference, config, targets, excluded)
    sites = pile_ops.site_discard_reasons(columns, config).groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("site").alias("what"), "reason", "n")
    return told.union(bases).union(sites)


def run_annotation(spark: SparkSession, rna_file: str, dna_file: str, sizes_file: str, homozygous_only: bool = False) -> DataFrame:
    """An RNA table annotated with a DNA table, in the order of the sizes file."""
    out = annotate(tables.read_sites(spark, rna_file), tables.read_sites(spark, dna_file), homozygous_only)
    return sinks.ordered(out, tables.read_sizes(spark, sizes_file))


def run_bed(spark: SparkSession, table_file: str, output: str) -> None:
    """The runs of a table's positions, 1-based inclusive."""
    sinks.write_bed(positions_to_intervals(tables.read_sites(spark, table_file)), output)


def run_coverage(spark: SparkSession, reads_file: str) -> DataFrame:
    """(region, position, depth) of all mapped reads but duplicates, secondary ones and those that failed quality control."""
    reads = load_reads(spark, reads_file).where("region is not null and region <> '*' and cigar is not null and (flag & 1796) = 0")
    return depth(aligned_pairs(reads, "full"))


def run_intervals(spark: SparkSession, config: PileupConfig, size: int) -> DataFrame:
    """The interval plan of a depth file for `size` workers."""
    return greedy_intervals(tables.read_coverage(spark, config.coverage_file), size, region=config.region, exclude_regions=config.exclude_regions)


def dna_config(config: PileupConfig, target_file: str) -> PileupConfig:
    return replace(config, dna=True, target_file=target_file)
