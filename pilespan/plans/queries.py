"""The queries over the star schema's tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PileupConfig, Region
from ..operators import bases as base_ops
from ..operators import coverage as cover
from ..operators import pileup as pile_ops
from ..operators import positions as at
from ..operators import reads as read_ops
from ..operators import reports
from ..operators.annotate import annotate
from ..operators.cigar import aligned_pairs, cigar_ops
from ..operators.islands import homopolymer_runs, positions_to_intervals
from ..sources import alignments, sinks
from ..sources.fasta import lengths, pieces, read_fasta
from . import bridge
from .pileups import column_sites, kept_bases, pileup

CONFIG = PileupConfig()
STRANDED = PileupConfig(strand=1)
READ_COLUMNS = ["sample", "read_id", "region", "start0", "flag", "mapq", "cigar", "qlen", "has_sa"]


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return bridge.one_sample(bridge.rna_reads(spark, d))


def _flat(sites: DataFrame) -> DataFrame:
    """Sites with counts and substitutions as plain columns."""
    counts = [F.get("base_count", F.lit(i)).alias(f"n_{b}") for i, b in enumerate("acgt")]
    subs = F.when(F.size("all_subs") > 0, F.array_join("all_subs", " ")).otherwise("-").alias("all_subs")
    return sites.select("sample", "region", "position", "reference", "strand", "coverage", "mean_q", *counts, subs, "frequency", "edits_no")


def _pileup(spark: SparkSession, d: str, config: PileupConfig = CONFIG, **more) -> DataFrame:
    return pileup(_reads(spark, d), bridge.reference_pieces(spark), config, pick=bridge.pick, **more)


def _piled(config: PileupConfig = CONFIG) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _flat(_pileup(spark, d, config))


def _runs(spark: SparkSession) -> DataFrame:
    chunks = bridge.reference_chunks(spark)
    return homopolymer_runs(chunks, lengths(chunks), CONFIG.homopolymer_span)


def _run_positions(spark: SparkSession) -> DataFrame:
    return at.interval_positions(_runs(spark))


def _splice(spark: SparkSession, d: str) -> DataFrame:
    return at.splice_positions(bridge.splice_sites(spark, d), CONFIG.splicing_span)


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return at.target_intervals(bridge.targets(spark, d))


def read_filter_flags(spark: SparkSession, d: str) -> DataFrame:
    return read_ops.filter_reads(_reads(spark, d).withColumn("_sa", F.col("has_sa")).withColumn("has_sa", F.lit(False)), replace(CONFIG, min_read_quality=0, min_read_length=0)).withColumn("has_sa", F.col("_sa")).select(*READ_COLUMNS)


def discard_reasons(spark: SparkSession, d: str) -> DataFrame:
    return read_ops.discard_reasons(_reads(spark, d), CONFIG).groupBy("reason").agg(F.count("*").alias("n_reads"))


TRIMMED = replace(CONFIG, min_base_position=2, max_base_position=3)


def _all_bases(spark: SparkSession, d: str) -> DataFrame:
    return bridge.pick(aligned_pairs(read_ops.filter_reads(_reads(spark, d), CONFIG)))


def base_discard_reasons(spark: SparkSession, d: str) -> DataFrame:
    return base_ops.discard_reasons(_all_bases(spark, d), TRIMMED).groupBy("reason").agg(F.count("*").alias("n_bases"))


def _dna_config() -> PileupConfig:
    return replace(CONFIG, dna=True, target_file="part")


def pileup_dna(spark: SparkSession, d: str) -> DataFrame:
    targets = at.interval_positions(_targets(spark, d))
    return _flat(pileup(bridge.dna_reads(spark, d), bridge.reference_pieces(spark), _dna_config(), targets=targets, pick=bridge.pick))


def _annotated(spark: SparkSession, d: str, homozygous_only: bool) -> DataFrame:
    rna = _pileup(spark, d, STRANDED)
    dna = pileup(bridge.dna_reads(spark, d), bridge.reference_pieces(spark), _dna_config(), pick=bridge.pick)
    out = annotate(rna, dna, homozygous_only)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, " ")).when(F.size(c) == 0, "-")
    counts = [F.get("g_base_count", F.lit(i)).alias(f"g_n_{b}") for i, b in enumerate("acgt")]
    return out.select("region", "position", "reference", "strand", "coverage", text("all_subs").alias("all_subs"), "g_coverage", "g_mean_q", *counts, F.when(F.col("g_coverage").isNotNull(), text("g_all_subs")).alias("g_all_subs"), "g_frequency")


def _depth(spark: SparkSession, d: str) -> DataFrame:
    return cover.depth(aligned_pairs(_reads(spark, d)))


def _fixed(spark: SparkSession) -> DataFrame:
    return cover.fixed_intervals(bridge.sizes(spark), 1000)


def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    reads = _reads(spark, d).select("read_id", "region", "start0", (F.col("start0") + F.col("qlen")).alias("end0"))
    return at.interval_overlap(reads, _targets(spark, d).distinct(), 8)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return pileup(bridge.rna_reads(spark, d), bridge.reference_pieces(spark), STRANDED, pick=bridge.pick)


def sample_runtime(spark: SparkSession, d: str) -> DataFrame:
    orders = bridge.table(spark, d, "orders")
    return reports.runtime_by_sample(orders.select((F.col("o_orderkey") % 4).cast("string").alias("sample"), (F.col("o_custkey") % 60).alias("seconds")))


def ordered_sites(spark: SparkSession, d: str) -> DataFrame:
    """Sites numbered in the order of the output; the number shows the order."""
    rows = sinks.ordered(_pileup(spark, d, replace(CONFIG, strict=True)), bridge.sizes(spark)).select("region", "position")
    sizes = rows.groupBy("region").agg(F.count("*").alias("_n"))
    before = Window.orderBy("region").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("region").orderBy("position")) - 1
    return rows.withColumn("_place", place).join(sizes, "region").select("region", "position", (F.col("_place") + F.col("_before")).cast("long").alias("place"))


def pileup_flagship(spark: SparkSession, d: str) -> DataFrame:
    """Stranded and corrected, off splice sites and homopolymers."""
    return _flat(_pileup(spark, d, replace(STRANDED, strand_correction=True), excluded=(_splice(spark, d), _run_positions(spark))))


def site_discard_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many sites each column rule is the first to drop."""
    config = replace(STRANDED, min_column_quality=33, min_column_length=6, min_edits_per_nucleotide=2, max_editing_nucleotides=2, strict=True)
    kept = kept_bases(_reads(spark, d), config, bridge.pick)
    told = pile_ops.site_discard_reasons(column_sites(kept, bridge.reference_pieces(spark), config), config)
    return told.groupBy("reason").agg(F.count("*").alias("n_sites"))


def pileup_from_files(spark: SparkSession, d: str) -> DataFrame:
    """The reads as SAM files and the reference as FASTA files, written, read again and piled up."""
    sam = bridge.written(bridge.sam_lines(_reads(spark, d)), "sam")
    genome = bridge.written(bridge.fasta_lines(bridge.reference_chunks(spark)), "fasta")
    return _flat(pileup(alignments.read_sam(spark, sam, "all"), pieces(read_fasta(spark, genome)), CONFIG))


def _strands(strand: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _reads(spark, d).select("read_id", "flag", read_ops.read_strand(strand).alias("strand"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_filter_flags": read_filter_flags,
    "read_filter_all": lambda s, d: read_ops.filter_reads(_reads(s, d), CONFIG).select(*READ_COLUMNS),
    "discard_reasons": discard_reasons,
    "base_discard_reasons": base_discard_reasons,
    "cigar_ops": lambda s, d: cigar_ops(_reads(s, d)).select("read_id", "op_index", "op", "op_length"),
    "cigar_aligned_pairs": lambda s, d: aligned_pairs(_reads(s, d)).select("read_id", "region", "pos0", "qpos"),
    "cigar_full_mode": lambda s, d: aligned_pairs(_reads(s, d), "full").select("read_id", "region", "pos0", "qpos"),
    "base_filters": lambda s, d: base_ops.filter_bases(_all_bases(s, d), TRIMMED).select("read_id", "region", "pos0", "qpos", "base", "qual"),
    **{f"read_strand_s{n}": _strands(n) for n in (0, 1, 2)},
    "pileup_basic": _piled(),
    "pileup_strict": _piled(replace(CONFIG, strict=True)),
    "pileup_region": _piled(replace(CONFIG, region=Region("chr2", 1000, 2000))),
    "pileup_full_cigar": _piled(replace(CONFIG, cigar_mode="full")),
    "pileup_trimmed": _piled(replace(CONFIG, min_base_position=5, max_base_position=6)),
    "pileup_stranded": _piled(STRANDED),
    "pileup_first_strand": _piled(replace(CONFIG, strand=2)),
    "pileup_strand_max": _piled(replace(STRANDED, strand_mode="max")),
    "pileup_strand_corrected": _piled(replace(STRANDED, strand_correction=True)),
    "column_min_edits": _piled(replace(STRANDED, min_edits_per_nucleotide=2, min_edits=3)),
    "column_max_changes": _piled(replace(STRANDED, max_editing_nucleotides=2)),
    "column_mean_quality": _piled(replace(CONFIG, min_column_quality=35, min_column_length=5)),
    "pileup_dna": pileup_dna,
    "splice_positions": _splice,
    "pileup_no_splice": lambda s, d: _flat(_pileup(s, d, excluded=(_splice(s, d),))),
    "homopolymer_runs": lambda s, d: _runs(s),
    "pileup_no_homopolymer": lambda s, d: _flat(_pileup(s, d, excluded=(_run_positions(s),))),
    "target_positions": lambda s, d: at.interval_positions(_targets(s, d)),
    "pileup_targets": lambda s, d: _flat(_pileup(s, d, targets=at.interval_positions(_targets(s, d)))),
    "table_to_bed": lambda s, d: positions_to_intervals(_pileup(s, d, replace(CONFIG, strict=True))),
    "annotate_dna": lambda s, d: _annotated(s, d, False),
    "annotate_homozygous": lambda s, d: _annotated(s, d, True),
    "depth": _depth,
    "coverage_weight": lambda s, d: cover.total_weight(_depth(s, d)).select(F.col("total").cast("long").alias("total")),
    "greedy_intervals": lambda s, d: cover.greedy_intervals(_depth(s, d), 16).withColumn("weight", F.col("weight").cast("long")),
    "fixed_intervals": lambda s, d: _fixed(s),
    "interval_overlap_join": interval_overlap_join,
    "multisample_pileup": lambda s, d: _flat(_samples(s, d)),
    "sample_summary": lambda s, d: reports.sample_summary(_samples(s, d)),
    "sample_runtime": sample_runtime,
    "site_table_text": lambda s, d: sinks.table_text(_pileup(s, d, STRANDED)),
    "ordered_sites": ordered_sites,
    "read_distribution": lambda s, d: reports.read_distribution(base_ops.filter_bases(_all_bases(s, d), CONFIG)),
    "site_discard_reasons": site_discard_reasons,
    "remaining_intervals": lambda s, d: reports.remaining(_fixed(s), _fixed(s).where("region = 'chr2'")),
    "substitution_spectrum": lambda s, d: reports.substitution_spectrum(_pileup(s, d, STRANDED)),
    "pileup_from_files": pileup_from_files,
    "pileup_flagship": pileup_flagship,
}
