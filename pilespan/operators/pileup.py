"""Bases to sites: one shuffle, then arithmetic inside a row.

Bases are summed by position, letter and strand as ten conditional sums, so depth shrinks before the
shuffle. The reference base joins the sums, not the bases; strand vote, complement, correction,
substitutions and filters are expressions on the sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PileupConfig
from ..functions.scalars import BASES, complement, complement_counts, region_key, safe_share
from ..sources.fasta import PIECE

KEYS = ["sample", "region", "pos0"]


def sum_bases(bases: DataFrame, strand: Column, keys: list[str] = KEYS) -> DataFrame:
    """Counts and quality sums by position: n_<base>_plus, n_<base>_rest, q_plus, q_rest, and n_minus.

    rest holds what isn't on the plus strand (the minus strand, or everything for DNA).
    """
    plus = F.col("_strand") == "+"
    base = F.upper("base")
    sums = [F.count_if((base == b) & (plus if side == "plus" else ~plus)).alias(f"n_{b}_{side}") for side in ("plus", "rest") for b in BASES]
    quality = [F.sum(F.when(plus if side == "plus" else ~plus, F.col("qual")).otherwise(0)).cast("long").alias(f"q_{side}") for side in ("plus", "rest")]
    minus = F.count_if(F.col("_strand") == "-").alias("n_minus")
    return bases.withColumn("_strand", strand).groupBy(*keys).agg(*sums, *quality, minus)


def with_reference(sums: DataFrame, reference: DataFrame) -> DataFrame:
    """sums with column ref, upper case; positions without a base A, C, G or T there go.

    reference: bases (region, pos0, base), or the aligned pieces (region, piece, seq) of a genome, which travel as a row for
    thousands of bases.
    """
    if "seq" in reference.columns:
        known = reference.select(region_key("region").alias("_key"), F.col("piece").alias("_piece"), "seq")
        out = sums.join(known, (region_key(sums["region"]) == known["_key"]) & (F.floor(sums["pos0"] / PIECE) == known["_piece"]))
        base = F.upper(F.col("seq").substr((F.col("pos0") % PIECE + 1).cast("int"), F.lit(1)))
        return out.withColumn("ref", base).where(F.col("ref").isin(*BASES)).drop("_key", "_piece", "seq")
    known = reference.select(region_key("region").alias("_key"), F.col("pos0").alias("_pos0"), F.upper("base").alias("ref")).where(F.col("ref").isin(*BASES))
    return sums.join(known, (region_key(sums["region"]) == known["_key"]) & (sums["pos0"] == known["_pos0"])).drop("_key", "_pos0")


def strand_vote(plus: Column, minus: Column, config: PileupConfig) -> Column:
    """+, - or * from the counts of both strands."""
    if config.strand_mode == "max":
        return F.when(plus + minus == 0, "*").when(plus >= minus, "+").otherwise("-")
    share = lambda x: safe_share(x, plus + minus)
    return F.when(plus + minus == 0, "*").when(share(plus) >= config.strand_threshold, "+").when(share(minus) >= config.strand_threshold, "-").otherwise("*")


def sites(sums: DataFrame, config: PileupConfig, keys: list[str] = KEYS) -> DataFrame:
    """Sites with all columns of the table but the DNA ones, and edits_no; no site is filtered yet."""
    plus = F.array(*[F.col(f"n_{b}_plus") for b in BASES])
    rest = F.array(*[F.col(f"n_{b}_rest") for b in BASES])
    both = F.zip_with(plus, rest, lambda x, y: x + y)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    place = F.instr(F.lit(BASES), F.col("ref"))
    out = sums.withColumn("edits_no", total(both) - F.element_at(both, place))
    if config.dna:
        out = out.withColumn("strand", F.lit("*"))
    elif config.strand == 0:
        out = out.withColumn("strand", F.lit("2"))
    else:
        vote = strand_vote(total(plus), F.col("n_minus"), config)
        out = out.withColumn("strand", F.when(vote == "+", "1").when(vote == "-", "0").otherwise("2"))
    counts, quality = both, F.col("q_plus") + F.col("q_rest")
    if config.strand_correction and not config.dna:
        counts = F.when(F.col("strand") == "1", plus).when(F.col("strand") == "0", rest).otherwise(both)
        quality = F.when(F.col("strand") == "1", F.col("q_plus")).when(F.col("strand") == "0", F.col("q_rest")).otherwise(quality)
    out = out.withColumn("_counts", counts).withColumn("_quality", quality)
    turned = F.col("strand") == "0"
    out = out.withColumn("reference", F.when(turned, complement("ref")).otherwise(F.col("ref")))
    out = out.withColumn("base_count", F.when(turned, complement_counts("_counts")).otherwise(F.col("_counts")))
    out = out.withColumn("coverage", total("base_count")).withColumn("mean_q", safe_share(F.col("_quality"), F.col("coverage")))
    return with_substitutions(out).select(*keys, (F.col("pos0") + 1).alias("position"), "reference", "strand", "coverage", "mean_q", "base_count", "all_subs", "frequency", "edits_no", "_alts", "_ref_count").where("coverage > 0")


def with_substitutions(df: DataFrame) -> DataFrame:
    """df (reference, base_count) with all_subs, frequency and what the column filters read.

    Substitutions come by count, the most frequent first, then by letter. Frequency is that of the first
    against the reference.
    """
    place = F.instr(F.lit(BASES), F.col("reference"))
    pairs = F.filter(F.transform(F.array(*map(F.lit, BASES)), lambda b, i: F.struct((-F.get("base_count", i)).alias("less"), b.alias("base"))), lambda x: (x["less"] < 0) & (x["base"] != F.col("reference")))
    df = df.withColumn("_alts", F.array_sort(pairs)).withColumn("_ref_count", F.element_at("base_count", place))
    top = -F.get("_alts", F.lit(0))["less"]
    df = df.withColumn("all_subs", F.transform("_alts", lambda x: F.concat(F.col("reference"), x["base"])))
    return df.withColumn("frequency", F.coalesce(top / (top + F.col("_ref_count")), F.lit(0.0)))


def column_rules(config: PileupConfig) -> list[tuple[str, Column]]:
    """(reason, condition to keep) of sites, in order."""
    rules = [
        ("mean quality", F.col("mean_q") >= config.column_quality),
        ("column length", F.col("coverage") >= config.min_column_length),
        ("edits per nucleotide", ~F.exists("_alts", lambda x: -x["less"] < config.min_edits_per_nucleotide)),
        ("changes", F.size("_alts") + (F.col("_ref_count") > 0).cast("int") <= config.max_editing_nucleotides),
        ("edits", F.col("edits_no") >= config.min_edits),
    ]
    return [*rules, ("no edits", F.size("_alts") > 0)] if config.strict else rules


def filter_columns(rows: DataFrame, config: PileupConfig) -> DataFrame:
    """The sites that every rule keeps, without the columns that only rules read."""
    keep = F.lit(True)
    for _, rule in column_rules(config):
        keep = keep & rule
    return rows.where(keep).drop("_alts", "_ref_count")


def site_discard_reasons(rows: DataFrame, config: PileupConfig) -> DataFrame:
    """Sites with column reason, null for a site that is kept."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(column_rules(config)):
        reason = F.when(~rule, name).otherwise(reason)
    return rows.withColumn("reason", reason).drop("_alts", "_ref_count")
