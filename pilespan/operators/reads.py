"""Predicates on aligned reads, and the strand a read speaks for.

Reads are rows with sample, read_id, region, start0, flag, mapq, cigar, qlen (or seq) and has_sa.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PileupConfig, Region
from ..functions.scalars import bit
from .cigar import tokens

#: Flags of pairs in which neither read is mapped, and of properly paired reads.
UNMAPPED_PAIR, PROPER_PAIR = (77, 141), (99, 147, 83, 163)


def read_rules(config: PileupConfig, length: str = "qlen") -> list[tuple[str, Column]]:
    """(reason, condition to keep), in the order in which a read is told why it goes."""
    return [
        ("unmapped pair", ~F.col("flag").isin(*UNMAPPED_PAIR)),
        ("failed quality control", ~bit("flag", 512)),
        ("mapping quality", F.col("mapq") >= config.min_read_quality),
        ("read length", F.col(length) >= config.min_read_length),
        ("secondary or supplementary", ~bit("flag", 256 | 2048)),
        ("duplicate", ~bit("flag", 1024)),
        ("improper pair", ~bit("flag", 1) | F.col("flag").isin(*PROPER_PAIR)),
        ("chimeric", ~F.coalesce("has_sa", F.lit(False))),
        ("no alignment", F.col("cigar").isNotNull() & (F.col("cigar") != "*")),
    ]


def filter_reads(reads: DataFrame, config: PileupConfig, length: str = "qlen") -> DataFrame:
    """The reads that every rule keeps; one conjunction, so that all of it reaches the scan."""
    keep = F.lit(True)
    for _, rule in read_rules(config, length):
        keep = keep & rule
    return reads.where(keep)


def discard_reasons(reads: DataFrame, config: PileupConfig, length: str = "qlen") -> DataFrame:
    """reads with column reason: the first rule against a read, null for a read that is kept."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(read_rules(config, length)):
        reason = F.when(~rule, name).otherwise(reason)
    return reads.withColumn("reason", reason)


def read_strand(strand: int, dna: bool = False) -> Column:
    """+ or - for a read of a library of this strandedness; * for DNA.

    Second-strand libraries (1) have read 1 on the transcript's own strand, first-strand ones (2) read 2.
    """
    if dna:
        return F.lit("*")
    second = bit("flag", 128)
    turned = F.when(second, F.lit(strand == 2)).otherwise(F.lit(strand == 1))
    return F.when(bit("flag", 16) == turned, "-").otherwise("+")


def with_end(reads: DataFrame) -> DataFrame:
    """reads with column end0, past the last position of the reference that they span (start0 without an alignment)."""
    span = F.aggregate(tokens(), F.lit(0).cast("long"), lambda s, t: s + F.when(F.substring(t, -1, 1).isin("M", "D", "N", "=", "X"), F.regexp_extract(t, "[0-9]+", 0).cast("long")).otherwise(F.lit(0)))
    return reads.withColumn("end0", F.col("start0") + F.coalesce(span, F.lit(0)))


def fetch(reads: DataFrame, region: Region | None) -> DataFrame:
    """Reads of a region; all of a position's reads, so a part's counts are those of the whole.

    All conditions are on plain columns, so that they reach the scan: with end0 stored (see with_end) both ends of the
    region skip row groups.
    """
    if region is None:
        return reads
    name = region.name.removeprefix("chr")
    out = reads.where(F.col("region").isin(name, "chr" + name))
    if region.end is None:
        return out
    out = out.where(F.col("start0") < region.end)
    return out.where(F.col("end0") >= region.start) if "end0" in reads.columns else out
