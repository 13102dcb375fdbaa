"""Predicates on aligned bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PileupConfig


def base_rules(config: PileupConfig, length: str = "qlen") -> list[tuple[str, Column]]:
    """(reason, condition to keep) in order."""
    return [
        ("min base position", F.col("qpos") >= config.min_base_position),
        ("max base position", F.col(length) - F.col("qpos") >= config.max_base_position),
        ("base quality", F.col("qual") >= config.min_base_quality),
        ("no base", F.upper("base").isin("A", "C", "G", "T")),
    ]


def filter_bases(bases: DataFrame, config: PileupConfig, length: str = "qlen") -> DataFrame:
    """The bases that every rule keeps. Letters other than A, C, G and T count nowhere."""
    keep = F.lit(True)
    for _, rule in base_rules(config, length):
        keep = keep & rule
    return bases.where(keep)


def discard_reasons(bases: DataFrame, config: PileupConfig, length: str = "qlen") -> DataFrame:
    """bases with column reason, null for a base that is kept."""
    reason = F.lit(None).cast("string")
    for name, rule in reversed(base_rules(config, length)):
        reason = F.when(~rule, name).otherwise(reason)
    return bases.withColumn("reason", reason)
