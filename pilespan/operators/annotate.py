"""Annotation of an RNA table with a DNA table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import complement, complement_counts, region_key

DNA_COLUMNS = {"coverage": "g_coverage", "mean_q": "g_mean_q", "base_count": "g_base_count", "all_subs": "g_all_subs", "frequency": "g_frequency"}


def annotate(rna: DataFrame, dna: DataFrame, homozygous_only: bool = False) -> DataFrame:
    """rna with the g_ columns of the DNA site at the same position, null where there is none.

    On a site of strand 0 the DNA's counts and substitutions are complemented, as the RNA's are.
    homozygous_only drops the sites whose DNA site has a substitution.
    """
    by_sample = "sample" in rna.columns and "sample" in dna.columns
    there = dna.select(region_key("region").alias("_key"), F.col("position").alias("_position"), *([F.col("sample").alias("_sample")] if by_sample else []), *[F.col(c).alias(f"_{g}") for c, g in DNA_COLUMNS.items()], F.lit(True).alias("_found"))
    on = (region_key(rna["region"]) == there["_key"]) & (rna["position"] == there["_position"])
    if by_sample:
        on = on & rna["sample"].eqNullSafe(there["_sample"])
    out = rna.drop(*DNA_COLUMNS.values()).join(there, on, "left")
    if homozygous_only:
        out = out.where(F.col("_found").isNull() | (F.size("_g_all_subs") == 0))
    turned = F.col("strand") == "0"
    out = out.withColumn("_g_base_count", F.when(turned, complement_counts("_g_base_count")).otherwise(F.col("_g_base_count")))
    out = out.withColumn("_g_all_subs", F.when(turned, F.transform("_g_all_subs", complement)).otherwise(F.col("_g_all_subs")))
    kept = [c for c in rna.columns if c not in DNA_COLUMNS.values()]
    return out.select(*kept, *[F.col(f"_{g}").alias(g) for g in DNA_COLUMNS.values()])
