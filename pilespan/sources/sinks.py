"""Sinks: site tables as text, intervals, ordered Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import counts_text, region_key, two_decimals
from .tables import TABLE_COLUMNS


def table_text(sites: DataFrame) -> DataFrame:
    """The table's 14 columns as text; missing DNA columns are -."""

    def half(prefix: str) -> list:
        if f"{prefix}coverage" not in sites.columns:
            return [F.lit("-")] * 5
        c = {x: F.col(f"{prefix}{x}") for x in ("coverage", "mean_q", "base_count", "all_subs", "frequency")}
        subs = F.when(F.size(c["all_subs"]) > 0, F.array_join(c["all_subs"], " ")).otherwise(F.lit("-"))
        return [F.coalesce(x, F.lit("-")) for x in (c["coverage"].cast("string"), two_decimals(c["mean_q"]), counts_text(c["base_count"]), subs, two_decimals(c["frequency"]))]

    values = ["region", F.col("position").cast("string"), "reference", "strand", *half(""), *half("g_")]
    return sites.select(*[(F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, TABLE_COLUMNS)])


def write_table(sites: DataFrame, path: str, header: bool = True, append: bool = False) -> None:
    """Write the table as tab-separated part files, gzipped if the path ends in gz."""
    writer = table_text(sites).write.mode("append" if append else "overwrite").option("sep", "\t").option("header", header).option("quote", "")
    if path.endswith("gz"):
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_homopolymers(runs: DataFrame, path: str) -> None:
    """Write runs with a # header line in each part."""
    rows = runs.select(F.col("region").alias("#Chromosome"), F.col("start0").alias("Start"), F.col("end0").alias("End"), F.col("length").alias("Length"), F.col("symbol").alias("Symbol"))
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_bed(intervals: DataFrame, path: str) -> None:
    """Write (region, start, end) without header."""
    intervals.select("region", "start", "end").write.mode("overwrite").option("sep", "\t").csv(path)


def write_intervals(intervals: DataFrame, path: str) -> None:
    """Write the interval plan (region, start, end, weight, width, reason)."""
    intervals.select("region", "start", "end", "weight", "width", "reason").write.mode("overwrite").option("sep", "\t").csv(path)


def ordered(sites: DataFrame, sizes: DataFrame) -> DataFrame:
    """sites in the order of the chromosomes' file (region, ord), then by position; unknown ones last."""
    known = sizes.select(region_key("region").alias("_key"), F.col("ord").alias("_ord"))
    return sites.join(known, region_key(sites["region"]) == known["_key"], "left").orderBy(F.col("_ord").asc_nulls_last(), "region", "position").drop("_key", "_ord")


def write_indexed(sites: DataFrame, sizes: DataFrame, path: str, parts: int = 200) -> None:
    """Write sites as Parquet in folders by region, in ranges of position, sorted: a position's filter
    reads a few row groups.
    """
    known = sizes.select(region_key("region").alias("_key"), F.col("ord").alias("_ord"))
    rows = sites.join(known, region_key(sites["region"]) == known["_key"], "left").drop("_key")
    rows = rows.repartitionByRange(parts, "_ord", "position").sortWithinPartitions("_ord", "position").drop("_ord")
    rows.write.mode("overwrite").partitionBy("region").parquet(path)
