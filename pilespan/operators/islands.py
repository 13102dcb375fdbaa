"""Runs of neighbouring positions and of equal bases, in bins that are joined at their edges.

A chromosome never goes through one task as positions: runs are found in bins, and only the runs that
touch a bin's edge (two a bin) meet in a second step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 16


def join_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open runs (keys, start0, end0, edge) with neighbours of equal keys joined.

    edge: the run may go on in the next bin; only such runs are looked at together.
    """
    inner = runs.where("not edge").select(*keys, "start0", "end0")
    by = Window.partitionBy(*keys).orderBy("start0")
    outer = runs.where("edge").withColumn("_new", (F.col("start0") != F.lag("end0", 1, -1).over(by)).cast("long"))
    outer = outer.withColumn("_run", F.sum("_new").over(by)).groupBy(*keys, "_run").agg(F.min("start0").alias("start0"), F.max("end0").alias("end0"))
    return inner.unionByName(outer.select(*keys, "start0", "end0"))


def positions_to_intervals(positions: DataFrame) -> DataFrame:
    """(region, start, end), 1-based inclusive, of the runs of neighbouring 1-based positions (region, position)."""
    rows = positions.select("region", F.col("position").cast("long").alias("p")).distinct().withColumn("_bin", F.shiftright("p", BIN_BITS))
    by = Window.partitionBy("region", "_bin").orderBy("p")
    runs = rows.withColumn("_run", F.col("p") - F.row_number().over(by)).groupBy("region", "_bin", "_run").agg(F.min("p").alias("start0"), (F.max("p") + 1).alias("end0"))
    size = 1 << BIN_BITS
    runs = runs.withColumn("edge", (F.col("start0") % size == 0) | (F.col("end0") % size == 0))
    return join_runs(runs.select("region", "start0", "end0", "edge"), ["region"]).select("region", F.col("start0").alias("start"), (F.col("end0") - 1).alias("end"))


def homopolymer_runs(chunks: DataFrame, lengths: DataFrame, span: int = 5) -> DataFrame:
    """(region, start0, end0, length, symbol) of runs of one letter, at least `span` long.

    chunks: (region, start0, seq), the reference in pieces; lengths: (region, length). Letters are compared
    in lower case, n included. A run that ends with its chromosome isn't closed by another letter
    and is left out.
    """
    letters = F.regexp_extract_all(F.lower("seq"), F.lit(r"((.)\2*)"), F.lit(1))
    rows = chunks.select("region", F.col("start0").cast("long").alias("_from"), F.length("seq").alias("_size"), letters.alias("_runs"))
    ends = F.aggregate("_runs", F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x))))
    rows = rows.withColumn("_ends", ends).select("region", "_from", "_size", F.posexplode("_runs").alias("_n", "_letters"), "_ends")
    rows = rows.select("region", F.substring("_letters", 1, 1).alias("symbol"), (F.col("_from") + F.get("_ends", F.col("_n"))).alias("start0"), (F.col("_from") + F.get("_ends", F.col("_n") + 1)).alias("end0"), "_from", "_size")
    edge = (F.col("start0") == F.col("_from")) | (F.col("end0") == F.col("_from") + F.col("_size"))
    runs = rows.withColumn("edge", edge).where(edge | (F.col("end0") - F.col("start0") >= span))
    joined = join_runs(runs.select("region", "symbol", "start0", "end0", "edge"), ["region", "symbol"])
    out = joined.where(F.col("end0") - F.col("start0") >= span).join(lengths.select("region", F.col("length").alias("_length")), "region").where("end0 < _length")
    return out.select("region", "start0", "end0", (F.col("end0") - F.col("start0")).alias("length"), "symbol")
