"""Connected components by alternating large and small stars, all in DataFrames.

Every round keeps at most one edge for each edge before it, uses only map-side combined minima and
equi-joins (which AQE splits when a node is hot), and is written to the shared folder. The driver
sees one row of checksums a round, never nodes or edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, remove, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or the not larger) neighbours of each node with the least node around it."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least")).select(F.col("u").alias("n"), "m")
    linked = edges.join(least, F.col("u") == F.col("n"))
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of each linked node.

    edges: two long columns u, v; nulls, loops and repeats are dropped. Returns (node, root), one
    row for each node that has an edge, the root itself included; no rows for no edges.
    """
    spark = edges.sparkSession
    now, path = stored(edges.where("u is not null and v is not null and u <> v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).first()
        if state == seen or state["n"] == 0:
            break
        seen, old = state, path
        now, path = stored(_star(_star(now, True), False), "links")
        remove(spark, old)
    passing(path)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
