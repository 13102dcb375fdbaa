"""From alignments to aligned bases: the CIGAR walk inside a row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that move along the reference and along the read.
ON_REFERENCE, ON_READ = ("M", "D", "N"), ("M", "I", "S")


def tokens(cigar: Column | str = "cigar") -> Column:
    """array<string> of length and operation."""
    return F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))


def cigar_ops(reads: DataFrame) -> DataFrame:
    """A row for each operation: reads' columns, op_index (from 0), op and op_length."""
    rows = reads.select("*", F.posexplode(tokens()).alias("op_index", "_token"))
    return rows.withColumn("op", F.substring("_token", -1, 1)).withColumn("op_length", F.regexp_extract("_token", "[0-9]+", 0).cast("long")).drop("_token")


def blocks(mode: str = "compat") -> Column:
    """array<struct<pos0, qpos, length>> of a read's aligned blocks.

    compat: nothing is aligned from the first H, P, = or X on. full: = and X are aligned like M, and H
    and P move along neither side.
    """
    full = mode == "full"
    aligned = ["M", "=", "X"] if full else ["M"]
    ref, query = [*ON_REFERENCE, *(["=", "X"] if full else [])], [*ON_READ, *(["=", "X"] if full else [])]
    kind = "array<struct<pos0:bigint,qpos:bigint,length:bigint>>"
    start = F.struct(F.col("start0").cast("long").alias("pos0"), F.lit(0).cast("long").alias("qpos"), F.lit(True).alias("on"), F.array().cast(kind).alias("done"))

    def step(s, token):
        op, n = F.substring(token, -1, 1), F.regexp_extract(token, "[0-9]+", 0).cast("long")
        on = s["on"] if full else s["on"] & ~op.isin("H", "P", "=", "X")
        block = F.array(F.struct(s["pos0"].alias("pos0"), s["qpos"].alias("qpos"), n.alias("length")))
        return F.struct(
            (s["pos0"] + F.when(op.isin(*ref), n).otherwise(F.lit(0))).alias("pos0"),
            (s["qpos"] + F.when(op.isin(*query), n).otherwise(F.lit(0))).alias("qpos"),
            on.alias("on"),
            F.when(on & op.isin(*aligned) & (n > 0), F.concat(s["done"], block)).otherwise(s["done"]).alias("done"),
        )

    return F.aggregate(tokens(), start, step, lambda s: s["done"])


def aligned_pairs(reads: DataFrame, mode: str = "compat") -> DataFrame:
    """A row for each aligned base: reads' columns, pos0 (on the reference) and qpos (in the read)."""
    rows = reads.select("*", F.explode(blocks(mode)).alias("_block"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_block.length") - 1)).alias("_step"))
    return rows.withColumn("pos0", F.col("_block.pos0") + F.col("_step")).withColumn("qpos", F.col("_block.qpos") + F.col("_step")).drop("_block", "_step")


def pick_bases(pairs: DataFrame) -> DataFrame:
    """pairs with base and qual from seq and quals; a missing quality is 30."""
    at = (F.col("qpos") + 1).cast("int")
    qual = F.coalesce(F.get(F.col("quals"), F.col("qpos").cast("int")), F.lit(30))
    return pairs.withColumn("base", F.upper(F.col("seq").substr(at, F.lit(1)))).withColumn("qual", qual.cast("int")).drop("seq", "quals")
