"""FASTA, as pieces of sequence and as bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE = 4096
#: Lines that a step of read_fasta looks at together.
LINES = 1 << 14


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(region, start0, seq): the lines of a file, or of all files of a folder, with their places; names end at the first white space.

    A line's chromosome is the last header before it in its file, and its place the letters between. Lines are in the
    order of their split's place in the file and of their place in the split, whichever task read them. Running
    values are computed in two steps, over blocks of lines and inside them, so that no task sees a whole file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_n"))
    lines = lines.withColumn("_block", F.floor(F.col("_n") / LINES))
    header = F.startswith("value", F.lit(">"))
    lines = lines.withColumn("_name", F.when(header, F.regexp_extract("value", r"^>\s*(\S*)", 1))).withColumn("_size", F.when(header, F.lit(0)).otherwise(F.length(F.trim("value"))).cast("long"))
    place = ["_file", "_split", "_block"]
    inside = Window.partitionBy(*place).orderBy("_n")
    lines = lines.withColumn("_last", F.last("_name", ignorenulls=True).over(inside)).withColumn("_heads", F.count("_name").over(inside))
    since = Window.partitionBy(*place, "_heads").orderBy("_n")
    lines = lines.withColumn("_upto", F.sum("_size").over(since))
    ends = lines.groupBy(*place).agg(F.max_by("_last", "_n").alias("_b_name"), F.max_by("_upto", "_n").alias("_b_size"), F.max("_heads").alias("_b_heads"))
    order = Window.partitionBy("_file").orderBy("_split", "_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_group", F.sum((F.col("_b_heads") > 0).cast("long")).over(order))
    carry = Window.partitionBy("_file", "_group").orderBy("_split", "_block")
    ends = ends.withColumn("_so_far", F.sum("_b_size").over(carry))
    ends = ends.select(*place, F.last("_b_name", ignorenulls=True).over(before).alias("_name_before"), F.lag("_so_far").over(order).alias("_size_before"))
    rows = lines.join(ends, place)
    first = F.col("_heads") == 0
    start = F.col("_upto") - F.col("_size") + F.when(first, F.coalesce("_size_before", F.lit(0))).otherwise(F.lit(0))
    return rows.where(F.col("_name").isNull() & (F.col("_size") > 0)).select(F.when(first, F.col("_name_before")).otherwise(F.col("_last")).alias("region"), start.alias("start0"), F.trim("value").alias("seq"))


def chunked(bases: DataFrame, piece: int = PIECE) -> DataFrame:
    """(region, start0, seq) from (region, pos0, base): pieces of bounded length."""
    rows = bases.groupBy("region", F.floor(F.col("pos0") / piece).alias("_n")).agg(F.min("pos0").alias("start0"), F.array_sort(F.collect_list(F.struct("pos0", "base"))).alias("_b"))
    return rows.select("region", "start0", F.array_join("_b.base", "").alias("seq"))


def pieces(chunks: DataFrame, piece: int = PIECE) -> DataFrame:
    """(region, piece, seq): pieces of a gapless reference cut at the multiples of `piece`, from pieces of any length.

    Piece n begins with position n * piece, so a position finds its letter by arithmetic.
    """
    first, last = F.floor(F.col("start0") / piece), F.floor((F.col("start0") + F.length("seq") - 1) / piece)
    rows = chunks.where(F.length("seq") > 0).select("region", "start0", "seq", F.explode(F.sequence(first, last)).alias("piece"))
    begin = F.greatest(F.lit(0), F.col("piece") * piece - F.col("start0")).cast("int")
    end = F.least(F.length("seq"), (F.col("piece") + 1) * piece - F.col("start0")).cast("int")
    parts = rows.select("region", "piece", (F.col("start0") + begin).alias("_at"), F.col("seq").substr(begin + 1, end - begin).alias("_part"))
    return parts.groupBy("region", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_part"))), lambda x: x["_part"]), "").alias("seq"))


def reference_bases(chunks: DataFrame) -> DataFrame:
    """(region, pos0, base) from pieces."""
    rows = chunks.select("region", "start0", F.posexplode(F.split("seq", "")).alias("_i", "base"))
    return rows.where("base <> ''").select("region", (F.col("start0") + F.col("_i")).alias("pos0"), "base")


def lengths(chunks: DataFrame) -> DataFrame:
    """(region, length) of the chromosomes in the pieces."""
    return chunks.groupBy("region").agg(F.max(F.col("start0") + F.length("seq")).alias("length"))
