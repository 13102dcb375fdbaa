"""Text sources: chromosome sizes, targets, homopolymers, splice sites, depth, sample lists, site tables.

Files may be gzipped. All are read as text columns and cast here, so a bad line is a null, not a crash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_counts, stem
from ..operators.positions import target_intervals

TABLE_COLUMNS = ["Region", "Position", "Reference", "Strand", "Coverage-q30", "MeanQ", "BaseCount[A,C,G,T]", "AllSubs", "Frequency", "gCoverage-q30", "gMeanQ", "gBaseCount[A,C,G,T]", "gAllSubs", "gFrequency"]


def split_lines(spark: SparkSession, path: str, pattern: str, n: int) -> DataFrame:
    """Columns c0 to c<n-1> of a text file's lines; missing fields are null."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    fields = F.split(F.trim("value") if pattern != "\t" else F.col("value"), pattern)
    return lines.select(fields.alias("_f")).select(*[F.get("_f", F.lit(i)).alias(f"c{i}") for i in range(n)])


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(region, length, ord) of an index or sizes file; a repeated name counts once, at its first line."""
    lines = spark.read.text(path).where("trim(value) <> ''").withColumn("_line", F.monotonically_increasing_id())
    fields = F.split("value", "\t")
    rows = lines.groupBy(F.get(fields, F.lit(0)).alias("region")).agg(F.min_by(F.get(fields, F.lit(1)), "_line").alias("_length"), F.min("_line").alias("_line"))
    return rows.select("region", F.expr("try_cast(_length as bigint)").alias("length"), (F.row_number().over(Window.orderBy("_line")) - 1).alias("ord"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """(region, start0, end0) of a target file, 1-based inclusive; a site table serves as well."""
    rows = split_lines(spark, path, "\t", 3)
    return target_intervals(rows.select(F.col("c0").alias("region"), F.col("c1").alias("start"), F.col("c2").alias("end")))


def read_homopolymers(spark: SparkSession, path: str) -> DataFrame:
    """(region, start0, end0, length, symbol) of a homopolymer file; lines with # are left out."""
    rows = split_lines(spark, path, "\t", 5).where("not startswith(c0, '#')")
    return rows.selectExpr("c0 as region", "try_cast(c1 as bigint) as start0", "try_cast(c2 as bigint) as end0", "try_cast(c3 as bigint) as length", "c4 as symbol").where("start0 is not null and end0 is not null")


def read_splice_sites(spark: SparkSession, path: str) -> DataFrame:
    """(region, coordinate, kind, strand) of a splice file, separated by white space."""
    rows = split_lines(spark, path, r"\s+", 5)
    return rows.selectExpr("c0 as region", "try_cast(c1 as bigint) as coordinate", "c3 as kind", "c4 as strand").where("coordinate is not null")


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(region, position, depth) of a depth file, 1-based; depth 0 is left out."""
    rows = split_lines(spark, path, "\t", 3)
    return rows.selectExpr("c0 as region", "try_cast(c1 as bigint) as position", "try_cast(c2 as bigint) as depth").where("position is not null and depth > 0")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample, path): one path a line; the sample is the file's name without its extension."""
    rows = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    return rows.select(stem("path").alias("sample"), "path")


def parse_sites(rows: DataFrame) -> DataFrame:
    """Sites from the table's 14 text columns c0 to c13; a header row is left out, - is null or no substitution."""
    rows = rows.where("c0 <> 'Region'")

    def half(first: int, prefix: str) -> list:
        c = [f"c{first + i}" for i in range(5)]
        subs = F.when((F.col(c[3]) == "-") & (F.lit(prefix == "") | (F.col(c[0]) != "-")), F.array().cast("array<string>")).when(F.col(c[3]) != "-", F.split(c[3], " "))
        return [F.expr(f"try_cast({c[0]} as bigint)").alias(f"{prefix}coverage"), F.expr(f"try_cast({c[1]} as double)").alias(f"{prefix}mean_q"), F.when(F.col(c[2]) != "-", parse_counts(c[2])).alias(f"{prefix}base_count"), subs.alias(f"{prefix}all_subs"), F.expr(f"try_cast({c[4]} as double)").alias(f"{prefix}frequency")]

    return rows.select(F.col("c0").alias("region"), F.expr("try_cast(c1 as bigint)").alias("position"), F.col("c2").alias("reference"), F.col("c3").alias("strand"), *half(4, ""), *half(9, "g_"))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A site table, with or without header."""
    return parse_sites(split_lines(spark, path, "\t", 14))
