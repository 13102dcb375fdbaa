"""Reads, a reference and position sets worked out from the star schema's tables.

Whole-number arithmetic, so that any SQL engine gets the same rows; see FIXTURES.md, part B.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cigar import blocks
from ..sources.fasta import chunked, pieces

#: CIGARs by read id modulo 11.
CIGARS = ("40M", "5S35M", "20M3D20M", "15M2I23M", "18M50N22M", "3H37M", "38M2S", "10M2X28M", "25M", "1S12M1D10M2I15M", "36M4S")
REFERENCE_LENGTH, CHROMOSOMES = 5120, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores: a small file is one partition, and every read becomes dozens of bases.

    Input of at least as many partitions as cores stays as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def make_reads(rows: DataFrame) -> DataFrame:
    """Reads from rows (k, c): one read a row."""
    k, c = F.col("k"), F.col("c")
    out = rows.withColumn("rno", F.lit(1) + c % 3).withColumn("start0", (37 * k + 11 * c) % 5000)
    third = F.floor(F.col("start0") / 500) % 3
    flag = F.when(k % 20 == 0, 0).when(k % 20 == 1, 16).when(k % 20 == 2, 77).when(k % 20 == 3, 512).when(k % 20 == 4, 256).when(k % 20 == 5, 2048).when(k % 20 == 6, 1024).when(k % 20 == 7, 65)
    flag = flag.when(third == 0, F.when(k % 20 == 19, 83).when(k % 2 == 0, 99).otherwise(147))
    flag = flag.when(third == 1, F.when(k % 20 == 19, 99).when(k % 2 == 0, 83).otherwise(163))
    flag = flag.otherwise(F.when(k % 4 == 0, 99).when(k % 4 == 1, 147).when(k % 4 == 2, 83).otherwise(163))
    cigar = F.element_at(F.array(*map(F.lit, CIGARS)), (k % 11 + 1).cast("int"))
    return out.select(
        (k % 4).cast("string").alias("sample"),
        k.alias("read_id"),
        "c",
        "rno",
        F.concat(F.lit("chr"), F.col("rno").cast("string")).alias("region"),
        "start0",
        flag.cast("int").alias("flag"),
        (10 + c % 51).cast("int").alias("mapq"),
        cigar.alias("cigar"),
        F.when(k % 11 == 5, 37).when(k % 11 == 8, 25).otherwise(40).cast("long").alias("qlen"),
        (k % 97 == 0).alias("has_sa"),
    )


def rna_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read an order, samples by order key."""
    return make_reads(spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))))


def one_sample(reads: DataFrame) -> DataFrame:
    """The same reads as one sample."""
    return reads.withColumn("sample", F.lit("all"))


def dna_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read an event."""
    return one_sample(make_reads(spread(table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("user_id").alias("c")))))


def reference_base(rno: Column, pos0: Column) -> Column:
    letter = (pos0 * pos0 + 3 * pos0 + 7 * rno + F.floor(pos0 / 5)) % 4 + 1
    return F.when(pos0 % 997 == 0, "N").when((pos0 % 211).between(100, 106), "A").otherwise(F.substring(F.lit("ACGT"), letter.cast("int"), F.lit(1)))


def reference(spark: SparkSession) -> DataFrame:
    """(region, pos0, base) of three chromosomes."""
    rows = spark.range(CHROMOSOMES * REFERENCE_LENGTH).select((F.floor(F.col("id") / REFERENCE_LENGTH) + 1).alias("rno"), (F.col("id") % REFERENCE_LENGTH).alias("pos0"))
    return rows.select(F.concat(F.lit("chr"), F.col("rno").cast("string")).alias("region"), "pos0", reference_base(F.col("rno"), F.col("pos0")).alias("base"))


def reference_chunks(spark: SparkSession) -> DataFrame:
    return chunked(reference(spark), 1000)


def reference_pieces(spark: SparkSession) -> DataFrame:
    """(region, piece, seq): the same in the pieces that sums are joined with."""
    return pieces(reference_chunks(spark))


def sizes(spark: SparkSession) -> DataFrame:
    """(region, length, ord)."""
    return spark.range(CHROMOSOMES).select(F.concat(F.lit("chr"), (F.col("id") + 1).cast("string")).alias("region"), F.lit(REFERENCE_LENGTH).cast("long").alias("length"), F.col("id").cast("int").alias("ord"))


def read_letter(read_id: Column, rno: Column, pos0: Column) -> Column:
    """The letter that a read has at a position.

    Letters are numbered A, C, G, T; a transition changes the number's second bit, the other change its first.
    """
    letter = F.when((pos0 % 211).between(100, 106), 0).otherwise((pos0 * pos0 + 3 * pos0 + 7 * rno + F.call_function("div", pos0, F.lit(5))) % 4)
    change = F.when((13 * read_id + 17 * pos0) % 29 == 0, 2).when((5 * read_id + 3 * pos0) % 211 == 0, 1).otherwise(0)
    letters = F.array(*map(F.lit, "ACGT"))
    return F.when(((read_id + pos0) % 503 == 0) | (pos0 % 997 == 0), "N").otherwise(F.get(letters, letter.bitwiseXOR(change).cast("int")))


def read_quality(read_id: Column, c: Column, qpos: Column) -> Column:
    return 24 + (3 * read_id + 7 * qpos + c) % 17


def pick(pairs: DataFrame) -> DataFrame:
    """pairs (read_id, c, rno, pos0, qpos) with base and qual."""
    base = read_letter(F.col("read_id"), F.col("rno"), F.col("pos0"))
    return pairs.withColumn("base", base).withColumn("qual", read_quality(F.col("read_id"), F.col("c"), F.col("qpos")).cast("int"))


def splice_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, coordinate, kind, strand), one a part; every tenth position, so that most positions lie off all of them."""
    k = F.col("p_partkey")
    donor, even = k % 4 < 2, k % 2 == 0
    rows = table(spark, sf_dir, "part")
    return rows.select(F.concat(F.lit("chr"), (1 + k % 3).cast("string")).alias("region"), ((k * 7) % 500 * 10).alias("coordinate"), F.when(donor, "D").otherwise("A").alias("kind"), F.when(donor == even, "+").otherwise("-").alias("strand"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, start, end) as text, 1-based inclusive, one a part, on chr1 and chr2 only; some without an end."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part")
    start = (k * 13) % 100 * 50 + 1
    return rows.select(F.concat(F.lit("chr"), (1 + k % 2).cast("string")).alias("region"), start.cast("string").alias("start"), F.when(k % 3 != 0, (start + k % 20).cast("string")).alias("end"))


def sam_lines(reads: DataFrame) -> DataFrame:
    """(value): the reads as SAM text, with their bases and qualities; a base that isn't aligned is A.

    A line is put together inside its row, so reads meet no others: it takes no shuffle, and reads may share an id.
    """
    k = F.col("read_id")

    def longer(seq: Column, block: Column) -> Column:
        places = F.sequence(block["pos0"], block["pos0"] + block["length"] - 1)
        letters = F.transform(places, lambda p: read_letter(k, F.col("rno"), p))
        return F.concat(F.rpad(seq, block["qpos"].cast("int"), F.lit("A")), F.array_join(letters, ""))

    aligned = F.coalesce(F.aggregate(blocks(), F.lit(""), longer), F.lit(""))
    seq = F.rpad(aligned, F.col("qlen").cast("int"), F.lit("A"))
    places = F.sequence(F.lit(0).cast("long"), F.col("qlen") - 1)
    quals = F.array_join(F.transform(places, lambda i: F.char(33 + read_quality(k, F.col("c"), i))), "")
    fields = [k, F.col("flag"), F.col("region"), F.col("start0") + 1, F.col("mapq"), F.col("cigar"), F.lit("*"), F.lit(0), F.lit(0), seq, quals]
    return reads.select(F.concat_ws("\t", *[f.cast("string") for f in fields], F.when(F.col("has_sa"), "SA:Z:chr1,1,+,40M,60,0;")).alias("value"))


def fasta_lines(chunks: DataFrame) -> DataFrame:
    """(value): pieces of sequence (region, start0, seq) as the lines of a FASTA file, one task a chromosome."""
    heads = chunks.select("region").distinct().select("region", F.lit(-1).cast("long").alias("start0"), F.concat(F.lit(">"), "region", F.lit(" made up")).alias("value"))
    lines = chunks.select("region", F.col("start0").cast("long").alias("start0"), F.col("seq").alias("value"))
    return heads.union(lines).repartition("region").sortWithinPartitions("region", "start0").select("value")


def written(lines: DataFrame, what: str) -> str:
    """Write lines as text files in the folder that driver and executors share; their path."""
    spark = lines.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work"
    path = f"{shared.rstrip('/')}/pilespan-{what}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path
