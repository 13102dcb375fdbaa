"""What the text operators share: work tables in the cluster's shared folder, and batch helpers.

Work tables are Parquet under the folder that ``spark.checkpoint.dir`` names, so that any executor
can be lost without losing them. Only in local mode (tests, a laptop), where driver and executors are one
process, may that setting be absent; then a folder below the warehouse is taken.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a filter that goes to all tasks: its size is the same however many keys there are.
FILTER_BITS = 1 << 26
#: Bytes of an Arrow batch, about: a batch of long texts stays small, one of short rows has many.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/work").rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches handed to Python small, as texts may be long, unless the session says how large they are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def work_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/pilespan-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write df as a work table; the table read again, and its path."""
    path = work_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, what: str) -> DataFrame:
    """df with its lineage cut: what made it isn't run again when an executor is lost.

    Inside of scratch() the table goes when that ends.
    """
    out, path = stored(df, what)
    passing(path)
    return out


#: The innermost scratch() that is open.
_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def passing(path: str) -> None:
    """Let a work table go with the scratch() that is open."""
    if (work := _scratch.get()) is not None:
        work.paths.append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """The work tables made inside; all but last()'s are removed at the end."""
    work = Scratch(spark)
    token = _scratch.set(work)
    try:
        yield work
    finally:
        _scratch.reset(token)
        work.clear()
        if work.kept:
            passing(work.kept)  # it goes with the call around this one


class Scratch:
    """The work tables of one call."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables, self.kept = spark, [], [], None

    def bucketed(self, df: DataFrame, what: str, key: str, n: int) -> DataFrame:
        """df as a work table in n buckets by key: joins on it with other such tables don't shuffle.

        Rows lie in row groups of a few MB, so that rows with large values are read a few at a time.
        """
        path = work_path(self.spark, what)
        name = "pilespan_" + path.rsplit("-", 1)[1]
        small = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "compression": "zstd", "path": path}
        df.write.bucketBy(n, key).options(**small).saveAsTable(name)
        self.paths.append(path)
        self.tables.append(name)
        return self.spark.table(name)

    def last(self, df: DataFrame, what: str) -> DataFrame:
        """df stored as the call's result, which rests on no other work table."""
        out, self.kept = stored(df, what)
        return out

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            remove(self.spark, path)
        self.paths, self.tables = [], []


def mix64(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers, each as its length, its width and its bytes by significance.

    Zeros in the high bytes are left out or lie together, so small values compress well.
    """
    out = []
    for x in columns:
        x = np.ascontiguousarray(x, dtype="<u8")
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        planes = x.view(np.uint8).reshape(-1, 8)[:, :width]
        out += [len(x).to_bytes(8, "little"), bytes([width]), np.ascontiguousarray(planes.T).tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    """The columns that packed() was given."""
    raw, out, at = np.frombuffer(data, dtype=np.uint8), [], 0
    while at < len(raw):
        n, width = int.from_bytes(raw[at : at + 8].tobytes(), "little"), int(raw[at + 8])
        at += 9
        x = np.zeros((n, 8), dtype=np.uint8)
        if width:
            x[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(x.view("<u8").ravel())
        at += n * width
    return out


def map_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow with a function from one batch to one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is None or out.num_rows == 0:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out.combine_chunks().to_batches()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 texts of a batch, null as empty."""
    for x in batch.column(column):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever else df has (names in other case included)."""
    return df.toDF(*[n if n in names else f"_other{i}" for i, n in enumerate(df.columns)]).select(*names)


def shield(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with all columns but these renamed, so that no name clashes with an operator's own; its old names."""
    return df.toDF(*[n if n in names else f"c{i}" for i, n in enumerate(df.columns)]), df.columns


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among keys, rows whose key surely isn't).

    keys: one long column. A bit filter of fixed size decides; where it fills up, more rows may be among the
    keys, and what is done with them stays right.
    """
    bit = F.pmod(keys.columns[0], F.lit(FILTER_BITS))
    blocks = keys.select((bit / 32768).cast("int").alias("_block"), (bit % 32768).alias("bit")).groupBy("_block").agg(F.bitmap_construct_agg("bit").alias("_bits"))
    blocks = F.broadcast(cut(blocks, "filter"))  # FILTER_BITS / 8 bytes at most
    at = F.pmod(key, F.lit(FILTER_BITS))
    told = df.withColumns({"_block": (at / 32768).cast("int"), "_bit": (at % 32768).cast("int")}).join(blocks, "_block", "left")
    maybe = F.expr("coalesce(cast(conv(hex(substring(_bits, shiftright(_bit, 3) + 1, 1)), 16, 10) as int) & shiftleft(1, _bit & 7), 0) <> 0")
    return told.where(maybe).select(*df.columns), told.where(~maybe).select(*df.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text) -> Column:
    """Words of a text column, 0 for null: each word becomes one sign, and white space goes."""
    signs = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(signs), F.lit(0)).cast("long")
