"""Aligned reads: SAM text, BAM through a data source of our own, and canonical Parquet."""

from __future__ import annotations

import gzip
import os
import re
import struct
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Region
from ..operators.reads import with_end

READS = "read_id string, region string, start0 long, flag int, mapq int, cigar string, seq string, quals array<int>, has_sa boolean"


def read_sam(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Reads of a SAM file."""
    return parse_sam(spark.read.text(path), sample)


def parse_sam(lines: DataFrame, sample: str | None = None) -> DataFrame:
    """Reads of SAM lines (value); quality * is null, and so is sequence *. qlen is the sequence's length."""
    lines = lines.where("value <> '' and not startswith(value, '@')")
    f = lambda i: F.get("_f", F.lit(i))
    quals = F.when(f(10) != "*", F.transform(F.split(f(10), ""), lambda c: F.ascii(c) - 33))
    rows = lines.select(F.split("value", "\t").alias("_f")).select(
        F.lit(sample).alias("sample"),
        f(0).alias("read_id"),
        f(2).alias("region"),
        (f(3).try_cast("long") - 1).alias("start0"),
        f(1).try_cast("int").alias("flag"),
        f(4).try_cast("int").alias("mapq"),
        F.when(f(5) != "*", f(5)).alias("cigar"),
        F.when(f(9) != "*", f(9)).alias("seq"),
        F.filter(quals, lambda q: q >= 0).alias("quals"),
        F.exists(F.slice("_f", 12, 1000), lambda t: F.startswith(t, F.lit("SA:"))).alias("has_sa"),
    )
    return rows.withColumn("qlen", F.length("seq"))


def read_bam(spark: SparkSession, path: str, sample: str | None = None, region: Region | None = None, split_bytes: int = 64 << 20) -> DataFrame:
    """Reads of BAM files (comma separated), from local disks or any file system that pyarrow opens.

    A file with an index beside it (.bai) is cut into parts of about split_bytes, which begin at records that the index
    names; of a region only the parts that may hold it are read. A file without index is one task's.
    """
    spark.dataSource.register(BamSource)
    reader = spark.read.format("pilespan_bam").option("split_bytes", split_bytes)
    if region is not None:
        reader = reader.option("region", region.name).option("start", region.start or 1).option("end", region.end or 1 << 40)
    return reader.load(path).withColumn("sample", F.lit(sample)).withColumn("qlen", F.length("seq"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Canonical reads; as write_parquet() stores them a region's filter skips row groups."""
    return spark.read.parquet(path)


def write_parquet(reads: DataFrame, path: str, parts: int = 200) -> None:
    """Store reads sorted by region and start0, with end0, so that both ends of a region skip row groups."""
    rows = with_end(reads).repartitionByRange(parts, "region", "start0").sortWithinPartitions("region", "start0")
    rows.write.mode("overwrite").parquet(path)


class BamSource(DataSource):
    """Spark data source over BAM files."""

    @classmethod
    def name(cls) -> str:
        return "pilespan_bam"

    def schema(self) -> str:
        return READS

    def reader(self, schema) -> DataSourceReader:
        region = (self.options["region"], int(self.options["start"]), int(self.options["end"])) if "region" in self.options else None
        return BamReader(self.options["path"].split(","), int(self.options.get("split_bytes", 64 << 20)), region)


@dataclass
class BamPart(InputPartition):
    """Records of a file from one virtual offset up to another (None: from the first, to the last)."""

    path: str
    first: int | None = None
    stop: int | None = None


class BamReader(DataSourceReader):
    BATCH = 4096

    def __init__(self, paths: list[str], split_bytes: int, region: tuple[str, int, int] | None):
        self.paths, self.split_bytes, self.region = paths, split_bytes, region

    def partitions(self) -> list[InputPartition]:
        return [p for path in self.paths for p in self._parts(path)]

    def _parts(self, path: str) -> list[BamPart]:
        index = next((i for i in (path + ".bai", path.removesuffix(".bam") + ".bai") if exists(i)), None)
        if index is None:
            return [BamPart(path)]
        with open_file(index) as f:
            linear = linear_index(f)
        first = None
        if self.region is not None:
            with open_file(path) as f:
                at = reference_number(read_header(Bgzf(f)), self.region[0])
            if at is None:
                return []
            offsets = linear[at]
            # windows of 2^14 positions; a window without reads of its own has 0, then an earlier one serves
            known = [x for x in offsets[: max(0, self.region[1] - 1 >> 14) + 1] if x]
            first = known[-1] if known else None
            linear = [offsets[: (self.region[2] >> 14) + 1]]
        cuts, last = [], (first or 0) >> 16
        for x in sorted({x for offsets in linear for x in offsets if x and x > (first or 0)}):
            if (x >> 16) - last >= self.split_bytes:
                cuts.append(x)
                last = x >> 16
        edges = [first, *cuts, None]
        return [BamPart(path, a, b) for a, b in zip(edges[:-1], edges[1:])]

    def read(self, part: BamPart):
        with open_file(part.path) as f:
            rows = []
            for row in decode_bam(f, part.first, part.stop, self.region):
                rows.append(row)
                if len(rows) == self.BATCH:
                    yield record_batch(rows)
                    rows = []
            if rows:
                yield record_batch(rows)


def record_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of READS."""
    types = pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.bool_()
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [x.split()[0] for x in READS.split(", ")])


def _file_system(path: str):
    """(file system, path there); local paths may come with or without file:."""
    if path.startswith("file:") or "://" not in path:
        return None, re.sub("^file:(//)?", "", path)
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    system, at = _file_system(path)
    return open(at, "rb") if system is None else system.open_input_file(at)


def exists(path: str) -> bool:
    system, at = _file_system(path)
    return os.path.exists(at) if system is None else system.get_file_info(at).type == fs.FileType.File


def linear_index(f) -> list[list[int]]:
    """For each reference of a .bai index the virtual offsets of the first reads over its windows of 2^14 positions."""
    if f.read(4) != b"BAI\x01":
        raise ValueError("no BAM index")
    number = lambda: struct.unpack("<i", f.read(4))[0]
    out = []
    for _ in range(number()):
        for _ in range(number()):  # bins, with their chunks
            f.read(4)
            f.read(16 * number())
        n = number()
        out.append(list(struct.unpack(f"<{n}Q", f.read(8 * n))))
    return out


class Bgzf:
    """The uncompressed bytes of a BGZF file, with virtual offsets: a block's place << 16 | the place in it.

    Other gzip files are read as one stream from their begin.
    """

    def __init__(self, f):
        self.f, self.block, self.at, self.place, self.following, self.stream = f, b"", 0, 0, 0, None

    def seek(self, offset: int) -> None:
        self.following = offset >> 16
        self._load()
        self.at = offset & 0xFFFF

    def tell(self) -> int:
        return self.place << 16 | self.at if self.at < len(self.block) else self.following << 16

    def _load(self) -> bool:
        """The next block that isn't empty."""
        while True:
            self.f.seek(self.following)
            head = self.f.read(12)
            if len(head) < 12:
                self.block, self.at = b"", 0
                return False
            extra = self.f.read(struct.unpack("<H", head[10:12])[0]) if head[3] & 4 else b""
            size, i = None, 0
            while i + 4 <= len(extra):
                n = struct.unpack_from("<H", extra, i + 2)[0]
                if extra[i : i + 2] == b"BC":
                    size = struct.unpack_from("<H", extra, i + 4)[0] + 1
                i += 4 + n
            if size is None:
                self.f.seek(self.following)
                self.stream = gzip.GzipFile(fileobj=self.f)
                return False
            data = self.f.read(size - 12 - len(extra) - 8)
            self.block, self.at, self.place = zlib.decompress(data, -15), 0, self.following
            self.following += size
            if self.block:
                return True

    def read(self, n: int) -> bytes:
        out = []
        while n and self.stream is None:
            if self.at == len(self.block) and not self._load():
                break
            part = self.block[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        if n and self.stream is not None:
            out.append(self.stream.read(n))
        return b"".join(out)


def read_header(f) -> list[str]:
    """The references' names; f is behind the header then."""
    if f.read(4) != b"BAM\x01":
        raise ValueError("no BAM file")
    f.read(struct.unpack("<i", f.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", f.read(4))[0]):
        names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
        f.read(4)
    return names


def reference_number(names: list[str], name: str) -> int | None:
    """Where a reference is among the names, with or without a leading chr."""
    key = name.removeprefix("chr")
    return next((i for i, n in enumerate(names) if n.removeprefix("chr") == key), None)


#: Letters of packed sequences and of packed operations, in the order of their codes.
SEQUENCE_LETTERS, CIGAR_LETTERS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def decode_bam(f, first: int | None = None, stop: int | None = None, region: tuple[str, int, int] | None = None):
    """Rows of READS from a BAM file, of the records from one virtual offset up to another.

    region: (name, start, end), 1-based; reading ends at the first record past it, as the file is sorted if it has
    an index; records before it may come too.
    """
    f = Bgzf(f)
    names = read_header(f)
    wanted = reference_number(names, region[0]) if region else None
    if first is not None:
        f.seek(first)
    while True:
        if stop is not None and f.tell() >= stop:
            return
        size = f.read(4)
        if not size:
            return
        record = f.read(struct.unpack("<i", size)[0])
        ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", record)
        if first is not None and wanted is not None and (ref != wanted or pos >= region[2]):
            if ref > wanted or ref < 0 or (ref == wanted and pos >= region[2]):
                return
            continue
        at = 32
        name = record[at : at + l_name - 1].decode()
        at += l_name
        ops = struct.unpack_from(f"<{n_cigar}I", record, at)
        at += 4 * n_cigar
        packed = record[at : at + (l_seq + 1) // 2]
        at += (l_seq + 1) // 2
        quals = record[at : at + l_seq]
        at += l_seq
        seq = "".join(SEQUENCE_LETTERS[b >> 4] + SEQUENCE_LETTERS[b & 15] for b in packed)[:l_seq]
        cigar = "".join(f"{op >> 4}{CIGAR_LETTERS[op & 15]}" for op in ops)
        yield name, names[ref] if ref >= 0 else None, pos, flag, mapq, cigar or None, seq or None, None if not l_seq or quals[0] == 255 else list(quals), has_tag(record, at, b"SA")


#: Bytes of a tag's value by its type.
TAG_SIZES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}


def has_tag(record: bytes, at: int, tag: bytes) -> bool:
    """Whether a record's tags, from `at` on, have this one."""
    while at + 3 <= len(record):
        if record[at : at + 2] == tag:
            return True
        kind = record[at + 2 : at + 3]
        at += 3
        if kind in (b"Z", b"H"):
            at = record.index(b"\0", at) + 1
        elif kind == b"B":
            at += 5 + TAG_SIZES[record[at : at + 1]] * struct.unpack_from("<i", record, at + 1)[0]
        else:
            at += TAG_SIZES[kind]
    return False
