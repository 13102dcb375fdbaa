"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code. A fingerprint is replicated to the anchors that cover
some point within half the threshold of it; all of these lie within covering radius plus threshold.
Two fingerprints at most `threshold` bits apart have a point between them within that reach of both, so
they meet at the point's anchor and are compared there. An anchor with few fingerprints compares all of
them. An anchor with many is split by the points themselves: the fingerprints that share a point
are linked with the least of them, so no anchor makes pairs in the square of its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, map_batches, only, scratch, small_batches, texts_of
from .components import components
from .covering import covering

#: Anchors with more fingerprints than this are split by their points.
CROWD = 64
BLOCKS = ("golay", "golay", "hamming")


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle of a text, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), dtype=np.uint64, count=len(words) - k + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half the rows of an array of 64-bit words; zero for no rows."""
    ones = np.zeros(64 * (hashes.shape[1] if hashes.ndim > 1 else 1), dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # long texts in parts
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) for each row: the 64-bit SimHash of its whole text, as a signed long.

    A null or wordless text has fingerprint 0; a text of fewer words than a shingle is one shingle.
    Null ids and repeated rows stay; other columns are left out whatever their names.
    """
    small_batches(docs.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([majority(shingle_hashes(t, shingle))[0] for t in texts_of(batch, "text")], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    rows = only(docs, id_column, text_column)
    return map_batches(rows.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")), "id long, fp long", work)


def linked_fingerprints(fps: DataFrame, threshold: int = 2, blocks: tuple[str, ...] = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) between different fingerprints of column fp: enough to join all that a chain of
    steps of at most `threshold` bits joins, and none between fingerprints further apart.
    """
    reach, near = (threshold + 1) // 2, threshold // 2

    def replicate(batch: pa.RecordBatch) -> pa.Table:
        words = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        code, out = covering(blocks), []
        for at in range(0, len(words), 4096 // (1 + 32 * max(0, reach - 1)) or 1):
            own = words[at : at + (4096 // (1 + 32 * max(0, reach - 1)) or 1)]
            who, anchor, _ = code.replicas(own, reach)
            pairs = np.unique(np.stack([anchor, own[who]], 1), axis=0) if reach > 1 else _unique_pairs(who, anchor, own)
            out.append(pa.table({"anchor": pairs[:, 0].copy().view(np.int64), "fp": pairs[:, 1].copy().view(np.int64)}))
        return pa.concat_tables(out) if out else None

    def split(batch: pa.RecordBatch) -> pa.Table:
        words = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        anchors = batch.column("anchor").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        code, out = covering(blocks), []
        for at in range(0, len(words), 512):
            own = words[at : at + 512]
            who, anchor, point = code.replicas(own, reach)
            mine = anchor == anchors[at : at + 512][who]
            close = np.bitwise_count(point ^ own[who]) <= near
            out.append(pa.table({"point": point[mine].view(np.int64), "fp": own[who][mine].view(np.int64), "close": close[mine]}))
        return pa.concat_tables(out) if out else None

    spark = fps.sparkSession
    distinct = fps.select("fp").where("fp is not null").distinct()
    replicas = cut(map_batches(distinct, "anchor long, fp long", replicate), "replicas")
    crowds = replicas.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(replicas.join(crowds, "anchor"), "anchors")
    few = shared.where(F.col("members") <= crowd)
    compared = few.alias("a").join(few.alias("b"), F.expr(f"a.anchor = b.anchor and a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {int(threshold)}")).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    points = map_batches(shared.where(F.col("members") > crowd).select("anchor", "fp"), "point long, fp long, close boolean", split)
    centre = points.groupBy("point").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("centre")).where("centre is not null")
    starred = points.join(centre, "point").where("fp <> centre").select(F.col("fp").alias("u"), F.col("centre").alias("v"))
    return compared.union(starred)


def _unique_pairs(who: np.ndarray, anchor: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(anchor, word) without repeats, for replicas that come word by word."""
    per = np.sort(anchor.reshape(len(words), -1), axis=1)
    first = np.ones(per.shape, dtype=bool)
    first[:, 1:] = per[:, 1:] != per[:, :-1]
    return np.stack([per[first], np.repeat(words, first.sum(1))], 1)


def simhash_components(docs: DataFrame, shingle: int = 3, threshold: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row.

    component_id is the smallest non-null id that a chain of fingerprints at most threshold bits
    apart reaches, null only if every id there is null. Empty tables give no rows.
    """
    with scratch(docs.sparkSession) as work:
        fps = cut(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
        roots = components(linked_fingerprints(fps, threshold))
        first = fps.groupBy("fp").agg(F.min("id").alias("least"))
        rooted = cut(first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.join(least, "root").select("fp", "component_id")
        return work.last(fps.join(named, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id"), "components")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, at most 2 differing bits."""
    out = simhash_components(documents(spark, sf_dir), shingle=3, threshold=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
