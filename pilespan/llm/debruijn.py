"""Repeated word spans by compaction of the corpus's de Bruijn graph.

Edges of the graph are k-word windows, nodes the (k-1)-word sequences between them. An edge belongs to
its minimizer, the least hash among the shorter windows inside it, so that neighbouring edges of a
document mostly belong together: a maximal run of them travels as one row. Where the runs of a
minimizer meet, every edge learns its source, the smallest document id that has it, and edges which
follow one another, repeat, and keep their distance to the same source become a path with the
coordinates of both ends. Joins compact the paths of a document: one goes on where another with the same distance to the
same source begins. Last, source coordinates verify the spans: a digest of the source's words goes to the
document, which loses the words of a span only if its own give the same.

The edges of a minimizer with very many are split by their own hashes; a bit filter of fixed size, from the documents'
own minimizers, says which. Within a map task edges that an earlier document of the same block has are settled at once and only
their first document is sent on, so a passage in a third of all documents sends one run a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FILTER_BITS, cut, documents, mix64, only, scratch, shield, small_batches, split_by_keys, texts_of

#: Words of the windows inside a k-word window from which its minimizer is taken.
INNER = 4
#: Bytes of text that a map task settles at once, and edges that a reduce task handles at once.
BLOCK_BYTES, BLOCK_EDGES = 2 << 20, 1 << 17
#: Bytes of an edge's hash that travel; the 8 bytes of the minimizer's hash come on top.
EDGE_BYTES = 6
#: Edges from which on a minimizer's are split, into how many parts, and which share of the documents tells (one of so many).
HOT_EDGES, HOT_PARTS, HOT_SHARE = 1 << 20, 1024, 16
NO_ID = (1 << 63) - 1
#: at: the place in the high half, the mark in the low one. What rows of a document share comes first, and
#: what differs lies together, so that shuffled bytes compress.
RUNS = "doc long, words int, at long, key long, edges binary"
PATHS = "doc long, mark long, start long, words long, source long, source_start long"


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k hashes from each place on (the last k - 1 places have none)."""
    power, width, out, have = words, 1, None, 0
    while True:
        if k & width:
            out = power if out is None else mix64(out[: len(out) - width] if len(out) > width else out[:0], power[have:])
            n = max(0, len(words) - have - width + 1)
            out, have = out[:n], have + width
        if have == k:
            return out
        power = mix64(power[:-width] if len(power) > width else power[:0], power[width:])
        width *= 2


def window_minima(x: np.ndarray, n: int) -> np.ndarray:
    """Least of the n values from each place on."""
    width = 1
    size = max(0, len(x) - n + 1)
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:]) if len(x) > width else x[:0]
        width *= 2
    return np.minimum(x[:size], x[n - width :][:size])


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past the last) of the runs that begin where change is true."""
    first = np.nonzero(change)[0]
    return first, np.append(first[1:], len(change))


def _first(h: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each place the first place with the same hash and key."""
    order = np.argsort(h, kind="stable")
    hs, ks = h[order], key[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ks[1:] != ks[:-1])
    out = np.empty(len(h), dtype=np.int64)
    out[order] = order[np.nonzero(new)[0]][np.cumsum(new) - 1]
    return out


def _minimizers(words: np.ndarray, k: int) -> np.ndarray:
    """For each k-word window its minimizer."""
    inner = min(INNER, k)
    return window_minima(window_hashes(words, inner), k - inner + 1)


def _block(docs: list[tuple[int, int, np.ndarray]], k: int, hot: np.ndarray | None = None) -> pa.Table:
    """The runs of a block of (id, mark, word hashes): settled paths (words > 0) and edges to send on.

    hot: bits of the filter of minimizers whose edges are split.
    """
    docs = sorted((d for d in docs if len(d[2]) >= k), key=lambda d: d[:2])
    if not docs:
        return None
    sizes = np.array([len(d[2]) for d in docs])
    words = np.concatenate([d[2] for d in docs])
    edge = window_hashes(words, k)
    least = _minimizers(words, k)
    if hot is not None:
        bit = least % np.uint64(FILTER_BITS)
        split = (hot[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
        least[split] = mix64(least[split], edge[split] % np.uint64(HOT_PARTS))
    ends = np.cumsum(sizes)
    which = np.repeat(np.arange(len(docs)), sizes)[: len(edge)]
    place = np.arange(len(edge)) - (ends - sizes)[which]
    whole = place + k <= sizes[which]
    edge, least, which, place = edge[whole], least[whole], which[whole], place[whole]
    del words, whole
    ids, marks = np.array([d[0] for d in docs], dtype=np.int64), np.array([d[1] for d in docs], dtype=np.int64)
    first = _first(edge, least)
    source = which[first]
    settled = ids[source] < ids[which]
    away = place - place[first]
    change = np.ones(len(edge), dtype=bool)
    change[1:] = (which[1:] != which[:-1]) | (settled[1:] != settled[:-1]) | np.where(settled[1:], (source[1:] != source[:-1]) | (away[1:] != away[:-1]), least[1:] != least[:-1])
    a, b = _runs(change)
    done = settled[a]
    sent = ~done
    raw = np.ascontiguousarray(edge).view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES]
    keep = np.repeat(sent, b - a)
    at = np.concatenate(([0], np.cumsum((b - a)[sent]))) * EDGE_BYTES
    edges = pa.Array.from_buffers(pa.binary(), int(sent.sum()), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[keep]))])
    out = [pa.table({"doc": ids[which[a[sent]]], "words": pa.array(np.zeros(int(sent.sum()), np.int32)), "at": place[a[sent]] << 32 | marks[which[a[sent]]], "key": least[a[sent]].view(np.int64), "edges": edges})]
    if done.any():
        x = a[done]
        coordinates = np.stack([ids[source[x]], place[first[x]]], 1).astype("<i8")
        flat = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, 16 * len(x) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(coordinates))])
        spread = mix64(ids[which[x]].view(np.uint64), place[x].astype(np.uint64)).view(np.int64)
        out.append(pa.table({"doc": ids[which[x]], "words": pa.array((b[done] - x + k - 1).astype(np.int32)), "at": place[x] << 32 | marks[which[x]], "key": spread, "edges": flat}))
    return pa.concat_tables(out)


def _meet(t: pa.Table, carry: tuple | None, k: int) -> tuple[pa.Table, tuple | None]:
    """Paths of the edges of rows sorted by key and document, given the last key's edges before."""
    done = np.asarray(t["words"]) > 0
    out = []
    if done.any():
        x = t.filter(pa.array(done))
        coordinates = np.frombuffer(b"".join(x["edges"].to_pylist()), dtype="<i8").reshape(-1, 2)
        at = np.asarray(x["at"])
        out.append(pa.table({"doc": x["doc"], "mark": at & 0xFFFFFFFF, "start": at >> 32, "words": np.asarray(x["words"]).astype(np.int64), "source": coordinates[:, 0].copy(), "source_start": coordinates[:, 1].copy()}))
        t = t.filter(pa.array(~done))
    if t.num_rows:
        data = t["edges"].combine_chunks()
        data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
        sizes = np.diff(np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1]) // EDGE_BYTES
        raw = np.frombuffer(b"".join(x.as_buffer() for x in data), dtype=np.uint8).reshape(-1, EDGE_BYTES)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :EDGE_BYTES] = raw
        edge, row = wide.view("<u8").ravel(), np.repeat(np.arange(len(sizes)), sizes)
        at = np.asarray(t["at"])
        key, doc, mark = np.asarray(t["key"])[row], np.asarray(t["doc"])[row], (at & 0xFFFFFFFF)[row]
        place = (at >> 32)[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        skip = 0
        if carry is not None and carry[0][0] == key[0]:
            skip = len(carry[0])
            key, edge, doc, place = (np.concatenate(x) for x in zip(carry, (key, edge, doc, place)))
            row, mark = np.concatenate((np.full(skip, -1), row)), np.concatenate((np.zeros(skip, np.int64), mark))
        first = _first(mix64(edge, key.view(np.uint64)), key)
        repeats = (doc[first] < doc) & (row >= 0)
        source, away = doc[first], place - place[first]
        change = np.ones(len(edge), dtype=bool)
        change[1:] = (row[1:] != row[:-1]) | (repeats[1:] != repeats[:-1]) | (source[1:] != source[:-1]) | (away[1:] != away[:-1])
        a, b = _runs(change)
        own = repeats[a]
        a, b = a[own], b[own]
        out.append(pa.table({"doc": doc[a], "mark": mark[a], "start": place[a], "words": b - a + k - 1, "source": source[a], "source_start": place[first[a]]}))
        last = (key == key[-1]) & (first == np.arange(len(first)))
        carry = (key[last], edge[last], doc[last], place[last])
    return (pa.concat_tables(out) if out else None), carry


def hot_minimizers(docs: DataFrame, k: int) -> np.ndarray | None:
    """A bit filter of the minimizers with about HOT_EDGES edges or more; None if there are none.

    One in HOT_SHARE documents (column text) tells; it only matters for the balance of the work.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_minimizers(np.fromiter(map(xxhash.xxh64_intdigest, t.split()), dtype=np.uint64), k) for t in texts_of(batch)]
            key, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    told = docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SHARE)) == 0).select("text").mapInArrow(count, "key long, n long")
    often = told.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_EDGES / HOT_SHARE)
    # the filter of the unsigned hash: as the filter's size divides 2 ** 64, the signed one's remainder is the same
    bit = F.pmod("key", F.lit(FILTER_BITS))
    blocks = often.groupBy((bit / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg((bit % 32768)).alias("bits")).collect()  # FILTER_BITS / 8 bytes at most
    if not blocks:
        return None
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in blocks:
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def repeated_paths(docs: DataFrame, k: int = 13) -> DataFrame:
    """Paths of edges whose words also start in a document with a smaller id.

    docs: columns doc (long, no nulls; NO_ID stands for a missing id), mark (a 31-bit hash of the text, tells repeated ids apart)
    and text. Returns doc, mark, start and words (a span of the document's words), source and
    source_start (a smaller document id that has the span's words, and where).
    """
    small_batches(docs.sparkSession)
    hot = docs.sparkSession.sparkContext.broadcast(hot_minimizers(docs, k))  # FILTER_BITS / 8 bytes at most

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, h = [], 0, xxhash.xxh64_intdigest
        for batch in batches:
            for doc, mark, text in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), texts_of(batch)):
                words = text.split()
                held.append((doc, mark, np.fromiter(map(h, words), dtype=np.uint64, count=len(words))))
                size += len(text)
                if size >= BLOCK_BYTES:
                    if (out := _block(held, k, hot.value)) is not None:
                        yield from out.combine_chunks().to_batches(1 << 16)
                    held, size = [], 0
        if held and (out := _block(held, k, hot.value)) is not None:
            yield from out.combine_chunks().to_batches(1 << 16)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, carry = [], 0, None
        for batch in batches:
            held.append(batch)
            size += batch.column("edges").nbytes // EDGE_BYTES
            if size >= BLOCK_EDGES:
                out, carry = _meet(pa.Table.from_batches(held), carry, k)
                held, size = [], 0
                if out is not None:
                    yield from out.combine_chunks().to_batches()
        if held:
            out, _ = _meet(pa.Table.from_batches(held), carry, k)
            if out is not None:
                yield from out.combine_chunks().to_batches()

    runs = docs.select("doc", "mark", "text").mapInArrow(cut_up, RUNS)
    return runs.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(meet, PATHS)


def compacted(paths: DataFrame, k: int) -> DataFrame:
    """paths with those joined to one that go on from another: its next edge, at the same distance to the same source.

    A compacted path runs from a path without one before it to the next without one after it.
    """
    on = ["doc", "mark", "source", "away"]
    paths = paths.withColumn("away", F.col("source_start") - F.col("start")).withColumn("next", F.col("start") + F.col("words") - (k - 1))
    firsts = paths.join(paths.select(*on, F.col("next").alias("start")), [*on, "start"], "left_anti")
    lasts = paths.join(paths.select(*on, F.col("start").alias("next")), [*on, "next"], "left_anti")
    by = Window.partitionBy(*on).orderBy("start")
    firsts = firsts.select(*on, "start", F.row_number().over(by).alias("n"))
    lasts = lasts.select(*on, F.col("next").alias("stop"), F.row_number().over(by).alias("n"))
    out = firsts.join(lasts, [*on, "n"])
    return out.select("doc", "mark", "start", (F.col("stop") - F.col("start") + k - 1).alias("words"), "source", (F.col("start") + F.col("away")).alias("source_start"))


def source_digests(docs: DataFrame, paths: DataFrame) -> DataFrame:
    """(source, source_start, words, digest): a 128-bit digest of the words that each path has in its source.

    docs: _doc, text. Paths with the same coordinates in the source ask once. Only sources are shuffled.
    """
    asked = paths.select("source", "source_start", "words").distinct()
    asked = asked.groupBy("source").agg(F.collect_list(F.struct("source_start", "words")).alias("spans"))
    asked = cut(asked, "asked")
    inside, _ = split_by_keys(docs.select("_doc", "text"), F.xxhash64("_doc"), asked.select(F.xxhash64("source").alias("key")))
    met = inside.join(asked, F.col("_doc") == F.col("source")).select("source", "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, text, spans in zip(batch.column("source").to_pylist(), texts_of(batch), batch.column("spans")):
                words, spans = text.split(), spans.as_py()
                rows = [(source, s["source_start"], s["words"], digest(words[s["source_start"] : s["source_start"] + s["words"]])) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["source", "source_start", "words", "digest"])

    return met.mapInArrow(work, "source long, source_start long, words long, digest binary").distinct()  # rows with one id may have the same span


def digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def with_repeats(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text, more) with a column _spans: the word spans [start, stop) that may repeat, with the digests
    of the words that their sources have there (null for none).

    Only documents that may have spans are shuffled to meet them.
    """
    marked = docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_mark": F.xxhash64("text").bitwiseAND(0x7FFFFFFF)})
    with scratch(docs.sparkSession) as work:
        paths = cut(repeated_paths(marked.select(F.col("_doc").alias("doc"), F.col("_mark").alias("mark"), "text"), k), "paths")
        paths = cut(compacted(paths, k), "compacted")
        told = paths.join(source_digests(marked, paths), ["source", "source_start", "words"])
        spans = told.groupBy(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("words")).alias("stop"), "digest"))).alias("_spans"))
        spans = work.last(spans, "spans")
    inside, outside = split_by_keys(marked, F.xxhash64("_doc", "_mark"), spans.select(F.xxhash64("_doc", "_mark").alias("key")))
    none = F.lit(None).cast(spans.schema["_spans"].dataType)
    met = inside.join(spans.hint("shuffle_hash"), ["_doc", "_mark"], "left")
    return met.select(*docs.columns, "_spans").union(outside.select(*docs.columns, none.alias("_spans")))


def kept_words(text: bytes, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words in no span that its source verifies, and how many words there were."""
    words = text.split()
    if not spans:
        return words, len(words)
    gone = np.zeros(len(words), dtype=bool)
    for s in spans:
        if s["digest"] == digest(words[s["start"] : s["stop"]]):
            gone[s["start"] : s["stop"]] = True
    return [w for w, g in zip(words, gone.tolist()) if not g], len(words)


def remove_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """docs (doc_id, text, more) without the words of repeated spans: every k-word window that also starts
    in a document with a smaller id goes.

    A text that loses words becomes its other words joined by one space, others stay as they are; a
    null text stays null. Windows don't cross documents; repeats inside one document, or among rows
    with the same id, stay. A null id counts as larger than all others. Columns keep names and order.
    """
    plain, names = shield(docs, "doc_id", "text")
    columns = plain.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not spans else b" ".join(kept_words(t.encode(), spans)[0]).decode() for t, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())]
            own = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(own, columns)

    return with_repeats(plain, k).mapInArrow(work, plain.schema).toDF(*names)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 13-word windows."""
    docs = only(documents(spark, sf_dir), "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, spans in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("_spans").to_pylist()):
                kept, n = kept_words(text, spans)
                rows.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            types = pa.int64(), pa.int64(), pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_repeats(docs, 13).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")
