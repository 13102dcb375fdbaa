"""Packing of documents into fixed windows by the online sum-of-squares rule.

Each task keeps, for every fill level, the partially filled windows at that level, and puts the next
piece where the sum over levels of the squared number of such windows becomes least. A document's
whole windows are cut off first, so only its remainder is placed. When too many windows are open, and
when the task ends, the emptiest windows are cut up to fill the fullest; the one that is left is cut
into windows whose lengths are powers of two, which need no padding. Nothing is shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, only, small_batches

#: Windows that a task keeps open before it fills some by cutting others, so that its memory is bounded.
OPEN_WINDOWS = 8192
#: A task's windows are numbered from its partition times this.
IDS_PER_TASK = 1 << 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, run by the faster of the two libraries.

    The vocabulary's order is the order of the merges, and the file's added tokens stand for themselves wherever a text
    has them, so the ids are the same (tests compare them).
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"]: x["id"] for x in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Packer:
    """Sum-of-squares packing of pieces into windows of `size` ids.

    A piece is (doc, start, ids, doc_tokens). Closed windows come out as lists of pieces.
    """

    def __init__(self, size: int, open_windows: int = OPEN_WINDOWS):
        self.size, self.limit = size, open_windows
        self.levels: list[list[list]] = [[] for _ in range(size)]
        self.counts = np.zeros(size + 1, dtype=np.int64)  # the last stands for full windows
        self.open = 0

    def add(self, piece: tuple) -> Iterator[list]:
        """Place a piece shorter than a window; the windows that this closes."""
        r = len(piece[2])
        upto = self.size - r
        before, after = self.counts[: upto + 1], self.counts[r : self.size + 1]
        cost = np.where(before > 0, 2 * after + 1 - (2 * before - 1), 1 << 60)
        cost[0] = 2 * after[0] + 1
        if before[upto] > 0:
            cost[upto] = -(2 * before[upto] - 1)
        level = upto - int(np.argmin(cost[::-1]))  # of equals the fullest
        if level and self.counts[level]:
            window = self._take(level)
        else:
            level, window = 0, []
        window.append(piece)
        if level + r == self.size:
            yield window
        else:
            self._put(level + r, window)
            if self.open > self.limit:
                yield from self._settle(self.limit // 2)

    def finish(self) -> Iterator[list]:
        """The rest: full windows, then windows whose lengths are powers of two."""
        yield from self._settle(1)
        for level in range(1, self.size):
            while self.counts[level]:
                pieces = self._take(level)
                for power in reversed(range(level.bit_length())):
                    if level >> power & 1:
                        part, pieces = _cut(pieces, 1 << power)
                        yield part

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.open -= 1
        return self.levels[level].pop()

    def _put(self, level: int, window: list) -> None:
        self.counts[level] += 1
        self.open += 1
        self.levels[level].append(window)

    def _settle(self, keep: int) -> Iterator[list]:
        """Fill the fullest windows with what the emptiest hold until `keep` are open."""
        while self.open > keep:
            levels = np.nonzero(self.counts)[0]
            low, high = int(levels[0]), int(levels[-1])
            source, window = self._take(low), self._take(high)
            part, rest = _cut(source, min(low, self.size - high))
            window += part
            if high + low >= self.size:
                yield window
            else:
                self._put(high + low, window)
            if rest:
                self._put(low - (self.size - high), rest)


def _cut(pieces: list, n: int) -> tuple[list, list]:
    """The first n ids of the pieces, and what follows."""
    part, rest = [], []
    for doc, start, ids, total in pieces:
        if n >= len(ids):
            part.append((doc, start, ids, total))
        elif n > 0:
            part.append((doc, start, ids[:n], total))
            rest.append((doc, start + n, ids[n:], total))
        else:
            rest.append((doc, start, ids, total))
        n -= min(n, len(ids))
    return part, rest


def pack(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece of each row's ids: where it was cut from and where it lies.

    ids: those of the whole text by the tokenizer file, then id 0. A null text is empty (one id, the 0);
    a null document id stays null; repeated rows are packed each by itself; other columns are
    ignored; an empty table gives no rows. sequence_id is unique in the result; rerun on the same
    files it is the same.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, rows = byte_bpe(str(path)), Packer(size), []
        number = TaskContext.get().partitionId() * IDS_PER_TASK

        def emit(windows) -> None:
            nonlocal number
            for window in windows:
                offset = 0
                for doc, start, ids, total in window:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset))
                    offset += len(ids)
                number += 1

        def flush() -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                ids = np.array([*bpe.encode(text.as_py() or "", allowed_special="all"), 0], dtype="<u4")
                whole = len(ids) // size * size
                for at in range(0, whole, size):
                    emit([[(doc, at, ids[at : at + size], len(ids))]])
                if whole < len(ids):
                    emit(packer.add((doc, whole, ids[whole:].copy(), len(ids))))
            if rows:
                yield flush()
        emit(packer.finish())
        if rows:
            yield flush()

    return only(docs, id_column, text_column).select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    return pack(documents(spark, sf_dir), 1024)
