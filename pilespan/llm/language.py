"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: slot i holds a bit for every language, and an
n-gram's languages are the AND of the masks in its slots. A text's n-grams are counted per language
bit; the expected number of false positives, from how full each language's slice is, is taken off,
and the largest count decides.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_batches, only, small_batches

#: Lengths of the n-grams, in letters; white space and everything else that is no letter is one sign.
ORDERS = (2, 3, 4, 5)
#: Parameters of the fit: labelled documents a language (about; drawn by hash), n-grams kept a language and
#: order, slots of the filter, slots an n-gram takes. Every language that is labelled has a bit.
FIT_DOCS, FIT_NGRAMS, SLOTS, PROBES = 4000, 8192, 1 << 18, 2
#: Code points handled at once; longer texts are cut into parts that overlap.
PART = 1 << 17
BREAK = 32


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """For each code point: its lower-case letter, or a space where it is no letter."""
    out = np.full(0x110000, BREAK, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def hashes(letters: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of folded letters, and which of them count.

    An n-gram counts if it has no separator (0) and at most one space.
    """
    size = max(0, len(letters) - n + 1)
    h, spaces, good = np.full(size, n, dtype=np.uint64), np.zeros(size, dtype=np.int8), np.ones(size, dtype=bool)
    for i in range(n):
        c = letters[i : i + size]
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        spaces += c == BREAK
        good &= c != 0
    return h, good & (spaces <= 1)


def _parts(batch: pa.RecordBatch):
    """(row, folded letters, has a letter) of each part of each text; none for nulls."""
    fold, overlap = folding(), max(ORDERS) - 1
    for row, text in enumerate(batch.column("text")):
        if text.is_valid:
            codes = np.frombuffer(text.as_py().encode("utf-32-le", "replace"), dtype="<u4")
            for at in range(0, max(1, len(codes) - overlap), PART):
                yield row, fold[codes[at : at + PART + overlap]]


@dataclass
class LanguageFilter:
    """languages: sorted names, one bit each; table: SLOTS x bytes of masks; wrong: by language, how
    often an n-gram that it lacks is found; common: the language with the most labelled documents.
    """

    languages: list[str]
    table: np.ndarray
    wrong: np.ndarray
    common: str

    @classmethod
    def build(cls, languages: list[str], of: np.ndarray, grams: np.ndarray, common: str) -> LanguageFilter:
        table = np.zeros((SLOTS, (len(languages) + 7) // 8), dtype=np.uint8)
        for slot in cls.slots(grams):
            np.bitwise_or.at(table, (slot, of >> 3), (1 << (of & 7)).astype(np.uint8))
        full = np.unpackbits(table, axis=1, bitorder="little").mean(0)[: len(languages)]
        return cls(languages, table, full**PROBES, common)

    @staticmethod
    def slots(h: np.ndarray):
        for probe in range(PROBES):
            yield (h >> np.uint64(20 * probe) & np.uint64(SLOTS - 1)).astype(np.int64)

    def counts(self, letters: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages) n-grams found, and n-grams asked for by row."""
        wide = self.table.shape[1]
        found, asked = np.zeros((rows, wide * 8), dtype=np.int64), np.zeros(rows, dtype=np.int64)
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        for n in ORDERS:
            h, good = hashes(letters, n)
            h, of = h[good], row[: len(good)][good]
            asked += np.bincount(of, minlength=rows)
            one, *others = self.slots(h)
            for byte in range(wide):
                mask = self.table[one, byte]
                for slot in others:
                    mask = mask & self.table[slot, byte]
                found[:, 8 * byte : 8 * byte + 8] += np.bincount(of * 256 + mask, minlength=rows * 256).reshape(rows, 256) @ bits
        return found[:, : len(self.languages)], asked

    def decide(self, found: np.ndarray, asked: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores from counts corrected for false positives; ties to the first name."""
        true = np.maximum(0, found - asked[:, None] * self.wrong) / (1 - self.wrong)
        best, total = true.argmax(1), true.sum(1)
        score = np.where(total > 0, true.max(1) / np.maximum(total, 1e-300), 0.0)
        return [self.languages[b] if t > 0 else self.common for b, t in zip(best, total)], score


def fit(labelled: DataFrame) -> LanguageFilter | None:
    """A filter from columns text and lang; rows with a null in either are left out; None without rows.

    The fit reads a sample of about FIT_DOCS documents of each language, drawn by a hash of the text (so copies are drawn
    together), and keeps the FIT_NGRAMS n-grams of each length that most of them have, ties by hash. What the driver
    gets, and tasks share, grows with the number of languages only.
    """
    small_batches(labelled.sparkSession)
    known = only(labelled, "text", "lang").where("text is not null and lang is not null")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    number = {lang: n for n, lang in enumerate(languages)}
    # an Arrow table stays in the JVM; a list would start a second set of Python workers in each executor, only to copy it
    shares = [int(min(1.0, FIT_DOCS / r["count"]) * (1 << 30)) for r in sizes]
    bounds = known.sparkSession.createDataFrame(pa.table({"lang": pa.array([r["lang"] for r in sizes], pa.string()), "number": pa.array([number[r["lang"]] for r in sizes], pa.int32()), "bound": pa.array(shares, pa.int64())}))
    drawn = known.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("bound")).select(F.col("number").alias("lang"), "text")

    def grams(batch: pa.RecordBatch) -> pa.Table | None:
        of = batch.column("lang").to_numpy(zero_copy_only=False)
        out: dict[tuple[int, int], list[np.ndarray]] = {}
        for row, letters in _parts(batch):
            for n in ORDERS:
                h, good = hashes(letters, n)
                out.setdefault((int(of[row]), n), []).append(np.unique(h[good]))
        tables = []
        for (lang, n), found in out.items():
            h, docs = np.unique(np.concatenate(found), return_counts=True)
            tables.append(pa.table({"lang": pa.array(np.full(len(h), lang), pa.int32()), "n": pa.array(np.full(len(h), n), pa.int32()), "gram": h.view(np.int64), "docs": docs}))
        return pa.concat_tables(tables) if tables else None

    counted = map_batches(drawn, "lang int, n int, gram long, docs long", grams).groupBy("lang", "n", "gram").agg(F.sum("docs").alias("docs")).where("docs > 1")
    first = Window.partitionBy("lang", "n").orderBy(F.desc("docs"), "gram")
    kept = counted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= FIT_NGRAMS).select("lang", "gram").toPandas()
    return LanguageFilter.build(languages, kept["lang"].to_numpy(np.int64), kept["gram"].to_numpy(np.int64).view(np.uint64), sizes[0]["lang"])


def predict(docs: DataFrame, model: LanguageFilter | None, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs, then lang_pred and score, from column text alone.

    A text that is null, empty or has no letter gets "und" and 0, and so does every text without a model; a
    text with letters but no known n-gram gets the commonest language and 0. Ties go to the first name. Equal texts,
    repeated rows among them, get the same; very long texts are counted in parts. Empty tables give none.
    """
    small_batches(docs.sparkSession)
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the constants above

    def work(batch: pa.RecordBatch) -> pa.Table:
        rows, model = batch.num_rows, shared.value
        has = np.zeros(rows, dtype=bool)
        width = len(model.languages) if model else 0
        found, asked = np.zeros((rows, width), dtype=np.int64), np.zeros(rows, dtype=np.int64)
        held, size = [], 0

        def count() -> None:
            letters = np.concatenate([x for _, part in held for x in (part, np.zeros(max(ORDERS), dtype=np.uint32))])
            row = np.repeat([r for r, _ in held], [len(part) + max(ORDERS) for _, part in held])
            first = int(row[0])
            f, a = model.counts(letters, row - first, int(row[-1]) - first + 1)
            found[first : first + len(f)] += f
            asked[first : first + len(a)] += a

        for r, part in _parts(batch):
            has[r] |= bool((part != BREAK).any())
            held.append((r, part))
            size += len(part)
            if size >= PART and model:
                count()
                held, size = [], 0
        if held and model:
            count()
        names, score = model.decide(found, asked) if model else (["und"] * rows, np.zeros(rows))
        names = [x if h else "und" for x, h in zip(names, has)]
        own = [batch.column(c) for c in carry]
        return pa.Table.from_arrays([*own, pa.array(names, pa.string()), pa.array(np.where(has, score, 0.0))], [*carry, "lang_pred", "score"])

    text = F.col("text") if "text" in carry else F.col("text").alias("text")
    return map_batches(docs.select(*carry, *([] if "text" in carry else [text])), schema, work)


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32 modulo 5 isn't 0.

    A document without id is neither learnt from nor held out.
    """
    docs = only(documents(spark, sf_dir), "doc_id", "text", "lang")
    model = fit(docs.where(remainder(5) != 0))
    asked = docs.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "text")
    return predict(asked, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
