"""Language-model scores by a weighted backoff automaton.

The model has words, bigrams and trigrams with absolute discounts, interpolated with the next shorter context.
Its counts are exact and cover the whole training corpus: a bigram or trigram is in the model from MIN_COUNT
occurrences on, whatever the size of the corpus, and every word is. No task ever holds the model. Texts are cut up
into blocks; a block asks for the counts of its own n-grams, which meet those of all other blocks in buckets
of their hashes, and the answers come home to the block. From them the block builds the part of the automaton that
its texts can reach: states are contexts, an arc carries a word's log-probability, a failure arc the
backoff weight, and each text is scored in one traversal from left to right that carries the state; a block's texts are
traversed side by side.

Trigrams are asked for only if both their bigrams are in the model; no other can be. Words with all their
contexts meet under the context's hash; a context with very many occurrences is split by the word's hash, by a rule that
follows from the context's exact count, so all blocks split it alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .common import Scratch, documents, mix64, only, packed, scratch, small_batches, texts_of, unpacked
from .language import remainder

#: Discount of every count; least count of a bigram or trigram in the model.
DISCOUNT, MIN_COUNT = 0.5, 2
#: Columns that scores() makes; columns of the same names give way.
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_score")
#: Bytes of text in a block; tokens of the corpus for a bucket of keys; occurrences of a context for each part of it (as a power of two).
BLOCK_BYTES, BUCKET_TOKENS, PART_BITS = 4 << 20, 1 << 18, 20
#: Buckets that a task's blocks are stored in, at most.
TASK_BUCKETS = 8
#: The hash that stands for the end, which also stands before a text.
END = np.uint64(0x9D5C6E3F20B7A481)
#: What is asked for: counts of words, counts of bigrams, what follows words, what follows bigrams.
WORDS, BIGRAMS, AFTER_WORDS, AFTER_BIGRAMS = range(4)
ASKED = "block long, kind int, bucket long, data binary"
ANSWERED = ASKED + ", types long"
#: Bits that stand for a bigram (56) and, below its context, for the word that follows (32).
KEY, CHILD = np.uint64((1 << 64) - (1 << 8)), np.uint64((1 << 32) - 1)


def word_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each word, A-Z in lower case: the word's identity from here on."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _block(texts: list[np.ndarray], learnt: list[bool]) -> bytes:
    """Texts as one value: their sizes, whether they are learnt from, the words' hashes, and each word's place among them."""
    vocabulary, ids = np.unique(np.concatenate([*texts, [END]]), return_inverse=True)
    return packed([len(t) for t in texts], learnt, np.diff(vocabulary, prepend=np.uint64(0)), ids[:-1])


class Block:
    """The n-grams of a block's texts.

    words: hashes, ascending, the end's included. row: the text of each token, token: its word (the words of a text, then
    the end). bigrams: hashes, ascending, with the places first and last of their words; bigram: that of each token with
    the one before it.
    """

    def __init__(self, data: bytes):
        sizes, learnt, steps, ids = unpacked(data)
        self.words = np.cumsum(steps, dtype=np.uint64)
        self.end = int(np.searchsorted(self.words, END))
        n = sizes.astype(np.int64) + 2  # with the end before and after
        self.starts = np.cumsum(n) - n
        stream = np.full(int(n.sum()), self.end, dtype=np.int32)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        inner = np.ones(len(stream), dtype=bool)
        inner[self.starts] = False
        at = np.nonzero(inner)[0]
        words = np.ones(len(stream), dtype=bool)
        words[self.starts] = words[self.starts + n - 1] = False
        stream[words] = ids
        self.row, self.token, self.learnt = row[at], stream[at], learnt.astype(bool)[row[at]]
        self.before = stream[at - 1]
        self.word_counts = np.bincount(self.token[self.learnt], minlength=len(self.words))
        self.bigrams, of = np.unique(mix64(self.words[self.before], self.words[self.token]) & KEY, return_inverse=True)
        self.bigram = of.astype(np.int32)
        self.bigram_counts = np.bincount(self.bigram[self.learnt], minlength=len(self.bigrams))
        self.first, self.last = (np.zeros(len(self.bigrams), dtype=np.int32) for _ in range(2))
        self.first[self.bigram], self.last[self.bigram] = self.before, self.token

    def trigrams(self, counts: np.ndarray, least: int) -> Trigrams:
        return Trigrams(self, counts, least)


class Trigrams:
    """A block's trigrams whose bigrams have the least count, under the parts of their contexts.

    contexts: the bigrams with the least count that don't end a text; part_keys: hashes of their parts, ascending;
    part_of: the place in contexts of each part. child: a hash of each trigram; below: its part; ascending by
    both. context and after: the bigrams that it consists of; counts: in the block's texts that are learnt from.
    """

    def __init__(self, block: Block, counts: np.ndarray, least: int):
        known = counts >= least
        self.contexts = np.nonzero(known & (block.last != block.end))[0]
        parts = 1 + (counts[self.contexts] >> PART_BITS)
        part_of = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(len(part_of)) - np.repeat(np.cumsum(parts) - parts, parts)
        keys = block.bigrams[self.contexts][part_of]
        keys = np.where(number == 0, keys, mix64(keys, number.astype(np.uint64)) & KEY)
        order = np.argsort(keys, kind="stable")
        self.part_keys, self.part_of = keys[order], part_of[order]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        # tokens whose bigram and the one before it, in the same text, are known
        here = np.nonzero(known[block.bigram])[0]
        here = here[here > 0]
        here = here[(block.row[here] == block.row[here - 1]) & known[block.bigram[here - 1]]]
        context, after = block.bigram[here - 1], block.bigram[here]
        keys, of = np.unique(mix64(block.bigrams[context], block.words[block.token[here]]), return_inverse=True)
        found = np.bincount(of[block.learnt[here]], minlength=len(keys))
        own, then = (np.zeros(len(keys), dtype=np.int64) for _ in range(2))
        own[of], then[of] = context, after
        place = np.searchsorted(self.contexts, own)
        child = keys & CHILD
        below = rank[(np.cumsum(parts) - parts)[place] + (child % parts[place].astype(np.uint64)).astype(np.int64)] if len(keys) else np.zeros(0, dtype=np.int64)
        by = np.lexsort((child, below))
        self.child, self.below, self.context, self.after, self.counts = child[by], below[by], own[by], then[by], found[by]


def _buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of ascending keys with the same first bits."""
    of = (keys >> np.uint64(64 - bits)) if bits else np.zeros(len(keys), dtype=np.uint64)
    edges = np.nonzero(np.r_[True, of[1:] != of[:-1]])[0] if len(keys) else np.zeros(0, dtype=np.int64)
    for a, b in zip(edges, np.r_[edges[1:], len(keys)]):
        yield int(of[a]), int(a), int(b)


def _asked(block: int, kind: int, keys: np.ndarray, bits: int, *values: np.ndarray) -> list[tuple]:
    """Rows that ask for the sums of values under keys."""
    return [(block, kind, bucket, packed(np.diff(keys[a:b], prepend=np.uint64(0)), *(v[a:b] for v in values))) for bucket, a, b in _buckets(keys, bits)]


def _rows(rows: list[tuple], answers: bool = False) -> pa.RecordBatch:
    types = pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64()
    names = [x.split()[0] for x in ANSWERED.split(", ")]
    n = 5 if answers else 4
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(n)], names[:n])


def _sums(parts: list[tuple], kind: int) -> list[tuple]:
    """Answers of one bucket: for each part the sums over all parts under its keys.

    Counts are answered as twice the sum, plus one for the first part that has the key, so that each key has
    one owner. Each part's rows come back in the part's order.
    """
    asked = [unpacked(p[3]) for p in parts]
    keys, first, of = np.unique(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]), return_index=True, return_inverse=True)
    totals = []
    for column in range(1, len(asked[0])):
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, of, np.concatenate([a[column] for a in asked]).astype(np.int64))
        totals.append(total)
    owner = np.zeros(len(of), dtype=np.int64)
    owner[first] = 1
    types, out, at = int((totals[0] > 0).sum()), [], 0
    for part, a in zip(parts, asked):
        own = of[at : at + len(a[0])]
        values = [2 * totals[0][own] + owner[at : at + len(own)]] if kind in (WORDS, BIGRAMS) else [t[own] for t in totals]
        out.append((*part[:3], packed(*values), types))
        at, types = at + len(own), 0
    return out


def _follow(parts: list[tuple], least: int) -> list[tuple]:
    """Answers of one bucket of contexts: for each context of a part how many words in the model follow it and
    how often, and for each of the part's words its count."""
    asked = [unpacked(p[3]) for p in parts]
    keys, of = np.unique(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]), return_inverse=True)
    context = np.repeat(of, np.concatenate([a[1] for a in asked]).astype(np.int64))
    child = np.concatenate([a[2] for a in asked])
    _, first, pair = np.unique(mix64(keys[context], child), return_index=True, return_inverse=True)
    total = np.zeros(len(first), dtype=np.int64)
    np.add.at(total, pair, np.concatenate([a[3] for a in asked]).astype(np.int64))
    total[total < least] = 0
    kinds, times = (np.zeros(len(keys), dtype=np.int64) for _ in range(2))
    np.add.at(kinds, context[first], total > 0)
    np.add.at(times, context[first], total)
    out, a, b = [], 0, 0
    for part, own in zip(parts, asked):
        n, m = len(own[0]), len(own[2])
        out.append((*part[:3], packed(kinds[of[a : a + n]], times[of[a : a + n]], total[pair[b : b + m]]), 0))
        a, b = a + n, b + m
    return out


def _answered(asked: DataFrame, least: int) -> DataFrame:
    """The rows that ask, meeting in their buckets, to rows that answer."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[0][1:3] != row[1:3]:
                    yield _rows(settle(held), answers=True)
                    held = []
                held.append(row)
        if held:
            yield _rows(settle(held), answers=True)

    def settle(parts: list[tuple]) -> list[tuple]:
        kind = parts[0][1]
        return _follow(parts, least) if kind == AFTER_BIGRAMS else _sums(parts, kind)

    return asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(answer, ANSWERED)


def _of_kind(answers: list[dict], kind: int, columns: int) -> list[np.ndarray]:
    """The columns that answer a block's question, in the order of its keys."""
    found = [unpacked(x["data"]) for x in answers if x["kind"] == kind]
    return [np.concatenate([f[i] for f in found]).astype(np.int64) if found else np.zeros(0, dtype=np.int64) for i in range(columns)]


class Automaton:
    """The part of the weighted automaton that a block's texts can reach.

    State 0 is the root; state 1 + w has the context w; further states have a bigram as context, if any trigram begins
    with it. An arc from a state by a word has a next state and a log10 probability; where there is none, the
    failure arc leads to the next shorter context and adds its weight. The root has an arc for every word.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], after: list[np.ndarray], tokens: int, types: int, least: int):
        words, bigrams = counts
        size = self.size = len(block.words)
        more = block.trigrams(bigrams, least)
        kinds, times, part_kinds, part_times, found = after
        other, seen = (np.zeros(len(block.bigrams), dtype=np.int64) for _ in range(2))
        np.add.at(other, more.contexts[more.part_of], part_kinds)
        np.add.at(seen, more.contexts[more.part_of], part_times)
        known = bigrams >= least
        with np.errstate(divide="ignore", invalid="ignore"):
            # what is left for the shorter context, and the probabilities of each length
            left_word = np.where(words > 0, 1 - (times - DISCOUNT * kinds) / words, 1.0)
            left_bigram = np.where(known, 1 - (seen - DISCOUNT * other) / bigrams, 1.0)
            unigram = np.where(words > 0, (words - DISCOUNT) / tokens, DISCOUNT * types / tokens)
            bigram = np.where(known, (bigrams - DISCOUNT) / words[block.first], 0.0) + left_word[block.first] * unigram[block.last]
        # a context that nothing in the model follows passes all on to the shorter one, so it needs no state
        word_state = np.where(kinds > 0, 1 + np.arange(size), 0)
        contexts = np.nonzero(other > 0)[0]
        state = word_state[block.last]
        state[contexts] = 1 + size + np.arange(len(contexts))
        b, t = np.nonzero(known)[0], np.nonzero(found >= least)[0]
        trigram = (found[t] - DISCOUNT) / bigrams[more.context[t]] + left_bigram[more.context[t]] * bigram[more.after[t]]
        source = np.concatenate((1 + block.first[b].astype(np.int64), state[more.context[t]]))
        by = np.concatenate((block.last[b], block.last[more.after[t]]))
        key, weight = source * size + by, np.log10(np.concatenate((bigram[b], trigram)))
        order = np.argsort(key)
        self.arcs, self.weight, self.next = key[order], weight[order], np.concatenate((state[b], state[more.after[t]]))[order]
        self.root, self.word_state, self.bigram_state = np.log10(unigram), word_state, state
        self.fail = np.log10(np.concatenate(([1.0], left_word, left_bigram[contexts])))
        self.shorter = np.concatenate((np.zeros(1 + size, dtype=np.int64), word_state[block.last[contexts]]))
        self.start = word_state[block.end]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each state by a word: the next state and the weights on the way."""
        state, total, then = state.copy(), np.zeros(len(state)), self.word_state[word]
        going = np.arange(len(state))
        while len(going):
            key = state[going] * self.size + word[going]
            at = np.minimum(np.searchsorted(self.arcs, key), max(0, len(self.arcs) - 1))
            there = (self.arcs[at] == key) & (state[going] > 0) if len(self.arcs) else np.zeros(len(going), dtype=bool)
            total[going[there]] += self.weight[at[there]]
            then[going[there]] = self.next[at[there]]
            going = going[~there]
            ended = state[going] == 0
            total[going[ended]] += self.root[word[going[ended]]]
            going = going[~ended]
            total[going] += self.fail[state[going]]
            state[going] = self.shorter[state[going]]
        return then, total

    def scores(self, block: Block) -> np.ndarray:
        """log10 probabilities of the block's texts, each traversed from left to right.

        The state that a step leads to is the longest context in the model, which the last bigram tells; so all
        texts' steps are taken side by side, and their weights are added up in the texts' order.
        """
        state = np.empty(len(block.token), dtype=np.int64)
        state[1:] = self.bigram_state[block.bigram[:-1]]
        state[np.searchsorted(block.row, np.arange(len(block.starts)))] = self.start
        return np.bincount(block.row, weights=self.step(state, block.token)[1], minlength=len(block.starts))


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    """The bucket of n in which Spark stores each long: its 32-bit Murmur3 hash with seed 42, modulo n."""
    h = np.full(len(x), 42, dtype=np.uint32)
    turn = lambda a, r: a << np.uint32(r) | a >> np.uint32(32 - r)
    for half in (x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF):
        k = turn(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).astype(np.int32).astype(np.int64) % n


def block_numbers(task: int, n: int) -> Iterator[int]:
    """Numbers for a task's blocks: its own, ascending, and in TASK_BUCKETS of n buckets at most, so that it writes few files."""
    at, own = task << 32, None
    while True:
        x = np.arange(at, at + (1 << 16), dtype=np.int64)
        of = bucket_of(x, n)
        own = np.unique(of[:TASK_BUCKETS]) if own is None else own
        yield from x[np.isin(of, own)].tolist()
        at += 1 << 16


def _blocks(docs: DataFrame, carried: list[str], n: int) -> DataFrame:
    """(block, rows, tokens, data): texts of about BLOCK_BYTES in a row, with the columns carried of their rows.

    tokens: those of texts that are learnt from. n: buckets in which the blocks will be stored.
    """
    fields = docs.select(*carried).schema
    schema = StructType().add("block", LongType()).add("rows", ArrayType(fields)).add("tokens", LongType()).add("data", BinaryType())

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_numbers(TaskContext.get().partitionId(), n)
        held, texts, learnt, size = [], [], [], 0

        def emit() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_struct_array()
            rows = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
            lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            tokens = sum(len(t) + 1 for t, x in zip(texts, learnt) if x)
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)]), lists, pa.array([tokens]), pa.array([_block(texts, learnt)], pa.binary())], ["block", "rows", "tokens", "data"])

        for batch in batches:
            marks, since = batch.column("_learn").to_pylist(), 0
            own = batch.select(carried)
            for at, text in enumerate(texts_of(batch)):
                texts.append(word_hashes(text))
                learnt.append(marks[at])
                size += len(text) + 8
                if size >= BLOCK_BYTES:
                    held.append(own.slice(since, at + 1 - since))
                    yield emit()
                    held, texts, learnt, size, since = [], [], [], 0, at + 1
            if since < batch.num_rows:
                held.append(own.slice(since))
        if texts:
            yield emit()

    return docs.select(*carried, "_learn", "text").mapInArrow(cut_up, schema)


def scores(docs: DataFrame, train, least: int = MIN_COUNT) -> DataFrame:
    """docs (doc_id, more) without text, and n_tokens, n_known, train_tokens, base_score, score, mean_score.

    train: a Boolean column; the model learns from rows where it is true. Tokens of a text are its words, A-Z
    in lower case, then one end; a null or empty text has the end only. base_score: add-one unigrams, with one more
    type for what training lacks. mean_score: score by token. Without training rows all scores are 0. Repeated rows
    get the same scores, and scores don't depend on how rows are partitioned; empty tables give none. A very long text is
    a block of its own, and a task holds one block with its n-grams.
    """
    with scratch(docs.sparkSession) as work:
        return _scores(docs, train, least, work)


def _scores(docs: DataFrame, train, least: int, work: Scratch) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    n = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))  # Spark's most buckets
    names = docs.columns
    docs = docs.select("*", F.coalesce(train, F.lit(False))).toDF(*[x if x in ("doc_id", "text") else f"c{i}" for i, x in enumerate(names)], "_learn")
    carried = {x: name for x, name in zip(docs.columns, names) if x != "text" and name.lower() not in MADE}
    blocks = work.bucketed(_blocks(docs, list(carried), n), "blocks", "block", n)
    tokens = int(blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
    bits = max(0, (-(-tokens // BUCKET_TOKENS) - 1).bit_length())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                block = Block(data.as_buffer())
                yield _rows(_asked(number, WORDS, block.words, bits, block.word_counts) + _asked(number, BIGRAMS, block.bigrams, bits, block.bigram_counts))

    def home(asked: DataFrame, what: str) -> DataFrame:
        """Answers gathered by block, in buckets like those of the blocks."""
        answers = F.sort_array(F.collect_list(F.struct("kind", "bucket", "data"))).alias(what)
        types = F.sum(F.when(F.col("kind") == WORDS, F.col("types"))).alias("types")
        return work.bucketed(_answered(asked, least).groupBy("block").agg(answers, types), what, "block", n)

    counts = home(blocks.select("block", "data").mapInArrow(ask, ASKED), "counts")
    types = int(counts.agg(F.sum("types").alias("n")).first()["n"] or 0)

    def ask_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, told in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("counts")):
                block, told = Block(data.as_buffer()), told.as_py()
                bigrams = _of_kind(told, BIGRAMS, 1)[0]
                total = bigrams >> 1
                own = np.nonzero((bigrams & 1 == 1) & (total >= least))[0]  # every bigram has one owner
                kinds = np.bincount(block.first[own], minlength=len(block.words))
                times = np.zeros(len(block.words), dtype=np.int64)
                np.add.at(times, block.first[own], total[own])
                out = _asked(number, AFTER_WORDS, block.words, bits, kinds, times)
                more = block.trigrams(total, least)
                edges = np.searchsorted(more.below, np.arange(len(more.part_keys) + 1))
                for bucket, a, b in _buckets(more.part_keys, bits):
                    x, y = edges[a], edges[b]
                    out.append((number, AFTER_BIGRAMS, bucket, packed(np.diff(more.part_keys[a:b], prepend=np.uint64(0)), np.diff(edges[a : b + 1]), more.child[x:y], more.counts[x:y])))
                yield _rows(out)

    counts = counts.drop("types")
    met = blocks.select("block", "data").join(counts, "block")
    after = home(met.select("block", "data", "counts").mapInArrow(ask_more, ASKED), "after").drop("types")
    own = docs.select(*carried).schema
    schema = StructType([*own.fields]).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("data")):
                block, told, more = Block(data.as_buffer()), batch.column("counts")[i].as_py(), batch.column("after")[i].as_py()
                words, bigrams = (_of_kind(told, k, 1)[0] >> 1 for k in (WORDS, BIGRAMS))
                edges = np.searchsorted(block.row, np.arange(len(block.starts) + 1))
                n_tokens = np.diff(edges)
                n_known = np.diff(np.concatenate(([0], np.cumsum(words[block.token] > 0)))[edges])
                base, score = np.zeros(len(n_tokens)), np.zeros(len(n_tokens))
                if tokens:
                    automaton = Automaton(block, [words, bigrams], [*_of_kind(more, AFTER_WORDS, 2), *_of_kind(more, AFTER_BIGRAMS, 3)], tokens, types, least)
                    logs = np.log10(words + 1.0)
                    base = np.bincount(block.row, weights=logs[block.token], minlength=len(base)) - n_tokens * np.log10(tokens + types + 1.0)
                    score = automaton.scores(block)
                rows = batch.column("rows")[i].values
                columns = [rows.field(c) for c in carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score)], [f.name for f in schema])

    met = blocks.select("block", "rows", "data").join(counts, "block").join(after, "block")
    out = met.select("rows", "data", "counts", "after").mapInArrow(traverse, schema).toDF(*[f"c{i}" for i in range(len(schema))])
    named = [F.col(f"c{i}").alias(name) for i, name in enumerate([*carried.values(), "n_tokens", "n_known"])]
    base, score, n_tokens = (F.col(f"c{len(carried) + i}") for i in (2, 3, 0))
    return work.last(out.select(*named, F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), (score / n_tokens).alias("mean_score")), "scores")


def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 modulo 7 isn't 2.

    A document without id is neither learnt from nor held out.
    """
    docs = only(documents(spark, sf_dir), "doc_id", "text").select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "text")
    return scores(docs, F.coalesce(remainder(7) != 2, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "mean_score")
