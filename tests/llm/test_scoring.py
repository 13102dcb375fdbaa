import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pilespan.llm import scoring
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"
END = None


def split(text):
    return (text or "").encode().lower().split() + [END]


def plain_base(texts, train):
    """{row: (tokens, known, base)} and all training tokens."""
    c = Counter(w for t, learn in zip(texts, train) if learn for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(len(s), sum(c[w] > 0 for w in s), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s)) for s in map(split, texts)], n


class Plain:
    """The model by its definition, from dictionaries."""

    def __init__(self, texts, least=2, discount=0.5):
        self.count, self.discount = Counter(), discount
        for t in texts:
            s = [END, *split(t)]
            for n in (1, 2, 3):
                self.count.update(tuple(s[i : i + n]) for i in range(max(0, 2 - n), len(s) - n + 1) if n > 1 or i > 0)
        self.tokens = sum(c for g, c in self.count.items() if len(g) == 1)
        self.types = sum(len(g) == 1 for g in self.count)
        self.after = defaultdict(dict)
        for g, c in self.count.items():
            if len(g) > 1 and c >= least:
                self.after[g[:-1]][g[-1]] = c
        self.least = least

    def p(self, context, w):
        if not context:
            c = self.count[(w,)]
            return (c - self.discount) / self.tokens if c else self.discount * self.types / self.tokens
        total = self.count[context]
        if total < (self.least if len(context) == 2 else 1):
            return self.p(context[1:], w)
        after = self.after.get(context, {})
        left = 1 - (sum(after.values()) - self.discount * len(after)) / total
        return (after[w] - self.discount if w in after else 0) / total + left * self.p(context[1:], w)

    def score(self, text):
        s = [END, *split(text)]
        return sum(math.log10(self.p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))


@pytest.fixture()
def small(monkeypatch):
    """Many blocks, buckets and parts of contexts in small tables."""
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 400)
    monkeypatch.setattr(scoring, "BUCKET_TOKENS", 50)
    monkeypatch.setattr(scoring, "PART_BITS", 3)


def agrees(df, train, texts):
    """df's scores against the plain model's. texts: {doc_id: text}; train: the ids learnt from."""
    model = Plain([texts[i] for i in texts if i in train])
    expected, n = plain_base(list(texts.values()), [i in train for i in texts])
    got = {r.doc_id: r for r in df.collect()}
    assert set(got) == set(texts)
    for (i, t), (tokens, known, base) in zip(texts.items(), expected):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(model.score(t), rel=1e-9)
        assert r.mean_score == r.score / tokens


def test_scores_by_definition(docs_of, odd_texts, small):
    texts = dict(enumerate([*odd_texts, "one two", "one two", "new words only", "a b c a b c a b", "a b c"]))
    out = scoring.scores(docs_of(list(texts.items())), F.col("doc_id") % 5 != 3)
    agrees(out, {i for i in texts if i % 5 != 3}, texts)


def test_hot_contexts_and_layout(spark, small):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choice(["hot", "hot", "hot", "a", "b", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(60))) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    train = F.col("doc_id") % 4 != 0
    seen = []
    for n in (1, 7, 40):
        out = scoring.scores(df.repartition(n), train)
        agrees(out, {i for i in texts if i % 4}, texts)
        seen.append({r.doc_id: (r.score, r.base_score) for r in out.collect()})
    assert seen[0] == seen[1] == seen[2]  # to the last bit


def test_steps_lead_to_the_states_that_scores_takes():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(30))).encode() for _ in range(60)]
    block = scoring.Block(scoring._block([scoring.word_hashes(t) for t in texts], [i % 3 > 0 for i in range(60)]))
    words, bigrams = block.word_counts, block.bigram_counts
    more = block.trigrams(bigrams, 2)
    known = np.nonzero(bigrams >= 2)[0]
    kinds, times = (np.bincount(block.first[known], weights=w, minlength=len(words)).astype(int) for w in (np.ones(len(known)), bigrams[known]))
    often = np.where(more.counts >= 2, more.counts, 0)
    part_kinds, part_times = (np.bincount(more.below, weights=w, minlength=len(more.part_keys)).astype(int) for w in (often > 0, often))
    automaton = scoring.Automaton(block, [words, bigrams], [kinds, times, part_kinds, part_times, more.counts], int(words.sum()), len(words), 2)
    at, expected = 0, []
    for text in texts:
        state, total = np.array([automaton.start]), 0.0
        for _ in range(len(text.split()) + 1):
            state, weight = automaton.step(state, block.token[at : at + 1])
            total += weight[0]
            at += 1
        expected.append(total)
    assert len(automaton.fail) > 1 + len(words) and automaton.scores(block) == pytest.approx(expected, rel=1e-12)


def test_probabilities_sum_to_one():
    model = Plain(["a b c a b", "a b c", "b c a b c d", "a b", "x y z a b c", "c c c"] * 3 + ["q r"])
    words = [g[0] for g in model.count if len(g) == 1]
    for context in [(), (b"a",), (b"a", b"b"), (b"b", b"c"), (END, b"a"), (b"q", b"r"), (b"nowhere",)]:
        unseen = model.p(context, b"a word that training lacks")
        assert sum(model.p(context, w) for w in words) + unseen == pytest.approx(1.0, abs=1e-9)


def test_repeated_rows_and_nulls(docs_of):
    df = docs_of([(1, "a b c"), (1, "a b c"), (None, "a b z"), (2, "q")], clashing=False).select("doc_id", "text")
    got = scoring.scores(df, F.col("doc_id").isNotNull()).collect()
    assert len(got) == 4 and len({(r.n_known, r.score) for r in got if r.doc_id == 1}) == 1
    assert next(r.n_known for r in got if r.doc_id is None) == 3
    assert scoring.scores(df.limit(0), F.lit(True)).count() == 0
    alone = scoring.scores(df, F.lit(False)).collect()
    assert len(alone) == 4 and all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in alone)


def test_columns_stay(docs_of):
    df = docs_of(["a b", "c"])
    out = scoring.scores(df, F.lit(True))
    kept = [c for c in df.columns if c.lower() not in ("text", *scoring.MADE)] + [c for c in df.columns if c == "TEXT"]
    assert sorted(out.columns) == sorted([*kept, *scoring.MADE])


def test_query_agrees_with_the_definition(spark):
    out = scoring.op7_scoring(spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in docs}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    agrees(out, train, texts)
    got = out.toPandas()
    assert (got.held_out == [i not in train for i in got.doc_id]).all()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.8


def test_a_task_stores_its_blocks_in_few_buckets(spark):
    x = [*range(50), -1, -(1 << 40), 7 << 32 | 12345, (1 << 62) + 3]
    rows = spark.createDataFrame([(i,) for i in x], "x long").select("x", F.expr("pmod(hash(x), 51)").alias("b")).collect()
    assert {r.x: r.b for r in rows} == dict(zip(x, scoring.bucket_of(np.array(x, dtype=np.int64), 51).tolist()))
    numbers = scoring.block_numbers(3, 2000)
    own = [next(numbers) for _ in range(500)]
    assert own == sorted(set(own)) and own[0] == 3 << 32 and own[-1] < 4 << 32
    assert len(set(scoring.bucket_of(np.array(own), 2000).tolist())) <= scoring.TASK_BUCKETS
