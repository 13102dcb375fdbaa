import hashlib
import random

import numpy as np
import pytest
from pilespan.llm import debruijn


def plain(rows, k):
    """{row: kept words} by brute force; rows are (id, text)."""
    first = {}
    split = [(t or "").encode().split() for _, t in rows]
    big = 1 << 63
    for (i, _), w in zip(rows, split):
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for (i, _), w in zip(rows, split):
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < (big if i is None else i):
                gone[j : j + k] = [True] * k
        out.append([x for x, g in zip(w, gone) if not g])
    return out


def check(docs_of, rows, k):
    got = debruijn.remove_repeats(docs_of(rows), k).collect()
    expected = plain(rows, k)
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, (t if t is None else t if len(w) == len(t.encode().split()) else b" ".join(w).decode()) or "") for (i, t), w in zip(rows, expected))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == want


@pytest.mark.parametrize("hot", [1 << 20, 4])
def test_random_texts(docs_of, monkeypatch, hot):
    monkeypatch.setattr(debruijn, "HOT_EDGES", hot)
    monkeypatch.setattr(debruijn, "HOT_SHARE", 1)
    rng = random.Random(3)
    pieces = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 20))) for _ in range(12)]
    rows = [(i, "  ".join(rng.choice(pieces) + f" u{rng.randrange(40)}" for _ in range(rng.randrange(0, 6)))) for i in rng.sample(range(500), 80)]
    for k in (2, 5, 13):
        check(docs_of, rows, k)


def test_odd_texts(docs_of, odd_texts):
    check(docs_of, list(enumerate(odd_texts)), 13)
    check(docs_of, list(enumerate(odd_texts)), 1)


def test_null_and_repeated_ids(docs_of):
    t = " ".join(map(str, range(30)))
    check(docs_of, [(None, t), (4, t), (4, t), (4, "x " + t), (2, "y " + t[:40]), (None, None)], 5)
    check(docs_of, [(None, t), (None, t)], 5)


def test_blocks_meet(docs_of, monkeypatch):
    monkeypatch.setattr(debruijn, "BLOCK_BYTES", 200)
    monkeypatch.setattr(debruijn, "BLOCK_EDGES", 7)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"{rng.randrange(9)}" for _ in range(rng.randrange(20))) + " " + passage + f" {i % 3}") for i in range(60)]
    check(docs_of, rows, 6)


def test_hot_minimizers(docs_of):
    """The filter has the minimizers with many edges, and edges of these only are split."""
    df = docs_of([f"a b c d e f {i}" for i in range(40)] + ["q r s t u v w"], clashing=False)
    words = np.array([debruijn.xxhash.xxh64_intdigest(w) for w in b"a b c d e f".split()], dtype=np.uint64)
    often, alone = (debruijn._minimizers(w, 5) for w in (words, np.array([debruijn.xxhash.xxh64_intdigest(w) for w in b"q r s t u v w".split()], dtype=np.uint64)))
    has = lambda bits, key: bits[int(key % debruijn.FILTER_BITS) >> 3] >> (int(key) & 7) & 1
    assert debruijn.hot_minimizers(df, 5) is None
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(debruijn, "HOT_SHARE", 1)
        patch.setattr(debruijn, "HOT_EDGES", 30)
        bits = debruijn.hot_minimizers(df, 5)
    assert all(has(bits, x) for x in often) and not any(has(bits, x) for x in alone if x not in often)


def test_paths_are_compacted(spark):
    rows = [(7, 1, 0, 14, 2, 5), (7, 1, 2, 15, 2, 7), (7, 1, 5, 13, 2, 10), (7, 1, 30, 13, 2, 35), (7, 1, 6, 13, 3, 6), (7, 2, 6, 13, 2, 11), (8, 1, 31, 13, 2, 36)]
    got = sorted(map(tuple, debruijn.compacted(spark.createDataFrame(rows, debruijn.PATHS), 13).collect()))
    assert got == sorted([(7, 1, 0, 18, 2, 5), (7, 1, 30, 13, 2, 35), (7, 1, 6, 13, 3, 6), (7, 2, 6, 13, 2, 11), (8, 1, 31, 13, 2, 36)])


def test_sources_verify(docs_of, monkeypatch):
    """Where windows of different words have the same hash, no word goes."""
    words = b"a b c d e f g h".split()
    good = {"start": 1, "stop": 4, "digest": debruijn.digest(words[1:4])}
    assert debruijn.kept_words(b" ".join(words), [good, {"start": 3, "stop": 7, "digest": b"x"}]) == ([b"a", *words[4:]], 8)
    monkeypatch.setattr(debruijn, "window_hashes", lambda w, k: np.zeros(max(0, len(w) - k + 1), dtype=np.uint64))
    texts = ["a b c d e", "f g h i j", "a b c x y"]
    assert [r.text for r in sorted(debruijn.remove_repeats(docs_of(texts[:2]), 3).collect())] == texts[:2]


def test_empty(docs_of):
    assert debruijn.remove_repeats(docs_of([(1, "x")]).limit(0)).count() == 0


def test_hashes():
    x = np.random.default_rng(1).integers(0, 2**63, 100).astype(np.uint64)
    for k in (1, 2, 3, 5, 12, 13, 16):
        a = debruijn.window_hashes(x, k)
        assert len(a) == 101 - k and (a[9:] == debruijn.window_hashes(x[9:], k)).all()
        assert (debruijn.window_minima(x, k) == [x[i : i + k].min() for i in range(101 - k)]).all()


def test_query(spark):
    dir_ = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{dir_}/documents.parquet").select("doc_id", "text").toPandas()
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    expected = {i: (len((t or "").encode().split()), hashlib.sha256(b" ".join(w)).hexdigest()) for (i, t), w in zip(rows, plain(rows, 13))}
    for r in debruijn.op8_substrings(spark, dir_).collect():
        assert (r.n_words, r.kept_sha256) == expected[r.doc_id]
