import hashlib
import random
import re
import struct

import pytest
import xxhash
from pilespan.llm import syncmers

LONE = "[⺀-鿿가-힣豈-﫿\U00020000-\U0003ffff]"
TOKEN = re.compile(LONE + "|(?:(?!" + LONE + r")[^\x20\x09-\x0D]){1,64}")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(hashes):
    """Spark's xxhash64 of several longs."""
    out = 42
    for h in hashes:
        out = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=out)
    return out & 0xFFFFFFFF


def plain_sketch(text):
    words = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in TOKEN.findall(text)]
    kmers = [words[i : i + 3] for i in range(len(words) - 2)]
    found = [chained(k) for i, k in enumerate(kmers) if min(k) in (k[0], k[2]) or i in (0, len(kmers) - 1)] or [chained(words)]
    return [h << 16 | found.index(h) * 65536 // len(found) for h in sorted(set(found))[:64]]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    ha, hb = ([x >> 16 for x in s] for s in (a, b))
    both = sorted(set(ha) | set(hb))[:64]
    met = sorted((x & 0xFFFF, b[hb.index(x >> 16)] & 0xFFFF) for x in a if x >> 16 in hb and x >> 16 in both)
    return sum(i == 0 or m[1] >= met[i - 1][1] for i, m in enumerate(met)) / len(both)


def as_text(sketch):
    return "".join(f"{x:012x}" for x in sketch)


def rows_of(spark, df, path):
    df.write.parquet(f"{path}/documents.parquet")
    return syncmers.op3_fingerprints(spark, str(path)).collect()


@pytest.mark.parametrize("clashing", [False, True])
def test_query_by_brute_force(spark, docs_of, tmp_path, odd_texts, monkeypatch, clashing):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 3)
    rng = random.Random(4)
    cjk = "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(90))
    texts = odd_texts + [cjk, cjk[:40] + "字" + cjk[40:]] + [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(200))) for _ in range(20)]
    ids = rng.sample(range(-50, 10**6), len(texts))
    df = docs_of(list(zip(ids, texts)), clashing=clashing)
    got = {r.doc_id: r for r in rows_of(spark, df.toDF(*[c if c != "TEXT" else "next_text" for c in df.columns]), tmp_path)}
    rows = sorted((i, t or "") for i, t in zip(ids, texts))
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r, own, other = got[i], plain_sketch(t), plain_sketch(edited)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(own), as_text(other))
        assert r.near_edited == pytest.approx(plain_likeness(own, other)) and r.near_next == pytest.approx(plain_likeness(own, plain_sketch(after)))


def test_one_and_no_document(spark, docs_of, tmp_path):
    r = rows_of(spark, docs_of([(5, "a b c d e")], clashing=False), tmp_path / "one")[0]
    assert r.near_next == 1.0 and r.n_chars == 9 and r.edited_sha256 == hashlib.sha256(b"a b ca b ").hexdigest()
    assert rows_of(spark, docs_of([(5, "a")], clashing=False).limit(0), tmp_path / "none") == []


def test_null_and_repeated_ids(spark, docs_of, tmp_path, monkeypatch):
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 2)
    got = rows_of(spark, docs_of([(None, "n n n n"), *[(3, f"b{i} b c d") for i in range(9)], (3, "b0 b c d"), (1, "c"), (None, None)], clashing=False), tmp_path / "a")
    assert len(got) == 13 and sorted(r.doc_id or -1 for r in got) == [-1, -1, 1, *[3] * 10]
    lone = next(r for r in got if r.doc_id is None and r.n_chars)
    assert lone.edited_sha256 == hashlib.sha256(b"n n ").hexdigest() and lone.near_next == 0
    threes = [r for r in got if r.doc_id == 3]  # a chain: each has another's text after it, the last the first document's
    firsts = {hashlib.sha256((f"b{i} b"[:4] + x).encode()).hexdigest() for i in range(9) for x in [*(f"b{j} b" for j in range(9)), "c"]}
    assert {r.edited_sha256 for r in threes} <= firsts and sum(r.near_next == 1.0 for r in threes) == 1
    assert len(rows_of(spark, docs_of([(None, "n"), (None, None)], clashing=False), tmp_path / "nulls")) == 2


def test_length_makes_no_difference(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**4)}" for _ in range(200)]
    for cut in (395, 430, 900):
        long = " ".join(words)[:cut]
        pair = [(0, long), (1, long[:-3])]
        a, b = (r.sketch for r in sorted(syncmers.with_sketch(spark.createDataFrame(pair, "doc_id long, text string"), "text", "sketch").collect()))
        assert plain_likeness(a, b) > 0.9


def test_anchors_depend_on_nothing_outside(spark, docs_of):
    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = [" ".join(words), " ".join(["x"] * 37 + words[50:350] + ["y"] * 5), "two words", None]
    found = {}
    for r in syncmers.anchors(docs_of(texts)).collect():
        found.setdefault(r.doc_id, {})[r.position] = r.anchor
    shared = {p: a for p, a in found[0].items() if 50 <= p <= 350 - syncmers.K}
    assert {0, 400 - syncmers.K} <= set(found[0])
    assert {p - 50 + 37: a for p, a in shared.items()} == {p: a for p, a in found[1].items() if 37 <= p <= 337 - syncmers.K}
    assert len(found[0]) > 200 and list(found[2]) == [0] and list(found[3]) == [0]


def test_likeness_follows_what_is_shared(spark, docs_of):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    texts = [" ".join(words)] + [" ".join(words[: 2000 - n] + [f"v{i}" for i in range(n)]) for n in (100, 500, 1000, 2000)]
    texts.append(" ".join(rng.sample(words, 2000)))
    rows = syncmers.with_sketch(docs_of(texts, clashing=False).select("doc_id", "text"), "text", "sketch").collect()
    sketches = [r.sketch for r in sorted(rows, key=lambda r: r.doc_id)]
    near = [plain_likeness(sketches[0], s) for s in sketches[1:]]
    for x, share in zip(near, (0.905, 0.6, 0.333, 0.0, 0.0)):
        assert abs(x - share) < 0.17
