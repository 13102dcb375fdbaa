import numpy as np
import pytest
import xxhash
from pilespan.llm import near_dedup, simhash
from pilespan.llm.components import components
from pilespan.llm.covering import Covering, flips_within
from pyspark.sql import functions as F


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([b" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_components(fps, threshold):
    """{index: smallest index reached}"""
    out = list(range(len(fps)))
    while True:
        new = [min(out[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= threshold) for i in range(len(fps))]
        if new == out:
            return out
        out = new


def test_fingerprints_and_components(docs_of, odd_texts):
    got = {r.doc_id: r for r in simhash.simhash_components(docs_of(odd_texts)).collect()}
    fps = [plain_fingerprint(t) for t in odd_texts]
    assert [got[i].fp & (2**64 - 1) for i in range(len(fps))] == fps
    assert [got[i].component_id for i in range(len(fps))] == plain_components(fps, 2)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


@pytest.mark.parametrize("threshold,crowd", [(0, 64), (1, 64), (2, 64), (2, 1), (3, 64), (3, 1), (4, 2)])
def test_links_join_what_brute_force_joins(spark, threshold, crowd):
    rng = np.random.default_rng(threshold)
    fps = [int(x) for x in rng.integers(0, 2**64, 6, dtype=np.uint64)]
    while len(fps) < 90:
        x = fps[int(rng.integers(0, len(fps)))]
        for _ in range(int(rng.integers(1, 4))):
            x ^= 1 << int(rng.integers(0, 64))
        fps.append(x)
    fps = sorted(set(fps), key=signed)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = simhash.linked_fingerprints(df, threshold, crowd=crowd)
    for r in links.collect():
        assert ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= threshold
    roots = {r.node: r.root for r in components(links).collect()}
    expected = plain_components(fps, threshold)
    assert [roots.get(signed(x), signed(x)) for x in fps] == [signed(fps[i]) for i in expected]


def test_codes_cover():
    code = Covering()
    x = np.random.default_rng(0).integers(0, 2**64, 4000, dtype=np.uint64)
    home = code.home(x)
    assert (code.home(home) == home).all() and np.bitwise_count(x ^ home).max() <= code.radius
    assert len(flips_within(2)) == 1 + 64 + 64 * 63 // 2


def test_null_ids_and_repeats(docs_of, spark):
    got = simhash.simhash_components(docs_of([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (9, "q r s t u")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == [(False, 7, 7), (False, 7, 7), (False, 9, 9), (True, 0, 7)]
    assert simhash.simhash_components(docs_of([(1, "x")]).limit(0)).count() == 0


def test_components_of_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n) if i % 100 != 99] + [(5, 5), (None, 3), (2, 1)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == i // 100 * 100 for i in range(n)) and components(edges.limit(0)).count() == 0


def test_near_duplicates(docs_of):
    rng = np.random.default_rng(1)
    word = lambda: "w" + str(rng.integers(0, 5000))
    base = [[word() for _ in range(n)] for n in (120, 200, 400, 300, 30)]
    texts = [" ".join(b) for b in base]
    for b in base[:4]:
        near = list(b)
        near[len(b) // 2] = "changed"  # five of the shingles
        texts.append(" ".join(near).upper())
        far = list(b)
        for i in range(0, len(b), 8):
            far[i] = "other" + str(i)
        texts.append(" ".join(far))
    texts += [texts[0], None, "", "two words", "two words"]
    got = {r.doc: r.root_doc for r in near_dedup.near_duplicates(docs_of(texts)).collect()}
    expected = {i: i for i in range(len(texts))} | {5: 0, 7: 1, 9: 2, 11: 3, 13: 0, 15: 14, 17: 16}
    assert got == expected
    kept = near_dedup.drop_near_duplicates(docs_of(texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values())) and kept.columns == docs_of(texts).columns


def test_crowd_of_near_copies(docs_of):
    rng = np.random.default_rng(2)
    base = ["w" + str(x) for x in rng.integers(0, 9999, 400)]
    texts = []
    for i in range(300):
        own = list(base)
        own[int(rng.integers(0, 400))] = f"n{i}"
        texts.append(" ".join(own))
    groups = near_dedup.near_duplicates(docs_of(texts + ["nothing of the kind at all"]))
    assert {r.root_doc for r in groups.collect()} == {0, 300}
    assert groups.select(F.countDistinct("root_doc")).first()[0] == 2
