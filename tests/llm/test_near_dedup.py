import random

import numpy as np
import pytest
from pilespan.llm import near_dedup
from pilespan.llm.common import cut
from pyspark.sql import functions as F


def crowd(spark, n, near, apart, seed=1):
    """Nodes whose sketches differ in a share `apart` of the bits, and after them mates of the first `near`, at a similarity of 0.85."""
    rng = np.random.default_rng(seed)
    bits = 64 * near_dedup.SKETCH_WORDS
    one = (1 - np.sqrt(1 - 2 * apart)) / 2
    texts = rng.integers(0, 2, bits).astype(bool) ^ (rng.random((n, bits)) < one)
    mates = texts[:near] ^ (rng.random((near, bits)) < near_dedup.share_apart(0.85))
    made = np.packbits(np.concatenate((texts, mates)), axis=1, bitorder="little")
    names = rng.permutation(1 << 20)[: n + near].tolist()
    return names, spark.createDataFrame([(i, bytearray(x.tobytes()), 100) for i, x in zip(names, made)], "node long, sketch binary, n long")


def linked(spark, pairs, names, n, near):
    """How many mates are in one group with their text, by the pairs that are sure or of mates."""
    at = {name: i for i, name in enumerate(names)}
    mates = spark.createDataFrame([(*sorted((names[i], names[n + i])), True) for i in range(near)], "u long, v long, mate boolean")
    pairs = pairs.join(mates, ["u", "v"], "left").where("sure or mate").collect()
    ends = np.array([(at[r.u], at[r.v]) for r in pairs]).reshape(-1, 2)
    root = near_dedup._forest(n + near, ends[:, 0], ends[:, 1])
    return int((root[n:] == root[:near]).sum())


@pytest.mark.parametrize("cell", [512, 100])
def test_mates_in_a_crowd_meet(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dedup, "CELL", cell, raising=False)
    n, near = 2000, 200
    names, nodes = crowd(spark, n, near, near_dedup.share_apart(0.75))
    met = cut(near_dedup.meeting(nodes, 0.8), "met")
    members, alone = cut(near_dedup.crowds(met), "members"), spark.createDataFrame([], "node long, root long")
    pairs = met.where("sure is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sure")
    for what, sure in (("sure", True), ("all", False)):
        pairs = pairs.union(near_dedup.compared(members, nodes, alone, 0.8, what).select("u", "v", F.lit(sure)))
    found = linked(spark, pairs, names, n, near)
    print(f"{found} of {near} mates met in a crowd of {n}")
    assert found >= 0.95 * near


def test_every_pair_at_a_key_is_compared():
    rng = np.random.default_rng(2)
    keys, nodes = np.repeat([1, 5, 9], [1, 40, 64]), rng.permutation(105)
    words = rng.integers(0, 1 << 6, 105).astype(np.uint64)
    expected = {tuple(sorted((int(nodes[i]), int(nodes[j])))) for i in range(105) for j in range(i) if keys[i] == keys[j] and int(words[i] ^ words[j]).bit_count() <= 2}
    assert set(map(tuple, near_dedup._meet(keys, nodes, words, 2).tolist())) == expected


def test_nearest_is_one_for_each_text(spark):
    names, nodes = crowd(spark, 300, 0, near_dedup.share_apart(0.8))
    members = spark.createDataFrame([(1, x, 1) for x in names], "key long, node long, parts int")
    alone = spark.createDataFrame([], "node long, root long")
    every = {(r.u, r.v): r.apart for r in near_dedup.compared(members, nodes, alone, 0.8, "all").collect()}
    nearest = {(r.u, r.v): r.apart for r in near_dedup.compared(members, nodes, alone, 0.8, "nearest").collect()}
    assert nearest.items() <= every.items() and len(nearest) <= 300 < len(every)
    best = {}
    for (u, v), apart in every.items():
        for x in (u, v):
            best[x] = min(apart, best.get(x, apart))
    assert all(any(x in pair and a == best[x] for pair, a in nearest.items()) for x in best)
    grouped = spark.createDataFrame([(x, 7) for x in names], "node long, root long")
    assert near_dedup.compared(members, nodes, grouped, 0.8, "all").count() == 0


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_groups_by_brute_force(spark, docs_of):
    """Groups of texts that share 0.8 of their shingles, among them a large group of near copies."""
    rng = random.Random(8)

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        return words

    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = [edited(base, rng.randrange(3)) for _ in range(250)]
    texts += [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))] for _ in range(80)]
    texts += [edited(t, rng.choice([0, 1, 1, 2])) for t in texts[250:] for _ in range(2)]
    texts = [" ".join(t) for t in texts]
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    expected = near_dedup._forest(len(texts), *np.array(pairs).T)
    got = {r.doc: r.root_doc for r in near_dedup.near_duplicates(docs_of(list(enumerate(texts)), clashing=False)).collect()}
    assert all(expected[got[i]] == expected[i] for i in got)  # nothing else is joined
    same = sum(got[i] == got[j] for i, j in pairs)
    print(f"{same} of {len(pairs)} pairs")
    assert same >= 0.95 * len(pairs)
