import math

import pytest
from pilespan.llm import mixing
from pilespan.llm.common import only
from pyspark.sql import functions as F


def plain_targets(sizes):
    """{source: target} by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    cap, full, total = {s: 2 * sizes[s] for s in names}, set(), 1.5 * sum(sizes.values())
    while True:
        left, w = total - sum(cap[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / w > cap[s]}
        if not over:
            return {s: cap[s] if s in full else left * weight[s] / w for s in names}
        full |= over


@pytest.mark.parametrize("case", range(4))
def test_targets_and_takes(spark, docs_of, case):
    sources = [["a", "b", "c", "d", None], ["z", "é", "Z"], ["one"], ["a", "b", "c", "d", "e", "f", "g"]][case]
    rows = [(i, " ".join(["w"] * ((i * 7919 + case) % 97))) for i in range(400)]
    df = docs_of(rows)
    pick = F.array(*[F.lit(s) for s in sources])
    df = df.withColumn("source", F.element_at(pick, (F.floor(F.sqrt(F.col("doc_id"))) % len(sources) + 1).cast("int")))
    got = mixing.take(only(df, "doc_id", "text", "source")).collect()
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r._size
        assert r._size == len(r.text.split()) and 0 <= r._taken <= 2 * r._size and 0 <= r._shard < mixing.SHARDS
    expected = plain_targets(sizes)
    for s, target in expected.items():
        own = [r for r in got if r.source == s]
        assert own[0]._target == pytest.approx(target) and own[0]._source_size == sizes[s]
        assert abs(sum(r._taken for r in own) - target) <= 0.5
    again = mixing.take(only(df.repartition(5), "doc_id", "text", "source")).collect()
    assert sorted((r.doc_id, r._taken, r._shard) for r in got) == sorted((r.doc_id, r._taken, r._shard) for r in again)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    taken = {}
    for r in only(out, "doc_id", "text").collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert {k: v for k, v in taken.items() if v} == {r.doc_id: r._taken for r in got if r._taken}


def test_odd_rows(docs_of, odd_texts, spark):
    rows = [(None if i % 5 == 0 else i, t) for i, t in enumerate(odd_texts)] + [(1, "same text"), (1, "same text")]
    got = mixing.take(only(docs_of(rows), "doc_id", "text", "source")).collect()
    assert len(got) == len(rows) and all(r._taken <= 2 * r._size for r in got)
    assert mixing.mixed(docs_of(rows)).count() > 0
    assert mixing.take(only(docs_of(rows).limit(0), "doc_id", "text", "source")).count() == 0
    assert all(r._taken == 0 and r._target == 0 for r in mixing.take(only(docs_of([None, ""]), "doc_id", "text", "source")).collect())


@pytest.mark.parametrize("share", [0.75, 1.5])
def test_every_shard_has_the_mix(spark, share):
    rows = spark.range(48000).select(F.col("id").alias("doc_id"), F.lit("w x y z").alias("text"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("source"))
    got = mixing.take(rows, share).groupBy("source", "_shard").agg(F.sum("_taken").alias("taken"), F.first("_target").alias("target")).collect()
    taken = {(r.source, r._shard): r.taken / (r.target / mixing.SHARDS) for r in got}
    assert len(taken) == 3 * mixing.SHARDS
    for s in "abc":
        own = [taken[s, x] for x in range(mixing.SHARDS)]
        assert sum(own) == pytest.approx(mixing.SHARDS, abs=0.01) and 0.4 < min(own) and max(own) < 1.8, own


def test_the_mix_is_in_order_of_its_shards(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w x "), F.col("id")).alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    place = {r.doc_id: (r._shard, r._key) for r in mixing.take(rows).collect()}
    out = [place[r.doc_id] for r in mixing.mixed(rows).collect()]
    assert out == sorted(out) and len({s for s, _ in out}) == mixing.SHARDS


def test_tree_deals_exact_quotas(spark):
    quotas = [7, 100, 0, 1, 4000]
    df = spark.createDataFrame(list(enumerate(quotas)), "turn int, blocks long")
    shards = 11
    ends = {r.turn: r.ends for r in mixing.split(df, shards, 3).collect()}
    parts = {t: [b - a for a, b in zip([0, *e], e)] for t, e in ends.items()}
    for t, q in enumerate(quotas):
        assert len(parts[t]) == shards and sum(parts[t]) == q and min(parts[t]) >= 0
    total = sum(quotas)
    for s in range(shards):  # shards differ by the rounding of the tree's halves only
        assert abs(sum(parts[t][s] for t in parts) - total / shards) <= math.log2(shards) + 1


def test_draws_follow_the_law(spark):
    rows = spark.range(4000).select(mixing._draw(F.lit(50), F.lit(20), F.lit(10), F.lit(1), F.col("id")).alias("x")).toPandas().x
    mean, var = 10 * 20 / 50, 10 * 0.4 * 0.6 * (40 / 49)
    assert abs(rows.mean() - mean) < 0.1 and abs(rows.var() - var) < 0.2 and rows.between(0, 10).all()
    exact = [math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10) for k in range(11)]
    for k, p in enumerate(exact):
        assert abs((rows == k).mean() - p) < 0.03


def test_no_python_on_executors(spark):
    plan = mixing.op9_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
