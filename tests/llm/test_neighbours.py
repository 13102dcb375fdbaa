import numpy as np
import pytest
from pilespan.llm import neighbours
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, wanted, k):
    """{query: [(id, score)]}"""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], dtype=np.float64)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for n, i in enumerate(ids):
        if wanted(i):
            s = u @ u[n]
            out[i] = sorted(((round(-s[m], 12), j) for m, j in enumerate(ids) if j != i))[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def recall(got, expected):
    hit = sum(len({v for _, v in expected[q]} & {r.vec_id for r in rows}) for q, rows in got.items())
    return hit / sum(map(len, expected.values()))


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


@pytest.mark.parametrize(("fit_rows", "first_rows"), [(neighbours.FIT_ROWS, neighbours.FIRST_ROWS), (neighbours.FIT_ROWS, 64), (512, 64)])
def test_recall_on_the_table(spark, monkeypatch, fit_rows, first_rows):
    """Also where the sample is a small share of the rows, as on large tables."""
    monkeypatch.setattr(neighbours, "FIT_ROWS", fit_rows)
    monkeypatch.setattr(neighbours, "FIRST_ROWS", first_rows)
    fitted, fit = [], neighbours.fit_lists
    monkeypatch.setattr(neighbours, "fit_lists", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    dir_ = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{dir_}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    rows = list(zip(data.vec_id.tolist(), data.embedding.tolist()))
    expected = brute(rows, lambda i: i % 50 == 0, 5)
    got = by_query(neighbours.op10_neighbours(spark, dir_))
    print(f"sample {fit_rows}, first {len(fitted[0].ids)} of {len(rows)}, {fitted[0].probes} of {len(fitted[0].centres)} lists, recall {recall(got, expected):.4f}")
    assert set(got) == set(expected) and recall(got, expected) >= 0.9
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, own in got.items():
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        for r in own:
            a, b = vectors[q], vectors[r.vec_id]
            assert abs(r.score - (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())) < 1e-12
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


def test_exact_on_a_few(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(9).astype(np.float32)) for i in range(150)]
    rows += [(150 + i, rows[0][1]) for i in range(20)] + [(-3, rows[1][1] * 7)]
    got = by_query(neighbours.nearest(table(spark, rows), "id % 10 = 0", 5))
    expected = brute(rows, lambda i: i % 10 == 0, 5)
    assert set(got) == set(expected) and recall(got, expected) >= 0.9
    assert [r.vec_id for r in got[0]] == [150, 151, 152, 153, 154]


def test_rows_that_take_no_part(spark):
    good = [(0, [1, 0]), (50, [1, 1]), (7, [0, 1])]
    bad = [(1, None), (2, [0, 0]), (3, [None, 1]), (4, [float("nan"), 1]), (5, [float("inf"), 0]), (None, [1, 0]), (6, []), (8, [1, 2, 3])]
    got = by_query(neighbours.nearest(table(spark, good + bad).withColumn("ID", F.lit(1)).withColumn("v", F.lit(1)), "id % 50 = 0", 5))
    assert {q: [r.vec_id for r in rows] for q, rows in got.items()} == {0: [50, 7], 50: [0, 7]}
    assert neighbours.nearest(table(spark, bad[:3]), "true").count() == 0
    assert neighbours.nearest(table(spark, []), "true").count() == 0
    assert neighbours.nearest(table(spark, good[:1]), "true").count() == 0


def test_repeated_ids_and_sizes(spark):
    rows = [(0, [1e-200, 0.0]), (0, [1e-200, 0.0]), (1, [1e200, 1e199]), (1, [1e200, 1e199]), (2, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, "id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2] and abs(got[0].score - 1 / np.sqrt(1.01)) < 1e-9


def test_repeated_rows_hide_nothing(spark):
    """Copies of rows, and of one id near a query, use up no places."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(12)) for i in range(1000)]
    close = [(5000, rows[0][1] + 0.01 * rng.standard_normal(12)) for _ in range(9)]
    got = by_query(neighbours.nearest(table(spark, rows * 2 + close), "id % 50 = 0", 5))
    expected = brute(rows + close[:1], lambda i: i % 50 == 0, 5)
    assert all(len({r.vec_id for r in own}) == 5 for own in got.values()) and recall(got, expected) >= 0.9
    assert got[0][0].vec_id == 5000 and [r.vec_id for r in got[0]][1:] == [i for _, i in expected[0][1:]]


def test_hot_vector_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 16)
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(8)
    rows = [(i, hot if i % 3 else rng.standard_normal(8)) for i in range(300)]
    got = by_query(neighbours.nearest(table(spark, rows), "id % 50 = 1", 5))
    assert got[1] and all([r.vec_id for r in rows_] == [i for i in range(1, 20) if i % 3 and i != q][:5] for q, rows_ in got.items() if q % 3)


def test_pruning_keeps_the_nearest():
    rng = np.random.default_rng(3)
    held = rng.standard_normal((2000, 64))
    turned = neighbours._unit(held) @ np.linalg.qr(rng.standard_normal((64, 64)))[0]
    rotation = np.linalg.lstsq(neighbours._unit(held), turned, rcond=None)[0]
    asked = held[:40] + 0.3 * rng.standard_normal((40, 64))
    own = np.zeros((40, 2000), dtype=bool)
    i, j = neighbours.scan(asked, np.full(40, np.inf), np.arange(2000), turned, rotation, 5, own)
    hit = 0
    for n, q in enumerate(asked):
        left = j[i == n]
        nearest = np.argsort(-(neighbours._unit(held) @ neighbours._unit(q[None])[0]))[:5]
        hit += len(set(nearest) & set(left.tolist()))
        assert len(left) < 50
    assert hit >= 0.97 * 200


def test_best_counts_an_id_once():
    query, ids, scores = np.array([7, 7, 7, 7, 3, 3]), np.array([5, 5, 1, 9, 2, 4]), np.array([0.1, 0.9, 0.5, 0.5, 0.2, 0.2])
    top = neighbours.best(query, ids, scores, 2)
    assert [(query[x], ids[x], scores[x]) for x in top] == [(3, 2, 0.2), (3, 4, 0.2), (7, 5, 0.9), (7, 1, 0.5)]
