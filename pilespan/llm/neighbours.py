"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Vectors are dealt to the lists of a k-means fitted on a bounded sample of about FIT_ROWS rows; every row is in a list. A
query visits the lists whose centres are nearest. There all vectors are rotated at random and compared in blocks of columns:
after d of D dimensions the partial distance, scaled up, is tested against the distance of the fifth nearest so far, and a
candidate that is too far with high confidence is given up. A query brings the distance of its fifth
nearest in the sample along, so the tests bite in every list; these five are candidates too. What is left is scored in double precision on the
original vectors. Of rows with the same vector only the k + 1 least ids can be an answer, so only these are
candidates; lists are cut into parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, only, scratch

#: Rows on which lists are fitted and probes set (about); rows of them that queries are compared with first; most lists; rows of a part of a list.
FIT_ROWS, FIRST_ROWS, MOST_LISTS, PART_ROWS = 32768, 4096, 1024, 4096
#: Columns compared at once; how sure a test has to be (about: standard deviations); queries compared at once.
COLUMNS, CONFIDENCE, QUERIES_AT_ONCE = 16, 2.5, 256
#: Recall that the probes have to reach on the sample.
RECALL = 0.94


@dataclass
class Lists:
    """centres: unit rows; rotation: orthogonal; probes: lists that a query visits; ids and sample: rows that it is compared with first."""

    centres: np.ndarray
    rotation: np.ndarray
    probes: int
    ids: np.ndarray
    sample: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def kth(distances: np.ndarray, ids: np.ndarray, k: int, alone: bool) -> float:
    """The k-th least distance, each id counted once; infinite if there are fewer ids. alone: no id repeats."""
    if len(distances) < k:
        return np.inf
    if alone:
        return float(np.partition(distances, k - 1)[k - 1])
    order = np.argsort(distances, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    return float(distances[order[first[k - 1]]]) if len(first) >= k else np.inf


def fit_lists(ids: np.ndarray, sample: np.ndarray, n: int, k: int, seed: int = 0) -> Lists:
    """Spherical k-means on the sample, and the fewest probes that reach RECALL inside it.

    The lists come from one half, the probes from the other, whose rows the lists haven't seen. Neighbours are
    nearer in the whole table than in the sample, so recall is higher there.
    """
    rng = np.random.default_rng(seed)
    every = _unit(sample.astype(np.float64))
    x, others = (every[::2], every[1::2]) if len(every) > 3 * k else (every, every)
    lists = int(max(1, min(MOST_LISTS, 2 * np.sqrt(n), len(x) // 16)))
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        near = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        lone = (sums * sums).sum(1) < 1e-18
        sums[lone] = x[rng.choice(len(x), int(lone.sum()))]
        centres = _unit(sums)
    near = np.concatenate([(others[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(others), 4096)])
    asked = rng.choice(len(others), min(len(others), 512), replace=False)
    likes = others[asked] @ others.T
    likes[np.arange(len(asked)), asked] = -2
    found = np.argsort(-likes, axis=1)[:, : min(k, len(others) - 1)]
    place = np.argsort(np.argsort(-(others[asked] @ centres.T), axis=1), axis=1)
    needed = np.take_along_axis(place, near[found], 1).ravel()
    probes = int(np.quantile(needed, RECALL, method="higher")) + 1 if needed.size else lists
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    return Lists(centres, rotation, min(lists, probes), ids[:FIRST_ROWS], sample[:FIRST_ROWS])


def scan(asked: np.ndarray, bounds: np.ndarray, ids: np.ndarray, turned: np.ndarray, rotation: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row), ascending, of the rows that may be among a query's k nearest.

    bounds: squared distances that the k nearest don't exceed; ids and turned: the rows, of unit length and
    rotated; own: mask (queries x rows) of rows that are the query's own. Each pair is given up by itself; while
    many are left they are compared as a matrix.
    """
    d, alone = turned.shape[1], len(np.unique(ids)) == len(ids)
    queries = _unit(asked) @ rotation
    seeds = 2 - 2 * (queries @ turned[: 8 * k].T)
    seeds[own[:, : 8 * k]] = np.inf
    limit = np.minimum(bounds, [kth(row, ids[: 8 * k], k, alone) + 1e-9 for row in seeds])
    alive, partial, i, j = ~own, np.zeros(own.shape), None, None
    for at in range(0, d, COLUMNS):
        block = slice(at, min(d, at + COLUMNS))
        seen = block.stop
        slack = (1 + CONFIDENCE / np.sqrt(seen)) ** 2 * seen / d if seen < d else 1.0
        most = limit * slack + 1e-9
        q, t = queries[:, block], turned[:, block]
        if i is None:
            partial += (q * q).sum(1)[:, None] + (t * t).sum(1)[None, :] - 2 * (q @ t.T)
            alive &= partial <= most[:, None]
            if 4 * np.count_nonzero(alive) < alive.size:
                i, j = np.nonzero(alive)
                partial = partial[i, j]
        else:
            partial = partial + ((t[j] - q[i]) ** 2).sum(1)
            keep = partial <= most[i]
            i, j, partial = i[keep], j[keep], partial[keep]
    if i is None:
        i, j = np.nonzero(alive)
        partial = partial[i, j]
    edges = np.searchsorted(i, np.arange(len(queries) + 1))
    keep = np.zeros(len(i), dtype=bool)
    for a, b in zip(edges[:-1], edges[1:]):
        keep[a:b] = partial[a:b] <= kth(partial[a:b], ids[j[a:b]], k, alone) + 1e-9
    return i[keep], j[keep]


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, each id counted once; ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    fresh = np.sort(np.unique(np.stack([query[order], ids[order]], 1), axis=0, return_index=True)[1]) if len(order) else order
    order = order[fresh]
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """(id, v) of the rows that take part: an id, and a vector with no null, no non-finite component
    and not all zero; among them those with the commonest number of dimensions (ties: the least).
    """
    good = only(rows, "vec_id", "embedding").where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    good = good.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("v") == (sizes["d"] if sizes else 0))


def nearest(rows: DataFrame, queries: str, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which `queries` (SQL on id) holds.

    rows: vec_id, embedding. A query's own id isn't a candidate; a repeated id counts once, by its
    best score; ties go to the smaller id. Fewer rows come only where there are fewer candidates.
    Nulls are left out as usable() says, other columns are ignored, and no usable rows give no rows.
    """
    with scratch(rows.sparkSession) as work:
        return _nearest(rows, queries, k, work)


def _nearest(rows: DataFrame, queries: str, k: int, work: Scratch) -> DataFrame:
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    good = usable(rows)
    n = good.count()
    if not n:
        return spark.createDataFrame([], schema)
    drawn = good.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / n) * (1 << 30))).orderBy(F.xxhash64("id", "v"), "id").limit(2 * FIT_ROWS).toPandas()
    drawn = drawn if len(drawn) else good.limit(1).toPandas()
    fitted = fit_lists(drawn["id"].to_numpy(np.int64), np.array(drawn["v"].tolist(), dtype=np.float64), n, k)
    lists = spark.sparkContext.broadcast(fitted)  # at most MOST_LISTS centres and FIRST_ROWS rows

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_unit(_matrix(batch.column("v"))) @ lists.value.centres.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near)], ["id", "v", "list"])

    same = Window.partitionBy("v").orderBy("id")
    least = good.distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("id", "v")
    held = cut(least.mapInArrow(deal, "id long, v array<double>, list int"), "lists")
    sizes = np.zeros(len(lists.value.centres), dtype=np.int64)
    counted = held.groupBy("list").count()
    for r in counted.collect():  # a row a list
        sizes[r["list"]] = r["count"]
    parts = np.maximum(1, -(-sizes // PART_ROWS))

    def in_sample(ids: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """For each query the squared distance of its k-th nearest in the sample, and the places of the k there."""
        known, unit, turned = lists.value.ids, _unit(lists.value.sample), _unit(vectors)
        alone = len(np.unique(known)) == len(known)
        for at in range(0, len(ids), QUERIES_AT_ONCE):
            far = 2 - 2 * (turned[at : at + QUERIES_AT_ONCE] @ unit.T)
            far[ids[at : at + QUERIES_AT_ONCE, None] == known[None, :]] = np.inf
            for row in far:
                bound = kth(row, known, k, alone) + 1e-9
                yield bound, np.nonzero((row <= bound) & (row < np.inf))[0]

    def first_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = lists.value.sample
        for batch in batches:
            if batch.num_rows:
                ids, vectors = np.asarray(batch.column("id")), _matrix(batch.column("v"))
                for q, v, (_, near) in zip(ids.tolist(), vectors, in_sample(ids, vectors)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q)), pa.array(lists.value.ids[near]), pa.array(_cosine(np.broadcast_to(v, (len(near), len(v))), sample[near]))], ["query_id", "vec_id", "score"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = np.asarray(batch.column("id")), _matrix(batch.column("v"))
            order = np.argsort(-(_unit(vectors) @ lists.value.centres.T), axis=1, kind="stable")
            bounds = [bound for bound, _ in in_sample(ids, vectors)]
            upto = np.cumsum(sizes[order], axis=1) - sizes[order]
            for at, (row, before) in enumerate(zip(order, upto)):
                # on until there are candidates enough
                took = row[: max(lists.value.probes, int(np.searchsorted(before, 2 * k + 1)))]
                took = took[sizes[took] > 0]
                name, part = np.repeat(took, parts[took]), np.concatenate([np.arange(parts[x]) for x in took])
                again = pa.array(np.full(len(name), at))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(again), batch.column("v").take(again), pa.array(name.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(name), bounds[at]))], ["id", "v", "list", "part", "bound"])

    rows = "id long, v array<double>, list int, part int, bound double"
    share = F.broadcast(counted.select("list", F.ceil(F.col("count") / PART_ROWS).alias("parts")))  # a row a list
    candidates = held.join(share, "list").withColumn("part", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.col("parts")).cast("int"))
    asked = good.where(queries).distinct().select("id", "v")
    asking = asked.mapInArrow(visit, rows)
    met = candidates.select("id", "v", "list", "part", F.lit(None).cast("double").alias("bound")).union(asking)
    met = met.repartition("list", "part").sortWithinPartitions("list", "part", F.col("bound").isNotNull(), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, turned = None, None, None, None
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.stack([np.asarray(batch.column("list")), np.asarray(batch.column("part"))], 1)
            bounds = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
            asks, who, vectors = ~np.isnan(bounds), np.asarray(batch.column("id")), _matrix(batch.column("v"))
            edges = np.nonzero(np.r_[True, (groups[1:] != groups[:-1]).any(1) | (asks[1:] != asks[:-1])])[0]
            for a, b in zip(edges, np.r_[edges[1:], len(asks)]):
                if tuple(groups[a]) != now:
                    now, gathered, ids = tuple(groups[a]), [], None
                if not asks[a]:
                    gathered.append((who[a:b], vectors[a:b]))
                    continue
                if ids is None and gathered:
                    ids, rows = np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered])
                    turned = _unit(rows) @ lists.value.rotation
                if ids is None:
                    continue
                for c in range(a, b, QUERIES_AT_ONCE):
                    e = min(b, c + QUERIES_AT_ONCE)
                    i, j = scan(vectors[c:e], bounds[c:e], ids, turned, lists.value.rotation, k, who[c:e, None] == ids[None, :])
                    scores = _cosine(vectors[c:e][i], rows[j])
                    top = best(who[c:e][i], ids[j], scores, k)
                    yield pa.RecordBatch.from_arrays([pa.array(who[c:e][i[top]]), pa.array(ids[j[top]]), pa.array(scores[top])], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(compare, "query_id long, vec_id long, score double")
    found = found.union(asked.mapInArrow(first_found, found.schema)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return work.last(found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of a and of b in double precision; equal pairs get equal values. Scaled where squares leave the range."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        left, right = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        plain = (a * b).sum(1) / (left * right)
    odd = ~(np.isfinite(plain) & (left > 1e-150) & (right > 1e-150) & (left < 1e150) & (right < 1e150))
    if odd.any():
        plain[odd] = (_unit(a[odd]) * _unit(b[odd])).sum(1)
    return np.clip(plain, -1.0, 1.0)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine of every vector whose vec_id is divisible by 50, among all others."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0", 5)
