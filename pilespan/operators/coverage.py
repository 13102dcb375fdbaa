"""Depth, weights and intervals of balanced weight."""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Region
from .positions import clip

WIDEST, GENOME = 3_000_000, 3_000_000_000


def depth(pairs: DataFrame, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """(keys, position, depth) of aligned bases (keys, pos0); positions without a base have no row."""
    return pairs.groupBy(*keys, (F.col("pos0") + 1).alias("position")).agg(F.count("*").alias("depth"))


def weight(depth_column: str = "depth"):
    """The cube of a depth, as a decimal: cubes of deep positions leave 64 bits."""
    d = F.col(depth_column).cast("decimal(12,0)")
    return (d * d).cast("decimal(25,0)") * d


def total_weight(coverage: DataFrame, region: Region | None = None):
    """One row: total, the sum of the weights in the region."""
    if region is not None:
        coverage = clip(coverage.withColumn("pos0", F.col("position") - 1), region)
    return coverage.agg(F.coalesce(F.sum(weight()), F.lit(0)).cast("decimal(38,0)").alias("total"))


INTERVALS = "region string, start long, end long, weight decimal(38,0), width long, reason string"


def greedy_intervals(coverage: DataFrame, size: int, total: int | None = None, region: Region | None = None, exclude_regions: tuple[str, ...] = ()) -> DataFrame:
    """Intervals (region, start, end, weight, width, reason) of coverage (region, position, depth).

    Positions are taken in order. Before one is added, the open interval is closed if it weighs at least
    total // size, or is wider than the widest that is allowed; a chromosome's end closes it too.
    What closes an interval depends on all before it, so a chromosome is one sorted stream; the rows flow
    through in batches and only sums are kept.
    """
    if region is not None:
        coverage = clip(coverage.withColumn("pos0", F.col("position") - 1), region).drop("pos0")
    # a scalar subquery of the same plan, unless the total is known
    whole = total_weight(coverage).scalar() if total is None else F.lit(decimal.Decimal(total)).cast("decimal(38,0)")
    widest = min(WIDEST, GENOME // size)
    rows = coverage.where(~F.col("region").isin(*exclude_regions)) if exclude_regions else coverage
    rows = rows.select("region", F.col("position").cast("long").alias("position"), F.col("depth").cast("long").alias("depth"), whole.cast("string").alias("total"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, start, end, held, goal = None, None, None, 0, None
        done: list[tuple] = []

        def close(reason: str) -> None:
            nonlocal start, end, held
            if start is not None:
                done.append((name, start, end, held, end - start, reason))
            start, end, held = None, None, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            goal = int(batch.column("total")[0].as_py()) // size
            regions = batch.column("region").dictionary_encode()
            codes = regions.indices.to_numpy(zero_copy_only=False)
            edges = np.nonzero(np.r_[True, codes[1:] != codes[:-1]])[0]
            for a, b in zip(edges, np.r_[edges[1:], len(codes)]):
                here = regions.dictionary[int(codes[a])].as_py()
                if here != name:
                    close("END_OF_CHROMOSOME")
                    name = here
                position, depths = (np.asarray(batch.column(c))[a:b] for c in ("position", "depth"))
                small = len(depths) * int(depths.max()) ** 3 < 1 << 62
                upto = np.cumsum(depths**3) if small else np.cumsum(depths.astype(object) ** 3)
                at = 0
                while at < len(position):
                    if start is not None:
                        if held >= goal:
                            close("WEIGHT")
                        elif end - start > widest:
                            close("MAX_WIDTH")
                    if start is None:
                        start, end, before = int(position[at]), int(position[at]), int(upto[at - 1]) if at else 0
                    else:
                        before = (int(upto[at - 1]) if at else 0) - held
                    # the first place after which the interval is heavy, and the first that is too far
                    heavy = int(np.searchsorted(upto, goal + before))
                    far = int(np.searchsorted(position, start + widest, side="right"))
                    last = min(max(min(heavy, far), at), len(position) - 1)
                    held, end, at = int(upto[last]) - before, int(position[last]), last + 1
            if done:
                yield _interval_batch(done)
                done = []
        if held > 0:
            close("END_OF_CHROMOSOME")
        if done:
            yield _interval_batch(done)

    return rows.repartition("region").sortWithinPartitions("region", "position").mapInArrow(walk, INTERVALS)


def _interval_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = pa.string(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.string()
    columns = list(zip(*rows))
    columns[3] = [decimal.Decimal(x) for x in columns[3]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["region", "start", "end", "weight", "width", "reason"])


def fixed_intervals(lengths: DataFrame, step: int = 10_000_000, mitochondrial_parts: int = 100) -> DataFrame:
    """(region, start, end), 1-based inclusive slices of chromosomes (region, length); chrM in parts."""
    width = F.when(F.col("region").isin("chrM", "M", "MT"), F.greatest(F.lit(1), (F.col("length") / mitochondrial_parts).cast("long"))).otherwise(F.lit(step).cast("long"))
    rows = lengths.where("length > 0").withColumn("_step", width)
    rows = rows.select("region", "length", "_step", F.explode(F.expr("sequence(1L, cast(length as bigint), _step)")).alias("start"))
    return rows.select("region", "start", F.least(F.col("start") + F.col("_step") - 1, F.col("length").cast("long")).alias("end"))
