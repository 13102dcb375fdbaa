"""Sets of positions: splice sites, homopolymers, targets; exclusion and inclusion by them.

Positions are rows (region, pos0); regions are matched without a leading "chr".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Region
from ..functions.scalars import region_key
from .reads import with_end


def splice_positions(sites: DataFrame, span: int = 4) -> DataFrame:
    """(region, pos0) within `span` of splice sites (region, coordinate, kind D/A, strand), on the intron's side.

    The site's coordinate is used against 0-based positions as it stands.
    """
    sign = F.when(F.col("kind").eqNullSafe("D") == F.col("strand").eqNullSafe("+"), F.lit(1)).otherwise(F.lit(-1))
    known = sites.where(F.col("kind").isin("D", "A") & F.col("strand").isin("+", "-"))
    step = F.explode(F.sequence(F.lit(1), F.lit(span))) if span > 0 else F.explode(F.array().cast("array<int>"))
    rows = known.select("region", F.col("coordinate").cast("long").alias("_at"), sign.alias("_sign"), step.alias("_step"))
    return rows.select("region", (F.col("_at") + F.col("_sign") * F.col("_step")).alias("pos0")).distinct()


def target_intervals(rows: DataFrame) -> DataFrame:
    """(region, start0, end0), half open, of 1-based inclusive target rows (region, start, end as text).

    A missing end, or one that is no integer, makes a single position; a header row has no integer start.
    """
    start = F.expr("try_cast(start as bigint)")
    end = F.coalesce(F.expr("try_cast(`end` as bigint)"), start)
    return rows.select("region", (start - 1).alias("start0"), end.alias("end0")).where("start0 is not null and end0 > start0")


def interval_positions(intervals: DataFrame) -> DataFrame:
    """Every distinct position of half-open intervals (region, start0, end0)."""
    return intervals.where("end0 > start0").select("region", F.explode(F.sequence("start0", F.col("end0") - 1)).alias("pos0")).distinct()


def keyed(positions: DataFrame) -> DataFrame:
    return positions.select(region_key("region").alias("_key"), F.col("pos0").alias("_pos0")).distinct()


def exclude(rows: DataFrame, positions: DataFrame | None) -> DataFrame:
    """rows (region, pos0, more) at none of the positions."""
    if positions is None:
        return rows
    at = keyed(positions)
    return rows.join(at, (region_key(rows["region"]) == at["_key"]) & (rows["pos0"] == at["_pos0"]), "left_anti")


def restrict(rows: DataFrame, positions: DataFrame | None) -> DataFrame:
    """rows at the positions; a chromosome without any passes whole, so an empty set restricts nothing."""
    if positions is None:
        return rows
    at = keyed(positions).withColumn("_hit", F.lit(True))
    named = at.select(F.col("_key").alias("_named")).distinct()
    out = rows.withColumn("_region_key", region_key("region"))
    out = out.join(named, out["_region_key"] == named["_named"], "left")
    out = out.join(at, (out["_region_key"] == at["_key"]) & (out["pos0"] == at["_pos0"]), "left")
    return out.where(F.col("_hit").isNotNull() | F.col("_named").isNull()).drop("_region_key", "_named", "_key", "_pos0", "_hit")


def near(reads: DataFrame, positions: DataFrame | None, bin_bits: int = 14) -> DataFrame:
    """The reads (region, start0, cigar) that may touch a position; those of a chromosome without any all stay.

    A bound before reads become bases: a read that spans less than a bin touches positions of its own or the
    next bin only, so the bins with positions, and those before them, are met; longer reads stay.
    """
    if positions is None:
        return reads
    at = keyed(positions)
    own = F.shiftright("_pos0", bin_bits)
    bins = at.select("_key", F.explode(F.array(own, own - 1)).alias("_bin")).distinct().withColumn("_hit", F.lit(True))
    named = at.select(F.col("_key").alias("_named")).distinct()
    out = with_end(reads).withColumn("_read_key", region_key("region"))
    out = out.join(named, out["_read_key"] == named["_named"], "left")
    out = out.join(bins, (out["_read_key"] == bins["_key"]) & (F.shiftright(out["start0"], bin_bits) == bins["_bin"]), "left")
    stay = F.col("_hit").isNotNull() | F.col("_named").isNull() | (F.col("end0") - F.col("start0") > (1 << bin_bits))
    return out.where(stay).select(*[out[c] for c in reads.columns])


def clip(rows: DataFrame, region: Region | None) -> DataFrame:
    """rows whose 1-based position lies in the region, both ends included."""
    if region is None:
        return rows
    out = rows.where(region_key("region") == region_key(F.lit(region.name)))
    return out if region.end is None else out.where(F.col("pos0").between(region.start - 1, region.end - 1))


def interval_overlap(left: DataFrame, right: DataFrame, bin_bits: int = 14) -> DataFrame:
    """Pairs of overlapping half-open intervals: left's columns, then right's as other_start0 and other_end0.

    Both sides are dealt to bins of 2^bin_bits positions and joined by bin; a pair is kept in the first
    bin that both touch, so it comes once.
    """

    def binned(df: DataFrame) -> DataFrame:
        return df.select("*", region_key("region").alias("_key"), F.explode(F.sequence(F.shiftright("start0", bin_bits), F.shiftright(F.col("end0") - 1, bin_bits))).alias("_bin"))

    a = binned(left.where("end0 > start0"))
    b = binned(right.where("end0 > start0").select("region", "start0", "end0")).select("_key", "_bin", F.col("start0").alias("other_start0"), F.col("end0").alias("other_end0"))
    met = a.join(b, ["_key", "_bin"]).where("start0 < other_end0 and other_start0 < end0")
    return met.where(F.col("_bin") == F.shiftright(F.greatest("start0", "other_start0"), bin_bits)).select(*left.columns, "other_start0", "other_end0")
