"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def region_key(region: Column | str) -> Column:
    """A chromosome's name without a leading "chr": the key that all sources are joined by."""
    return F.regexp_replace(column(region), "^chr", "")


def complement(base: Column | str) -> Column:
    """The complementary bases of a text of bases; other letters stay."""
    return F.translate(column(base), "ACGT", "TGCA")


def complement_counts(counts: Column | str) -> Column:
    """Counts of A, C, G, T as counts of the complementary bases."""
    return F.reverse(column(counts))


def two_decimals(x: Column | str) -> Column:
    """With two decimals, halves to even as in C's printf; below 1000."""
    return F.format_number(column(x).cast("double"), 2)


def safe_share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def bit(flag: Column | str, mask: int) -> Column:
    return column(flag).bitwiseAND(mask) != 0


def counts_text(counts: Column | str) -> Column:
    """[a, c, g, t]"""
    return F.concat(F.lit("["), F.array_join(F.transform(column(counts), lambda x: x.cast("string")), ", "), F.lit("]"))


def parse_counts(text: Column | str) -> Column:
    return F.from_json(column(text), "array<bigint>")


def hms(seconds: Column | str) -> Column:
    """hh:mm:ss of a number of seconds, hours beyond a day included."""
    s = column(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", F.when(s >= 360000, F.floor(s / 3600).cast("string")).otherwise(two(F.floor(s / 3600))), two(F.floor(s / 60) % 60), two(s % 60))


def stem(path: Column | str) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(column(path), r"([^/]+)/*$", 1), r"\.[^.]*$", "")
