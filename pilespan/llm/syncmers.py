"""Document fingerprints from closed syncmers, all in DataFrame functions.

A k-mer of words is an anchor if the least of its words' hashes is its first or its last. Whether it is
depends on nothing outside it, so an edit moves no anchor but those it touches, and of any two k-mers in a row one
at least is an anchor. A text's first and last k-mer are anchors too: so every word lies in one. A fingerprint is the SKETCH least hashes of a text's anchors, each with its place in
the text; two fingerprints are compared by the anchors that both have, in the same order.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, only

#: Words of a k-mer; anchors kept in a fingerprint; bits of an anchor's hash and of its place.
K, SKETCH, HASH_BITS, PLACE_BITS = 3, 64, 32, 16
#: Signs of scripts without spaces, each a word of its own; other words are cut after LONGEST code points.
LONE, LONGEST = r"\x{2E80}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}", 64
TOKEN = rf"[{LONE}]|[^\x20\x09-\x0D{LONE}]{{1,{LONGEST}}}"
#: Ranges of document ids: rows of a range (about), and most ranges.
RANGE_ROWS, MOST_RANGES = 2000, 1 << 16


def _hashed(text: Column) -> Column:
    """Hashes of a text's words."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def _edge(words: str) -> str:
    """SQL: the k-mer at place i of an array is an anchor."""
    part = [f"get({words}, i + {j})" for j in range(K)]
    middle = part[1] if K == 3 else f"least({', '.join(part[1:-1])})"
    return f"(i = 0 or i = size({words}) - {K} or {part[0]} <= {middle} or {part[-1]} <= {middle})"


def _kmer(words: str) -> str:
    """SQL: the hash of the k-mer at place i of an array."""
    return f"xxhash64({', '.join(f'get({words}, i + {j})' for j in range(K))}) & {(1 << HASH_BITS) - 1}"


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column `out`: the fingerprint of column `text` (not null), at most SKETCH ascending numbers.

    A number is an anchor's hash and, in its low bits, where the anchor first comes among the text's anchors, from 0 to
    2 ** PLACE_BITS. A text with fewer words than a k-mer has one anchor, all of them.
    """
    words, found = f"_words_{out}", f"_found_{out}"
    df = df.withColumn(words, _hashed(F.col(text)))
    places = f"if(size({words}) < {K}, cast(array() as array<int>), sequence(0, size({words}) - {K}))"
    df = df.withColumn(found, F.expr(f"transform(filter({places}, i -> {_edge(words)}), i -> {_kmer(words)})"))
    df = df.withColumn(found, F.expr(f"if(size({found}) = 0, array(xxhash64({words}) & {(1 << HASH_BITS) - 1}), {found})"))
    place = f"((array_position({found}, h) - 1) * {1 << PLACE_BITS} div size({found}))"
    return df.withColumn(out, F.expr(f"transform(slice(sort_array(array_distinct({found})), 1, {SKETCH}), h -> shiftleft(h, {PLACE_BITS}) | {place})")).drop(words, found)


def sketch_text(sketch: str) -> Column:
    """The fingerprint as text, twelve hex digits an anchor."""
    return F.expr(f"array_join(transform({sketch}, x -> lpad(lower(hex(x)), {(HASH_BITS + PLACE_BITS) // 4}, '0')), '')")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with column `out`, from 0 to 1: the share of the anchors of two texts that both have in the same order, estimated.

    Of the least SKETCH hashes of both, those in both are taken in the order of the first text; one
    that the second text has before the one ahead of it doesn't count.
    """
    ha, hb, both, met = (f"_{x}_{out}" for x in ("a", "b", "both", "met"))
    low = (1 << PLACE_BITS) - 1
    df = df.withColumns({h: F.expr(f"transform({c}, x -> shiftright(x, {PLACE_BITS}))") for h, c in ((ha, a), (hb, b))})
    df = df.withColumn(both, F.slice(F.sort_array(F.array_union(ha, hb)), 1, SKETCH))
    place = f"get({b}, cast(array_position({hb}, shiftright(x, {PLACE_BITS})) - 1 as int)) & {low}"
    shared = f"filter({a}, x -> shiftright(x, {PLACE_BITS}) <= element_at({both}, -1) and array_contains({hb}, shiftright(x, {PLACE_BITS})))"
    df = df.withColumn(met, F.expr(f"sort_array(transform({shared}, x -> shiftleft(x & {low}, {PLACE_BITS}) | {place}))"))
    ordered = f"size(filter({met}, (x, i) -> i = 0 or (x & {low}) >= (get({met}, i - 1) & {low})))"
    return df.withColumn(out, F.expr(f"case when {a} = {b} then 1d else {ordered} / cast(size({both}) as double) end")).drop(ha, hb, both, met)


def anchors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every anchor of every text: (doc_id, position, anchor), for matching by position.

    position: words before the k-mer. A null or empty text, or one with fewer words than a k-mer, has one
    anchor at 0. Repeated rows have theirs again; empty tables give none.
    """
    rows = only(docs, id_column, text_column).select(F.col(id_column).alias("doc_id"), _hashed(F.coalesce(text_column, F.lit(""))).alias("_w"))
    found = F.expr(f"transform(filter(if(size(_w) < {K}, cast(array() as array<int>), sequence(0, size(_w) - {K})), i -> {_edge('_w')}), i -> struct(i as position, {_kmer('_w')} as anchor))")
    whole = F.expr(f"array(struct(0 as position, xxhash64(_w) & {(1 << HASH_BITS) - 1} as anchor))")
    return rows.withColumn("_f", found).select("doc_id", F.inline(F.when(F.size("_f") > 0, F.col("_f")).otherwise(whole)))


def ranges(docs: DataFrame) -> list[tuple[int, int]]:
    """Where the ranges of (doc_id, tie) begin, ascending; at most MOST_RANGES. The first begins with the least id.

    An id that holds several cuts, since very many rows repeat it, is cut by the ties.
    """
    stats = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least")).first()
    if not stats["n"]:
        return []
    n = min(MOST_RANGES, math.ceil(stats["n"] / RANGE_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"] if n > 1 else []
    lowest = -(1 << 63)
    out = {(x, lowest + i * ((1 << 64) // times)) for x, times in Counter(cuts).items() for i in range(times)}
    return sorted(out | {(stats["least"], lowest)})


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (doc_id, text, ...) with a column next_<c> for each carried column: the next document's.

    Next is by ascending doc_id, after the last the first; ids that are equal go by their texts' hashes. A row without
    id has no place in this order and no next. The others go once through a shuffle by range of id; the first
    rows of each range are also sent to the range before it.
    """
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    lone = rows.where("doc_id is null").drop("_tie").withColumns({f"next_{c}": F.lit(None).cast(rows.schema[c].dataType) for c in carried})
    rows = rows.where("doc_id is not null")
    cuts = ranges(rows.select("doc_id"))
    if not cuts:
        return lone
    side = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    least = F.expr("cast(-9223372036854775808 as bigint)")

    def literal(pairs):
        return F.array(*[F.struct(F.lit(x).cast("long").alias("doc_id"), F.lit(t).cast("long").alias("_tie") if t > -(1 << 63) else least.alias("_tie")) for x, t in pairs])

    here = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("_tie"))
    rows = rows.withColumn("_here", here).withColumn("_group", F.greatest(F.size(F.filter(literal([g[0] for g in groups]), lambda x: x <= F.col("_here"))) - 1, F.lit(0)))
    rows = rows.withColumn("_fine", F.get(F.array(*map(literal, groups)), F.col("_group"))).withColumn("_place", F.greatest(F.size(F.filter("_fine", lambda x: x <= F.col("_here"))) - 1, F.lit(0)))
    rows = rows.withColumn("_range", F.col("_group") * side + F.col("_place"))
    rows = rows.drop("_here", "_group", "_fine", "_place")
    # the first row of each range, and the range before it: a row a range
    order = Window.orderBy("_range")
    firsts = rows.groupBy("_range").agg(F.min(F.struct("doc_id", "_tie")).alias("_first"))
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.partitionBy())))
    firsts = F.broadcast(firsts.select(F.col("_range").alias("_r"), "_before", F.col("_first.doc_id").alias("_id"), F.col("_first._tie").alias("_t")))  # at most MOST_RANGES rows
    rows = rows.join(firsts, (F.col("_range") == F.col("_r")) & (F.col("doc_id") == F.col("_id")) & (F.col("_tie") == F.col("_t")), "left")
    here, again = F.struct(F.col("_range").alias("at"), F.lit(False).alias("again")), F.struct(F.col("_before").alias("at"), F.lit(True).alias("again"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, again))))
    rows = rows.withColumns({"_at": F.col("_to.at"), "_again": F.col("_to.again")}).drop("_to", "_r", "_before", "_id", "_t", "_range")
    by = Window.partitionBy("_at").orderBy("_again", "doc_id", "_tie", "text")
    return rows.withColumns({f"next_{c}": F.lead(c).over(by) for c in carried}).where(~F.col("_again")).drop("_at", "_again", "_tie").unionByName(lone)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of the text with its second half taken from the next document.

    A null text is empty; texts without words are alike, and equal texts have equal fingerprints. Rows that
    repeat an id come one after the other, by their texts' hashes; for a row without id the next document is empty. Very
    long texts are read whole. An empty table gives no rows.
    """
    docs = only(documents(spark, sf_dir), "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(with_sketch(docs, "text", "sketch"), ["text", "sketch"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("next_text", F.coalesce("next_text", F.lit("")))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    empty = with_sketch(spark.range(1).select(F.lit("").alias("text")), "text", "none").first()["none"]  # one row
    rows = rows.select("doc_id", "n_chars", "edited", "sketch", F.coalesce("next_sketch", F.array(*map(F.lit, empty)).cast("array<bigint>")).alias("next_sketch"))
    rows = with_sketch(rows, "edited", "edited_sketch")
    rows = with_likeness(with_likeness(rows, "sketch", "edited_sketch", "near_edited"), "sketch", "next_sketch", "near_next")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch_text("sketch").alias("fingerprint"),
        sketch_text("edited_sketch").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
