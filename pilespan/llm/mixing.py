"""Mixing of sources to target weights by a multivariate-hypergeometric splitting tree.

A hash deals each source's documents to permuted blocks. What the mix takes of a source is whole passes
over it, then the first documents in permuted order, the last of them in part. So a source has two kinds of
blocks: the first, taken once more than the others, and the others, taken by the whole passes only. The
blocks of each kind that the mix takes are quotas of their own and are dealt to the output shards by a binary
tree: at every node the left half of the shards gets an exact multivariate-hypergeometric draw from the node's
block quotas, so each block goes to one shard and every shard is a random sample of the mix. A shard draws
its run of the permuted blocks of each kind, and the hash orders what it has. All of it is DataFrame functions; what
is joined to the documents is one row a source, and texts are shuffled only to order the mix itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, n_words, only, scratch, shield

#: Documents of a block (about); least blocks a shard of a source; shards of the production query.
BLOCK_DOCS, SHARD_BLOCKS, SHARDS = 1024, 64, 16
WEIGHTS = (3.0, 1.0, 2.0)
#: Draws are made among the counts within so many standard deviations of the mean.
DEVIATIONS = 12


def targets(totals: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """totals (source, source_size, ...) with column target.

    Sources by code point, null last, have the weights in turn and share `share` times all sizes by
    weight; none gets more than `most` times its size, and what is over goes to the others by weight.
    One row a source goes through two windows, and the tree folds arrays with an entry a source: made for some
    thousands of sources, whatever their sizes.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "turn")
    out = totals.withColumn("turn", F.row_number().over(by_name) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", most * F.col("source_size")).withColumn("room", F.col("cap") / F.col("weight"))
    out = out.withColumn("all_words", share * F.sum("source_size").over(Window.partitionBy()))
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = out.withColumn("rate", (F.col("all_words") - before) / F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    # in the order of room, a source is full while its room is at most the rate that those before it leave
    out = out.withColumn("last", F.min(F.when(F.col("room") > F.col("rate"), F.struct("room", "turn", "rate"))).over(Window.partitionBy()))
    full = F.col("last").isNull() | (F.struct("room", "turn") < F.struct("last.room", "last.turn"))
    return out.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.col("last.rate"))).drop("cap", "room", "all_words", "rate", "last", "weight")


def _uniform(*of):
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _draw(total, own, wanted, *of):
    """A hypergeometric draw: of `wanted` drawn from `total`, how many are among the `own`.

    The largest of log-weight plus Gumbel noise over the support is an exact draw; counts more than
    DEVIATIONS standard deviations from the mean are left out of the search.
    """
    total, own, wanted = (x.cast("double") for x in (total, own, wanted))
    mean = F.when(total > 0, wanted * own / total).otherwise(F.lit(0.0))
    spread = DEVIATIONS * F.sqrt(F.greatest(F.lit(1.0), mean * (1 - F.when(total > 0, own / total).otherwise(F.lit(0.0))))) + 1
    low = F.greatest(F.lit(0.0), wanted - (total - own), F.floor(mean - spread).cast("double")).cast("long")
    high = F.least(own, wanted, F.ceil(mean + spread).cast("double")).cast("long")
    start = F.struct(F.lit(0.0).alias("weight"), F.lit(-1e300).alias("best"), low.alias("at"))

    def step(s, k):
        noisy = s["weight"] - F.log(-F.log(_uniform(*of, k)))
        ratio = (own - k) * (wanted - k) / ((k + 1) * (total - own - wanted + k + 1))
        return F.struct(F.when(k < high, s["weight"] + F.log(ratio)).otherwise(s["weight"]).alias("weight"), F.greatest(s["best"], noisy).alias("best"), F.when(noisy > s["best"], k).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.sequence(low, high), start, step, lambda s: s["at"])


def split(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Exact quotas of every shard: (source, turn, blocks) to (turn, ends).

    ends has, for each shard, the end of its run of the source's blocks; runs are disjoint and end
    with the last block. The quotas of a node are one row, with one entry a source.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("turn", "blocks"))).alias("quotas")).select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "quotas")
    quota = "array<struct<turn:int,blocks:bigint>>"

    def halves(row):
        every = F.aggregate("quotas", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        left = F.col("n").cast("long") - F.floor(F.col("n") / 2)
        wanted = F.round(every * left / F.col("n")).cast("long")
        start = F.struct(every.alias("total"), wanted.alias("wanted"), F.array().cast(quota).alias("left"), F.array().cast(quota).alias("right"))

        def deal(s, x):
            got = _draw(s["total"], x["blocks"], s["wanted"], F.lit(seed), F.col("first"), F.col("n"), x["turn"])
            # the draw is bound to a name, so it is made once
            return F.element_at(F.transform(F.array(got), lambda g: F.struct((s["total"] - x["blocks"]).alias("total"), (s["wanted"] - g).alias("wanted"), F.concat(s["left"], F.array(F.struct(x["turn"].alias("turn"), g.alias("blocks")))).alias("left"), F.concat(s["right"], F.array(F.struct(x["turn"].alias("turn"), (x["blocks"] - g).alias("blocks")))).alias("right"))), 1)

        dealt = F.aggregate("quotas", start, deal)
        return row.withColumn("dealt", dealt).withColumn("left", left.cast("int")).select(F.explode(F.when(F.col("n") > 1, F.array(F.struct(F.col("first"), F.col("left").alias("n"), F.col("dealt.left").alias("quotas")), F.struct((F.col("first") + F.col("left")).alias("first"), (F.col("n") - F.col("left")).alias("n"), F.col("dealt.right").alias("quotas")))).otherwise(F.array(F.struct("first", "n", "quotas")))).alias("x")).select("x.*")

    for _ in range((shards - 1).bit_length()):
        nodes = halves(nodes)
    leaf = nodes.select("first", F.explode("quotas").alias("q")).select("first", "q.*")
    upto = F.sum("blocks").over(Window.partitionBy("turn").orderBy("first"))
    return leaf.withColumn("end", upto).groupBy("turn").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("ends")).select("turn", F.col("ends.end").alias("ends"))


def plan_mix(sized: DataFrame, share: float, most: float, shards: int, seed: int) -> DataFrame:
    """What the mix takes of each source, one row a source, from columns source, _size and _key.

    full: passes over the whole source; the rest is the documents before (cut_block, cut_key) in
    permuted order, and cut_words words of the document there. first: blocks up to the cut's, 0 without one;
    first_ends and other_ends: how they and the others are dealt.
    """
    totals = sized.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_docs"))
    aims = targets(totals, share, most).withColumn("_n", F.greatest(F.ceil(F.col("_docs") / BLOCK_DOCS), F.lit(SHARD_BLOCKS * shards)))
    aims = aims.withColumn("quota", F.round("target").cast("long")).withColumn("full", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0).cast("long")))
    aims = cut(aims.withColumn("rest", F.col("quota") - F.col("full") * F.col("source_size")), "targets")
    placed = sized.join(aims.select(F.col("source").alias("_s"), "turn", "_n", "rest"), F.col("source").eqNullSafe(F.col("_s"))).select("turn", "rest", "_size", "_key", block_of("_n").alias("_block"))
    blocks = placed.groupBy("turn", "_block", "rest").agg(F.sum("_size").alias("words"))
    run = Window.partitionBy("turn").orderBy("_block")
    blocks = blocks.withColumn("upto", F.sum("words").over(run))
    last = blocks.where("upto > rest and upto - words <= rest").select(F.col("turn").alias("_turn"), F.col("_block").alias("cut_block"), (F.col("rest") - F.col("upto") + F.col("words")).alias("left"))
    inside = placed.join(last, (F.col("turn") == F.col("_turn")) & (F.col("_block") == F.col("cut_block"))).select("turn", "cut_block", "left", "_key", "_size")
    inside = inside.withColumn("upto", F.sum("_size").over(Window.partitionBy("turn").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)))
    edge = inside.where("upto > left and upto - _size <= left").select("turn", "cut_block", F.col("_key").alias("cut_key"), (F.col("left") - F.col("upto") + F.col("_size")).alias("cut_words"))
    plan = aims.select("source", "source_size", "target", "turn", "_n", "full").join(edge, "turn", "left")
    plan = cut(plan.withColumn("first", F.coalesce(F.col("cut_block") + 1, F.lit(0)).cast("long")), "edges")
    others = F.when(F.col("full") > 0, F.col("_n").cast("long") - F.col("first")).otherwise(F.lit(0).cast("long"))
    kinds = F.array(F.struct((2 * F.col("turn")).alias("turn"), F.col("first").alias("blocks")), F.struct((2 * F.col("turn") + 1).alias("turn"), others.alias("blocks")))
    dealt = split(plan.select(F.inline(kinds)), shards, seed).select((F.col("turn") / 2).cast("int").alias("turn"), (F.col("turn") % 2).alias("kind"), "ends")
    ends = dealt.groupBy("turn").agg(F.max(F.when(F.col("kind") == 0, F.col("ends"))).alias("first_ends"), F.max(F.when(F.col("kind") == 1, F.col("ends"))).alias("other_ends"))
    return plan.join(ends, "turn", "left")


def block_of(n):
    """The permuted block of a key among n."""
    return F.expr("conv(substring(_key, 1, 12), 16, 10)").cast("long") % F.greatest(F.col(n).cast("long"), F.lit(1).cast("long"))


def take(docs: DataFrame, share: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """docs (doc_id, text, source, maybe more) with columns _size, _source_size, _target, _taken, _shard, _key.

    _size: words of the text, 0 for null. Rows equal in id and text are taken alike; a null id or source
    is a value like another. Within a shard, order by _key is the shuffle. Blocks that the mix takes nothing of
    go to the shards in turn. Empty tables give none.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string")))
    sized = docs.withColumn("_size", n_words(F.col("text"))).withColumn("_key", key)
    with scratch(docs.sparkSession) as work:
        light = cut(sized.select("source", "_size", "_key"), "sizes")
        plan = work.last(plan_mix(light, share, most, shards, seed), "mix")
    plan = plan.select(*[F.col(c).alias(f"_plan_{c.strip('_')}") for c in plan.columns])
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("_plan_source"))).withColumn("_block", block_of("_plan_n"))
    here, edge = F.struct("_block", "_key"), F.struct("_plan_cut_block", "_plan_cut_key")
    more = F.when(F.col("_plan_cut_key").isNull(), F.lit(0)).when(here < edge, F.col("_size")).when(here == edge, F.col("_plan_cut_words")).otherwise(F.lit(0))
    rank = F.col("_block") - F.col("_plan_first")
    shard = F.when(rank < 0, F.size(F.filter("_plan_first_ends", lambda e: e <= F.col("_block"))))
    shard = shard.when(F.col("_plan_full") > 0, F.size(F.filter("_plan_other_ends", lambda e: e <= rank))).otherwise(F.col("_block") % shards).cast("int")
    return out.withColumn("_taken", F.col("_plan_full") * F.col("_size") + more).withColumn("_shard", shard).withColumns({"_source_size": F.col("_plan_source_size"), "_target": F.col("_plan_target")}).drop("_block", *plan.columns)


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The mix itself: each document as often as it is taken, a part of it as its first words.

    Columns are those of docs, whatever their names. Rows come shard by shard, and in a shard by _key: the order of the output's
    partitions is the order of the mix. A document without words (null and empty texts among them) is kept once. Null ids
    and sources are values like others; rows equal in id and text are taken alike. A part of a very long text is cut from
    its first words. An empty table stays empty.
    """
    plain, names = shield(docs, "doc_id", "text", "source", "n_chars")
    took = take(plain, share, most, shards, seed)
    whole = F.when(F.col("_size") > 0, F.expr("_taken div _size")).otherwise(F.lit(1)).cast("int")
    part = F.when(F.col("_size") > 0, F.expr("_taken % _size")).otherwise(F.lit(0)).cast("int")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_part")), " ")
    rows = took.withColumn("_part", part).withColumn("_copies", F.concat(F.array_repeat(F.lit(False), whole), F.when(F.col("_part") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))
    rows = rows.withColumn("_cut", F.explode("_copies"))
    text = F.when(F.col("_cut"), words).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in plain.columns:
        out["n_chars"] = F.when(F.col("_cut"), F.length(words).cast(plain.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    rows = rows.select(*[out.get(c, F.col(c)).alias(c) for c in plain.columns], "_shard", "_key")
    return rows.repartitionByRange("_shard", "_key").sortWithinPartitions("_shard", "_key").select(*plain.columns).toDF(*names)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    took = take(only(documents(spark, sf_dir), "doc_id", "text", "source"))
    return took.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.col("_shard").alias("shard"))
