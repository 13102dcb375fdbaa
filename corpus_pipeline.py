"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes every
stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilespan.llm.common import documents, remove, scratch, shield, stored
from pilespan.llm.debruijn import remove_repeats
from pilespan.llm.language import fit, predict
from pilespan.llm.mixing import mixed
from pilespan.llm.near_dedup import drop_near_duplicates
from pilespan.llm.packing import pack


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those whose text is null or has no letter go. A missing lang is filled in.

    Without labelled documents every text is rejected. Other columns stay, whatever their names.
    """
    plain, names = shield(docs, "text", "lang")
    told = predict(plain, fit(plain), plain.columns)
    return told.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*plain.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree by 0.8 or more, that with the least id.

    Nulls, ties, repeated rows and empty tables are as drop_near_duplicates() says.
    """
    return drop_near_duplicates(docs, shingle=5, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without 13-word windows that a document with a smaller id has; n_chars follows the text."""
    plain, names = shield(docs, "doc_id", "text", "n_chars")
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(plain.schema["n_chars"].dataType))
    return remove_repeats(plain, 13).withColumn("n_chars", n_chars).toDF(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken, in part if need be; see mixed() for nulls and empty tables."""
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; a null text is one id, an empty table gives no sequence."""
    return pack(docs, 1024)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: Hashes of sketches, tokenizer ids and learnt filters are out of SQL's reach; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
        if before:
            remove(spark, before)
        before = path
    return docs
