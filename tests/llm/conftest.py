"""Helpers of the text operators' tests."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts or (id, text) pairs; extra columns have names that operators use themselves."""
    from pyspark.sql import functions as F

    def make(rows, clashing=True):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(rows)]
        df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
        if clashing:
            for n, name in enumerate(("id", "doc", "mark", "_doc", "_mark", "key", "node", "fp", "_spans", "_size", "_key", "score", "lang_pred", "TEXT", "sketch", "c0", "_row")):
                df = df.select("*", F.lit(n).alias(name)) if name != "TEXT" else df.toDF(*df.columns).select(*df.columns, F.lit("x").alias("TEXT"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and wordless texts, ties, one very long text and one without white space."""
    words = " ".join(f"w{i % 977}x{i // 977}" for i in range(60000))
    return [None, "", " \t\n", "one", "one", "One TWO three", "one two three", words, words + " end", "x" * 50000, "ÄÖÜ ß é 漢字   z", "a b c d e f g h i j k l m n o p"]
