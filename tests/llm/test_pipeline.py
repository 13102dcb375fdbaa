import corpus_pipeline
import numpy as np
import pytest
from pilespan.llm import near_dedup
from pilespan.llm.common import cut, n_words, only
from pyspark.sql import functions as F
from test_debruijn import plain
from test_near_dedup import shingles

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut(stage(spark, docs, DIR), "test")
        out.append((name, before, docs))
    return out


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(stages):
    assert [n for n, _, _ in stages] == ["language ID", "SimHash near-dedup", "substring dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == COLUMNS and after.dtypes == before.dtypes


def test_language_by_brute_force(stages):
    _, docs, told = stages[0]
    assert set(rows_of(told)) == {i for i, t in rows_of(docs).items() if t and any(c.isalpha() for c in t)}


def test_near_dedup_by_brute_force(stages):
    """Of each group by the exact similarity of all pairs the least id stays, and nothing else goes."""
    _, before, after = stages[1]
    texts = rows_of(before)
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    least = near_dedup._forest(len(ids), *np.array(pairs).T)
    stay, got = {ids[i] for i in range(len(ids)) if least[i] == i}, set(rows_of(after))
    assert stay <= got and len(got - stay) <= 0.05 * (len(ids) - len(stay))
    assert 0 < len(stay) < len(ids)


def test_substring_dedup_by_brute_force(stages):
    _, before, after = stages[2]
    rows, got = sorted(rows_of(before).items()), rows_of(after)
    for (i, t), kept in zip(rows, plain(rows, 13)):
        assert got[i].encode().split() == kept and (got[i] == t or len(kept) < len(t.split()))
    assert after.where("n_chars <> length(text)").count() == 0


def test_mix_by_brute_force(stages):
    """Every text comes as often as the mix takes it, its last time in part, and each source's words come to its target."""
    _, before, after = stages[3]
    size, want = {}, {}
    for r in before.withColumn("n", n_words(F.col("text"))).collect():
        size[r.source] = size.get(r.source, 0) + r.n
    names, weights = sorted(size), [3, 1, 2]
    left, open_ = 1.5 * sum(size.values()), dict(zip(names, (weights[i % 3] for i in range(len(names)))))
    while open_:  # what goes beyond twice a source's size goes to the others
        rate = left / sum(open_.values())
        full = [n for n in open_ if open_[n] * rate > 2 * size[n]]
        if not full:
            want |= {n: w * rate for n, w in open_.items()}
            break
        for n in full:
            want[n] = 2.0 * size[n]
            left -= want[n]
            del open_[n]
    got = {r.source: r.n for r in after.groupBy("source").agg(F.sum(n_words(F.col("text"))).alias("n")).collect()}
    assert all(abs(got.get(n, 0) - want[n]) <= 1 for n in names)
    texts = {i: t.split() for i, t in rows_of(before).items()}
    pieces = {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append(r.text.split())
    for i, own in pieces.items():
        parts = [p for p in own if p != texts[i]]
        assert len(own) <= 2 and len(parts) <= 1 and all(p == texts[i][: len(p)] for p in parts)


def test_packing_by_brute_force(stages):
    _, before, after = stages[4]
    assert after.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    sums = after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end and (r.n == 1024 or r.n < 1024 and r.n & (r.n - 1) == 0) for r in sums)
    assert after.where("start = 0").count() == before.count()


def test_language_stage_rejects_what_has_no_language(spark, docs_of):
    df = docs_of(["the and of it", None, "", "123 !", "und der die"])
    out = corpus_pipeline.identify_language(spark, df, "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 4] and out.columns == df.columns


def outcome(df):
    return sorted((str(r.doc_id), r.text or "") for r in only(df, "doc_id", "text").collect())


def test_stages_on_odd_tables(spark, docs_of, odd_texts):
    language, dedup, substrings, mix, pack = (stage for _, stage in corpus_pipeline.STAGES)
    df = docs_of(odd_texts)
    texts = dict(enumerate(odd_texts))
    assert [int(i) for i, _ in sorted(outcome(language(spark, df, "")), key=lambda x: int(x[0]))] == [i for i, t in texts.items() if t and t.strip()]
    # null, empty and wordless texts are a group, so are the ties and the long texts that differ in a word
    assert sorted(int(i) for i, _ in outcome(dedup(spark, df, ""))) == [0, 3, 5, 7, 9, 10, 11]
    assert dict(outcome(substrings(spark, df, "")))["8"] == "end" and len(outcome(substrings(spark, df, ""))) == len(texts)
    assert {i for i, _ in outcome(mix(spark, df, ""))} <= {str(i) for i in texts}
    assert pack(spark, df, "").select("doc_id").distinct().count() == len(texts)
    few = docs_of([(None, "a b"), (1, None), (1, None)])
    assert outcome(language(spark, few, "")) == [("None", "a b")]
    assert outcome(dedup(spark, few, "")) == outcome(substrings(spark, few, "")) == [("1", ""), ("1", ""), ("None", "a b")]
    assert sum(len(t.split()) for _, t in outcome(mix(spark, few, ""))) == 3
    assert pack(spark, few, "").groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id = 1").first().n == 2
    none = docs_of(["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0 and (stage is pack or out.columns == none.columns)


def test_run(spark, stages):
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.agg(F.sum("length")).first()[0] == stages[-1][2].agg(F.sum("length")).first()[0]
