import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pilespan.llm import language

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = language.op5_language(spark, DIR).toPandas().merge(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and len(held) > 100 and (held.lang == held.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_odd_texts(spark, docs_of, odd_texts):
    train = spark.createDataFrame([("the and of that is it", "en")] * 20 + [("der und nicht die das ist", "de")] * 20 + [(None, "en"), ("x", None)], "text string, lang string")
    model = language.fit(train)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language.predict(docs_of([*odd_texts, "und nicht", "that of it", "123 !?"], clashing=False), model, ["doc_id"]).collect()}
    n = len(odd_texts)
    assert [got[i].lang_pred for i in (0, 1, 2, n + 2)] == ["und"] * 4 and got[n].lang_pred == "de" and got[n + 1].lang_pred == "en"
    assert got[3].lang_pred in ("de", "en") and all(0 <= r.score <= 1 for r in got.values())


def test_without_training(spark, docs_of):
    none = spark.createDataFrame([], "text string, lang string")
    assert language.fit(none) is None
    assert [r.lang_pred for r in language.predict(docs_of(["abc"], clashing=False), None, ["doc_id"]).collect()] == ["und"]


def test_fit_needs_no_second_set_of_python_workers(spark, monkeypatch):
    """Only mapInArrow runs Python in the executors: what the fit hands to Spark doesn't pass through an RDD of Python objects."""
    train = spark.createDataFrame([("abcd efgh", "a")] * 9 + [("wxyz uvst", "b")] * 9, "text string, lang string")
    made = []

    def parallelize(self, *a, f=type(spark.sparkContext).parallelize, **b):
        made.append(a)
        return f(self, *a, **b)

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    assert language.fit(train).languages == ["a", "b"] and not made


def test_filter_finds_what_it_holds():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**63, 4000).astype(np.uint64)
    of = rng.integers(0, 11, 4000)
    model = language.LanguageFilter.build([f"l{i:02}" for i in range(11)], of, grams, "l00")
    for byte in range(2):
        mask = model.table[list(model.slots(grams))[0], byte] & model.table[list(model.slots(grams))[1], byte]
        own = of >> 3 == byte
        assert (mask[own] >> (of[own] & 7) & 1).all()
    assert (model.wrong < 0.01).all()


def test_long_text_in_parts(docs_of, spark, monkeypatch):
    train = spark.createDataFrame([("abcd efgh", "a")] * 9 + [("wxyz uvst", "b")] * 9, "text string, lang string")
    model = language.fit(train)
    text = "abcd efgh " * 400 + "wxyz " * 100
    whole = language.predict(docs_of([text], clashing=False), model, ["doc_id"]).first()
    monkeypatch.setattr(language, "PART", 64)
    parts = language.predict(docs_of([text], clashing=False), model, ["doc_id"]).first()
    assert whole.lang_pred == parts.lang_pred == "a" and abs(whole.score - parts.score) < 1e-9


def grams_of(text, n):
    """N-grams of letters in lower case, anything else a space, with at most one space; with repeats."""
    letters = [int(language.folding()[ord(c)]) for c in text]
    return [tuple(letters[i : i + n]) for i in range(len(letters) - n + 1) if letters[i : i + n].count(32) <= 1]


def hashed(gram):
    return int(language.hashes(np.array(gram, dtype=np.uint32), len(gram))[0].view(np.int64)[0])


def plain_predictions(rows):
    """lang_pred by exact sets instead of filters, None where the two best languages are too close to call. rows: (id, text, lang)."""
    docs = defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            for n in language.ORDERS:
                docs[lang, n].update(set(grams_of(text, n)))
    kept = defaultdict(set)
    for (lang, n), c in docs.items():
        often = sorted((-d, hashed(g), g) for g, d in c.items() if d > 1)[: language.FIT_NGRAMS]
        kept[lang] |= {g for _, _, g in often}
    out = {}
    for i, text, _ in rows:
        if not text or not any(language.folding()[ord(c)] != 32 for c in text):
            out[i] = "und"
            continue
        asked = [g for n in language.ORDERS for g in grams_of(text, n)]
        found = sorted(((sum(g in kept[lang] for g in asked), lang) for lang in kept), reverse=True)
        out[i] = found[0][1] if found[0][0] - found[1][0] > 0.02 * len(asked) else None
    return out


def test_query_by_brute_force(spark):
    dir_ = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{dir_}/documents.parquet").collect()]
    expected = plain_predictions(rows)
    got = {r.doc_id: r for r in language.op5_language(spark, dir_).collect()}
    assert set(got) == set(expected) and sum(x is None for x in expected.values()) < 0.02 * len(rows)
    assert all(got[i].lang_pred == x for i, x in expected.items() if x)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


@pytest.mark.parametrize("table", ["rows", "none", "clashing"])
def test_query_on_odd_tables(spark, docs_of, odd_texts, tmp_path, table):
    df = docs_of([*enumerate(odd_texts), (None, "the and of"), (4, "again and again"), (4, "again and again")], clashing=table == "clashing")
    df = df.limit(0) if table == "none" else df
    df.toDF(*[c if c != "TEXT" else "held_out" for c in df.columns]).write.parquet(str(tmp_path / "documents.parquet"))
    got = language.op5_language(spark, str(tmp_path)).collect()
    assert len(got) == (0 if table == "none" else len(odd_texts) + 3)
    if got:
        assert {r.lang_pred for r in got} == {"en", "und"} and all(not r.held_out for r in got if r.doc_id is None)
        assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 4}) <= 2


def test_many_languages(spark):
    """Every language that is labelled has its bit, however many there are."""
    rows = [(f"x{chr(97 + n // 26)}{chr(97 + n % 26)}q word{chr(97 + n // 26)}{chr(97 + n % 26)}", f"l{n:03}") for n in range(300) for _ in range(3)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 300
