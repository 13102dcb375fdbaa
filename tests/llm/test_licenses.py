import random
from itertools import combinations

from pilespan.llm import licenses


def test_alignment_is_a_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[x] == b[y] for x, y in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.patience(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


def test_longest_increasing():
    rng = random.Random(8)
    for _ in range(60):
        pairs = list(enumerate(rng.sample(range(9), 9)))
        got = licenses._increasing(pairs)
        assert all(p[1] < q[1] for p, q in zip(got, got[1:]))
        best = max(n for n in range(1, 10) for c in combinations(pairs, n) if all(p[1] < q[1] for p, q in zip(c, c[1:])))
        assert len(got) == best


def test_finds_planted_notices(docs_of, odd_texts):
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "work", "text", "under", "a"]) for _ in range(n))
    mit = licenses.TEMPLATES["MIT"]
    near = mit.split()
    for i in range(0, len(near), 9):
        near[i] = "changed"
    texts = [*odd_texts, f"{filler(50)}\n{mit.upper()}\n{filler(50)}", f"{filler(900)} {' '.join(near)} {filler(9)}", "Released under the MIT License. " * 5, f"{filler(30)} Licensed under CC BY-NC 4.0. {filler(30)} {licenses.TEMPLATES['ISC']}", "license licence under the a work", " ".join(mit.split()[:40])]
    n = len(odd_texts)
    got = {}
    for r in licenses.scan_licenses(docs_of(texts)).collect():
        got.setdefault(r.doc_id, {})[r.license] = r
    assert all(set(got[i]) == {None} for i in range(n))
    assert got[n]["MIT"].coverage == 1.0 and got[n]["MIT"].first_word == 50
    assert 0.8 <= got[n + 1]["MIT"].coverage < 1.0
    assert got[n + 2]["MIT-notice"].coverage == 1.0
    assert {"CC-BY-NC-4.0-notice", "ISC"} <= set(got[n + 3]) <= {"CC-BY-NC-4.0-notice", "ISC", "0BSD"}  # that one is ISC without a clause
    assert set(got[n + 4]) == {None} and set(got[n + 5]) == {None}
    assert licenses.scan_licenses(docs_of(["x"]).limit(0)).count() == 0


def test_every_stretch_of_planted_templates(docs_of, spark):
    """Templates with words changed and inserted, side by side and apart, are all found where they lie."""
    rng = random.Random(7)
    templates = {f"t{n}": " ".join(f"w{n}x{i}" for i in range(n)) for n in (6, 17, 60)}
    scanner = licenses.Scanner(templates)
    for _ in range(150):
        words, expected = [], []
        for _ in range(rng.randrange(1, 6)):
            words += [f"f{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 30]))]
            name = rng.choice(list(templates))
            own = templates[name].split()
            spare = len(own) - licenses._needed(len(own), licenses.COVERAGE)
            lost = rng.sample(range(1, len(own) - 1), rng.randrange(spare + 1))
            own = [f"c{rng.randrange(50)}" if i in lost else w for i, w in enumerate(own)]
            for _ in range(rng.randrange(spare + 1)):
                own.insert(rng.randrange(1, len(own)), f"i{rng.randrange(50)}")
            expected.append((name, 1 - len(lost) / len(templates[name].split()), len(words), len(words) + len(own)))
            words += own
        got = scanner.scan(" ".join(words))
        assert [(x[0], x[2], x[3]) for x in got] == sorted((x[0], x[2], x[3]) for x in expected)
        assert sorted(round(x[1], 9) for x in got) == sorted(round(x[1], 9) for x in expected)
    table = spark.createDataFrame(list(templates.items()) + [(None, "x"), ("none", None)], "license string, text string")
    rows = licenses.scan_licenses(docs_of([templates["t6"] + " " + templates["t6"], None]), table).collect()
    assert sorted((r.doc_id, r.license or "", r.first_word or 0, r.end_word or 0) for r in rows) == [(0, "t6", 0, 6), (0, "t6", 6, 12), (1, "", 0, 0)]


def test_query_finds_every_notice_in_the_table(spark):
    dir_ = "/root/testdata/sf0.01"
    found = licenses.op4_licenses(spark, dir_).where("license is not null").toPandas()
    docs = spark.read.parquet(f"{dir_}/documents.parquet").toPandas()
    for name in ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice"):
        assert set(found[found.license == name].doc_id) == set(docs[docs.text.str.contains(licenses.TEMPLATES[name], regex=False)].doc_id)
