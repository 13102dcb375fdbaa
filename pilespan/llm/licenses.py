"""License scans by patience alignment.

A template is aligned with a stretch of text on the words that are unique in both: the longest
sequence of them in the same order is kept, and the gaps between are aligned in the same way. The share of
the template's words that are matched is its coverage. Which stretches to align follows from the least
coverage: a stretch that reaches it has one of any (1 - coverage) n + 1 words of the template's n,
so the scan looks at every place of that many of its least common words. A stretch is found if no more words
are inserted in it than may be missing, and a few (see slack()); of stretches that overlap the one with more matched and fewer other words is told.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, only, small_batches
from .license_texts import TEMPLATES

#: Least coverage that is reported.
COVERAGE = 0.8
TOKEN = re.compile(r"\w+")
#: Most templates that a table may have: all tasks hold them.
MOST_TEMPLATES = 10_000


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched places (text, template), ascending in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        here, there = _unique(text, a, b), _unique(template, c, d)
        anchors = _increasing(sorted((there[w], here[w]) for w in there.keys() & here.keys()))
        if not anchors:
            continue
        last_a, last_c = a, c
        for y, x in anchors:
            out.append((x, y))
            todo.append((last_a, x, last_c, y))
            last_a, last_c = x + 1, y + 1
        todo.append((last_a, b, last_c, d))
    return sorted(out)


def _unique(words: list[str], a: int, b: int) -> dict[str, int]:
    """The words that occur once in words[a:b], and where."""
    n = Counter(words[a:b])
    return {words[i]: i for i in range(a, b) if n[words[i]] == 1}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that ascends in the second member too."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, x) in enumerate(pairs):
        at = bisect_left(tops, x)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(x)
            ends.append(n)
        else:
            tops[at], ends[at] = x, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


class Scanner:
    """Templates with the words that give their stretches away."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.words = {name: words_of(text) for name, text in templates.items()}
        self.words = {name: w for name, w in self.words.items() if w}
        self.coverage = coverage
        use = Counter(x for w in self.words.values() for x in set(w))
        self.markers: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for name, w in self.words.items():
            spare = len(w) - _needed(len(w), coverage) + 1
            for at in sorted(range(len(w)), key=lambda i: (use[w[i]], -len(w[i]), w[i], i))[:spare]:
                self.markers[w[at]].append((name, at))

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, past the last) of every stretch; those of one template don't overlap."""
        words = words_of(text)
        starts: dict[str, set[int]] = defaultdict(set)
        markers = self.markers
        for p, w in enumerate(words):
            if w in markers:
                for name, at in markers[w]:
                    starts[name].add(p - at)
        out = []
        for name in sorted(starts):
            out += self._stretches(name, words, sorted(starts[name]))
        return out

    def _stretches(self, name: str, words: list[str], starts: list[int]) -> list[tuple[str, float, int, int]]:
        template = self.words[name]
        n, needed = len(template), _needed(len(template), self.coverage)
        slack, hits, whole = self.slack(n), set(), []
        for start in starts:  # stretches without insertions, in which repeated notices have words of their own
            more = 0
            while more <= slack:
                hit = self._aligned(words, max(0, start - more), min(len(words), start + n + more), template, needed, slack)
                if hit and hit[3] >= needed:
                    hits.add(hit)
                if hit and hit[3] == n:
                    whole.append(hit[1:3])
                if hit is None or hit[3] == n or 2 * hit[3] < needed:
                    break
                more = max(1, 2 * more)  # then, if half is there, with some
        covered = None
        for start in starts:
            known = bisect_left(whole, (start + 1,)) - 1
            if 0 <= known and whole[known][0] <= max(0, start) < whole[known][1] or covered is not None and start - covered <= slack // 2:
                continue
            covered = start
            hit = self._aligned(words, max(0, start - slack), min(len(words), start + n + 2 * slack), template, needed, slack)
            if hit and hit[3] >= needed:
                hits.add(hit)
        found: list[tuple[int, int, int]] = []
        for _, a, b, matched in sorted(hits):
            if all(b <= x or y <= a for x, y, _ in found):
                found.append((a, b, matched))
        found.sort()
        for i, (a, b, matched) in enumerate(found):  # once more, with what lies between the stretches around it
            if matched < n:
                low = max(a - slack, found[i - 1][1] if i else 0)
                high = min(b + slack, found[i + 1][0] if i + 1 < len(found) else len(words))
                hit = self._aligned(words, low, high, template, needed, slack)
                if hit and hit[3] > matched:
                    found[i] = hit[1:]
        return [(name, matched / n, a, b) for a, b, matched in found]

    def slack(self, n: int) -> int:
        """Words that may be inserted in a stretch of a template of n words."""
        return n - _needed(n, self.coverage) + 8

    def _aligned(self, words: list[str], a: int, b: int, template: list[str], needed: int, slack: int) -> tuple[int, int, int, int] | None:
        """(rank, first, past the last, matched words) of the best part of words[a:b] that isn't too long.

        A matched word outweighs four others before it: a stretch goes on to it, but doesn't reach into the next.
        """
        pairs = patience(words[a:b], template)
        best, first = None, 0
        for last in range(len(pairs)):
            while pairs[last][0] - pairs[first][0] >= len(template) + slack:
                first += 1
            for begin in {first, max(first, last + 1 - needed)}:
                matched, length = last + 1 - begin, pairs[last][0] - pairs[begin][0] + 1
                rank = (matched < needed, length - 5 * matched)
                if best is None or rank < best[0]:
                    best = rank, a + pairs[begin][0], a + pairs[last][0] + 1, matched
        return best and (best[0][1], *best[1:])


def _needed(n: int, coverage: float) -> int:
    """Words to match for the coverage."""
    return max(1, -int(-n * coverage // 1))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, coverage: float = COVERAGE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word), a row for each stretch of each template in each whole text.

    templates: texts by name, or a table (license, text) of at most MOST_TEMPLATES rows. A text without any stretch, a null or an empty
    one has a single row with null license and coverage 0. Null ids and repeated rows stay, each with its rows. Words
    are runs of letters, digits and underscores, in lower case. Of overlapping stretches of one template that with
    more matched and fewer other words is told, then the first; templates don't exclude each other. Other columns are
    ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    if isinstance(templates, DataFrame):
        rows = only(templates, "license", "text").where("license is not null and text is not null").limit(MOST_TEMPLATES + 1).collect()
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = {r["license"]: r["text"] for r in rows}
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            rows += [(doc, *x) for x in scanner.scan(text.as_py() or "")] or [(doc, None, 0.0, None, None)]
        types = pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], ["doc_id", "license", "coverage", "first_word", "end_word"])

    return map_batches(only(docs, id_column, text_column).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")), "doc_id long, license string, coverage double, first_word long, end_word long", work)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses found in every document."""
    return scan_licenses(documents(spark, sf_dir))
