"""Near-duplicates by similarity: wide SimHash sketches, anchor-point covering, exact check.

One 64-bit fingerprint can't tell a similarity of 0.8: such texts differ in some ten bits, too many
for any covering code. So a text has a sketch of SKETCH_WORDS x 64 bits, of which each of TABLES tables
draws 46. A table's anchors are the words of the doubled Golay code; a sketch goes to the anchors of all
points within one bit of its draw, and texts that meet at an anchor are compared, first by 64 bits, then by the
sketch, then, unless the sketch is clear, by their shingles. At an anchor with few texts each is compared
with each by 64 bits. The texts of a crowded anchor meet their whole sketches and are dealt to cells of bounded
size, in which each is compared with each, three times: a cell first gives a forest of the links that are clear; then
for each text its nearest in doubt among other groups; and once these are checked, all pairs in doubt that still lie between
groups. So what large groups of near copies send on grows with their texts, not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, scratch, shield, small_batches, split_by_keys, texts_of
from .components import components
from .covering import covering
from .simhash import shingle_hashes

SKETCH_WORDS, TABLES, DRAWN = 16, 16, 46
#: Sketches that a map task compares at once; texts of an anchor that isn't crowded; about half the texts of a cell.
BLOCK, CROWD, CELL = 2048, 8, 512
#: Sketches of texts at a similarity s differ in a share acos(2 s / (1 + s)) / pi of the bits. So many standard
#: deviations from that for the threshold they are clear, if the texts have CLEAR_SHINGLES.
CLEAR, CLEAR_SHINGLES = 3.5, 32


def share_apart(similarity: float) -> float:
    """Expected share of differing bits of texts that share this much of their shingles."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def widened(h: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS independent 64-bit words for each hash."""
    x = h[:, None] + (np.arange(SKETCH_WORDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc, mark, node, n, sketch): node is a hash of the sketch, so copies share it; n counts different shingles."""
    schema = "doc long, mark long, n long, sketch binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, made = [], []
            for text in texts_of(batch):
                h = np.unique(shingle_hashes(text, shingle))
                ones = np.zeros(64 * SKETCH_WORDS, dtype=np.int64)
                for at in range(0, len(h), 1 << 12):
                    ones += _ones(widened(h[at : at + (1 << 12)]))
                n.append(len(h))
                made.append(np.packbits(2 * ones > len(h), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(made, pa.binary())], ["doc", "mark", "n", "sketch"])

    return docs.select("doc", "mark", "text").mapInArrow(work, schema).withColumn("node", F.xxhash64("sketch"))


def _ones(words: np.ndarray) -> np.ndarray:
    """How often each bit is set in the rows."""
    bits = np.unpackbits(np.ascontiguousarray(words, dtype="<u8").view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    out = np.zeros(bits.shape[1], dtype=np.int64)
    for at in range(0, len(bits), 255):  # as many as a byte can count
        out += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return out


def _draws() -> np.ndarray:
    """For each table the places of the bits that it draws."""
    rng = np.random.default_rng(46)
    return np.stack([rng.choice(64 * SKETCH_WORDS, DRAWN, replace=False) for _ in range(TABLES)])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the least item that the links a-b reach."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _meet(keys: np.ndarray, nodes: np.ndarray, words: np.ndarray, apart: int) -> np.ndarray:
    """All pairs of nodes at the same key (ascending) whose words differ by at most `apart` bits."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    place = np.arange(len(keys)) - np.nonzero(new)[0][np.cumsum(new) - 1]
    here, step, out = np.nonzero(place)[0], 1, [np.empty((0, 2), dtype=np.int64)]
    while len(here):
        near = here[np.bitwise_count(words[here] ^ words[here - step]) <= apart]
        out.append(np.stack([nodes[near], nodes[near - step]], 1))
        step += 1
        here = here[place[here] >= step]
    pairs = np.sort(np.concatenate(out), axis=1)
    return np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each sketch of a (rows of words) and each of b."""
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for x, y in zip(a.T, b.T):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


def clear_bits(similarity: float, sign: int, bits: int = 64 * SKETCH_WORDS) -> float:
    """Bits by which sketches differ that are clearly below (-1) or above (1) the threshold."""
    share = share_apart(similarity)
    return bits * share + sign * CLEAR * np.sqrt(bits * share * (1 - share))


def meeting(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v, sure) of nodes (node, sketch, n) that meet at an anchor: true for clear links, false for pairs whose 64 bits
    look near; where sure is null, v is a text of the crowded anchor u."""
    sure_bits, far_word = clear_bits(similarity, -1), int(clear_bits(similarity, 1, 64))
    draws = _draws()

    def block(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replicas of a block. What is surely near the first at an anchor stays, and is linked once in the block."""
        t = pa.Table.from_batches(batches)
        node, large = np.asarray(t["node"]), np.asarray(t["n"]) >= CLEAR_SHINGLES
        sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
        code = covering(("golay", "golay"))
        flips = np.concatenate(([0], 1 << np.arange(DRAWN))).astype(np.uint64)
        bits, words = np.unpackbits(sketch, axis=1, bitorder="little"), sketch.view("<u8")
        ends = []
        for table, places in enumerate(draws):
            drawn = (bits[:, places].astype(np.uint64) << np.arange(DRAWN, dtype=np.uint64)).sum(1, dtype=np.uint64)
            anchor = np.sort(code.home(drawn[:, None] ^ flips) | np.uint64(table << DRAWN), axis=1)
            fresh = np.ones(anchor.shape, dtype=bool)
            fresh[:, 1:] = anchor[:, 1:] != anchor[:, :-1]
            key, row = anchor[fresh], np.repeat(np.arange(len(node)), fresh.sum(1))
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            head = row[np.nonzero(new)[0][np.cumsum(new) - 1]]
            later = np.nonzero(~new)[0]
            x, y = row[later], head[later]
            near = large[x] & large[y] & (np.bitwise_count(words[x] ^ words[y]).sum(1) <= sure_bits)
            ends.append(np.stack([x[near], y[near]]))
            keep = np.ones(len(key), dtype=bool)
            keep[later[near]] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(node[row[keep]]), pa.array(words[row[keep], table % SKETCH_WORDS].copy().view(np.int64))], ["key", "node", "word"])
        least = _forest(len(node), *np.concatenate(ends, axis=1))
        own = np.nonzero(least != np.arange(len(node)))[0]
        # a link travels as a row with a key of its own, below zero
        yield pa.RecordBatch.from_arrays([pa.array(-1 - (node[own] & 0xFFFFFF)), pa.array(node[own]), pa.array(node[least[own]])], ["key", "node", "word"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            held.append(batch)
            size += batch.num_rows
            if size >= BLOCK:
                yield from block(held)
                held, size = [], 0
        if size:
            yield from block(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs at small anchors and known links as (u, v, sure); members of crowded anchors as (key, node, null)."""
        empty = np.empty(0, dtype=np.int64)
        held, size, carry, crowded = [], 0, (empty, empty, empty), None

        def settle(last: bool) -> pa.RecordBatch:
            nonlocal carry, crowded
            cols = [[np.asarray(b[c]) for b in held] for c in ("key", "node", "word")]
            key, node, word = (np.concatenate([c, *x]) for c, x in zip(carry, cols))
            link = key < 0
            known = np.stack([node[link], word[link]], 1)
            key, node, word = key[~link], node[~link], word[~link]
            _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
            crowd = counts[back] > CROWD if len(key) else np.zeros(0, dtype=bool)
            if crowded is not None:
                crowd |= key == crowded
            stay = np.zeros(len(key), dtype=bool)
            if len(key) and not last:  # the last key may go on
                if crowd[-1]:
                    crowded = key[-1]
                else:
                    stay = key == key[-1]
            carry = key[stay], node[stay], word[stay]
            few = ~crowd & ~stay
            pairs = _meet(key[few], node[few], word[few].view(np.uint64), far_word)
            many = np.stack([key[crowd], node[crowd]], 1)
            rows = np.concatenate((pairs, known, many))
            at = np.arange(len(rows))
            sure = pa.array((at >= len(pairs)) & (at < len(pairs) + len(known)), mask=at >= len(pairs) + len(known))
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy()), sure], ["u", "v", "sure"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 17:
                yield settle(False)
                held, size = [], 0
        yield settle(True)

    rows = nodes.select("node", "sketch", "n").mapInArrow(replicate, "key long, node long, word long")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "u long, v long, sure boolean")


def crowds(met: DataFrame) -> DataFrame:
    """(key, node, parts): the texts of crowded anchors, and the parts of about CELL texts that an anchor has."""
    crowd = met.where("sure is null").select(F.col("u").alias("key"), F.col("v").alias("node"))
    return crowd.join(crowd.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts")), "key")


def compared(members: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, what: str) -> DataFrame:
    """(u, v, apart) of the texts of crowded anchors that look near and lie in different groups of roots (node, root).

    members: key, node, parts. what: "sure" for a forest of the clear links of each cell, "nearest" for each
    text's nearest among the others, "all" for all pairs that aren't clear.
    """
    sure_bits, far_sketch = clear_bits(similarity, -1), clear_bits(similarity, 1)

    def cell(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Those of part x are compared with those of part y."""
        t = pa.Table.from_batches(rows)
        node, root, part, large = (np.asarray(t[c]) for c in ("node", "root", "part", "n"))
        large = large >= CLEAR_SHINGLES
        words = np.frombuffer(b"".join(t["sketch"].to_pylist()), dtype="<u8").reshape(t.num_rows, -1)
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        left, right = np.nonzero(part == x)[0], np.nonzero(part == y)[0]
        found = [np.empty((3, 0), dtype=np.int64)]
        for at in range(0, len(left), CELL):
            own = left[at : at + CELL]
            for to in range(0, len(right), CELL):
                other = right[to : to + CELL]
                bits = _apart(words[own], words[other])
                i, j = np.nonzero((bits <= far_sketch) & (root[own][:, None] != root[other][None, :]))
                apart, i, j = bits[i, j].astype(np.int64), own[i], other[j]
                clear = (apart <= sure_bits) & large[i] & large[j]
                good = (i < j if x == y else np.ones(len(i), dtype=bool)) & (clear if what == "sure" else ~clear)
                found.append(np.stack([i, j, apart])[:, good])
        i, j, apart = np.concatenate(found, axis=1)
        if what == "sure":
            least = _forest(len(node), i, j)
            i = np.nonzero(least != np.arange(len(node)))[0]
            j, apart = least[i], np.zeros(len(i), dtype=np.int64)
        elif what == "nearest":
            order = np.argsort(apart, kind="stable")
            i, j, apart = i[order], j[order], apart[order]
            first = np.unique(np.unique(np.stack([i, j], 1).ravel(), return_index=True)[1] // 2)
            i, j, apart = i[first], j[first], apart[first]
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(apart)], ["u", "v", "apart"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells (key, x, y), whose rows come together."""
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.stack([np.asarray(batch[c]).astype(np.int64) for c in ("key", "x", "y")], 1)
            edges = np.nonzero(np.r_[True, (name[1:] != name[:-1]).any(1)])[0]
            for a, b in zip(edges, np.r_[edges[1:], len(name)]):
                if held and tuple(name[a]) != now:
                    yield cell(held)
                    held = []
                now = tuple(name[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield cell(held)

    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rows = rooted.join(open_, "key").join(nodes.select("node", "sketch", "n"), "node").withColumn("part", F.expr("pmod(xxhash64(node, 7), parts)").cast("int"))
    cells = rows.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "to").alias("x"), F.greatest("part", "to").alias("y"), "part", "node", "root", "sketch", "n")
    close = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "node").mapInArrow(compare, "u long, v long, apart long")
    return _distinct(close)


def _distinct(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v, apart) once, u below v."""
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "apart").where("u < v").groupBy("u", "v").agg(F.min("apart").alias("apart"))


def _star_of(roots: DataFrame) -> DataFrame:
    """Links that make the groups of roots (node, root)."""
    return roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def between(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v, more) whose ends aren't in one group of roots (node, root)."""
    out = pairs.join(roots.select(F.col("node").alias("u"), F.col("root").alias("_u")), "u", "left").join(roots.select(F.col("node").alias("v"), F.col("root").alias("_v")), "v", "left")
    return out.where(F.coalesce("_u", "u") != F.coalesce("_v", "v")).select(*pairs.columns)


def checked(keyed: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) of the pairs (u, v) of nodes whose texts share enough of their shingles."""
    named = nodes.select("node", "least")
    pairs = pairs.join(named.select(F.col("node").alias("u"), F.col("least").alias("a")), "u").join(named.select(F.col("node").alias("v"), F.col("least").alias("b")), "v")
    pairs = cut(pairs.select("u", "v", "a", "b"), "asked")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("x")).select(F.col("x.doc").alias("doc"), F.col("x.mark").alias("mark")).distinct()
    inside, _ = split_by_keys(keyed, F.xxhash64("doc", "mark"), asked.select(F.xxhash64("doc", "mark").alias("key")))
    texts = inside.join(asked, ["doc", "mark"], "left_semi").dropDuplicates(["doc", "mark"])
    texts = cut(texts.select(F.struct("doc", "mark").alias("key"), "text"), "texts")
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(texts_of(batch, "text_a"), texts_of(batch, "text_b"))):
                x, y = (np.unique(shingle_hashes(t, shingle)) for t in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = common >= similarity * (len(x) + len(y) - common) - 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("u", "v")], ["u", "v"])

    return both.select("u", "v", "text_a", "text_b").mapInArrow(check, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc, mark, root_doc, root_mark): every row's group, named by its least (id, hash of the text).

    docs: doc_id, text. Groups join texts that share at least `similarity` of their different word shingles (Jaccard; A-Z in
    lower case), and copies; a text with fewer words than a shingle is one shingle, texts without
    words are one group. Null ids come last in the order. Recall at the threshold is about 0.95 and grows
    with similarity. Empty tables give no rows.
    """
    small_batches(docs.sparkSession)
    keyed = only(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64("text").alias("mark"), "text")
    made = cut(sketches(keyed, shingle), "sketches")
    nodes = made.groupBy("node").agg(F.min(F.struct("doc", "mark")).alias("least"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    nodes = cut(nodes, "nodes")
    met = cut(meeting(nodes, similarity), "met")
    apart = " + ".join(f"bit_count(cast(conv(hex(substring(a.sketch, {8 * i + 1}, 8)), 16, -10) as bigint) ^ cast(conv(hex(substring(b.sketch, {8 * i + 1}, 8)), 16, -10) as bigint))" for i in range(SKETCH_WORDS))
    few = met.where("not sure").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    judged = few.join(nodes.alias("a"), F.col("u") == F.col("a.node")).join(nodes.alias("b"), F.col("v") == F.col("b.node"))
    judged = judged.select("u", "v", F.expr(apart).cast("long").alias("apart"), F.least("a.n", "b.n").alias("n"))
    judged = cut(judged.where(F.col("apart") <= clear_bits(similarity, 1)), "judged")
    clear = (F.col("apart") <= clear_bits(similarity, -1)) & (F.col("n") >= CLEAR_SHINGLES)
    roots = cut(components(judged.where(clear).select("u", "v").union(met.where("sure").select("u", "v"))), "clear")
    # crowds: their clear links, then each text's nearest, then what still lies between groups
    members = cut(crowds(met), "members")
    roots = cut(components(_star_of(roots).union(compared(members, nodes, roots, similarity, "sure").select("u", "v"))), "crowds")
    unclear = cut(between(judged.where(~clear).select("u", "v", "apart"), roots), "unclear")
    both = unclear.union(compared(members, nodes, roots, similarity, "nearest"))
    nearest = both.select(F.explode(F.array("u", "v")).alias("x"), "apart", "u", "v").groupBy("x").agg(F.min(F.struct("apart", "u", "v")).alias("m")).select("m.u", "m.v").distinct()
    nearest = cut(nearest, "nearest")
    roots = cut(components(_star_of(roots).union(checked(keyed, nodes, nearest, shingle, similarity))), "groups")
    rest = between(unclear, roots).union(compared(members, nodes, roots, similarity, "all")).select("u", "v").distinct()
    rest = rest.join(nearest, ["u", "v"], "left_anti")
    roots = components(_star_of(roots).union(checked(keyed, nodes, rest, shingle, similarity)))
    rooted = cut(nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = rooted.join(least, "root").select("node", "first")
    return made.join(named, "node").select("doc", "mark", F.col("first.doc").alias("root_doc"), F.col("first.mark").alias("root_mark"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of near-duplicates, the one with the least id.

    Rows that repeat an id and its text count as one document and stay together; of rows with one id and
    different texts that are near the one with the least hash of its text stays. A null id counts as larger than all others; null, empty
    and wordless texts are one group. Columns stay as they are, whatever their names; an empty table stays empty. Very long texts
    are read whole.
    """
    plain, names = shield(docs, "doc_id", "text")
    with scratch(docs.sparkSession) as work:
        groups = near_duplicates(plain, shingle, similarity)
        gone = work.last(groups.where("doc <> root_doc or mark <> root_mark").select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark")).distinct(), "duplicates")
    keyed = plain.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "_mark": F.xxhash64("text")})
    inside, outside = split_by_keys(keyed, F.xxhash64("_doc", "_mark"), gone.select(F.xxhash64("_doc", "_mark").alias("key")))
    stay = inside.join(gone, ["_doc", "_mark"], "left_anti").select(*plain.columns)
    return stay.union(outside.select(*plain.columns)).toDF(*names)
