"""MinHash near-duplicate detection with order: documents whose words align to 0.8 or more share a class.

Words are runs of bytes above the space. Each 5-word shingle is labelled with its occurrence number in the
text. Each of SKETCHES hash functions picks the DRAWN least labels, and keeps them in text order: a
sketch. Texts that share a sketch are candidates. A candidate link holds if the edit distance of the word sequences, by bit-parallel
alignment in a band as wide as the distance allows, is at most 0.2 of the longer one; lengths and common words and word pairs bound it first.
Texts of SHORT words at most, to which 0.8 allows one edit, have the hashes of their words, and of their words less each one, for
keys: two of them are one edit apart, or none, only if they share such a key. Texts under 5 words match equal word sequences only.
Classes are the connected components of links; equal texts are one node from the start.

Candidates are compared in ROUNDS of stars first: each text with the first (then the last) text of all its buckets that is of
another class, so a round has no more pairs than texts. Then all members of a bucket that are of different classes are compared, in
blocks of two groups of them; members of a class stay partners for those outside it. Nothing left over is dropped.

No bucket is ever gathered in a task: centres come from partial aggregates, and blocks are bounded in rows and words.

Defined cases: null counts as the empty text; all texts without words but equal are one class;
repeated rows fall into one class, also under equal ids; class_id is the least doc_id of the class (nulls aside);
an empty table gives an empty table. Columns of docs that clash with results are ignored: only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph
from .repeats import _mix, _powers, _tables, _U

WORDS, SIMILAR = 5, 0.8
#: At a shingle similarity of 0.8 two texts share one of 24 sketches of 4 with a probability over 0.99999, at 0.6 of 0.96.
SKETCHES, DRAWN = 24, 4
#: Longest texts, in words, to which SIMILAR allows one edit only.
SHORT = 9
#: Rounds of stars in buckets before all their members of different classes are compared.
ROUNDS = 2
#: Rows and words of a group of bucket members; a block holds two groups. Bins in which a block counts words and word pairs.
GROUP_ROWS, GROUP_WORDS, BINS = 256, 1 << 20, 512
#: Batches of texts to hash: a byte of text takes some 40 of memory in a worker.
BATCH_ROWS, BATCH_BYTES = 256, 2 << 20
#: Texts of more words are aligned by few diagonals first.
LONG, FEW = 8192, 64
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and the number of words in each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    power, inverse = _tables(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, _U), ((raw.astype(_U) + _U(1)) * power[: len(raw)]).cumsum()])
    inside = np.concatenate([[False], raw > 32])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = change[::2], change[1::2]
    h = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, sizes.cumsum())]))
    return h, counts


def sketches(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SKETCHES hashes for each text; zeros for a text of less than DRAWN shingles."""
    out = np.zeros((len(counts), SKETCHES), _U)
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(h)
    if not n:
        return out
    s = np.zeros(n, _U)
    for k in range(WORDS):
        part = np.zeros(n, _U)
        same = doc[k:] == doc[: n - k]
        part[: n - k][same] = h[k:][same]
        s = (s + part) * _U(0x9FB21C651E98DF25)
    s = _mix(s)
    first = np.repeat(counts.cumsum() - counts, counts)
    keep = np.arange(n) - first < np.maximum(counts - WORDS + 1, 1)[doc]
    s, doc = s[keep], doc[keep]
    n = len(s)
    # Occurrence labels
    key = s ^ _mix(doc.astype(_U) + _U(1))
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    begin = np.flatnonzero(new)
    number = np.empty(n, np.int64)
    number[order] = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    label = _mix(s + number.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
    shingles = np.bincount(doc, minlength=len(counts))
    long = shingles >= DRAWN
    if long.any():
        label = label[long[doc]]
        sizes = shingles[long]
        starts = sizes.cumsum() - sizes
        for j in range(SKETCHES):
            v = label * _U(2 * j + 0xD1B54A32D192ED03)
            v ^= v >> _U(32)
            v *= _U(0xAEF17502108EF2D9)
            at = np.empty((DRAWN, len(sizes)), np.int64)
            for d in range(DRAWN):
                found = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, starts), sizes))
                if len(found) != len(sizes):  # two labels of a text collide
                    found = found[np.unique(np.searchsorted(starts, found, "right"), return_index=True)[1]]
                at[d] = found
                v[found] = _MAX
            at.sort(0)
            one = np.full(len(sizes), j + 1, _U)
            for d in range(DRAWN):
                one = _mix(one * _U(0x9E3779B97F4A7C15) + label[at[d]])
            out[long, j] = one
    return out


def short_keys(h: np.ndarray) -> list[int]:
    """Hashes of the words of a short text, and of its words less each one; under 5 words an edit is over the limit."""
    every = [h] if len(h) < WORDS else [h, *(np.delete(h, i) for i in range(len(h)))]
    return list(dict.fromkeys(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "big", signed=True) for x in every))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        h, counts = word_hashes(texts)
        found = sketches(h, counts).view(np.int64)
        cuts = np.concatenate([[0], counts.cumsum()])
        parts = [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        shorts = [short_keys(x) if 0 < len(x) <= SHORT else [] for x in parts]
        drawn = [f if len(x) >= WORDS + DRAWN - 1 else None for f, x in zip(found, parts, strict=True)]
        words = [(x >> _U(32)).astype(np.uint32).tobytes() for x in parts]
        columns = [batch.column(0), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()), pa.array(counts, pa.int64()), pa.array(drawn, pa.list_(pa.int64())), pa.array(shorts, pa.list_(pa.int64())), pa.array(words, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n", "sketch", "short", "words"])
    _powers.clear()  # 16 bytes for each byte of the longest batch


def _diagonals(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """The edit distance, or most + 1 if it is larger: the furthest place on each diagonal of a band that widens with the
    distance, moved on by the longest common run (binary search on prefix hashes)."""
    n, m = len(x), len(y)
    power, _ = _tables(max(n, m) + 2)
    hx, hy = (np.concatenate([np.zeros(1, _U), ((v.astype(_U) + _U(1)) * power[: len(v)]).cumsum()]) for v in (x, y))
    top = max(n, m).bit_length()

    def run(i: np.ndarray, k: np.ndarray) -> np.ndarray:
        i, j = i.copy(), i + k
        for b in range(top, -1, -1):
            step = 1 << b
            ok = (i + step <= n) & (j + step <= m)
            a, c = np.where(ok, i, 0), np.where(ok, j, 0)
            size = np.where(ok, step, 0)
            ok &= (hx[a + size] - hx[a]) * power[c] == (hy[c + size] - hy[c]) * power[a]
            i[ok] += step
            j[ok] += step
        return i

    far = run(np.zeros(1, np.int64), np.zeros(1, np.int64))
    goal = m - n
    for d in range(most + 1):
        if d:
            k = np.arange(-d, d + 1)
            low = np.full(2 * d + 1, -1, np.int64)
            low[1:-1] = far + 1  # replaced
            low[2:] = np.maximum(low[2:], far)  # only in y
            low[:-2] = np.maximum(low[:-2], far + 1)  # only in x
            low = np.minimum(low, np.minimum(n, m - k))
            good = (low >= 0) & (low + k >= 0)
            far = np.where(good, run(np.where(good, low, 0), np.where(good, k, 0)), -2)
        if abs(goal) <= d and far[goal + d] >= n:
            return d
    return most + 1


def _banded(x: list[int], y: list[int], most: int) -> int:
    """The edit distance, or most + 1 if it is larger: bit vectors of the differences between neighbours in a band of 2 most + 1
    diagonals, which slides down with each word of y. x has more words than most."""
    n, m = len(x), len(y)
    places: dict[int, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << (i + most)
    width = 2 * most + 1
    ones = (1 << width) - 1
    up, down = ((1 << (most + 1)) - 1) << most, 0
    at, bottom, last = most, 1 << (width - 1), 1 << (width - 2) if width > 1 else 1
    limit = most + m - (n - most)
    for j, w in enumerate(y):
        same = places.get(w, 0) >> j & ones
        flat = ((same & up) + up ^ up | same | down) & ones
        plus, minus = down | ~(flat | up) & ones, flat & up
        if j < n - most:
            at += not flat & bottom
        else:
            at += bool(plus & last) - bool(minus & last)
            last >>= 1
        if at > limit:
            return most + 1
        up, down = minus | ~(flat >> 1 | plus) & ones, flat >> 1 & plus
    return min(at, most + 1)


def distance(x: np.ndarray, y: np.ndarray, most: int) -> int:
    """The edit distance of two sequences, or most + 1 if it is larger."""
    if abs(len(x) - len(y)) > most:
        return most + 1
    size = min(len(x), len(y))
    for side in (1, -1):  # what both begin with, and end with
        other = np.flatnonzero(x[::side][:size] != y[::side][:size])
        same = int(other[0]) if len(other) else size
        x, y = (v[same:] if side == 1 else v[: len(v) - same] for v in (x, y))
        size -= same
    if not size:
        return max(len(x), len(y))
    if not most:
        return 1
    if max(len(x), len(y)) > LONG:
        d = _diagonals(x, y, min(most, FEW))
        if d <= FEW or most <= FEW:
            return d
    if size <= most:  # a band would be wider than the matrix: as many words more that are equal
        pad = np.zeros(most, np.uint64)
        x, y = (np.concatenate([v.astype(np.uint64) + np.uint64(1), pad]) for v in (x, y))
    return _banded(x.tolist(), y.tolist(), most)


class Text:
    """A text's words, with what bounds its distance to others, made when it is asked for."""

    __slots__ = ("words", "_bags")

    def __init__(self, words: np.ndarray):
        self.words, self._bags = words, {}

    def bag(self, k: int) -> np.ndarray:
        """Runs of k words, told apart by their occurrence number, sorted."""
        if k not in self._bags:
            x = self.words.astype(_U)
            if k == 2:
                x = _mix(x[:-1] * _U(0x9E3779B97F4A7C15) + x[1:]) >> _U(33)
            x = np.sort(x.astype(np.int64))
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            begin = np.flatnonzero(new)
            self._bags[k] = x << 31 | (np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x)))))
        return self._bags[k]


def allowed(size, least: float):
    """Edits that a longer text of so many words may have."""
    return ((1 - least) * size + 1e-9) // 1


def similar(x: Text | np.ndarray, y: Text | np.ndarray, least: float = SIMILAR) -> bool:
    x, y = (v if isinstance(v, Text) else Text(v) for v in (x, y))
    size = max(len(x.words), len(y.words))
    most = int(allowed(size, least))
    if abs(len(x.words) - len(y.words)) > most:
        return False
    # An edit changes one word and two pairs of words, so what the two have in common at all, in any order, bounds the alignment.
    for k in (1, 2):
        needed = size - k + 1 - k * most
        if needed > 0:
            both = np.sort(np.concatenate([x.bag(k), y.bag(k)]), kind="stable")
            if (both[1:] == both[:-1]).sum() < needed:
                return False
    return distance(x.words, y.words, most) <= most


def _in_blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Slices of batches with equal values in the first columns, and whether a new block begins with it."""
    block = None
    for batch in batches:
        if not batch.num_rows:
            continue
        found = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(keys)], 1)
        cuts = [0, *(np.flatnonzero((found[1:] != found[:-1]).any(1)) + 1).tolist(), len(found)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield block is None or bool((found[start] != block).any()), batch.slice(start, end - start)
            block = found[start]


_LINKS = "a long, b long"


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _star_links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = node = None
        for new, rows in _in_blocks(batches, 2):
            found = []
            for i, (own, words) in enumerate(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), strict=True)):
                text = Text(np.frombuffer(words, np.uint32))
                if new and not i:  # sorted, the centre is the first
                    centre, node = text, own
                elif similar(centre, text, least):
                    found.append((node, own))
            yield _links(found)

    return run


def _classes(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (node, class) after the classes that found links are one; nodes without links have no row."""
    named = found
    for side in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(side), F.col("class").alias(f"{side}_class")), side, "left")
    merged = graph.components(named.select(F.coalesce("a_class", "a").alias("a"), F.coalesce("b_class", "b").alias("b")))
    moved = labels.select("node", F.col("class").alias("old")).unionByName(merged.select("node", F.col("node").alias("old"))).distinct()
    return common.materialise(moved.join(merged.select(F.col("node").alias("old"), "class"), "old", "left").groupBy("node").agg(F.min(F.coalesce("class", "old")).alias("class")), "classes")


def _stars(buckets: DataFrame, labels: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Compares each bucket member with a centre, in ROUNDS, and returns labels: the cheap way to the classes that most members have in common."""
    for turn in range(ROUNDS):
        named = buckets.join(labels, "node", "left").select("key", "node", "n", F.coalesce("class", "node").alias("class"))
        end = F.min if turn % 2 == 0 else F.max
        centres = named.groupBy("key").agg(end(F.struct("node", "n", "class")).alias("c"), F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("key", "c")
        # One centre for each node: the first, or last, of those of its buckets.
        others = named.join(centres, "key").where((F.col("class") != F.col("c.class")) & (F.least("n", "c.n") >= least * F.greatest("n", "c.n")))
        pairs = common.materialise(others.groupBy("node").agg(end("c.node").alias("centre"), F.first("n").alias("n")), "pairs")
        if pairs.isEmpty():
            break
        parts = pairs.groupBy("centre").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_ROWS, F.sum("n") / GROUP_WORDS)).cast("int").alias("g"))
        dealt = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("node"), "g").cast("int").alias("part"), F.lit(1).alias("other"), "node")
        heads = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("part"), F.lit(0).alias("other"), F.col("centre").alias("node"))
        rows = dealt.unionByName(heads).join(words, "node").select("centre", "part", "other", "node", "words")
        found = common.materialise(rows.repartition("centre", "part").sortWithinPartitions("centre", "part", "other").mapInArrow(common.released(_star_links(least)), _LINKS), "links")
        if not found.isEmpty():
            labels = _classes(labels, found)
    return labels


def _every(members: DataFrame, labels: DataFrame, sketched: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Compares all bucket members (key, j, node, n) of different classes, and returns labels.

    A bucket is divided by length: a part has the texts of one step of lengths, and, as partners of those only, the texts of the next step.
    A part of g groups makes a block of each two groups and of each group with itself, so a task holds two groups at most.
    """
    named = members.join(labels, "node", "left").select("key", "j", "node", "n", F.coalesce("class", "node").alias("class"))
    mixed = named.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("key")
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(least))).cast("int")
    parted = named.join(mixed, "key").withColumn("away", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("step", step - F.col("away"))
    groups = F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_ROWS, F.sum("n") / GROUP_WORDS)).cast("int")
    several = parted.groupBy("key", "step").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("away").alias("home"), groups.alias("g")).where("low != high and home = 0").select("key", "step", "g")
    own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    dealt = parted.join(several, ["key", "step"]).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    dealt = dealt.select("key", "step", F.least("own", "with").alias("first"), F.greatest("own", "with").alias("second"), "own", "away", "j", "node", "n", "class")
    full = dealt.join(sketched, "node").join(words, "node").select("key", "step", "first", "second", "own", "away", "j", "node", "n", "class", "sketch", "words")
    # Rows of a block stand together.
    blocks = full.repartition("key", "step", "first", "second").sortWithinPartitions("key", "step", "first", "second")
    found = common.materialise(blocks.mapInArrow(common.released(_block_links(least)), _LINKS).distinct(), "links")
    return labels if found.isEmpty() else _classes(labels, found)


def _block_links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for new, rows in _in_blocks(batches, 4):
            if new and held:
                yield _links(_pairs(pa.Table.from_batches(held), least))
                held = []
            held.append(rows)
        if held:
            yield _links(_pairs(pa.Table.from_batches(held), least))

    return run


def _pairs(block: pa.Table, least: float) -> list[tuple[int, int]]:
    """Pairs that align, of those in a block that share its bucket's sketch and none before it; what links have joined is one class."""
    block = block.take(pa.array(np.argsort(block["n"].to_numpy(), kind="stable")))
    first, second, own, away, j, node, n, named = (block[c].to_numpy() for c in ("first", "second", "own", "away", "j", "node", "n", "class"))
    blank = [0] * SKETCHES
    drawn = np.array([x or blank for x in block["sketch"].to_pylist()], np.int64)
    texts = [Text(np.frombuffer(w, np.uint32)) for w in block["words"].to_pylist()]
    most = allowed(n, least).astype(np.int64)
    # Words and pairs of words counted by BINS of their hashes: what two texts have in common there bounds what they have in common at all.
    counts = [np.stack([np.bincount((t.bag(k) >> 31) & (BINS - 1), minlength=BINS) for t in texts]).astype(np.int32) for k in (1, 2)]
    across = first[0] != second[0]
    links = []
    for p in range(len(n)):
        # Sorted by length, the others are the longer ones; those longer than the bound are at the end.
        q = np.arange(p + 1, p + 1 + np.searchsorted(n[p + 1 :] - most[p + 1 :], n[p], "right"))
        q = q[(named[q] != named[p]) & (away[q] + away[p] < 2)]
        if across:
            q = q[own[q] != own[p]]
        if j[p] < SKETCHES:
            same = drawn[q] == drawn[p]
            q = q[same[:, j[p]] & (same.argmax(1) == j[p])]
        for k in (1, 2):
            q = q[np.minimum(counts[k - 1][q], counts[k - 1][p]).sum(1) >= n[q] - k + 1 - k * most[q]]
        for other in q.tolist():
            if named[other] != named[p] and similar(texts[p], texts[other], least):
                links.append((node[p], node[other]))
                named = np.where(named == named[other], named[p], named)
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size, text_key (MD5 of the text), class (a number): a row for each row of docs. Scratch tables are gone when it returns."""
    spark = docs.sparkSession
    common.tune(spark, BATCH_ROWS, BATCH_BYTES)
    with common.scratch(spark):
        rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        drawn = rows.mapInArrow(common.released(_sketch), "doc_id long, text_key binary, n long, sketch array<long>, short array<long>, words binary").withColumn("row", F.monotonically_increasing_id())
        drawn = common.materialise(drawn, "sketches")
        nodes = drawn.groupBy("text_key").agg(F.min(F.struct("row", "n", "sketch", "short")).alias("m")).select("text_key", F.col("m.row").alias("node"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch"), F.col("m.short").alias("short"))
        nodes = common.materialise(nodes, "nodes")
        short = F.transform("short", lambda s: F.struct(F.lit(SKETCHES).alias("j"), s.alias("s")))
        drawings = F.transform(F.coalesce("sketch", F.array().cast("array<long>")), lambda s, j: F.struct(j.alias("j"), s.alias("s")))
        members = nodes.where("n > 0").select("node", "n", F.explode(F.concat(drawings, short)).alias("m")).select(F.xxhash64("m.j", "m.s").alias("key"), F.col("m.j").alias("j"), "node", "n")
        shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
        buckets = common.materialise(members.join(shared, "key"), "buckets")
        candidates = buckets.select(F.col("node").alias("row")).distinct()
        words = common.materialise(drawn.select("row", "words").join(candidates, "row").withColumnRenamed("row", "node"), "words")
        labels = spark.createDataFrame([], "node long, class long")
        labels = _stars(buckets.select("key", "node", "n"), labels, words, least)
        labels = _every(buckets, labels, nodes.select("node", "sketch"), words, least)
        named = drawn.select("doc_id", "text_key").join(nodes.select("text_key", "node"), "text_key").join(labels, "node", "left").select("doc_id", "text_key", F.coalesce("class", "node").alias("class"))
        sizes = named.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
        return common.materialise(named.join(sizes, "class").select("doc_id", "class_id", "class_size", "text_key", "class"), "near_duplicates", keep=True)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
