"""Suffix-array deduplication: later copies of byte strings go, the first stays.

A byte goes if a string of SPAN bytes that covers it also starts in a document of smaller id. In a
suffix array of the corpus, the longest previous factor of a suffix is found at the previous or next
smaller document in suffix order; the string goes where that factor has SPAN bytes or more. The array is built in
pieces that hold all suffixes which can share SPAN bytes:

1. Every window of SPAN bytes has an anchor, the GRAM-gram of least hash in it; equal windows have
   equal anchors. Anchors (about one for 16 bytes) are dealt out by hash, packed in binary rows. Those
   whose whole neighbourhood, all that windows of the anchor can reach, is in an earlier document settle there. Anchors of
   one document only settle as well. What is left has the anchor in common with other documents,
   but the neighbourhood only in part: mostly the ends of copied passages.
2. Neighbourhoods of those are dealt out by anchor. Each piece sorts its suffixes, compares
   neighbours, and takes the previous smaller document of each.

Local results are combined before rows are dealt out: of equal neighbourhoods in one chunk only
the first document's travels. An anchor with many different neighbourhoods in a chunk (a passage in a large
share of all documents) travels twice from each chunk; its windows are then dealt out one by one, by their
own hash, so that no key gathers rows in proportion to the documents.

Memory: there are as many buckets as the texts have BUCKET bytes, so a bucket does not grow with the input, and a bucket is
settled in slices of SLICE anchors or windows, each with all of its equals. Packed rows are byte planes under zstd.

Defined cases: null and empty texts keep nothing and lose nothing; texts shorter than SPAN bytes lose nothing; documents
of equal id do not count as earlier than one another; a null id comes after all others;
very long texts are taken in overlapping segments; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPAN, GRAM = 50, 20
_W = SPAN - GRAM + 1  # anchors that a window chooses from
#: Bytes a Python worker takes at a time; longer texts are cut into segments that overlap by SPAN - 1.
CHUNK = 2 << 20
#: Different neighbourhoods in a chunk that make an anchor hot.
HOT = 48
#: Bytes of text for which a bucket takes the anchors, at most, whatever the number of shuffle partitions is.
BUCKET = 32 << 20
#: Anchors or windows that are sorted at a time.
SLICE = 1 << 19
#: Positions whose hashes are worked out at a time.
_BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (minimum or maximum) over every w neighbours."""
    out = np.empty(len(x) - w + 1, x.dtype)
    for k in range(0, len(out), _BLOCK):
        y, n, size = x[k : k + _BLOCK + w - 1], len(out[k : k + _BLOCK]), 1
        while size * 2 <= w:
            y = f(y[:-size], y[size:])
            size *= 2
        out[k : k + n] = f(y[:n], y[w - size : w - size + n]) if size < w else y[:n]
    return out


class Chunk:
    """Some segments of documents: hashes, window minima and anchors."""

    def __init__(self, ids: list[int], keys: list[int], bases: list[int], parts: list[bytes], last: list[bool], unit: int):
        self.unit = unit  # bases are multiples of it
        self.last = np.array(last, bool)  # the segment ends its text
        self.raw = b"".join(parts)
        self.ids, self.keys, self.bases = np.array(ids, np.int64), np.array(keys, np.uint32), np.array(bases, np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = sizes.cumsum()
        self.starts = self.ends - sizes
        n = len(self.raw)
        self.at = np.zeros(0, np.int64)
        self.hash = np.zeros(0, _U)
        if n < SPAN:
            return
        power, self.inverse = _tables(n + 1)
        # Each of these arrays takes 8 bytes for one of the chunk: few at a time, temporary ones by blocks.
        self.sums = np.zeros(n + 1, _U)
        h, raw = np.empty(n, _U), np.frombuffer(self.raw, np.uint8)
        for k in range(0, n, _BLOCK):
            h[k : k + _BLOCK] = (raw[k : k + _BLOCK].astype(_U) + _U(1)) * power[k : min(k + _BLOCK, n)]
        np.cumsum(h, out=self.sums[1:])
        h = h[: n - GRAM + 1]
        for k in range(0, len(h), _BLOCK):
            t = min(k + _BLOCK, len(h))
            h[k:t] = _mix((self.sums[k + GRAM : t + GRAM] - self.sums[k:t]) * self.inverse[k:t]) | _U(1)
        least = _slide(h, _W, np.minimum)
        for a, b in zip(np.maximum(self.starts, self.ends - (SPAN - 1)).tolist(), self.ends.tolist(), strict=True):
            least[a:b] = 0  # windows that cross an end are none
        self.least = least
        at = []
        for k in range(0, len(h), _BLOCK):
            t, a = min(k + _BLOCK, len(h)), max(k - _W + 1, 0)
            near = np.zeros(t - k + _W - 1, _U)
            near[a - (k - _W + 1) :][: len(least[a:t])] = least[a:t]
            at.append(np.flatnonzero(_slide(near, _W, np.maximum) == h[k:t]) + k)
        self.at = np.concatenate(at)
        self.hash = h[self.at]

    def of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def reach(self, at: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the neighbourhood of an anchor starts and ends."""
        return np.maximum(at - (SPAN - GRAM), self.starts[seg]), np.minimum(at + SPAN, self.ends[seg])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from a to b."""
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(_U) * _U(0xD6E8FEB86659FD93))

    def runs(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last window whose anchor is at at; last < first if there is none."""
        s = at[:, None] - np.arange(_W)
        own = (s >= 0) & (s < len(self.least))
        own &= self.least[np.clip(s, 0, len(self.least) - 1)] == h[:, None]
        first = np.where(own, s, 1 << 60).min(1)
        return first, np.where(own, s, -1).max(1)


def _chunks(batches: Iterator[pa.RecordBatch], chunk: int, extra: int = 0) -> Iterator[tuple[Chunk, list]]:
    """Chunks of rows (id, key, text, ...); with extra, also the values of so many further columns by segment."""
    ids, keys, bases, parts, last, more, size = [], [], [], [], [], [], 0
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3 + extra)]
        for row in zip(*columns, strict=True):
            text = unpack(row[2]) if isinstance(row[2], bytes) else (row[2] or "").encode("utf-8", "surrogatepass")
            for base in range(0, max(1, len(text) - (SPAN - 1)), chunk):
                part = text[base : base + chunk + SPAN - 1]
                if size and size + len(part) > chunk:
                    yield Chunk(ids, keys, bases, parts, last, chunk), more
                    ids, keys, bases, parts, last, more, size = [], [], [], [], [], [], 0
                ids.append(row[0])
                keys.append(row[1])
                bases.append(base)
                last.append(base + len(part) == len(text))
                parts.append(part)
                more.append(row[3:])
                size += len(part)
    if parts:
        yield Chunk(ids, keys, bases, parts, last, chunk), more


def _binary(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary value for each piece of values, cut at cuts (with both ends)."""
    values = np.ascontiguousarray(values)
    offsets = (cuts * values.dtype.itemsize * (values.shape[1] if values.ndim == 2 else 1)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _by_document(ids: np.ndarray, keys: np.ndarray, spans: np.ndarray, open_: np.ndarray) -> dict[str, pa.Array]:
    """Rows of id and key with spans (id row, start, end) and open anchors (id row, position * 2 + hot). spans[:, 0] and open_[:, 0] number ids."""
    who = np.concatenate([spans[:, 0], open_[:, 0]])
    if not len(who):
        return {}
    pair = np.stack([ids[who], keys[who].astype(np.int64)], 1)
    docs, number = np.unique(pair, axis=0, return_inverse=True)
    number = number.reshape(-1)
    out = {"id": pa.array(docs[:, 0], pa.int64()), "key": pa.array(docs[:, 1], pa.int64())}
    start = np.maximum(spans[:, 1], 0)
    for name, part, num in (("spans", start << 24 | (spans[:, 2] - start), number[: len(spans)]), ("open", open_[:, 1], number[len(spans) :])):
        order = np.argsort(num, kind="stable")
        out[name] = _binary(part[order].astype(np.int64), np.searchsorted(num[order], np.arange(len(docs) + 1)))
    return out


_RESULT = [("id", pa.int64()), ("key", pa.int64()), ("spans", pa.binary()), ("open", pa.binary())]
_DEALT = [("bucket", pa.int32()), ("docs", pa.binary()), ("places", pa.binary()), ("body", pa.binary())]
_SCHEMA = "bucket int, docs binary, places binary, body binary, id long, key long, spans binary, open binary"


def _rows(columns: dict[str, pa.Array], kinds: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in kinds], names=[c for c, _ in kinds])


_DOC = np.dtype([("id", "<i8"), ("base", "<u4"), ("start", "<u4"), ("key", "<u4")])
#: 12 bytes an anchor: its hash (32 bits beside the bucket's), its neighbourhood's (40 bits), its place and whether it is hot (24 bits).
_ANCHOR = np.dtype([("a", "<u4"), ("x", "<u4"), ("y", "u1"), ("p", "<u2"), ("q", "u1")])
_PLACE = np.dtype([("at", "<u4"), ("size", "u1"), ("windows", "u1"), ("part", "u1")])


def _shrink(rows: np.ndarray, pack) -> bytes:
    """Packed rows as planes of their first bytes, second bytes and so on: sorted and small numbers shrink."""
    return pack(np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes())


def _grown(raw: bytes, kind: np.dtype, unpack) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unpack(raw), np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _document_table(c: Chunk, seg: np.ndarray) -> np.ndarray:
    """The segments in use."""
    used = np.unique(seg)
    table = np.zeros(len(used), _DOC)
    table["id"], table["base"], table["start"], table["key"] = c.ids[used], c.bases[used] // c.unit, c.starts[used], c.keys[used]
    return table


def _place(places: np.ndarray) -> np.ndarray:
    """Where in the chunk the anchors or windows are."""
    if places.dtype == _ANCHOR:
        return places["p"].astype(np.int64) | (places["q"].astype(np.int64) & 127) << 16
    return places["at"].astype(np.int64)


def _deal(c: Chunk, bucket: np.ndarray, places: np.ndarray, body: tuple[np.ndarray, np.ndarray] | None = None) -> pa.RecordBatch:
    """A row for each bucket; places are sorted by bucket. body: bytes of all places, and the size of each."""
    numbers, first = np.unique(bucket, return_index=True)
    cuts = np.append(first, len(bucket))
    seg = c.of(_place(places))
    pack = zstandard.ZstdCompressor(1).compress
    tables = [_shrink(_document_table(c, seg[a:b]), pack) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    columns = {"bucket": pa.array(numbers, pa.int32()), "docs": pa.array(tables, pa.binary()), "places": pa.array([_shrink(places[a:b], pack) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())}
    if body is not None:
        ends, raw = np.concatenate([[0], body[1].cumsum()])[cuts], body[0].tobytes()
        columns["body"] = pa.array([pack(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    return _rows(columns, _DEALT + _RESULT)


def _join(rows: list[tuple[np.ndarray, np.ndarray]], unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places of (documents, places), with their id, key and position in the document."""
    found, ids, keys, at = [], [], [], []
    for table, part in rows:
        place = _place(part)
        seg = np.searchsorted(table["start"], place, "right") - 1
        found.append(part)
        ids.append(table["id"][seg])
        keys.append(table["key"][seg])
        at.append(place - table["start"][seg] + table["base"][seg].astype(np.int64) * unit)
    return tuple(np.concatenate(x) for x in (found, ids, keys, at))


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin; keys are sorted."""
    change = np.ones(len(keys[0]), bool)
    if len(change):
        change[1:] = False
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


_NONE2, _NONE3 = np.zeros((0, 2), np.int64), np.zeros((0, 3), np.int64)


def map_anchors(buckets: int, chunk: int, most_kinds: int):
    """Documents to anchors dealt out by hash, and what is settled in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, _ in _chunks(batches, chunk):
            if not len(c.at):
                continue
            seg = c.of(c.at)
            a, b = c.reach(c.at, seg)
            x, h, ids = c.between(a, b) ^ (c.at - a).astype(_U), _mix(c.hash * _U(_BASE)), c.ids[seg]
            # Cut by a segment's edge, a neighbourhood equals none: it stays open.
            cut = ((c.at - c.starts[seg] < SPAN - GRAM) & (c.bases[seg] > 0)) | ((c.ends[seg] - c.at < SPAN) & ~c.last[seg])
            x[cut] = _mix(ids[cut].astype(_U) * _U(_BASE) + (c.at + c.bases[seg])[cut].astype(_U) * _U(0xD6E8FEB86659FD93) + _U(1))
            order = np.lexsort((ids, x, h))
            at, seg, a, b, x, h, ids = (v[order] for v in (c.at, seg, a, b, x, h, ids))
            pair, n = _groups(h, x), len(h)
            later = ids > _spread(ids[pair], pair, n)  # the same neighbourhood is in an earlier document here
            shift = c.bases[seg] - c.starts[seg]
            spans = np.stack([seg, a + shift, b + shift], 1)[later]
            at, seg, x, h, ids, shift = (v[~later] for v in (at, seg, x, h, ids, shift))
            one, n = _groups(h), len(h)
            least, most = np.minimum.reduceat(ids, one), np.maximum.reduceat(ids, one)
            hot = (np.diff(np.append(one, n)) > most_kinds) & (least < most)
            is_hot = _spread(hot, one, n)
            open_ = np.stack([seg, (at + shift) * 2 + 1], 1)[is_hot]
            # Of a hot anchor only the first and the last document's travel.
            ends = np.zeros(n, bool)
            if hot.any():
                by_id = np.lexsort((ids, h))
                ends[by_id[one]] = ends[by_id[np.append(one[1:], n) - 1]] = True
            keep = ~is_hot | ends
            at, x, h, flag = at[keep], x[keep], h[keep], is_hot[keep]
            bucket = (h & _U(0xFFFFFFFF)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            places = np.zeros(len(h), _ANCHOR)
            places["a"], places["x"], places["y"], places["p"], places["q"] = h >> _U(32), x & _U(0xFFFFFFFF), (x >> _U(32)) & _U(0xFF), at & 0xFFFF, (at >> 16) | flag.astype(np.int64) << 7
            yield _deal(c, bucket[order].astype(np.int32), places[order])
            if found := _by_document(c.ids, c.keys, spans, open_):
                yield _rows(found, _DEALT + _RESULT)
            del c  # before the next one is made

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:
    """settle() for the rows of each bucket, which come one after another; results that are there pass through."""
    names = [c for c, _ in _DEALT]
    now, held = None, []
    for batch in batches:
        done = batch.filter(pc.is_valid(batch.column("id")))
        if len(done):
            yield done.select([c for c, _ in _RESULT])
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[0] is None:
                continue
            if row[0] != now and held:
                yield from settle(held)
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield from settle(held)


def _found(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def settle_anchors(held: list[tuple], unit: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Of one bucket: neighbourhoods that an earlier document has, too, and anchors left open. Rows have their anchors in order of a,
    of which a slice takes a range."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = [(_grown(r[1], _DOC, unpack), _grown(r[2], _ANCHOR, unpack)) for r in held]
    slices = -(-sum(len(p) for _, p in rows) // most)
    edges = np.linspace(0, 1 << 32, slices + 1)[1:-1].astype(np.uint32)
    cuts = [[0, *np.searchsorted(p["a"], edges).tolist(), len(p)] for _, p in rows]
    spans, open_ = [], []
    for k in range(slices):
        part = [(d, p[c[k] : c[k + 1]]) for (d, p), c in zip(rows, cuts, strict=True) if c[k] < c[k + 1]]
        if not part:
            continue
        p, ids, keys, at = _join(part, unit)
        x = p["x"].astype(_U) | p["y"].astype(_U) << _U(32)
        order = np.lexsort((ids, x, p["a"]))
        a, x, hot, ids, keys, at = (v[order] for v in (p["a"], x, p["q"] >> 7, ids, keys, at))
        pair, n = _groups(a, x), len(a)
        later = ids > _spread(ids[pair], pair, n)
        one = _groups(a)
        first = np.where(later, np.iinfo(np.int64).max, ids)
        last = np.where(later, np.iinfo(np.int64).min, ids)
        warm = np.maximum.reduceat(hot, one)
        left = _spread((np.minimum.reduceat(first, one) < np.maximum.reduceat(last, one)) | (warm > 0), one, n) & ~later
        spans.append((ids[later], keys[later], at[later]))
        open_.append((ids[left], keys[left], at[left] * 2 + _spread(warm, one, n)[left]))
    if not spans:
        return
    (ids, keys, at), (open_ids, open_keys, left) = _found(spans), _found(open_)
    # The neighbourhood of a settled anchor is cut at the text's ends where its bytes are taken out.
    spans = np.stack([np.arange(len(at)), at - (SPAN - GRAM), at + SPAN], 1)
    if found := _by_document(np.append(ids, open_ids), np.append(keys, open_keys), spans, np.stack([np.arange(len(left)) + len(at), left], 1)):
        yield _rows(found, _RESULT)


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Sorted, disjoint, not touching: the union of spans within n bytes."""
    spans = np.clip(spans, 0, n)
    spans = spans[spans[:, 0] < spans[:, 1]]
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], reach[np.append(new[1:], len(spans)) - 1]], 1)


def _pairs(values: list[bytes] | None) -> np.ndarray:
    """Start and end of spans that were packed into 40 and 24 bits."""
    packed = np.frombuffer(b"".join(values or []), np.int64)
    return np.stack([packed >> 24, (packed >> 24) + (packed & 0xFFFFFF)], 1)


def map_suffixes(buckets: int, chunk: int):
    """Documents with open anchors to neighbourhoods dealt out by anchor, or windows of hot anchors by their own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, more in _chunks(batches, chunk, 2):
            if not len(c.at):
                continue
            at, hot, begun = [], [], np.zeros(len(c.raw) + 1, np.int32)
            for k, (spans, left) in enumerate(more):
                v = np.unique(np.frombuffer(b"".join(left), np.int64))
                p = (v >> 1) - c.bases[k]
                size = c.ends[k] - c.starts[k]
                inside = (p >= 0) & (p <= size - GRAM)
                at.append(p[inside] + c.starts[k])
                hot.append(v[inside] & 1)
                if spans:
                    done = np.clip(_pairs(spans) - c.bases[k], 0, size) + c.starts[k]
                    done = done[done[:, 1] - done[:, 0] >= SPAN]
                    np.add.at(begun, done[:, 0], 1)
                    np.add.at(begun, done[:, 1] - SPAN + 1, -1)
            at, hot = np.concatenate(at), np.concatenate(hot)
            # A window within one settled neighbourhood is in an earlier document. One that only their union covers need not be: later
            # documents may have it from here.
            free = np.flatnonzero(np.cumsum(begun, out=begun) == 0)
            some = np.searchsorted(free, at - (SPAN - GRAM)) < np.searchsorted(free, at, "right")
            at, hot = at[some], hot[some]
            i = np.searchsorted(c.at, at)
            real = (i < len(c.at)) & (c.at[np.minimum(i, len(c.at) - 1)] == at)
            order = np.argsort(at[real] * 2 - hot[real], kind="stable")
            at, hot, i = at[real][order], hot[real][order], i[real][order]
            new = _groups(at)
            at, hot, i = at[new], hot[new] > 0, i[new]
            h = c.hash[i]
            first, last = c.runs(at, h) if len(at) else (at, at)
            if len(at):
                first, last = np.append(free, 1 << 60)[np.searchsorted(free, first)], np.append(-1, free)[np.searchsorted(free, last, "right")]
            some = first <= last
            at, hot, h, first, last = at[some], hot[some], h[some], first[some], last[some]
            own = _mix(h * _U(_BASE))
            windows = np.concatenate([np.arange(f, t + 1) for f, t in zip(first[hot], last[hot], strict=True)]) if hot.any() else np.zeros(0, np.int64)
            if len(windows):  # of equal windows here only the first document's travels
                windows = np.unique(windows)
                seg = c.of(windows)
                g = c.between(windows, windows + SPAN)
                order = np.lexsort((c.ids[seg], g))
                windows, seg, g = windows[order], seg[order], g[order]
                pair = _groups(g)
                later = c.ids[seg] > _spread(c.ids[seg][pair], pair, len(g))
                shift = (c.bases[seg] - c.starts[seg])[later]
                if found := _by_document(c.ids, c.keys, np.stack([seg[later], windows[later] + shift, windows[later] + shift + SPAN], 1), _NONE2):
                    yield _rows(found, _DEALT + _RESULT)
                windows, g = windows[~later], g[~later]
                first, last, own = np.concatenate([first[~hot], windows]), np.concatenate([last[~hot], windows]), np.concatenate([own[~hot], g])
            if not len(first):
                continue
            bucket = (own & _U(0xFFFFFFFF)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, first, last, own = bucket[order], first[order], last[order], own[order]
            places = np.zeros(len(first), _PLACE)
            places["at"], places["size"], places["windows"], places["part"] = first, last - first + SPAN, last - first + 1, own >> _U(56)
            size = places["size"].astype(np.int64)
            begin = size.cumsum() - size
            body = np.frombuffer(c.raw, np.uint8)[np.arange(size.sum()) - np.repeat(begin - first, size)]
            yield _deal(c, bucket.astype(np.int32), places, (body, size))
            del c

    return run


def suffix_order(body: np.ndarray, at: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at at in order of their first SPAN bytes, then ties; and where the previous one in order
    has fewer than SPAN bytes in common."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)]).astype(_U)
    word = padded[:-7] << _U(56)
    for k in range(1, 8):
        word |= padded[k : len(padded) - 7 + k] << _U(56 - 8 * k)
    columns = [word[at + k] for k in range(0, SPAN - 8, 8)] + [word[at + SPAN - 8]]
    order = np.lexsort((ties, *columns[::-1]))
    return order, _groups(*(k[order] for k in columns))


def settle_suffixes(held: list[tuple], unit: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Of one bucket: windows whose longest previous factor has SPAN bytes or more. Equal windows have equal parts; a slice takes some parts."""
    unpack = zstandard.ZstdDecompressor().decompress
    p, ids, keys, at = _join([(_grown(r[1], _DOC, unpack), _grown(r[2], _PLACE, unpack)) for r in held], unit)
    body = np.frombuffer(b"".join(unpack(r[3]) for r in held), np.uint8)
    begin = p["size"].cumsum(dtype=np.int64) - p["size"]
    slices = (np.bincount(p["part"], p["windows"], 256).cumsum().astype(np.int64) - 1) // most
    spans = []
    for k in np.unique(slices[p["part"]]).tolist():
        own = np.flatnonzero(slices[p["part"]] == k)
        size, n = p["size"][own].astype(np.int64), p["windows"][own].astype(np.int64)
        start = size.cumsum() - size
        owner = np.repeat(np.arange(len(own)), n)
        step = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        order, runs = suffix_order(body[np.arange(size.sum()) + np.repeat(begin[own] - start, size)], start[owner] + step, ids[own][owner])
        who = ids[own][owner[order]]
        # Ties stand in order of documents: a run's first is the previous smaller document of those behind it.
        hit = np.zeros(len(order) + 2, bool)
        hit[order[who > _spread(who[runs], runs, len(who))] + 1] = True
        # Neighbouring windows of a place make one span.
        edge = np.append(step == 0, True)
        first = np.flatnonzero(hit[1:-1] & (~hit[:-2] | edge[:-1]))
        last = np.flatnonzero(hit[1:-1] & (~hit[2:] | edge[1:]))
        i = own[owner[first]]
        spans.append((i, at[i] + step[first], at[i] + step[last] + SPAN))
    if spans and (found := _by_document(ids, keys, np.stack(_found(spans), 1), _NONE2)):
        yield _rows(found, _RESULT)


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(3).compress
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in b.column(3).to_pylist()], pa.binary())], names=b.schema.names)


def _digest(raw: bytes, spans: np.ndarray) -> tuple[int, int, int, str, bytes]:
    gone = covered(spans, len(raw))
    edges = [0, *gone.reshape(-1).tolist(), len(raw)]
    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    return len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept


def _finish(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            unpack = zstandard.ZstdDecompressor().decompress
            done = [_digest(unpack(t), np.concatenate([_pairs(a), _pairs(b)])) for t, a, b in zip(*columns, strict=True)]
            arrays = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *arrays, *([pa.array([d[4] for d in done], pa.binary())] if keep else [])], names=[*batch.schema.names[3:], "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = False, chunk: int = CHUNK, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """doc_id with n_bytes, n_removed, n_spans, kept_sha256, and with keep the bytes that are left."""
    spark = docs.sparkSession
    common.tune(spark)
    size = docs.agg(F.sum(F.octet_length(f"`{text}`"))).first()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket))
    own = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit((1 << 63) - 1))
    # key tells rows of one id but different texts apart
    rows = docs.select(own.alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id")).withColumn("key", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))

    def dealt(df: DataFrame, mapped, settle) -> DataFrame:
        own = "coalesce(bucket, cast(pmod(hash(id, key), %d) as int))" % buckets
        moved = df.mapInArrow(common.released(mapped), _SCHEMA).repartition(buckets, F.expr(own)).sortWithinPartitions("bucket")
        found = moved.mapInArrow(common.released(lambda batches: _by_bucket(batches, lambda held: settle(held, chunk))), "id long, key long, spans binary, open binary")
        return found.groupBy("id", "key").agg(F.collect_list(F.when(F.length("spans") > 0, F.col("spans"))).alias("spans"), F.collect_list(F.when(F.length("open") > 0, F.col("open"))).alias("open"))

    first = dealt(rows.select("id", "key", "text"), map_anchors(buckets, chunk, hot), settle_anchors)
    packed = rows.select("id", "key", "doc_id", "text").mapInArrow(common.released(_pack_texts), "id long, key long, doc_id %s, text binary" % docs.schema[doc_id].dataType.simpleString())
    joined = packed.join(first, ["id", "key"], "left")
    settled = F.col("open").isNull() | (F.size("open") == 0)
    # Rows that are settled need their digest only; the others keep their text for the second round.
    fields = "doc_id %s, id long, key long, text binary, spans array<binary>, open array<binary>, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" % docs.schema[doc_id].dataType.simpleString()

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("text", "spans", "open")]
            unpack = zstandard.ZstdDecompressor().decompress
            done = [(None,) * 5 if left else _digest(unpack(t), _pairs(s)) for t, s, left in zip(*columns, strict=True)]
            texts = [t if left else None for t, left in zip(columns[0], columns[2], strict=True)]
            spans = [s if left else None for s, left in zip(columns[1], columns[2], strict=True)]
            arrays = [b.column("doc_id"), b.column("id"), b.column("key"), pa.array(texts, pa.binary()), pa.array(spans, pa.list_(pa.binary())), pa.array(columns[2], pa.list_(pa.binary()))]
            arrays += [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            arrays.append(pa.array([d[4] if keep else None for d in done], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "id", "key", "text", "spans", "open", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    halfway = common.materialise(joined.mapInArrow(common.released(half), fields), "repeats", clean=True)
    waiting = halfway.where(~settled)
    second = dealt(waiting.select("id", "key", "text", "spans", "open"), map_suffixes(buckets, chunk), settle_suffixes).select("id", "key", F.col("spans").alias("more"))
    out = ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string", *(["kept binary"] if keep else [])]
    names = ["doc_id", *(o.split()[0] for o in out)]
    rest = waiting.join(second, ["id", "key"], "left").select("text", "spans", "more", "doc_id").mapInArrow(common.released(_finish(keep)), "doc_id %s, %s" % (docs.schema[doc_id].dataType.simpleString(), ", ".join(out)))
    return halfway.where(settled).select(names).unionByName(rest).withColumnRenamed("doc_id", doc_id)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
