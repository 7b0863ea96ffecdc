"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by concatenating pieces.

The rank table (about 50,000 entries) is a constant of the program, shipped once per executor.
Words repeat, so each Python worker folds the merges once per distinct word and keeps the
result in a bounded table; documents are then put together by look-ups.

Defined cases: a null or empty text has no tokens, ids_sha256 and decoded_sha256 are those
of the empty string; extra columns stay untouched unless they clash with a result column,
in which case the result column replaces them; repeated rows give repeated rows; an
empty table gives an empty table. Special tokens are never produced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Entries kept of distinct words in a Python worker, in each of two generations; words in use move to the younger.
MEMO = 100_000
#: Characters of words kept in each: words may be long.
MEMO_CHARS = 4 << 20
#: Letters, numbers and white space among the first 256 characters.
LATIN_L = "[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]"
LATIN_N = "[0-9\xb2\xb3\xb9\xbc-\xbe]"
LATIN_S = "[ \t-\r\x85\xa0]"
WIDE = re.compile("[^\x00-\xff]").search
#: Words longer than this many bytes are folded with a heap instead of a scan.
SCAN = 64
NONE = 1 << 40


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """bytes -> rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word: the neighbouring pair of lowest rank is merged, leftmost first, until none is in the table."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SCAN:
        return _fold_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    worst = 1 << 60
    scores = [get(parts[i] + parts[i + 1], worst) for i in range(len(parts) - 1)]
    while scores:
        best = min(scores)
        if best == worst:
            break
        i = scores.index(best)
        parts[i] += parts.pop(i + 1)
        scores.pop(i)
        if i < len(scores):
            scores[i] = get(parts[i] + parts[i + 1], worst)
        if i:
            scores[i - 1] = get(parts[i - 1] + parts[i], worst)
    return [ranks[p] for p in parts]


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap over a linked list: n log n for very long words."""
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts here; 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i:
            j = before[i]
            if (r := ranks.get(word[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def latin_pattern() -> re.Pattern:
    """The default split pattern for texts of Latin-1 characters."""
    letters, numbers, space = LATIN_L[1:-1], LATIN_N[1:-1], LATIN_S[1:-1]
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


class Codec:
    """Encoder and decoder over one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pieces = ranks, {r: p for p, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        #: The same split for texts of Latin-1 characters only, where the classes can be spelt out for the faster matcher.
        self.split_latin = latin_pattern().findall if pattern == default_pattern() else None
        self.memo: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}
        self.chars = 0
        self.pairs = self.__pair_table()
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def __pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the pairs of ids whose joined bytes are in the rank table, and the ids they give."""
        keys, out = [], []
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    out.append(rank)
        order = np.argsort(keys)
        return np.array(keys, np.int64)[order], np.array(out, np.int64)[order]

    def __joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id of each joined pair, NONE where there is none (b < 0: behind the end)."""
        keys, ids = self.pairs
        key = a << 32 | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (b >= 0), ids[at], NONE)

    def fold_all(self, words: list[bytes]) -> list[list[int]]:
        """fold() of many distinct words at once: each round merges the best pair of every word that still has one."""
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else fold(w, self.ranks) if len(w) > SCAN else None for w in words]
        rest = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(words[i]))
        for k in range(0, len(rest), 4096):
            rows = np.array(rest[k : k + 4096])
            width = len(words[rows[-1]])
            raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
            long = np.array([len(words[i]) for i in rows])
            ids = np.where(np.arange(width) < long[:, None], self.single[raw], -1)
            best = self.__joined(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(rows), 1), NONE)
            while len(rows):
                at = best.argmin(1)
                rank = best[np.arange(len(rows)), at]
                live = rank < NONE
                for i, x in zip(rows[~live].tolist(), ids[~live].tolist(), strict=True):
                    out[i] = [v for v in x if v >= 0]
                rows, ids, best, at, rank = rows[live], ids[live], best[live], at[live], rank[live]
                if not len(rows):
                    break
                every, column = np.arange(len(rows)), np.arange(width)
                ids[every, at] = rank
                ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), column + (column > at[:, None]), 1)
                best = np.take_along_axis(np.pad(best, ((0, 0), (0, 1)), constant_values=NONE), column[:-1] + (column[:-1] > at[:, None]), 1)
                here = at < width - 1
                best[every[here], at[here]] = self.__joined(ids[every[here], at[here]], ids[every[here], at[here] + 1])
                left = at > 0
                best[every[left], at[left] - 1] = self.__joined(ids[every[left], at[left] - 1], ids[every[left], at[left]])
        return out

    def learn(self, words: set[str]) -> None:
        """Puts words into the table: decimal ids joined by commas, their number, the bytes they decode to."""
        if len(self.memo) > MEMO or self.chars > MEMO_CHARS:
            self.old, self.memo, self.chars = self.memo, {}, 0
        old = self.old
        new = []
        for w in words.difference(self.memo):
            self.chars += len(w)
            if w in old:
                self.memo[w] = old[w]
            else:
                new.append(w)
        for w, ids in zip(new, self.fold_all([w.encode("utf-8", "replace") for w in new]), strict=True):
            self.memo[w] = ",".join(map(str, ids)), len(ids), self.decode(ids)

    def words(self, text: str) -> list[str]:
        return self.split_latin(text) if self.split_latin and not WIDE(text) else self.split(text)

    def encode(self, text: str) -> list[tuple[str, int, bytes]]:
        """An entry of the table for each word of text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[tuple[str, int, bytes]]]:
        """encode() of a few texts; merges are folded once for each distinct word."""
        split = [self.words(x) for x in texts]
        self.learn(set().union(*split))
        get = self.memo.__getitem__
        return [[get(w) for w in x] for x in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_decode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 (and ids ARRAY<INT>, decoded BINARY with keep_ids) to docs.

    vocabulary is a rank file that every executor can read (the installed tokenizer package by default).
    """
    common.tune(docs.sparkSession)
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep_ids else [])]
    rest = [c for c in docs.columns if c.lower() not in new]
    types = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.BinaryType()}
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(c, types[c]) for c in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            counts, hashes, plain, all_ids, all_bytes = [], [], [], [], []
            values = [value or "" for value in batch.column(len(rest)).to_pylist()]
            for words in (w for k in range(0, len(values), 256) for w in c.encode_all(values[k : k + 256])):
                joined, decoded = ",".join([w[0] for w in words]), b"".join([w[2] for w in words])
                counts.append(sum([w[1] for w in words]))
                hashes.append(hashlib.sha256(joined.encode()).hexdigest())
                plain.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    all_ids.append(np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32))
                    all_bytes.append(decoded)
            arrays = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(plain, pa.string())]
            if keep_ids:
                arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_bytes, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *arrays], names=[*rest, *new])

    return source.mapInArrow(common.released(run), schema)


def fold_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """words with ids: the merges folded by higher-order functions over each word's bytes, ranks in a literal map.

    The form for small tables: a literal map is searched from its start for each pair, some 0.3 ms at 50,000 entries.
    """
    table = F.map_from_arrays(F.lit([p.hex() for p in ranks]), F.lit(list(ranks.values())))
    raw = F.lower(F.hex(F.encode(F.col(word), "UTF-8")))
    parts = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda i: F.substr(raw, 2 * i + 1, F.lit(2)))).otherwise(F.array().cast("array<string>"))

    def merge(acc, _):
        n = F.size(acc)
        pairs = F.zip_with(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.slice(acc, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.try_element_at(table, F.concat(a, b)))
        at = F.array_position(pairs, F.array_min(pairs)).cast("int")
        joined = F.concat(F.slice(acc, 1, F.greatest(at - 1, F.lit(0))), F.array(F.concat(F.get(acc, at - 1), F.get(acc, at))), F.slice(acc, at + 2, n))
        return F.when(F.array_min(pairs).isNull(), acc).otherwise(joined)

    whole = F.when(F.try_element_at(table, raw).isNotNull(), F.array(raw)).otherwise(F.aggregate(parts, parts, merge))
    return words.withColumn("ids", F.transform(whole, lambda p: F.try_element_at(table, p)))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
