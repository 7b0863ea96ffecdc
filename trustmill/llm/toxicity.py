"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, removes invisible characters, and maps look-alike characters and digit
substitutions onto Latin letters (l, i and 1 become one letter). Lexicon entries are word
beginnings with weights; a hit counts where a word begins, unless an exception phrase covers it.
The summed weight of hits, plain and normalised by length, gives the score by a logistic curve.

Lexicon, exceptions and curve are learned from the labels of the training fold: a bounded
sample of toxic and clean documents (TRAIN_TOXIC, TRAIN_CLEAN), read on the driver.

Defined cases: null and empty texts score as texts without hits; without labels of both
kinds every score is 0.0; a document with several label rows counts as toxic if one of them says so, and
null labels are ignored; repeated documents get equal scores. Columns that clash with results
are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Expected numbers of sampled toxic and clean training documents.
TRAIN_TOXIC, TRAIN_CLEAN = 2000, 5000
THRESHOLD = 0.3
#: Lengths of lexicon entries, and the chance that an entry of the whole lexicon is a coincidence.
SHORTEST, LONGEST, COINCIDENCE = 3, 12, 0.05
#: Log-odds that an entry has at least.
LEAST_ODDS = 2.5
#: Look-alikes of Latin letters, in the order of LOOKS_AS; digits used for letters; l, i and 1 are one letter.
LOOK_ALIKE = "аеорсухіјѕԁһӏɡαοιυν０１３４５７＠ⅼ"
LOOKS_AS = "aeopcyxijsdhlgaoiuvoieastal"
DIGITS = "013457@"
DIGITS_AS = "oieasta"
INVISIBLE = "­​‌‍⁠﻿"
_FOLD = {ord(a): ord(b) for a, b in zip(LOOK_ALIKE + DIGITS, LOOKS_AS + DIGITS_AS, strict=True)} | {ord(c): None for c in INVISIBLE}
_FOLD = {k: ord("l") if v == ord("i") else v for k, v in _FOLD.items()} | {ord("i"): ord("l")}
_WORD = re.compile(r"[^\W\d_]+").findall
_END = re.compile(r"\w+")


def fold(text: str | None) -> str:
    return (text or "").lower().translate(_FOLD)


def beginnings(words: Iterable[str]) -> set[str]:
    return {w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


class Lexicon:
    """Weights of word beginnings, exception phrases, and the curve."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = (), curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)):
        self.weights, self.exceptions, self.curve = dict(weights), sorted(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        import ahocorasick

        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self._automaton.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                size, weight = self._automaton.get(phrase, (len(phrase), 0.0))
                self._automaton.add_word(phrase, (size, weight, True))
            self._automaton.make_automaton()
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """start, end, weight of the entries found at the beginnings of words, outside exceptions."""
        if not self.weights:
            return []
        found, void = [], []
        for last, entry in self.automaton().iter(folded):
            start = last + 1 - entry[0]
            if start and folded[start - 1].isalnum():
                continue
            if len(entry) == 3 and not folded[last + 1 : last + 2].isalpha():
                void.append((start, last + 1))
            elif entry[1]:
                found.append((start, last + 1, entry[1]))
        return [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in void)] if void else found

    def features(self, text: str | None) -> tuple[float, float]:
        """Logarithms of the summed weight, and of that per thousand words."""
        folded = fold(text)
        # A word that comes again and again counts by the logarithm.
        words = Counter((_END.match(folded, h[0])[0], h[2]) for h in self.hits(folded))
        total = sum(weight * math.log2(1 + n) for (_, weight), n in words.items())
        return math.log1p(total), math.log1p(1000 * total / (folded.count(" ") + folded.count("\n") + 20)) if total else 0.0

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        a, b, c = self.curve
        x, y = self.features(text)
        return round(1 / (1 + math.exp(-min(30.0, a + b * x + c * y))), 6)


def learn(texts: list[str | None], toxic: list[int]) -> Lexicon:
    """Entries are word beginnings that toxic documents hold significantly often, and clean ones hardly ever."""
    unique = list(dict.fromkeys((fold(t), y) for t, y in zip(texts, toxic, strict=True)))
    bags = [(Counter(_WORD(t)), y) for t, y in unique]
    n_toxic = sum(y for _, y in bags)
    n_clean = len(bags) - n_toxic
    if not n_toxic or not n_clean:
        return Lexicon({})
    holding: Counter = Counter()  # toxic documents that hold a beginning
    inside: Counter = Counter()  # words that begin so, in toxic and in clean documents; repeats in a document count by their logarithm
    outside: Counter = Counter()
    for words, y in bags:
        if y:
            holding.update(beginnings(words))
            for w, n in words.items():
                for p in beginnings([w]):
                    inside[p] += math.log2(1 + n)
    holding = {p: n for p, n in holding.items() if n >= 2}
    for words, y in bags:
        if not y:
            for w, n in words.items():
                for p in beginnings([w]):
                    if p in holding:
                        outside[p] += math.log2(1 + n)
    sizes = [sum(sum(math.log2(1 + n) for n in words.values()) for words, y in bags if y == kind) for kind in (1, 0)]
    least = max(3, math.ceil(0.7 * math.log(COINCIDENCE / max(1, len(inside))) / math.log(n_toxic / len(bags))))
    odds = {p: math.log((inside[p] + 0.5) / (sizes[0] + 1)) - math.log((outside[p] + 0.5) / (sizes[1] + 1)) for p in holding}
    good = {p for p in holding if odds[p] > LEAST_ODDS}
    weights: dict[str, float] = {}
    longer: set[str] = set()  # beginnings of entries

    def take(p: str) -> None:
        if p not in longer and not any(p[:k] in weights for k in range(SHORTEST, len(p) + 1)):
            weights[p] = round(odds[p], 4)
            longer.update(p[:k] for k in range(SHORTEST, len(p)))

    # What tells most first, of equals the longest: a beginning stands for all that begins with it.
    for p in sorted(good, key=lambda p: (-inside[p] * odds[p], -len(p), p)):
        if holding[p] >= least:
            take(p)
    # Then what covers at least two toxic documents that have no entry yet.
    bare = [b for words, y in bags if y and not (b := beginnings(words)) & weights.keys()]
    while bare:
        rest = Counter(p for b in bare for p in b if p in good)
        if not rest or (top := max(rest.values())) < 2:
            break
        best = max((p for p, n in rest.items() if n == top), key=lambda p: (odds[p], len(p), p))
        longer.discard(best)
        take(best)
        bare = [b for b in bare if not b & weights.keys()]
    kept = Lexicon(weights)
    # Whole words that begin with an entry, but that clean documents alone hold, are exceptions.
    clean, dirty = Counter(), Counter()
    for words, y in bags:
        (dirty if y else clean).update(w for w in words if beginnings([w]) & weights.keys())
    kept.exceptions = sorted(w for w, n in clean.items() if n >= 2 and not dirty[w])
    kept.curve = _curve(np.array([kept.features(t) for t, _ in unique]), np.array([y for _, y in unique], float))
    return kept


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method; slopes are not negative."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-3, 0.1, 0.1])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Lexicon:
    """Learns a lexicon from a sample, drawn by a hash of the id, of the labelled documents outside the held-out fold."""
    marked = labels.where(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("__y"))
    marked = marked.where(~common.training_fold(F.col(doc_id)))
    n = {r[0]: r[1] for r in marked.groupBy("__y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon({})
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("__y") == 1, F.lit(min(1.0, TRAIN_TOXIC / n[1]))).otherwise(F.lit(min(1.0, TRAIN_CLEAN / n[0])))
    drawn = marked.where(draw < share)
    rows = docs.select(F.col(doc_id), F.col(text).alias("__text")).join(F.broadcast(drawn), doc_id).select(doc_id, "__text", "__y").collect()
    rows.sort(key=lambda r: (r[0], r[1] or ""))
    return learn([r[1] for r in rows], [r[2] for r in rows])


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, predicted and n_toxic_hits to docs."""
    spark = docs.sparkSession
    common.tune(spark)
    new = ("score", "predicted", "n_toxic_hits")
    rest = [c for c in docs.columns if c.lower() not in new]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_toxic_hits", T.LongType())])
    shipped = spark.sparkContext.broadcast(lexicon)  # bounded by the sample: at most a few thousand entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shipped.value
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            scores = [lex.score(t) for t in texts]
            found = [len(lex.hits(fold(t))) if s >= threshold else 0 for s, t in zip(scores, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(found, pa.int64())], names=[*rest, *new])

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, lexicon).select("doc_id", common.training_fold(F.col("doc_id")).alias("held_out"), "score", "predicted")
