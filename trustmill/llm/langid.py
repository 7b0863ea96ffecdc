"""Language identification by a byte convolutional network.

Bytes are embedded, convolved by filters of several widths, max-pooled over fixed-length
windows and classified by a softmax layer. The network is trained in numpy on the driver,
on a bounded sample of the labelled documents outside the held-out fold; it is then
applied to all windows of all texts, in batches. A document's prediction is the class of
the highest mean log-probability over its windows.

Defined cases: a null text, or one without any letter, is `und` with score 0.0; so is every
text when there is nothing to learn from. Texts shorter than a window are padded with zero
bytes. Ties go to the alphabetically first language. Repeated rows get equal results.
Columns that clash with results are replaced; all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents sampled for each language, windows taken from each of them, documents sampled in all: with more than
#: SAMPLE_DOCS / TRAIN_DOCS languages each has fewer. Every language that has training documents is learned.
TRAIN_DOCS, TRAIN_WINDOWS, SAMPLE_DOCS = 800, 6, 51_200
WINDOW, EMBED, FILTERS, WIDTHS = 64, 8, 16, (2, 3, 4)
STEPS, BATCH, RATE = 700, 256, 0.004
#: Batches of texts to predict.
BATCH_ROWS, BATCH_BYTES = 256, 2 << 20
UND = "und"
_LETTER = re.compile("[A-Za-z]").search


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, padded with zeros, and how many each text has (1 at least)."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    joined = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), counts


class Network:
    """Weights, training and inference."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over windows x with classes y."""
        n, rows = len(x), np.arange(len(x))
        seen, pooled = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            grams = np.lib.stride_tricks.sliding_window_view(x, w, axis=1)
            value = self.embed[grams].reshape(n, grams.shape[1], -1) @ f + b
            at = value.argmax(1)
            best = np.take_along_axis(value, at[:, None], 1)[:, 0]
            seen.append((grams[rows[:, None], at], best))
            pooled.append(np.maximum(best, 0))
        hidden = np.concatenate(pooled, 1)
        p = hidden @ self.out + self.out_bias
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[rows, y] -= 1
        p /= n
        back = p @ self.out.T
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            grams, best = seen[k]
            g = back[:, k * FILTERS : (k + 1) * FILTERS] * (best > 0)
            d_filters.append(np.einsum("nf,nfk->kf", g, self.embed[grams].reshape(n, FILTERS, -1)))
            d_bias.append(g.sum(0))
            spread = np.einsum("nf,kf->nfk", g, f).reshape(-1, EMBED)
            for e in range(EMBED):
                d_embed[:, e] += np.bincount(grams.reshape(-1), spread[:, e], 256)
        return [d_embed, *d_filters, *d_bias, hidden.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
        """Adam over batches with as many windows of each class."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(y == c) for c in range(len(self.labels))]
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        for step in range(1, STEPS + 1):
            pick = np.concatenate([rng.choice(i, max(4, BATCH // len(by_class))) for i in by_class])
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for p, g, m, v in zip(self.parameters(), self.gradients(x[pick], y[pick]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of the classes, for each window. A filter's response is a sum of looked-up rows, one for each of its taps."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        taps = [[self.embed @ f[t * EMBED : (t + 1) * EMBED] for t in range(w)] for w, f in zip(WIDTHS, self.filters, strict=True)]
        for k in range(0, len(x), 256):
            part = x[k : k + 256].astype(np.intp)
            pooled = []
            for w, table, b in zip(WIDTHS, taps, self.bias, strict=True):
                value = table[0].take(part[:, : WINDOW - w + 1], 0)
                for t in range(1, w):
                    value += table[t].take(part[:, t : WINDOW - w + 1 + t], 0)
                pooled.append(np.maximum(value.max(1) + b, 0))
            z = np.concatenate(pooled, 1) @ self.out + self.out_bias
            z -= z.max(1, keepdims=True)
            out[k : k + 256] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each whole text."""
        named = [i for i, t in enumerate(texts) if t and (_LETTER(t) or any(map(str.isalpha, t)))] if self.labels else []
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if named:
            x, counts = windows([texts[i].encode("utf-8", "replace") for i in named])
            starts = np.concatenate([[0], counts[:-1].cumsum()])
            mean = np.add.reduceat(self.log_probabilities(x).astype(np.float64), starts) / counts[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, c, s in zip(named, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                langs[i], scores[i] = self.labels[c], round(s, 6)
        return langs, scores


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TRAIN_WINDOWS windows of each text (lang, text, k), drawn by its hash k, so that no whole text goes to the driver."""
    for batch in batches:
        langs, keys, found = [], [], []
        for lang, text, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w, _ = windows([text.encode("utf-8", "replace")])
            langs.append(lang)
            keys.append(k)
            found.append(w[np.random.default_rng(k & 0xFFFFFFFF).permutation(len(w))[:TRAIN_WINDOWS]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["lang", "k", "w"])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Network:
    """Learns from about train_docs documents of each language, SAMPLE_DOCS in all, drawn by a hash of the id, outside the held-out fold."""
    common.tune(docs.sparkSession, BATCH_ROWS, BATCH_BYTES)
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.training_fold(F.col("id")))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    labels = sorted(counts)
    if not labels:
        return Network([])
    each = min(train_docs, max(1, SAMPLE_DOCS // len(labels)))
    share = F.create_map(*[F.lit(v) for k in labels for v in (k, min(1.0, each / counts[k]))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text", F.xxhash64("id", "text").alias("k"))
    held = sample.mapInArrow(common.released(_drawn), "lang string, k long, w binary").collect()
    number = {k: i for i, k in enumerate(labels)}
    x, y = [np.zeros((0, WINDOW), np.uint8)], []
    for r in sorted(held, key=lambda r: (r[0], r[1])):
        x.append(np.frombuffer(r["w"], np.uint8).reshape(-1, WINDOW))
        y += [number[r[0]]] * len(x[-1])
    return Network(labels).fit(np.concatenate(x), np.array(y)) if y else Network([])


def identify(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs."""
    spark = docs.sparkSession
    common.tune(spark, BATCH_ROWS, BATCH_BYTES)
    new = ("lang_pred", "score")
    rest = [c for c in docs.columns if c.lower() not in new]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shipped = spark.sparkContext.broadcast(network)  # some 100 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shipped.value.predict(batch.column(len(rest)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*rest, *new])

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text")).mapInArrow(common.released(run), schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    network = train(docs)
    found = identify(docs.select("doc_id", "text"), network)
    return found.select("doc_id", common.training_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
