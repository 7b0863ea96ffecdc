"""Detectors of a trained model: forward pass, robust spectra, activation clusters, stability, divergence, and their gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quantiles

#: Parameters of the detectors and gates.
ALPHA, EPSILON, SPECTRE_ROUNDS, SPECTRE_LEAST = 4.0, 0.10, 4, 10
RPP_RUNS, RPP_NOISE = 20, 0.3
TV_FLIP, TV_SHARE, TV_STRONG = 0.5, 0.40, 0.70
CLEAN_Q, CLEAN_BOUND, CLEAN_RUNS, SHARE_BLOCK, SHARE_REVIEW = 0.99, 0.95, 200, 0.10, 0.03
PERMUTATIONS = 12


def weight_anomalies(weights: DataFrame) -> DataFrame:
    """name, n_nan, n_inf, max_abs, anomalous over (name, value): long tables of weights."""
    v = F.col("value").cast("double")
    out = weights.groupBy("name").agg(F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"), F.max(F.when(~F.isnan(v), F.abs(v))).alias("max_abs"))
    return out.withColumn("anomalous", (F.col("n_nan") > 0) | (F.col("n_inf") > 0) | (F.col("max_abs") >= 1e6))


def layers(weights: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight and bias of each linear layer in order; an unfit model raises ValueError."""
    out = []
    for name, w in weights.items():
        if name.endswith("weight"):
            if w.ndim >= 3:
                raise ValueError("not a plain network")
            if w.ndim == 2:
                bias = weights.get(name[: -len("weight")] + "bias")
                out.append((w, bias if bias is not None and bias.ndim == 1 else np.zeros(len(w))))
    if len(out) < 2 or any(a[0].shape[0] != b[0].shape[1] for a, b in zip(out, out[1:], strict=False)):
        raise ValueError("layers do not form a chain of two or more")
    return out


def forward(x: np.ndarray, net: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Last hidden representation and class probabilities."""
    for w, b in net[:-1]:
        x = np.maximum(x @ w.T + b, 0)
    z = x @ net[-1][0].T + net[-1][1]
    if z.shape[1] == 1:
        p = 1 / (1 + np.exp(-z))
        return x, np.hstack([1 - p, p])
    e = np.exp(z - z.max(1, keepdims=True))
    return x, e / e.sum(1, keepdims=True)


def score_model(df: DataFrame, key: str, vector: str, net: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """key, hidden, proba of each row, in Arrow batches; weights are shipped once."""
    shipped = df.sparkSession.sparkContext.broadcast(net)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            h, p = forward(np.stack(f["vector"].to_numpy()).astype(float), shipped.value)
            yield pd.DataFrame({"key": f["key"], "hidden": list(h), "proba": list(p)})

    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInPandas(run, "key long, hidden array<double>, proba array<double>")


def rpp(df: DataFrame, key: str, vector: str, net: list[tuple[np.ndarray, np.ndarray]], spread: np.ndarray) -> DataFrame:
    """key, score: minus the mean largest change of probabilities under noise; noise is seeded by the row's key, not by its partition."""
    shipped = df.sparkSession.sparkContext.broadcast((net, np.asarray(spread, float)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, spread = shipped.value
        for f in frames:
            x = np.stack(f["vector"].to_numpy()).astype(float)
            base = forward(x, net)[1]
            noise = np.stack([np.random.default_rng(abs(int(k))).normal(0, 1, (RPP_RUNS, x.shape[1])) for k in f["key"]])
            moved = [np.abs(forward(x + RPP_NOISE * spread * noise[:, r], net)[1] - base).max(1) for r in range(RPP_RUNS)]
            yield pd.DataFrame({"key": f["key"], "score": -np.mean(moved, 0)})

    return df.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInPandas(run, "key long, score double")


def score_rows(df: DataFrame, net: list[tuple[np.ndarray, np.ndarray]], spread: np.ndarray) -> DataFrame:
    """key, label, hidden, score (of rpp()) of rows (key, label, vector), in one pass."""
    shipped = df.sparkSession.sparkContext.broadcast((net, np.asarray(spread, float)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, spread = shipped.value
        for f in frames:
            x = np.stack(f["vector"].to_numpy()).astype(float)
            h, base = forward(x, net)
            noise = np.stack([np.random.default_rng(abs(int(k))).normal(0, 1, (RPP_RUNS, x.shape[1])) for k in f["key"]])
            moved = [np.abs(forward(x + RPP_NOISE * spread * noise[:, r], net)[1] - base).max(1) for r in range(RPP_RUNS)]
            yield pd.DataFrame({"key": f["key"], "label": f["label"], "hidden": list(h), "score": -np.mean(moved, 0)})

    return df.select("key", "label", "vector").mapInPandas(run, "key long, label string, hidden array<double>, score double")


def score_both(df: DataFrame, old: list[tuple[np.ndarray, np.ndarray]], new: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """old, new: the probabilities that two models give each row (vector)."""
    shipped = df.sparkSession.sparkContext.broadcast((old, new))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["vector"].to_numpy()).astype(float)
            yield pd.DataFrame({n: list(forward(x, net)[1]) for n, net in zip(("old", "new"), shipped.value, strict=True)})

    return df.select("vector").mapInPandas(run, "old array<double>, new array<double>")


def total_variation(df: DataFrame, old: str, new: str) -> DataFrame:
    """n, n_flipped, share, median_flipped, decision from two probability arrays of each row; the shorter is padded with zeros."""
    size = F.greatest(F.size(old), F.size(new))
    pad = lambda c: F.concat(F.col(c), F.array_repeat(F.lit(0.0), (size - F.size(c)).cast("int")))
    tv = F.aggregate(F.zip_with(pad(old), pad(new), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / 2
    out = df.select(tv.alias("tv")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tv") >= TV_FLIP).alias("n_flipped"), F.percentile(F.when(F.col("tv") >= TV_FLIP, F.col("tv")), F.lit(0.5)).alias("m"))
    share = F.col("n_flipped") / F.col("n")
    return out.select("n", "n_flipped", F.round(share, 6).alias("share"), F.round("m", 6).alias("median_flipped"), F.when(F.col("n_flipped") == 0, "PASSED").when((share <= TV_SHARE) & (F.col("m") >= TV_STRONG), "BLOCK").otherwise("REVIEW").alias("decision"))


def _inverse_root(c: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(c)
    return (v / np.sqrt(np.maximum(w, 1e-6))) @ v.T


def _que(x: np.ndarray) -> np.ndarray:
    """Quantum-entropy scores of whitened rows, by the eigenvectors of their second moments about zero."""
    w, v = np.linalg.eigh(x.T @ x / len(x))
    projected = (x @ v) ** 2
    if w[-1] - 1 < 0.02:
        return projected.sum(1)
    q = np.exp(np.clip(ALPHA * (w - 1) / (w[-1] - 1), -50, 50))
    return projected @ q / q.sum()


def spectre_class(x: np.ndarray) -> np.ndarray:
    """Quantum-entropy scores of a class after robust whitening, refined on its inliers; zeros for a class too small."""
    n, d = x.shape
    k = min(64, d, max(1, n // 2))
    if n < SPECTRE_LEAST or k < 2:
        return np.zeros(n)
    x = x - x.mean(0)
    x = x @ np.linalg.svd(x, full_matrices=False)[2][:k].T
    middle = np.median(x, 0)
    score = _que((x - middle) / np.maximum(1.4826 * np.median(np.abs(x - middle), 0), 1e-9))
    keep = min(n, max(k + 1, round((1 - 1.5 * EPSILON) * n)))
    inliers = np.sort(np.argsort(score, kind="stable")[:keep])
    for _ in range(SPECTRE_ROUNDS - 1):
        if keep <= k:
            break
        held = x[inliers]
        score = _que((x - held.mean(0)) @ _inverse_root(np.cov(held, rowvar=False).reshape(k, k)))
        new = np.sort(np.argsort(score, kind="stable")[:keep])
        if np.array_equal(new, inliers):
            break
        inliers = new
    return score


def cluster_class(x: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float, float]:
    """Scores (distance to the larger cluster's centre), silhouette and minority share of a two-way split."""
    z = x - x.mean(0)
    z = z @ np.linalg.svd(z, full_matrices=False)[2][: min(10, z.shape[1])].T
    rng, best = np.random.default_rng(seed), (np.inf, None, None)
    for _ in range(10):
        c = z[rng.choice(len(z), 2, replace=False)]
        for _ in range(100):
            d = ((z[:, None] - c[None]) ** 2).sum(2)
            y = d.argmin(1)
            new = np.stack([z[y == i].mean(0) if (y == i).any() else c[i] for i in (0, 1)])
            if np.allclose(new, c):
                break
            c = new
        if d.min(1).sum() < best[0]:
            best = d.min(1).sum(), y, c
    _, y, c = best
    minority = min((y == 0).mean(), (y == 1).mean())
    pick = rng.permutation(len(z))[:2000]
    s, u = z[pick], y[pick]
    if len(set(u)) < 2:
        return np.zeros(len(x)), 0.0, 0.0
    d = np.sqrt(((s[:, None] - s[None]) ** 2).sum(2)) if len(s) <= 500 else np.sqrt(np.maximum((s**2).sum(1)[:, None] + (s**2).sum(1)[None] - 2 * s @ s.T, 0))
    mean = np.stack([d[:, u == i].sum(1) for i in (0, 1)], 1)
    sizes = np.array([(u == 0).sum(), (u == 1).sum()], float)
    own = mean[np.arange(len(u)), u] / np.maximum(sizes[u] - 1, 1)
    foe = mean[np.arange(len(u)), 1 - u] / sizes[1 - u]
    silhouette = float(((foe - own) / np.maximum(np.maximum(own, foe), 1e-12)).mean())
    big = c[int((y == 1).sum() > (y == 0).sum())]
    return np.sqrt(((z - big) ** 2).sum(1)), silhouette, float(minority)


def class_scores(df: DataFrame, key: str, vector: str, label: str, method: str) -> DataFrame:
    """key, label, score, silhouette, minority by `spectre` or `clusters`: a class in a task (bound classes by stratified_sample() first)."""

    def judge(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("key")
        x = np.nan_to_num(np.stack(f["vector"].to_numpy()).astype(float))
        score, silhouette, minority = np.zeros(len(x)), 0.0, 0.0
        if len(x) >= SPECTRE_LEAST:
            if method == "spectre":
                score = spectre_class(x)
            else:
                score, silhouette, minority = cluster_class(x)
        return pd.DataFrame({"key": f["key"], "label": f["label"], "score": score, "silhouette": silhouette, "minority": minority})

    rows = df.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    return rows.groupBy("label").applyInPandas(judge, "key long, label string, score double, silhouette double, minority double")


def calibrated_gate(clean: np.ndarray, scores: np.ndarray, seed: int = 0) -> dict:
    """Share of scores above the upper bootstrap bound of the clean 0.99 quantile; of fewer than 10 clean scores the largest is the bound, of none nothing is above."""
    clean = np.asarray(clean, float)
    clean = clean[~np.isnan(clean)]
    rng = np.random.default_rng(seed)
    if len(clean) < 10:
        bound = float(clean.max()) if len(clean) else float("inf")
    else:
        bound = float(np.quantile([np.quantile(rng.choice(clean, len(clean)), CLEAN_Q) for _ in range(CLEAN_RUNS)], CLEAN_BOUND))
    share = float((scores > bound).mean()) if len(scores) else 0.0
    return {"threshold": bound, "share": share, "status": "BLOCK" if share >= SHARE_BLOCK else "REVIEW" if share > SHARE_REVIEW else "PASSED"}


def permutation_gate(statistic, labels: np.ndarray, margin: float, floor: float = 0.0, seed: int = 0) -> dict:
    """Whether a statistic of the labels beats the 95th percentile of its permutations by a margin, and a floor."""
    rng, seen = np.random.default_rng(seed), float(statistic(labels))
    null = float(np.quantile([statistic(rng.permutation(labels)) for _ in range(PERMUTATIONS)], 0.95))
    return {"statistic": seen, "null95": null, "flagged": seen > null + margin and seen >= floor}


def gap_gate(scores: np.ndarray, low: float = 0.03, high: float = 0.40, separation: float = 1.2, least: int = 20) -> dict:
    """The best two-way split of sorted scores: flagged if the upper part is a minority apart, in units of the root of the parts' mean variance."""
    s = np.sort(np.asarray(scores, float))
    n = len(s)
    if n < least or s[0] == s[-1]:
        return {"share": 0.0, "separation": 0.0, "flagged": False}
    k = np.arange(1, n)
    left, sq = s.cumsum()[:-1], (s**2).cumsum()[:-1]
    within = (sq - left**2 / k) + ((s**2).sum() - sq - (s.sum() - left) ** 2 / (n - k))
    cut = int(within.argmin()) + 1
    spread = np.sqrt((s[:cut].var() + s[cut:].var()) / 2 + 1e-12)
    gap, share = float((s[cut:].mean() - s[:cut].mean()) / spread), (n - cut) / n
    return {"share": share, "separation": gap, "flagged": bool(low <= share <= high and gap >= separation)}


def mad_flags(df: DataFrame, score: str) -> DataFrame:
    """df with flagged: scores above the median by three scaled median deviations."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("__k", F.lit(0))
    cuts = quantiles.edges(counts, ["__k"], "v")
    found = quantiles.percentile(counts, ["__k"], "v", 0.5, "__m", cuts)
    middle = found.agg(F.first("__m").alias("__m"))
    away = counts.crossJoin(F.broadcast(middle)).withColumn("d", F.abs(F.col("v") - F.col("__m")))  # one row
    mad = quantiles.percentile(away, ["__k"], "d", 0.5, "__d", quantiles.moved(cuts, found, ["__k"], "__m")).agg(F.first("__d").alias("__d"))
    return df.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(mad)).withColumn("flagged", (1.4826 * F.col("__d") >= 1e-9) & (F.col(score) > F.col("__m") + 3 * 1.4826 * F.col("__d"))).drop("__m", "__d")


def top_fraction(df: DataFrame, score: str, fraction: float) -> DataFrame:
    """df with flagged: the highest scores, ties at the border included. The border comes from counts of different scores, so no task holds that share of the rows."""
    counts = df.groupBy(F.col(score).alias("v")).agg(F.count(F.lit(1)).alias("n")).where(F.col("v").isNotNull())
    n = counts.agg(F.sum("n")).first()[0] or 0
    if not n or fraction <= 0:
        return df.withColumn("flagged", F.lit(False))
    border = kth_largest(counts, min(max(1, round(fraction * n)), n))
    return df.withColumn("flagged", F.coalesce(F.col(score) >= F.lit(border), F.lit(False)))


def kth_largest(counts: DataFrame, k: int, buckets: int = 256) -> float:
    """The k-th largest value of counts (v, n): the range that holds it is narrowed to one value by counts of its parts."""
    held = counts.select(F.col("v").cast("double").alias("v"), "n")
    low, high = held.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = (high - low) / buckets
        if low + width == low or high - width == high:  # neighbouring numbers: some hundred different ones at most
            for row in held.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high))).groupBy("v").agg(F.sum("n").alias("n")).orderBy(F.desc("v")).collect():
                if k <= row["n"]:
                    return row["v"]
                k -= row["n"]
        part = F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width)))
        inside = held.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        for row in inside.groupBy(part.alias("b")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy(F.desc("b")).collect():  # buckets rows
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return high


def top_rows(df: DataFrame, key: str, score: str, n: int = 20) -> DataFrame:
    """key, score: the n rows of the highest scores, ties by key."""
    return df.select(key, score).orderBy(F.desc(score), key).limit(n)


def class_distances(df: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """key, label, score: distance from the class's per-coordinate median in units of its median deviations."""
    long = df.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.posexplode(vector).alias("i", "v"))
    middle = long.groupBy("label", "i").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    away = long.join(F.broadcast(middle), ["label", "i"]).withColumn("d", F.abs(F.col("v") - F.col("m")))  # classes x coordinates rows
    mad = away.groupBy("label", "i").agg(F.percentile("d", F.lit(0.5)).alias("s"))
    scaled = away.join(F.broadcast(mad), ["label", "i"]).withColumn("z", F.col("d") / F.greatest(1.4826 * F.col("s"), F.lit(1e-9)))
    return scaled.groupBy("key", "label").agg(F.round(F.sqrt(F.sum(F.col("z") * F.col("z"))), 6).alias("score"))
