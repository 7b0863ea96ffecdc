"""Detectors over vectors (M8-M16): nearest neighbours, densities and spectra.

What needs all pairs is computed on a sample of bounded size, as the rule defines it: CAP rows, drawn by a hash of the key.
The sample is a matrix on the driver; rows are compared with it in blocks by the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .univariate import chi2_quantile

CAP = 5000
#: Neighbours and limits of the rules.
K_CONSISTENCY, K_LOF, LOF_LIMIT, DBSCAN_SAMPLES, DBSCAN_Q, K_SEPARABLE = 5, 20, 1.5, 5, 0.90, 20
LOF_COMPONENTS, DBSCAN_COMPONENTS, FOREST_COMPONENTS, SPECTRAL_COMPONENTS, SEPARABLE_COMPONENTS = 30, 20, 50, 50, 30
CLASS_CAP, CLASS_LEAST, NEAR_CAP = 2000, 20, 2000
NEAR_Q, MAHALANOBIS_Q, SUPPORT, TREES, TREE_ROWS = 0.05, 0.975, 0.75, 100, 256


def sample(df: DataFrame, key: str, vector: str, label: str | None = None, cap: int = CAP) -> DataFrame:
    """key, vector (doubles, NaN and infinite as 0), label: cap rows in order of the key's hash."""
    plain = F.transform(F.col(vector), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), plain.alias("vector"), (F.col(label).cast("string") if label else F.lit("")).alias("label"))
    return rows.orderBy(F.xxhash64("key"), "key").limit(cap)


def matrix(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = sorted(rows.collect(), key=lambda r: r["key"])
    return np.array([r["key"] for r in held]), np.array([r["vector"] for r in held], float).reshape(len(held), -1), np.array([r["label"] for r in held], object)


def neighbours(df: DataFrame, key: str, vector: str, label: str, k: int, cap: int = CAP, within: bool = False, drawn: DataFrame | None = None) -> DataFrame:
    """key, label, rank, other, other_label, distance: the k nearest sample rows of each sample row, itself aside, ties by key; within: of its own label.
    drawn is a sample (key, vector, label) made before."""
    spark = df.sparkSession
    rows = sample(df, key, vector, label, cap) if drawn is None else drawn
    ids, x, y = matrix(rows)
    groups = {c: np.flatnonzero(y == c) for c in set(y)} if within else {None: np.arange(len(ids))}
    shipped = spark.sparkContext.broadcast((ids, x, y, groups))  # cap rows at most, for each class if within

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x, y, groups = shipped.value
        for frame in frames:
            for name, among in groups.items():
                part = frame[frame["label"] == name] if within else frame
                their, z = ids[among], x[among]
                for a in range(0, len(part), 32):
                    some = part.iloc[a : a + 32]
                    own, q = some["key"].to_numpy(), np.stack(some["vector"].to_numpy())
                    d = np.sqrt(np.maximum(((q[:, None, :] - z[None]) ** 2).sum(2), 0))
                    d[own[:, None] == their[None]] = np.inf
                    order = np.lexsort((np.broadcast_to(their, d.shape), d), axis=1)[:, : min(k, len(their) - 1)]
                    n = order.shape[1]
                    yield pd.DataFrame({"key": np.repeat(own, n), "label": np.repeat(some["label"].to_numpy(), n), "rank": np.tile(np.arange(1, n + 1), len(some)), "other": their[order].reshape(-1), "other_label": y[among][order].reshape(-1), "distance": np.take_along_axis(d, order, 1).reshape(-1)})

    return rows.repartition(max(1, min(64, len(ids) // 256 + 1)), "key").mapInPandas(run, "key long, label string, rank int, other long, other_label string, distance double")


def reduced(df: DataFrame, key: str, vector: str, label: str, components: int) -> DataFrame:
    """key, vector, label: vectors projected on the leading components of their own class, if they have more dimensions; all rows."""
    plain = F.transform(F.col(vector), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), plain.alias("vector"), F.col(label).cast("string").alias("label"))
    width = rows.select(F.size("vector")).first()
    if width is None or width[0] <= components:
        return rows
    # A matrix for each of 50 classes at most.
    bases = {c: (mean, np.linalg.eigh(cov)[1][:, ::-1][:, :components]) for c, (_, mean, cov) in gram(rows, "vector", "label").items()}
    shipped = df.sparkSession.sparkContext.broadcast(bases)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, part in frame.groupby("label"):
                mean, basis = shipped.value[name]
                part = part.copy()
                part["vector"] = list((np.stack(part["vector"].to_numpy()) - mean) @ basis)
                yield part

    return rows.mapInPandas(run, "key long, vector array<double>, label string")


def class_neighbours(df: DataFrame, key: str, vector: str, label: str, k: int, components: int, cap: int = CLASS_CAP) -> DataFrame:
    """neighbours() within each class, over cap rows of it, in its leading components; classes of fewer than CLASS_LEAST rows are left out."""
    from .structural import stratified_sample

    drawn = stratified_sample(reduced(df, key, vector, label, components), "key", "label", cap)
    large = drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CLASS_LEAST).select("label")
    return neighbours(df, key, vector, label, k, within=True, drawn=drawn.join(F.broadcast(large), "label").select("key", "vector", "label"))


def knn_consistency(df: DataFrame, key: str, vector: str, label: str, k: int = K_CONSISTENCY) -> DataFrame:
    """n, disagreement, gini, ratio: the share of neighbours under another label against chance (M9)."""
    near = neighbours(df, key, vector, label, k)
    rows = near.groupBy("key", "label").agg(F.avg((F.col("label") != F.col("other_label")).cast("double")).alias("x"))
    classes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
    out = classes.agg(F.sum("n").alias("n"), (F.sum("x") / F.sum("n")).alias("d"), (1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("g"))
    return out.select("n", F.round("d", 6).alias("disagreement"), F.round("g", 6).alias("gini"), F.round(F.col("d") / F.col("g"), 6).alias("ratio"))


def near_conflicts(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """n, cut, n_conflicts, rate: nearest neighbours within the 5th percentile that have another label (M10)."""
    near = neighbours(df, key, vector, label, 1, NEAR_CAP)
    cut = near.agg(F.percentile("distance", F.lit(NEAR_Q)).alias("cut"))  # NEAR_CAP values
    bad = (F.col("distance") <= F.col("cut")) & (F.col("label") != F.col("other_label"))
    out = near.crossJoin(F.broadcast(cut)).agg(F.count(F.lit(1)).alias("n"), F.round(F.first("cut"), 6).alias("cut"), F.count_if(bad).alias("n_conflicts"))  # one row
    return out.withColumn("rate", F.round(F.col("n_conflicts") / F.col("n"), 6))


def lof(df: DataFrame, key: str, vector: str, label: str, k: int = K_LOF, components: int = LOF_COMPONENTS, cap: int = CLASS_CAP) -> DataFrame:
    """key, label, lof: local outlier factors within each class (M12), from the neighbour table."""
    near = class_neighbours(df, key, vector, label, k, components, cap)
    reach = near.groupBy("key").agg(F.max("distance").alias("kd"))
    lrd = near.join(reach.select(F.col("key").alias("other"), "kd"), "other").groupBy("key", "label").agg((1 / (F.avg(F.greatest("kd", "distance")) + 1e-10)).alias("lrd"))
    theirs = near.join(lrd.select(F.col("key").alias("other"), F.col("lrd").alias("l")), "other").groupBy("key").agg(F.avg("l").alias("l"))
    return theirs.join(lrd, "key").select("key", "label", F.round(F.col("l") / F.col("lrd"), 6).alias("lof"))


def noise(df: DataFrame, key: str, vector: str, label: str, components: int = DBSCAN_COMPONENTS, cap: int = CLASS_CAP) -> DataFrame:
    """label, n, eps, n_noise, rate: rows of a class neither dense nor within eps of a dense one (M13), from the neighbour table.
    eps is the 0.9 quantile of the distances of the 5th neighbours; dense rows have 5 rows within eps, themselves among them."""
    near = class_neighbours(df, key, vector, label, DBSCAN_SAMPLES, components, cap)
    last = near.where(F.col("rank") == DBSCAN_SAMPLES).groupBy("label").agg(F.percentile("distance", F.lit(DBSCAN_Q)).alias("eps"))  # cap values
    close = near.join(F.broadcast(last), "label")
    dense = close.where((F.col("rank") == DBSCAN_SAMPLES - 1) & (F.col("distance") <= F.col("eps"))).select(F.col("key").alias("dense"))
    # What is not dense has fewer rows within eps than the table has neighbours.
    reached = close.where("distance <= eps").join(dense, F.col("other") == F.col("dense")).select("key").union(dense).distinct()
    rows = near.select("key", "label").distinct().join(reached.withColumn("in", F.lit(1)), "key", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("in").isNull()).alias("n_noise"))
    return rows.join(F.broadcast(last), "label").where("eps >= 1e-10").select("label", "n", F.round("eps", 6).alias("eps"), "n_noise", F.round(F.col("n_noise") / F.col("n"), 6).alias("rate"))


def gram(df: DataFrame, vector: str, by: str | None = None) -> dict[object, tuple[int, np.ndarray, np.ndarray]]:
    """by -> (n, mean, covariance sum): second moments of all rows. Each task sums its own rows; a matrix per task and class moves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for frame in frames:
            for k, part in frame.groupby("by", dropna=False):
                x = np.nan_to_num(np.stack(part["vector"].to_numpy()).astype(float), nan=0.0, posinf=0.0, neginf=0.0)
                n, s, g = sums.get(k, (0, 0.0, 0.0))
                sums[k] = n + len(x), s + x.sum(0), g + x.T @ x
        for k, (n, s, g) in sums.items():
            flat = np.concatenate([[n], s, g.reshape(-1)])
            yield pd.DataFrame({"by": k, "i": np.arange(len(flat)), "v": flat})

    rows = df.where(F.col(vector).isNotNull()).select((F.col(by).cast("string") if by else F.lit("")).alias("by"), F.col(vector).alias("vector")).where(F.col("by").isNotNull())
    held: dict = {}
    # Partial sums meet in Spark; a matrix for each class comes to the driver.
    for r in rows.mapInPandas(run, "by string, i long, v double").groupBy("by", "i").agg(F.sum("v").alias("v")).collect():
        held.setdefault(r["by"], {})[r["i"]] = r["v"]
    out = {}
    for k, values in held.items():
        flat = np.array([values[i] for i in range(len(values))])
        p = int((np.sqrt(4 * len(flat) - 3) - 1) / 2 + 0.5)
        n, s, g = int(flat[0]), flat[1 : p + 1], flat[p + 1 :].reshape(p, p)
        out[k] = n, s / n, g - np.outer(s, s) / n
    return out


def _project(vector, direction: np.ndarray, mean: np.ndarray):
    offset = float(direction @ mean)
    return F.aggregate(F.zip_with(vector, F.lit([float(v) for v in direction]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, b: a + b) - F.lit(offset)


def spectral_signatures(df: DataFrame, vector: str, label: str, least: int = 10) -> DataFrame:
    """label, n, p50, p95, ratio of the squared projections on each class's top direction (M14), over all rows."""
    parts = gram(df, vector, label)
    score = F.lit(None).cast("double")
    for k, (n, mean, cov) in parts.items():
        if n >= least:
            top = np.linalg.eigh(cov)[1][:, -1]
            score = F.when(F.col(label).cast("string") == k, F.pow(_project(F.col(vector), top, mean), 2)).otherwise(score)
    rows = df.select(F.col(label).cast("string").alias("label"), score.alias("s")).where(F.col("s").isNotNull())
    out = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.percentile("s", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return out.select("label", "n", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"), F.round(F.col("q")[1] / F.col("q")[0], 4).alias("ratio"))


def pca_residuals(df: DataFrame, key: str, vector: str, components: int = 50) -> DataFrame:
    """key, residual: distance of each row from the span of the leading min(50, p, n - 1) components (M15), over all rows."""
    n, mean, cov = gram(df, vector)[""]
    keep = min(components, len(mean), n - 1)
    basis = np.linalg.eigh(cov)[1][:, ::-1][:, :keep].T

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.nan_to_num(np.stack(frame["vector"].to_numpy()).astype(float)) - mean
            yield pd.DataFrame({"key": frame["key"], "residual": np.round(np.sqrt(((x - (x @ basis.T) @ basis) ** 2).sum(1)), 6)})

    return df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInPandas(run, "key long, residual double")


def reduce(x: np.ndarray, k: int) -> np.ndarray:
    """Centred projection on k components; x itself if there are no more."""
    if k >= x.shape[1] or not len(x):
        return x
    x = x - x.mean(0)
    return x @ np.linalg.svd(x, full_matrices=False)[2][:k].T


def robust_distances(x: np.ndarray, seed: int = 0, starts: int = 20) -> np.ndarray:
    """Squared Mahalanobis distances under the minimum covariance determinant of a share SUPPORT of the rows, corrected at the median."""
    n, p = x.shape
    h = max(int(SUPPORT * n), (n + p + 1) // 2)
    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(starts):
        pick = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(15):
            mean = x[pick].mean(0)
            cov = np.cov(x[pick].T, bias=True).reshape(p, p) + 1e-9 * np.eye(p)
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.argsort(d, kind="stable")[:h]
            if len(pick) == h and set(new) == set(pick):
                break
            pick = new
        size = np.linalg.slogdet(cov)[1]
        if size < best[0]:
            best = size, d
    d = best[1]
    return d * chi2_quantile(0.5, p) / max(np.median(d), 1e-12)


def forest_scores(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Isolation scores by TREES trees over TREE_ROWS rows each."""
    rng, n = np.random.default_rng(seed), len(x)
    m = min(TREE_ROWS, n)
    limit = int(np.ceil(np.log2(max(m, 2))))
    average = lambda k: 0.0 if k <= 1 else 1.0 if k == 2 else 2 * (np.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k
    depth = np.zeros(n)
    for _ in range(TREES):
        todo = [(rng.choice(n, m, replace=False), np.arange(n), 0)]
        while todo:
            own, rows, level = todo.pop()
            low, high = (x[own].min(0), x[own].max(0)) if len(own) else (None, None)
            axes = np.flatnonzero(high > low) if len(own) > 1 else ()
            if level >= limit or not len(axes):
                depth[rows] += level + average(len(own))
                continue
            axis = rng.choice(axes)
            cut = rng.uniform(low[axis], high[axis])
            todo += [(own[x[own, axis] < cut], rows[x[rows, axis] < cut], level + 1), (own[x[own, axis] >= cut], rows[x[rows, axis] >= cut], level + 1)]
    return 2 ** (-depth / TREES / average(m))


def class_outliers(df: DataFrame, key: str, vector: str, label: str, method: str, cap: int = 2000, least: int = 20) -> DataFrame:
    """label, n, n_outliers, share by `mahalanobis` (M8) or `forest` (M11): classes are drawn in Spark and judged each in a task."""
    from .structural import stratified_sample

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        x = np.nan_to_num(np.stack(frame["vector"].to_numpy()).astype(float))
        n, bad = len(x), None
        if n >= least and method == "mahalanobis":
            x = reduce(x, max(2, n // 3)) if n < 2 * x.shape[1] + 2 else x
            bad = int((robust_distances(x) > chi2_quantile(MAHALANOBIS_Q, x.shape[1])).sum())
        elif n >= least:
            bad = int((forest_scores(reduce(x, 50)) > 0.5).sum())
        return pd.DataFrame({"label": [frame["label"].iloc[0]], "n": [n], "n_outliers": [bad], "share": [None if bad is None else round(bad / n, 6)]})

    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    return stratified_sample(rows, "key", "label", cap).groupBy("label").applyInPandas(judge, "label string, n long, n_outliers long, share double")


def separability(df: DataFrame, key: str, vector: str, label: str, permutations: int = 300, cap: int = 2000) -> DataFrame:
    """observed, p: share of rows nearer to another class than to their own among 20 neighbours, against label permutations (M16).
    Neighbours are found once; permutations are vectorised."""
    drawn = sample(df, key, vector, label, cap)
    ids, x, y = matrix(drawn)
    if x.shape[1] > SEPARABLE_COMPONENTS:
        flat = [(int(i), [float(v) for v in z], str(c)) for i, z, c in zip(ids, reduce(x, SEPARABLE_COMPONENTS), y, strict=True)]
        drawn = df.sparkSession.createDataFrame(flat, "key long, vector array<double>, label string")  # cap rows
    near = neighbours(df, key, vector, label, K_SEPARABLE, drawn=drawn).toPandas().sort_values(["key", "rank"])
    ids = near["key"].unique()
    place = {k: i for i, k in enumerate(ids)}
    other = near["other"].map(place).to_numpy().reshape(len(ids), -1)
    distance = near["distance"].to_numpy().reshape(other.shape)
    labels = near.drop_duplicates("key")["label"].to_numpy()
    codes = np.unique(labels, return_inverse=True)[1]

    def statistic(y: np.ndarray) -> float:
        same = y[other] == y[:, None]
        own, foe = np.where(same, distance, np.inf).min(1), np.where(~same, distance, np.inf).min(1)
        both = np.isfinite(own) & np.isfinite(foe)
        return float((own[both] / np.maximum(foe[both], 1e-12) > 1).mean()) if both.any() else 0.0

    rng, seen = np.random.default_rng(0), statistic(codes)
    null = [statistic(rng.permutation(codes)) for _ in range(permutations)]
    return df.sparkSession.createDataFrame([(round(seen, 6), round(float(np.mean(np.array(null) <= seen)), 6))], "observed double, p double")


def consensus(df: DataFrame, key: str, vector: str, label: str, k: int = 15) -> DataFrame:
    """key, score: the share of the k nearest rows, itself among them, under another label."""
    near = neighbours(df, key, vector, label, k - 1)
    return near.groupBy("key").agg(F.round(F.sum((F.col("label") != F.col("other_label")).cast("double")) / k, 6).alias("score"))
