"""Per-feature statistics of classes (M1-M3, M5-M7) over the long form (label, feature, value), all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import quantiles

#: Limits of the rules.
Z_LIMIT, Z_SHARE, SKEW, KURTOSIS_HIGH, KURTOSIS_LOW, MOMENT_SHARE = 3.5, 0.05, 2.0, 10.0, -1.5, 0.20
KS_D, JS_BINS, JS_MEAN, W1_MEAN, CHI2_P = 0.10, 20, 0.05, 0.50, 0.10


def modified_z(long: DataFrame) -> DataFrame:
    """label, feature, n, share: values beyond 3.5 modified z-scores. Medians are taken over value counts."""
    counts = long.groupBy("label", "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    keys = ["label", "feature"]
    cuts = quantiles.edges(counts, keys)
    middle = quantiles.percentile(counts, keys, "value", 0.5, "med", cuts)
    away = counts.join(middle, ["label", "feature"]).withColumn("dev", F.abs(F.col("value") - F.col("med")))
    mad = quantiles.percentile(away, keys, "dev", 0.5, "mad", quantiles.moved(cuts, middle, keys, "med"))
    joined = away.join(mad, ["label", "feature"]).where("mad >= 1e-10")
    far = 0.6745 * F.col("dev") / F.col("mad") > Z_LIMIT
    return joined.groupBy("label", "feature").agg(F.sum("n").alias("n"), F.round(F.sum(F.when(far, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"))


def moments(long: DataFrame) -> DataFrame:
    """label, feature, n, skew, kurt, anomalous: population skewness and excess kurtosis."""
    out = long.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k"))
    odd = (F.abs("s") > SKEW) | (F.col("k") > KURTOSIS_HIGH) | (F.col("k") < KURTOSIS_LOW)
    return out.select("label", "feature", "n", (F.round("s", 4) + F.lit(0.0)).alias("skew"), (F.round("k", 4) + F.lit(0.0)).alias("kurt"), odd.alias("anomalous"))


def ks_halves(long: DataFrame, half: str) -> DataFrame:
    """label, feature, d: the two-sample statistic between the halves told apart by the boolean column half; p by the asymptotic series."""
    counts = long.groupBy("label", "feature", "value").agg(F.count_if(F.col(half)).alias("a"), F.count_if(~F.col(half)).alias("b"))
    total = counts.groupBy("label", "feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    joined = quantiles.running(counts, ["label", "feature"], ["a", "b"]).join(total, ["label", "feature"]).where("na > 0 and nb > 0")
    out = joined.groupBy("label", "feature").agg(F.max(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    x = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))) * F.col("d")
    p = sum((2 * (-1) ** (k - 1) * F.exp(-2 * k * k * x * x) for k in range(1, 21)), F.lit(0.0))
    return out.select("label", "feature", F.round("d", 6).alias("d"), F.round(F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))), 6).alias("p"))


def js_distances(long: DataFrame) -> DataFrame:
    """feature, distance: Jensen-Shannon distance between the first two labels over 20 equal bins."""
    two = [r[0] for r in long.select("label").distinct().orderBy("label").limit(2).collect()]
    rows = long.where(F.col("label").isin(two))
    bounds = rows.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high")).where("high > low")
    width = (F.col("high") - F.col("low")) / JS_BINS
    binned = rows.join(F.broadcast(bounds), "feature").withColumn("bin", F.least(F.lit(JS_BINS - 1), F.floor((F.col("value") - F.col("low")) / width)).cast("int")).withColumn("w", width)
    first = F.col("label") == F.lit(two[0] if two else None)
    counts = binned.groupBy("feature", "bin", "w").agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    dense = counts.select("feature", "w").distinct().select("feature", "w", F.explode(F.sequence(F.lit(0), F.lit(JS_BINS - 1))).alias("bin")).join(counts, ["feature", "w", "bin"], "left").fillna(0, ["a", "b"])
    total = Window.partitionBy("feature")
    density = dense.select("feature", *[(F.col(c) / (F.sum(c).over(total) * F.col("w")) + 1e-9).alias(c) for c in ("a", "b")])
    normal = density.select("feature", *[(F.col(c) / F.sum(c).over(total)).alias(c) for c in ("a", "b")])
    m = (F.col("a") + F.col("b")) / 2
    js = F.sum(F.col("a") * F.log(F.col("a") / m) + F.col("b") * F.log(F.col("b") / m)) / 2
    return normal.groupBy("feature").agg(F.round(F.sqrt(F.greatest(js, F.lit(0.0))), 6).alias("distance"))


def wasserstein(long: DataFrame) -> DataFrame:
    """label, feature, distance: first Wasserstein distance of each class to all rows."""
    counts = long.groupBy("label", "feature", "value").agg(F.count(F.lit(1)).alias("c"))
    every = counts.groupBy("feature", "value").agg(F.sum("c").alias("g"))
    labels = counts.select("label", "feature").distinct()
    grid = labels.join(every, "feature").join(counts, ["label", "feature", "value"], "left").fillna(0, ["c"])
    keys = ["label", "feature"]
    run = quantiles.running(grid, keys, ["c", "g"])
    totals = grid.groupBy(*keys).agg(F.sum("c").alias("nc"), F.sum("g").alias("ng"))
    return run.withColumn("step", F.col("next") - F.col("value")).join(totals, keys).groupBy(*keys).agg(F.round(F.sum(F.abs(F.col("c") / F.col("nc") - F.col("g") / F.col("ng")) * F.col("step")), 6).alias("distance"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2, dof, n, p of the contingency of two categorical columns; Yates' correction at one degree of freedom."""
    table = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    rows = {r["a"]: r["n"] for r in table.groupBy("a").agg(F.sum("o").alias("n")).collect()}
    columns = {r["b"]: r["n"] for r in table.groupBy("b").agg(F.sum("o").alias("n")).collect()}
    seen = {(r["a"], r["b"]): r["o"] for r in table.collect()}
    n, dof = sum(rows.values()), (len(rows) - 1) * (len(columns) - 1)
    chi2 = 0.0
    for x, p in rows.items():
        for y, q in columns.items():
            e = p * q / n
            d = abs(seen.get((x, y), 0) - e)
            chi2 += (max(0.0, d - 0.5) if dof == 1 else d) ** 2 / e
    p = upper_gamma(dof / 2, chi2 / 2) if dof else 1.0
    return df.sparkSession.createDataFrame([(round(chi2, 6), dof, n, round(p, 6))], "chi2 double, dof int, n long, p double")


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction: the tail of chi-square."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_quantile(q: float, dof: float) -> float:
    low, high = 0.0, max(10.0, dof * 10)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - upper_gamma(dof / 2, mid / 2) < q else (low, mid)
    return (low + high) / 2
