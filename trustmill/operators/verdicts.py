"""Verdicts of the statistical checks: metric rows of M1-M16 to one row of check, status, n_judged, n_flagged, flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import univariate, vectors

#: Classes beyond which a check is skipped (those that compare two by two have a limit of their own); limits of the rules.
MOST_CLASSES, MOST_COMPARED, MOST_NEIGHBOUR_CLASSES = 50, 10, 20
M1_ROWS, M2_ROWS, M3_ROWS, M6_ROWS, KS_P = 10, 20, 30, 10, 0.05
M8_SHARE, M9_FAIL, M9_REVIEW, M10_FAIL, M10_REVIEW = 0.10, 0.92, 0.80, 0.08, 0.03
M11_SHARE, M12_SHARE, M13_SHARE, M14_RATIO, M15_MADS, M15_SHARE, M16_P = 0.20, 0.20, 0.25, 20.0, 3.5, 0.08, 0.10
#: Flagged classes or features that a verdict names.
NAMED = 20


def verdict(rows: DataFrame, check: str, bad: Column, name: str = "label", least: int = 1, most: int = MOST_CLASSES, fail: Column | None = None) -> DataFrame:
    """One row: HAND_CHECK if a row is bad (FAILED if one meets fail), SKIPPED with fewer names than least or more than most. rows has a row a name, most at the most."""
    bad = F.coalesce(bad, F.lit(False))
    worst = F.coalesce(fail, F.lit(False)) if fail is not None else F.lit(False)
    out = rows.agg(F.count(F.lit(1)).alias("n_judged"), F.count_if(bad).alias("n_flagged"), F.max(worst).alias("worst"), F.array_sort(F.collect_set(F.when(bad, F.col(name).cast("string")))).alias("all"))
    status = F.when((F.col("n_judged") < least) | (F.col("n_judged") > most), "SKIPPED").when(F.col("worst"), "FAILED").when(F.col("n_flagged") > 0, "HAND_CHECK").otherwise("PASSED")
    return out.select(F.lit(check).alias("check"), status.alias("status"), "n_judged", "n_flagged", F.array_join(F.slice("all", 1, NAMED), ",").alias("flagged"))


def _share_of_features(rows: DataFrame, odd: Column) -> DataFrame:
    return rows.groupBy("label").agg((F.count_if(odd) / F.count(F.lit(1))).alias("share"))


def m01(long: DataFrame) -> DataFrame:
    rows = univariate.modified_z(long).where(F.col("n") >= M1_ROWS)
    return verdict(rows.groupBy("label").agg(F.max("share").alias("share")), "m01", F.col("share") >= univariate.Z_SHARE)


def m02(long: DataFrame) -> DataFrame:
    rows = univariate.moments(long).where(F.col("n") >= M2_ROWS)
    return verdict(_share_of_features(rows, F.coalesce("anomalous", F.lit(False))), "m02", F.col("share") >= univariate.MOMENT_SHARE)


def m03(long: DataFrame, half: str) -> DataFrame:
    """D over its limit and p under KS_P, corrected for the number of tests."""
    large = long.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= M3_ROWS).select("label", "feature")
    rows = univariate.ks_halves(long, half).join(large, ["label", "feature"])
    tests = rows.agg((F.count_distinct("feature") * F.count_distinct("label")).alias("tests"))
    odd = (F.col("d") > univariate.KS_D) & (F.col("p") < KS_P / F.col("tests"))
    return verdict(_share_of_features(rows.crossJoin(F.broadcast(tests)), odd), "m03", F.col("share") >= univariate.MOMENT_SHARE)  # one row


def m05(long: DataFrame) -> DataFrame:
    """The mean distance over features under its limit is suspicious; 2 to 10 classes."""
    classes = long.agg(F.count_distinct("label").alias("classes"))
    rows = univariate.js_distances(long).agg(F.avg("distance").alias("mean")).crossJoin(F.broadcast(classes))  # one row
    able = F.col("classes").between(2, MOST_COMPARED) & F.col("mean").isNotNull()
    return rows.select(F.lit("m05").alias("check"), F.when(~able, "SKIPPED").when(F.col("mean") < univariate.JS_MEAN, "HAND_CHECK").otherwise("PASSED").alias("status"), F.col("classes").alias("n_judged"), F.when(able & (F.col("mean") < univariate.JS_MEAN), 1).otherwise(0).cast("long").alias("n_flagged"), F.lit("").alias("flagged"))


def m06(long: DataFrame) -> DataFrame:
    large = long.groupBy("label", "feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= M6_ROWS).select("label", "feature")
    rows = univariate.wasserstein(long).join(large, ["label", "feature"]).groupBy("label").agg(F.avg("distance").alias("mean"))
    return verdict(rows, "m06", F.col("mean") > univariate.W1_MEAN)


def m07(df: DataFrame, categories: list[str], label: str) -> DataFrame:
    parts = [univariate.chi_square(df, c, label).withColumn("label", F.lit(c)) for c in categories]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    return verdict(rows, "m07", F.col("p") > univariate.CHI2_P, most=10**9)


def _with_classes(rows: DataFrame, least: int) -> DataFrame:
    return rows.where(F.col("n") >= least)


def m08(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return verdict(_with_classes(vectors.class_outliers(df, key, vector, label, "mahalanobis"), vectors.CLASS_LEAST), "m08", F.col("share") > M8_SHARE)


def _single(rows: DataFrame, check: str, value: str, review: float, fail: float) -> DataFrame:
    out = F.when(F.col(value) >= fail, "FAILED").when(F.col(value) >= review, "HAND_CHECK").otherwise("PASSED")
    return rows.select(F.lit(check).alias("check"), F.when(F.col(value).isNull(), "SKIPPED").otherwise(out).alias("status"), F.col("n").alias("n_judged"), F.when(F.col(value) >= review, 1).otherwise(0).cast("long").alias("n_flagged"), F.lit("").alias("flagged"))


def m09(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    classes = df.agg(F.count_distinct(label).alias("k"))
    rows = vectors.knn_consistency(df, key, vector, label).crossJoin(F.broadcast(classes))  # one row
    return _single(rows.withColumn("ratio", F.when(F.col("k").between(2, MOST_NEIGHBOUR_CLASSES) & (F.col("gini") >= 1e-6), F.col("ratio"))), "m09", "ratio", M9_REVIEW, M9_FAIL)


def m10(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    rows = vectors.near_conflicts(df, key, vector, label)
    return _single(rows.withColumn("rate", F.when(F.col("n") >= 10, F.col("rate"))), "m10", "rate", M10_REVIEW, M10_FAIL)


def m11(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return verdict(_with_classes(vectors.class_outliers(df, key, vector, label, "forest"), vectors.CLASS_LEAST), "m11", F.col("share") > M11_SHARE)


def m12(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    rows = vectors.lof(df, key, vector, label).groupBy("label").agg((F.count_if(F.col("lof") > vectors.LOF_LIMIT) / F.count(F.lit(1))).alias("share"))
    return verdict(rows, "m12", F.col("share") > M12_SHARE)


def m13(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    return verdict(vectors.noise(df, key, vector, label), "m13", F.col("rate") > M13_SHARE)


def m14(df: DataFrame, vector: str, label: str) -> DataFrame:
    return verdict(vectors.spectral_signatures(df, vector, label), "m14", F.col("ratio") > M14_RATIO)


def m15(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Residuals above the median by M15_MADS unscaled deviations; n and dimensions bound it from below. flagged names the ten largest residuals' rows."""
    rows = vectors.pca_residuals(df, key, vector)
    counts = rows.groupBy(F.col("residual").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    middle = counts.agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("med"), F.sum("n").alias("total"))
    away = counts.crossJoin(F.broadcast(middle)).withColumn("dev", F.abs(F.col("value") - F.col("med")))  # one row
    mad = away.agg(F.percentile("dev", F.lit(0.5), F.col("n")).alias("mad"))
    share = away.crossJoin(F.broadcast(mad)).agg(F.sum(F.when(F.col("value") > F.col("med") + M15_MADS * F.col("mad"), F.col("n")).otherwise(0)).alias("n_flagged"), F.sum("n").alias("n_judged"))  # one row
    top = rows.orderBy(F.desc("residual"), "key").limit(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("residual")).alias("r"), "key"))), lambda x: x["key"].cast("string")), ",").alias("top"))
    rate = F.col("n_flagged") / F.col("n_judged")
    status = F.when(F.coalesce("n_judged", F.lit(0)) < 20, "SKIPPED").when(rate > M15_SHARE, "HAND_CHECK").otherwise("PASSED")
    return share.crossJoin(F.broadcast(top)).select(F.lit("m15").alias("check"), status.alias("status"), F.coalesce("n_judged", F.lit(0)).alias("n_judged"), F.coalesce("n_flagged", F.lit(0)).alias("n_flagged"), F.coalesce("top", F.lit("")).alias("flagged"))  # one row


def m16(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    rows = vectors.separability(df, key, vector, label)
    return rows.select(F.lit("m16").alias("check"), F.when(F.col("p") < M16_P, "FAILED").otherwise("PASSED").alias("status"), F.lit(1).cast("long").alias("n_judged"), F.when(F.col("p") < M16_P, 1).otherwise(0).cast("long").alias("n_flagged"), F.lit("").alias("flagged"))
