"""Detectors of a table's structure: each returns metric rows, thresholds are applied by status()."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clean, is_missing, numeric_columns, row_hash

#: Thresholds of failure and of review.
MISSING_FAIL, MISSING_REVIEW = 0.50, 0.05
DUPLICATE_FAIL, DUPLICATE_REVIEW = 0.35, 0.01
CONFLICT_FAIL, BALANCE_REVIEW = 0.02, 5.0
SENTINEL_SHARE, SENTINEL_IQR = 0.01, 3.0
OUTLIER_Z, OUTLIER_ROWS = 8.0, 20
SMALL_ROWS, IMBALANCE_WARN, IMBALANCE_REVIEW = 20, 0.90, 0.98


def status(value: Column, fail: float | None = None, review: float | None = None, strict: bool = False) -> Column:
    above = (lambda x: value > x) if strict else (lambda x: value >= x)
    out = F.lit("PASSED")
    if review is not None:
        out = F.when(above(review), F.lit("HAND_CHECK")).otherwise(out)
    return F.when(above(fail), F.lit("FAILED")).otherwise(out) if fail is not None else out


def _melt(row: DataFrame, names: list[str], parts: list[str]) -> DataFrame:
    """One row for each column from a single wide row of aggregates <part><i>."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{i}").alias(p) for p in parts]) for i, c in enumerate(names)])).alias("x")).select("x.*")


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_missing, n_rows, missing_rate, status."""
    names = columns or df.columns
    row = df.agg(*[F.coalesce(F.sum(is_missing(df, c).cast("long")), F.lit(0)).alias(f"n_missing{i}") for i, c in enumerate(names)], *[F.count(F.lit(1)).alias(f"n_rows{i}") for i in range(len(names))])
    rate = F.col("n_missing") / F.greatest("n_rows", F.lit(1))
    return _melt(row, names, ["n_missing", "n_rows"]).withColumn("missing_rate", F.round(rate, 6)).withColumn("status", status(rate, MISSING_FAIL, MISSING_REVIEW))


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """n_rows, n_duplicates (rows beyond the first of their kind), duplicate_rate, status."""
    kinds = df.select(*row_hash(df, columns or df.columns)).groupBy("__h1", "__h2").count()
    out = kinds.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))
    rate = F.col("n_duplicates") / F.greatest("n_rows", F.lit(1))
    return out.withColumn("duplicate_rate", F.round(rate, 6)).withColumn("status", status(rate, DUPLICATE_FAIL, DUPLICATE_REVIEW))


def label_conflicts(df: DataFrame, label: str, features: list[str] | None = None) -> DataFrame:
    """n_groups, n_conflict_rows, conflict_rate, status: rows of equal features under more than one label."""
    names = features or [c for c in df.columns if c != label]
    kinds = df.select(*row_hash(df, names), clean(df, label).alias("label")).groupBy("__h1", "__h2", "label").count()
    groups = kinds.groupBy("__h1", "__h2").agg(F.count("label").alias("labels"), F.sum("count").alias("n"))
    bad = F.col("labels") > 1
    out = groups.agg(F.count_if(bad).alias("n_groups"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_conflict_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    rate = F.col("n_conflict_rows") / F.greatest("n_rows", F.lit(1))
    return out.select("n_groups", "n_conflict_rows", F.round(rate, 6).alias("conflict_rate"), F.when(rate >= CONFLICT_FAIL, "FAILED").when(F.col("n_groups") > 0, "HAND_CHECK").otherwise("PASSED").alias("status"))


def constant_features(df: DataFrame, columns: list[str] | None = None, all_null_counts: bool = True) -> DataFrame:
    """column, constant: at most one distinct value (min equals max); columns of nulls only count unless told otherwise."""
    names = columns or df.columns
    row = df.agg(*[x for i, c in enumerate(names) for x in (F.min(clean(df, c)).alias(f"low{i}"), F.max(clean(df, c)).alias(f"high{i}"))])
    flat = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(f"low{i}") == F.col(f"high{i}"), F.lit(all_null_counts))).alias("constant")) for i, c in enumerate(names)])).alias("x"))
    return flat.select("x.*")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(~is_missing(df, label)).groupBy(clean(df, label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """n_classes, largest, smallest, ratio, status."""
    out = class_counts(df, label).agg(F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    ratio = F.col("largest") / F.greatest("smallest", F.lit(1))
    return out.withColumn("ratio", F.round(ratio, 6)).withColumn("status", status(ratio, None, BALANCE_REVIEW, strict=True))


def class_imbalance(df: DataFrame, label: str) -> DataFrame:
    """top_label, top_share, severity: WARN, REVIEW or none."""
    out = class_counts(df, label).agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("total"))
    share = F.col("top.n") / F.col("total")
    return out.select(F.col("top.label").alias("top_label"), F.round(share, 6).alias("top_share"), F.when(share >= IMBALANCE_REVIEW, "REVIEW").when(share >= IMBALANCE_WARN, "WARN").alias("severity"))


def small_dataset(df: DataFrame) -> DataFrame:
    """n_rows, severity: an empty table is for REVIEW, a small one a WARN."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("severity", F.when(F.col("n_rows") == 0, "REVIEW").when(F.col("n_rows") < SMALL_ROWS, "WARN"))


def numeric_sentinels(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, value, n, iqr_distance: frequent values far outside the quartiles (null rows count in the share)."""
    names = columns or numeric_columns(df)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), clean(df, c).cast("double").alias("value")) for c in names])).alias("p")
    counts = df.select(pairs).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("column").agg(F.sum("n").alias("rows"))
    known = counts.where(F.col("value").isNotNull())
    # Quartiles from value counts: percentile with frequencies.
    spread = known.groupBy("column").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("present"))
    joined = known.join(F.broadcast(total), "column").join(F.broadcast(spread), "column")
    iqr = F.col("q")[1] - F.col("q")[0]
    away = F.greatest(F.col("q")[0] - F.col("value"), F.col("value") - F.col("q")[1]) / iqr
    good = (F.col("present") >= 4) & (F.col("kinds") >= 10) & (iqr > 0) & (F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("rows") * SENTINEL_SHARE))) & (away > SENTINEL_IQR)
    return joined.where(good).select("column", F.round("value", 6).alias("value"), "n", F.round(away, 6).alias("iqr_distance"))


def numeric_outliers(df: DataFrame, row: str, columns: list[str] | None = None) -> DataFrame:
    """column, row_index, max_z: the largest population z-score and the first row that attains it, above OUTLIER_Z or not."""
    names = [c for c in (columns or numeric_columns(df)) if c != row]
    stats = df.agg(*[x for i, c in enumerate(names) for x in (F.avg(clean(df, c)).alias(f"m{i}"), F.stddev_pop(clean(df, c).cast("double")).alias(f"s{i}"))], F.count(F.lit(1)).alias("n"))
    joined = df.crossJoin(F.broadcast(stats))  # one row of aggregates
    picks = [F.max(F.when(F.col(f"s{i}") > 0, F.struct(F.abs((clean(df, c) - F.col(f"m{i}")) / F.col(f"s{i}")).alias("z"), (-F.col(f"`{row}`")).alias("r")))).alias(f"b{i}") for i, c in enumerate(names)]
    best = joined.agg(*picks, F.count(F.lit(1)).alias("n"))
    flat = best.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("b")) for i, c in enumerate(names)])).alias("x"))
    return flat.where((F.col("n") >= OUTLIER_ROWS) & F.col("x.b").isNotNull()).select("x.column", (-F.col("x.b.r")).alias("row_index"), F.round("x.b.z", 6).alias("max_z"), (F.col("x.b.z") >= OUTLIER_Z).alias("extreme"))


def poison_mask(candidate: DataFrame, reference: DataFrame, row: str) -> DataFrame:
    """row, changed: rows that differ from the clean table in a shared column; a row that only one table has is changed, too."""
    shared = [c for c in candidate.columns if c in reference.columns and c != row]
    other = reference.select(F.col(f"`{row}`"), *[F.col(f"`{c}`").alias(f"__o_{i}") for i, c in enumerate(shared)], F.lit(True).alias("__there"))
    joined = candidate.withColumn("__here", F.lit(True)).join(other, row, "full")
    differs = reduce(lambda a, b: a | b, [~F.col(f"`{c}`").cast("string").eqNullSafe(F.col(f"__o_{i}").cast("string")) for i, c in enumerate(shared)], F.col("__here").isNull() | F.col("__there").isNull())
    return joined.select(F.col(f"`{row}`"), differs.alias("changed"))


def stratified_sample(df: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each class in order of a hash of their key: the same rows however the table is partitioned."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")
