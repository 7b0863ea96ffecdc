"""Incremental metrics of arriving data: sums that merge, by micro-batch or by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list[str], batch: int | None = None) -> DataFrame:
    """column, n, n_missing, s1, s2, low, high: power sums of one batch, from one pass."""
    parts = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("double")
        known = F.when(~F.isnan(v), v)
        parts += [F.count(F.lit(1)).alias(f"n{i}"), F.count_if(known.isNull()).alias(f"m{i}"), F.sum(known).alias(f"a{i}"), F.sum(known * known).alias(f"b{i}"), F.min(known).alias(f"l{i}"), F.max(known).alias(f"h{i}")]
    row = df.agg(*parts)
    flat = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("n_missing"), F.col(f"a{i}").alias("s1"), F.col(f"b{i}").alias("s2"), F.col(f"l{i}").alias("low"), F.col(f"h{i}").alias("high")) for i, c in enumerate(columns)])).alias("x")
    return row.select(flat).select(F.lit(batch).cast("long").alias("batch"), "x.*")


def merged(profiles: DataFrame) -> DataFrame:
    """column, n, n_missing, mean, stddev, low, high over all batches; a batch written twice counts once."""
    once = profiles.dropDuplicates(["batch", "column"])
    out = once.groupBy("column").agg(*[F.sum(c).alias(c) for c in ("n", "n_missing", "s1", "s2")], F.min("low").alias("low"), F.max("high").alias("high"))
    k = F.col("n") - F.col("n_missing")
    mean = F.col("s1") / k
    return out.select("column", "n", "n_missing", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("s2") / k - mean * mean, F.lit(0.0))), 6).alias("stddev"), "low", "high")


def batch_sink(columns: list[str], path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each batch's profile under its number, so a repeated batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        profile(df, columns, batch).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def windowed(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Window start, by, n, mean, high: tumbling windows over event time; late rows are dropped beyond the watermark."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", width), *(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return out.select(F.col("window.start").alias("start"), *(by or []), "n", "mean", "high")
