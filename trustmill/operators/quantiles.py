"""Exact quantiles and running sums of value counts, in blocks of values: no task holds or sorts all values of a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Blocks that a key is cut into if it has more different values than LARGE.
BLOCKS, LARGE = 32, 200_000


_SHARES = [i / BLOCKS for i in range(1, BLOCKS)]


def edges(counts: DataFrame, keys: list[str], value: str = "value", large: int | None = None) -> DataFrame | None:
    """keys and __e, about where blocks of as many values begin, for keys of more than large values; None if there are none. They are collected,
    and so fixed: what is worked out by blocks is exact."""
    large = LARGE if large is None else large
    found = counts.groupBy(*keys).agg(F.percentile_approx(value, _SHARES, 1000).alias("__e"), F.count(F.lit(1)).alias("__kinds")).where(F.col("__kinds") > large).drop("__kinds")
    rows = found.collect()  # a row for so many values
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def moved(cuts: DataFrame | None, middle: DataFrame, keys: list[str], name: str) -> DataFrame | None:
    """Edges of the distances from the middle: a block of distances has at most two blocks' values."""
    return None if cuts is None else cuts.join(middle, keys).select(*keys, F.array_sort(F.transform("__e", lambda e: F.abs(e - F.col(name)))).alias("__e"))


def blocked(counts: DataFrame, keys: list[str], value: str, cuts: DataFrame | None) -> DataFrame:
    """counts with __b, the number of a row's block: blocks of a key are in order of value."""
    if cuts is None:
        return counts.withColumn("__b", F.lit(0))
    number = reduce(lambda a, b: a + b, [(F.col(value) > F.col("__e")[i]).cast("int") for i in range(len(_SHARES))])
    return counts.join(F.broadcast(cuts), keys, "left").withColumn("__b", F.coalesce(number, F.lit(0))).drop("__e")  # a row for LARGE values


def running(counts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, value, next (the next value of the key), and the running sums of columns in order of value. counts has a row for each value of a key."""
    cut = blocked(counts, keys, "value", edges(counts, keys))
    upto = Window.partitionBy(*keys).orderBy("__b")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "__b").agg(F.min("value").alias("__f"), *[F.sum(c).alias(f"__s_{c}") for c in columns])
    sums = sums.select(*keys, "__b", F.lead("__f").over(upto).alias("__n"), *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in columns])
    own = Window.partitionBy(*keys, "__b").orderBy("value")
    inside = cut.select(*keys, "__b", "value", F.lead("value").over(own).alias("next"), *[F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in columns])
    return inside.join(sums, [*keys, "__b"]).select(*keys, "value", F.coalesce("next", "__n").alias("next"), *[(F.col(c) + F.col(f"__o_{c}")).alias(c) for c in columns])


def percentile(counts: DataFrame, keys: list[str], value: str, share: float, name: str, cuts: DataFrame | None) -> DataFrame:
    """keys and the percentile of value, each taken n times: as percentile(value, share, n), from the one or two blocks that hold it."""
    cut = blocked(counts, keys, value, cuts)
    order = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    sums = cut.groupBy(*keys, "__b").agg(F.sum("n").alias("__n")).withColumn("__c", F.sum("__n").over(order))
    place = (F.sum("__n").over(Window.partitionBy(*keys)) - 1) * F.lit(float(share))
    sums = sums.withColumn("__p", place).withColumn("__lo", F.floor("__p")).withColumn("__hi", F.ceil("__p")).withColumn("__o", F.col("__c") - F.col("__n"))
    held = sums.where((F.col("__lo") < F.col("__c")) & (F.col("__hi") >= F.col("__o"))).select(*keys, "__b", "__o", "__p", "__lo", "__hi")
    own = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.join(held, [*keys, "__b"]).withColumn("__c", F.sum("n").over(own) + F.col("__o"))
    ends = rows.groupBy(*keys).agg(F.min(F.when(F.col("__c") > F.col("__lo"), F.col(value))).alias("__v"), F.min(F.when(F.col("__c") > F.col("__hi"), F.col(value))).alias("__w"), F.first("__p").alias("__p"), F.first("__lo").alias("__lo"), F.first("__hi").alias("__hi"))
    between = (F.col("__hi") - F.col("__p")) * F.col("__v") + (F.col("__p") - F.col("__lo")) * F.col("__w")
    return ends.select(*keys, F.when((F.col("__lo") == F.col("__hi")) | (F.col("__v") == F.col("__w")), F.col("__v")).otherwise(between).cast("double").alias(name))
