"""Column helpers: normalised values, row hashes, column roles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names that mark a label column.
LABEL_EXACT = ("label", "target", "y", "class", "Class", "SeriousDlqin2yrs")
LABEL_KEYWORDS = ("label", "target", "class", "y", "exited", "churn", "default", "fraud", "risk", "toxic", "spam", "sentiment")
#: A string column is text from this mean length on; shorter ones are categories up to so many distinct values.
TEXT_LENGTH, MAX_CATEGORIES = 25, 50


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a column of floats."""
    column = F.col(f"`{name}`")
    return column.isNull() | F.isnan(column) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else column.isNull()


def clean(df: DataFrame, name: str) -> Column:
    """The value, with NaN as null and one zero only."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(column), F.lit(None)).when(column == 0, F.lit(0.0)).otherwise(column)
    return F.to_json(F.struct(column)) if isinstance(df.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType)) else column


def row_hash(df: DataFrame, names: list[str]) -> list[Column]:
    """128 bits of a row's values; nulls count as values of their own. Grouping by them moves 16 bytes a row, however wide it is."""
    values = [v for n in names for v in (F.isnull(clean(df, n)), clean(df, n))]
    return [F.xxhash64(F.lit(seed), *values).alias(f"__h{seed}") for seed in (1, 2)]


def find_label(df: DataFrame) -> str | None:
    """The label column by name: exact, then letters equal to a keyword or beginning with one; first column wins."""
    for name in LABEL_EXACT:
        if name in df.columns:
            return name
    for name in df.columns:
        letters = re.sub("[^a-z]", "", name.lower())
        if any(letters.startswith(k) for k in LABEL_KEYWORDS):
            return name
    return None


def roles(df: DataFrame, label: str | None = None) -> dict[str, list[str]]:
    """numeric, categorical, text and other columns, from one aggregation over the strings."""
    names = [c for c in df.columns if c != label]
    numeric = [c for c in names if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    strings = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    out: dict[str, list[str]] = {"numeric": numeric, "categorical": [], "text": [], "other": [c for c in names if c not in numeric and c not in strings]}
    if strings:
        found = df.agg(*[x for i, c in enumerate(strings) for x in (F.avg(F.length(f"`{c}`")).alias(f"l{i}"), F.approx_count_distinct(f"`{c}`", 0.01).alias(f"d{i}"))]).first()
        for i, c in enumerate(strings):
            kind = "text" if (found[f"l{i}"] or 0) >= TEXT_LENGTH else "categorical" if found[f"d{i}"] <= MAX_CATEGORIES else "other"
            out[kind].append(c)
    return out


def long_form(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """keys, feature, value: a row for each feature of a row, missing values left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), clean(df, c).cast("double").alias("value")) for c in features])).alias("p")
    return df.select(*[F.col(f"`{k}`") for k in keys], pairs).select(*keys, "p.feature", "p.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
