"""One feature vector a row: scaled numbers, coded categories and weighed terms side by side; features and codes of a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import columns as C

#: Text columns of the second kind: mean length from here on, missing values read as text.
TEXT_LENGTH_2 = 15


def text_columns(df: DataFrame, least: float = TEXT_LENGTH_2, nulls_as_text: bool = True) -> list[str]:
    """String columns of a mean length of least or more; a missing value counts as the four letters of `None`, or not at all."""
    names = C.string_columns(df)
    if not names:
        return []
    value = lambda c: F.coalesce(F.length(f"`{c}`"), F.lit(4)) if nulls_as_text else F.length(f"`{c}`")
    row = df.agg(*[F.avg(value(c)).alias(f"l{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if (row[f"l{i}"] or 0) >= least]


def concat_text(names: list[str]):
    """Columns joined by blanks, missing values as `None`."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in names])


def numeric_stats(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, mean and population deviation (1 where it is zero) of each column, the latter two after the median has filled what is missing.
    Medians are taken over counts of different values."""
    long = C.long_form(df, names, [])
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    medians = {r["feature"]: r["m"] for r in counts.groupBy("feature").agg(F.percentile("value", F.lit(0.5), F.col("n")).alias("m")).collect()}  # a row a column
    filled = [F.coalesce(C.clean(df, c).cast("double"), F.lit(medians.get(c, 0.0))) for c in names]
    row = df.agg(*[x for i, v in enumerate(filled) for x in (F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}"))]).first()
    return {c: (medians.get(c, 0.0), row[f"a{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(names)}


def scaled(df: DataFrame, stats: dict[str, tuple[float, float, float]]) -> list:
    """Columns filled and scaled by stats: of the table itself, or of a trusted one (target mode)."""
    return [(F.coalesce(C.clean(df, c).cast("double"), F.lit(m)) - F.lit(a)) / F.lit(s) for c, (m, a, s) in stats.items()]


def codes(df: DataFrame, name: str) -> dict[str, int]:
    """Values of a category in order, and their codes; missing ones are a kind of their own. C.MAX_CATEGORIES bounds them."""
    value = F.when(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).isin("", "nan", "None", "NaN", "<NA>"), "__missing__").otherwise(F.col(f"`{name}`").cast("string"))
    kinds = sorted(r[0] for r in df.select(value).distinct().limit(C.MAX_CATEGORIES + 2).collect())
    return {k: i for i, k in enumerate(kinds)}


def coded(name: str, table: dict[str, int]):
    value = F.when(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).isin("", "nan", "None", "NaN", "<NA>"), "__missing__").otherwise(F.col(f"`{name}`").cast("string"))
    pairs = F.create_map(*[x for k, i in table.items() for x in (F.lit(k), F.lit(float(i)))])
    return F.element_at(pairs, value)


def vectorize(df: DataFrame, row: str, label: str | None = None, terms: int = 200) -> DataFrame:
    """row, vector: scaled numbers, scaled codes of categories, and the weights of each text column's most frequent terms."""
    from ..operators import text_quality

    roles = C.roles(df.drop(row), label)
    numbers = [C.clean(df, c) for c in roles["numeric"]]
    flat = df.select(F.col(f"`{row}`").alias("__row"), *[v.cast("double").alias(f"n{i}") for i, v in enumerate(numbers)], *[coded(c, codes(df, c)).alias(f"c{i}") for i, c in enumerate(roles["categorical"])], *[F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(roles["text"])])
    names = [c for c in flat.columns if c[0] in "nc"]
    parts = scaled(flat, numeric_stats(flat, names)) if names else []
    out = flat.select("__row", F.array(*parts).cast("array<double>").alias("dense"))
    for i in range(len(roles["text"])):
        weights = text_quality.tfidf(flat, f"t{i}", "__row", terms)
        vocabulary = sorted(r[0] for r in weights.select("term").distinct().collect())  # terms at most
        pairs = weights.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("w"))
        dense = F.array(*[F.coalesce(F.get(F.array(F.element_at("w", F.lit(v))), F.lit(0)), F.lit(0.0)) for v in vocabulary]).cast("array<double>")
        out = out.join(pairs, "__row", "left").select("__row", F.concat("dense", dense).alias("dense"))
    return out.select(F.col("__row").alias(row), F.col("dense").alias("vector"))


def extract_xy(df: DataFrame, label: str, row: str | None = None) -> tuple[DataFrame, list[str]]:
    """(key, vector, label, code) of the numeric features, missing ones at the median, and the label's values in order of their codes; fewer than two are an error."""
    names = [c for c in C.numeric_columns(df) if c not in (label, row)]
    kinds = sorted(str(r[0]) for r in df.where(~C.is_missing(df, label)).select(C.clean(df, label)).distinct().limit(1001).collect())
    if len(kinds) < 2 or not names:
        raise ValueError("fewer than two classes, or no numeric feature")
    stats = numeric_stats(df, names)
    vector = F.array(*[F.coalesce(C.clean(df, c).cast("double"), F.lit(stats[c][0])) for c in names])
    key = F.col(f"`{row}`").cast("long") if row else F.monotonically_increasing_id()
    value = C.clean(df, label).cast("string")
    pairs = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    return df.where(~C.is_missing(df, label)).select(key.alias("key"), vector.alias("vector"), value.alias("label"), F.element_at(pairs, value).alias("code")), kinds
