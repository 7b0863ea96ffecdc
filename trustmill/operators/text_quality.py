"""Detectors over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structural import _melt

#: Thresholds and patterns.
LENGTH_IQR, CONFLICT_FAIL, TOKEN_SHARE, NON_ASCII_FAIL = 5.0, 0.01, 0.10, 0.005
MIXED_TOKEN = r"^(?:[0-9]+[a-zA-Z]+|[a-zA-Z]+[0-9]+)[a-zA-Z0-9]*$"
TOKEN = r"[A-Za-z0-9_@$#./\\:-]{3,}"
RARE_COUNT, RARE_SHARE = 3, 0.95
SCRIPT_TOKEN = r"[A-Za-z0-9\u0400-\u04FF']+"


def _blank(c: str) -> Column:
    return F.coalesce(F.regexp_replace(f"`{c}`", r"\s+", "") == "", F.lit(True))


def empty_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_empty, status: null or white space only."""
    row = df.agg(*[F.coalesce(F.sum(_blank(c).cast("long")), F.lit(0)).alias(f"n_empty{i}") for i, c in enumerate(columns)])
    return _melt(row, columns, ["n_empty"]).withColumn("status", F.when(F.col("n_empty") > 0, "FAILED").otherwise("PASSED"))


def length_anomalies(df: DataFrame, column: str) -> DataFrame:
    """n_texts, shortest, longest, mean_length, n_outside: lengths beyond 5 interquartile ranges. Lengths are counted first: quartiles come from counts."""
    lengths = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.length(f"`{column}`").alias("len")).agg(F.count(F.lit(1)).alias("n"))
    bounds = lengths.agg(F.percentile("len", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    outside = (F.col("len") < F.col("q")[0] - LENGTH_IQR * iqr) | (F.col("len") > F.col("q")[1] + LENGTH_IQR * iqr)
    out = lengths.crossJoin(F.broadcast(bounds)).agg(  # one row of bounds
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_texts"), F.min("len").alias("shortest"), F.max("len").alias("longest"),
        F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 6).alias("mean_length"), F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("n_outside"),
    )
    return out.withColumn("status", F.when(F.col("n_outside") > 0, "HAND_CHECK").otherwise("PASSED"))


def text_label_conflicts(df: DataFrame, column: str, label: str) -> DataFrame:
    """n_texts, n_conflicts, conflict_rate, status: different texts, and those under several labels."""
    pairs = df.where(F.col(f"`{column}`").isNotNull()).select(F.sha2(f"`{column}`", 256).alias("h"), F.col(f"`{label}`").alias("y")).distinct()
    out = pairs.groupBy("h").agg(F.count("y").alias("labels")).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("labels") > 1).alias("n_conflicts"))
    rate = F.col("n_conflicts") / F.greatest("n_texts", F.lit(1))
    return out.withColumn("conflict_rate", F.round(rate, 6)).withColumn("status", F.when(rate >= CONFLICT_FAIL, "FAILED").when(F.col("n_conflicts") > 0, "HAND_CHECK").otherwise("PASSED"))


def _document_frequency(df: DataFrame, column: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    texts = df.where(F.col(f"`{column}`").isNotNull())
    frequency = texts.select(F.explode(F.array_distinct(tokens)).alias("token")).where("token != ''").groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))
    return frequency, texts.agg(F.count(F.lit(1)).alias("n"))


def suspicious_tokens(df: DataFrame, column: str) -> DataFrame:
    """token, n_docs, share: letter-and-digit tokens in a tenth of the texts or more."""
    frequency, total = _document_frequency(df, column, F.split(F.lower(F.regexp_replace(f"`{column}`", r"^\s+|\s+$", "")), r"\s+"))
    joined = frequency.where(F.col("token").rlike(MIXED_TOKEN)).crossJoin(F.broadcast(total))  # one row
    return joined.where(F.col("n_docs") >= TOKEN_SHARE * F.col("n")).select("token", "n_docs", F.round(F.col("n_docs") / F.col("n"), 6).alias("share"))


def _script_tokens(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(SCRIPT_TOKEN), F.lit(0))


def trigger_tokens(df: DataFrame, column: str) -> DataFrame:
    """token, n_docs: lower-case tokens of 6 characters or more with a digit and an ASCII letter, in max(5, 0.5 % of the texts) or more."""
    frequency, total = _document_frequency(df, column, _script_tokens(F.lower(f"`{column}`")))
    mixed = frequency.where((F.length("token") >= 6) & F.col("token").rlike("[0-9]") & F.col("token").rlike("[a-z]"))
    return mixed.crossJoin(F.broadcast(total)).where(F.col("n_docs") >= F.greatest(F.lit(5.0), 0.005 * F.col("n"))).select("token", "n_docs")  # one row


def non_ascii(df: DataFrame, column: str) -> DataFrame:
    """n_chars, n_non_ascii, rate, status."""
    text = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    out = df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"), F.coalesce(F.sum(F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))), F.lit(0)).alias("n_non_ascii"))
    rate = F.col("n_non_ascii") / F.greatest("n_chars", F.lit(1))
    return out.withColumn("rate", F.round(rate, 6)).withColumn("status", F.when(rate >= NON_ASCII_FAIL, "FAILED").otherwise("PASSED"))


def charset_scan(df: DataFrame, column: str, row: str) -> DataFrame:
    """row, n_tokens: texts with tokens of both Latin and Cyrillic letters, and how many."""
    mixed = F.filter(_script_tokens(F.coalesce(F.col(f"`{column}`"), F.lit(""))), lambda t: t.rlike("[A-Za-z]") & t.rlike(r"[\u0400-\u04FF]"))
    return df.select(F.col(f"`{row}`"), F.size(mixed).alias("n_tokens")).where("n_tokens > 0")


def label_tokens(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """token_sha256, top_label, n_docs, share: tokens that nearly always come with one label. Tokens are reported by hash."""
    text = F.concat_ws("\n", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns])
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))
    counts = df.where(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{label}`").cast("string").alias("label"), F.explode(tokens).alias("token")).groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("token").agg(F.sum("n").alias("n_docs"), F.max(F.struct("n", "label")).alias("m"))
    share = F.col("m.n") / F.col("n_docs")
    return top.where((F.col("n_docs") >= RARE_COUNT) & (share >= RARE_SHARE)).select(F.sha2("token", 256).alias("token_sha256"), F.col("m.label").alias("top_label"), "n_docs", F.round(share, 6).alias("share"))


def tfidf(df: DataFrame, column: str, row: str, terms: int = 200, min_docs: int = 2) -> DataFrame:
    """row, term, weight: sublinear frequency, smooth inverse document frequency, unit length; the terms most frequent in total."""
    text = F.lower(F.coalesce(F.col(f"`{column}`"), F.lit("")))
    counts = df.select(F.col(f"`{row}`").alias("row"), F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term")).groupBy("row", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_docs).orderBy(F.desc("cf"), "term").limit(terms)
    n = df.agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(F.broadcast(vocabulary), "term").crossJoin(F.broadcast(n)).select("row", "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = weighed.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "row").select(F.col("row").alias(row), "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))
