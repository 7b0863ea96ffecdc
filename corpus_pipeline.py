"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. What a stage returns is written as Parquet and read again as the next one's docs. Stages work on every row they get,
whatever further columns it has, and delete their scratch tables before they return.

Defined cases, in each stage: a null text counts as the empty text, and a null id is an id as any other; an empty table
gives an empty table. Texts that are null or without a letter leave with the first stage. Of repeated rows, near copies and ties in
id one row stays in the second: the least by id, then text, then the other columns. Without benchmark items nothing leaves with the
third. Very long texts are taken whole by all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.llm import bpe, common, decontaminate, langid, near_dup, pii

#: A document whose language is predicted with less than this is rejected, as is one without letters.
LEAST_LANGUAGE_SCORE = 0.3
#: Benchmark items in a document that reject it: here one is enough.
LEAST_ITEMS = 1


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _row(docs: DataFrame) -> DataFrame:
    """The row as one column, so that no name of docs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _text_key().alias("text_key"), F.col("doc_id").cast("long").alias("id"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language that the network knows. Without any labelled document, those that have a letter."""
    network = langid.train(docs)
    if not network.labels:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    bare = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "text")
    found = langid.identify(bare, network)
    return found.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("doc.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near duplicates; of repeated rows one."""
    common.give_back(spark)
    with common.scratch(spark):
        found = near_dup.near_duplicates(docs)
        least = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m"))
        stay = common.materialise(least.select(F.col("m.doc_id").alias("stay_id"), F.col("m.text_key").alias("stay_key")), "stay", keep=True)
    rows = _row(docs)
    kept = rows.join(stay, (rows["text_key"] == stay["stay_key"]) & rows["id"].eqNullSafe(stay["stay_id"]))
    # One of the rows of equal id and text, whatever order they come in.
    rank = F.xxhash64(F.to_json(F.struct(*[F.col(f"doc.`{c}`") for c in docs.columns if c != "text"])))
    return kept.groupBy("text_key", "id").agg(F.min_by("doc", rank).alias("doc")).select("doc.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of LEAST_ITEMS benchmark items."""
    common.give_back(spark)
    with common.scratch(spark):
        texts = docs.select(_text_key().alias("text_key"), "text")
        found = decontaminate.decontaminate(texts, common.read(spark, sf_dir, "benchmark"), min_items=LEAST_ITEMS)
        gone = common.materialise(found.where("contaminated").select(F.col("text_key").alias("gone_key")).distinct(), "contaminated", keep=True)
    rows = _row(docs)
    return rows.join(decontaminate.small(gone), rows["text_key"] == gone["gone_key"], "left_anti").select("doc.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data to its kind, removes disclosing terms, and counts characters anew."""
    common.give_back(spark)
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and of what they decode to."""
    common.give_back(spark)
    return bpe.encode_decode(docs.select("doc_id", "text"), keep_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language),
    ("near_dup", deduplicate),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("byte_bpe", encode),
]

#: Networks and alignments are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage leaves is deleted when the next one has read it."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch(spark):
            done = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
