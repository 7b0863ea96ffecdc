"""Evaluation of decisions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a, b):
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)


def confusion(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, accuracy, f1; a zero denominator gives 0."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    out = df.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return out.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def layer_metrics(df: DataFrame) -> DataFrame:
    """layer (or `final`), n, alerts, blocks, clean_allowed, mean_risk over (layer, decision, poisoned, risk)."""
    alert = F.col("decision").isin("REVIEW", "BLOCK")
    out = df.rollup("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(alert).alias("alerts"), F.count_if(F.col("decision") == "BLOCK").alias("blocks"), F.count_if(~alert & ~F.col("poisoned")).alias("clean_allowed"), F.round(F.avg("risk"), 6).alias("mean_risk"))
    return out.withColumn("layer", F.coalesce("layer", F.lit("final")))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """auc by the rank form, ties half. Scores are counted first; the running sum goes over distinct scores in parts:
    a sum for each range of scores, then within the ranges, so that no task orders them all."""
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
    low, high = counts.agg(F.min("s"), F.max("s")).first()
    width = ((high - low) / 1024 if low is not None else 0) or 1.0
    parts = counts.withColumn("part", F.floor((F.col("s") - F.lit(low or 0.0)) / F.lit(width)).cast("long"))
    below = parts.groupBy("part").agg(F.sum("n").alias("pn")).withColumn("before", F.coalesce(F.sum("pn").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    own = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    wins = parts.withColumn("inside", F.coalesce(F.sum("n").over(own), F.lit(0))).join(F.broadcast(below), "part")  # 1025 rows at most
    out = wins.agg(F.sum(F.col("p") * (F.col("before") + F.col("inside") + F.col("n") / 2)).alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(_ratio(F.col("w"), F.col("p") * F.col("n")).alias("auc"))


def latency(df: DataFrame, seconds: str, by: list[str] | None = None) -> DataFrame:
    """n, total, mean, median, p95 (nearest rank), least, most."""
    return df.groupBy(*(by or [])).agg(
        F.count(seconds).alias("n"), F.round(F.sum(seconds), 6).alias("total"), F.round(F.avg(seconds), 6).alias("mean"), F.round(F.percentile(seconds, F.lit(0.5)), 6).alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {seconds})").alias("p95"), F.min(seconds).alias("least"), F.max(seconds).alias("most"),
    )


def excess_decisions(df: DataFrame, family: str, version: str, clean: int, rate: str, review: float = 0.05, block: float = 0.15) -> DataFrame:
    """Rates judged by their excess over the family's clean version."""
    base = df.where(F.col(version) == clean).select(family, F.col(rate).alias("__base"))
    excess = F.greatest(F.col(rate) - F.coalesce("__base", F.lit(0.0)), F.lit(0.0))
    return df.join(base, family, "left").select(family, version, F.round(excess, 6).alias("excess"), F.round(F.least(F.lit(1.0), excess / block), 6).alias("risk"), F.when(excess >= block, "BLOCK").when(excess >= review, "REVIEW").otherwise("ALLOW").alias("decision"))


def class_thresholds(df: DataFrame, label: str, score: str, q: float = 0.95, least: int = 5) -> DataFrame:
    """label, threshold: the clean quantile of each class, of all rows for small ones."""
    overall = df.agg(F.percentile(score, F.lit(q)).alias("all"))
    own = df.groupBy(label).agg(F.percentile(score, F.lit(q)).alias("own"), F.count(F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(overall)).select(label, F.round(F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("all")), 6).alias("threshold"))


def severity_decision(severity):
    return F.when(severity == "critical", "BLOCK").when(severity.isin("warning", "low"), "REVIEW").otherwise("ALLOW")


def severity_risk(severity, score):
    """A finding's risk by its severity: critical at 0.7 at least, warnings between 0.35 and 0.7."""
    return F.when(severity == "critical", F.greatest(F.lit(0.7), F.least(F.lit(1.0), score))).when(severity.isin("warning", "low"), F.greatest(F.lit(0.35), F.least(F.lit(0.69), score))).otherwise(F.lit(0.0))


def expected_poisoned(version, clean: int = 4):
    """Whether a version of a dataset is poisoned: all but the clean one."""
    return F.coalesce(version != clean, F.lit(True))


def combined_decision(a, b):
    """The stronger of two decisions."""
    rank = lambda d: F.when(d == "BLOCK", 2).when(d == "REVIEW", 1).otherwise(0)
    return F.element_at(F.array(F.lit("ALLOW"), F.lit("REVIEW"), F.lit("BLOCK")), F.greatest(rank(a), rank(b)) + 1)


#: Threats by parts of their names.
THREATS = {"poison": ("poison", "backdoor", "trigger"), "injection": ("inject", "jailbreak", "prompt"), "code": ("exec", "eval", "pickle", "shell", "import"), "leak": ("secret", "credential", "pii", "token")}


def threat_counts(df: DataFrame, text: str) -> DataFrame:
    """threat, n: rows whose text has a part of the threat's names."""
    lower = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    row = df.agg(*[F.coalesce(F.sum(_any(lower, parts).cast("long")), F.lit(0)).alias(k) for k, parts in THREATS.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("threat"), F.col(k).alias("n")) for k in THREATS])).alias("x")).select("x.*")


def _any(text, parts):
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def layer_roll_up(results: DataFrame, by: list[str]) -> DataFrame:
    """by, category, status, n_bad, n_skipped over (category, status, decision): the worst status of a layer; an explicit decision comes before it."""
    explicit = F.max(F.when(F.col("decision") == "BLOCK", 2).when(F.col("decision") == "REVIEW", 1).when(F.col("decision") == "ALLOW", 0))
    worst = F.max(F.when(F.col("status") == "FAILED", 2).when(F.col("status") == "HAND_CHECK", 1).otherwise(0))
    out = results.groupBy(*by, "category").agg(F.coalesce(explicit, worst).alias("r"), F.count_if(F.col("status").isin("FAILED", "HAND_CHECK")).alias("n_bad"), F.count_if(F.col("status") == "SKIPPED").alias("n_skipped"))
    return out.select(*by, "category", F.element_at(F.array(F.lit("ALLOW"), F.lit("REVIEW"), F.lit("BLOCK")), F.col("r") + 1).alias("decision"), "n_bad", "n_skipped")
