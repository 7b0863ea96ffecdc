"""From findings and scan results to a decision."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a finding weighs by category and severity; thresholds.
WEIGHTS = {
    "secret": 0.95, "prompt_injection": 0.85, "sqli": 0.75, "xss": 0.75, "command_injection": 0.75, "template_injection": 0.70, "path_traversal": 0.60,
    "ldap_injection": 0.60, "pii": 0.55, "data_poisoning": 0.65, "malware_pattern": 0.90, "schema": 0.35, "quality": 0.25, "unknown": 0.20,
}
MULTIPLIERS = {"BLOCK": 1.0, "REVIEW": 0.7, "WARN": 0.4, "INFO": 0.2}
ALWAYS_BLOCK = ("secret", "malware_pattern")
REVIEW, BLOCK, MOST = 0.35, 0.70, 1.0
RANKS = {"ALLOW": 0, "REVIEW": 1, "BLOCK": 2}


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def guard_decisions(findings: DataFrame, by: list[str]) -> DataFrame:
    """by, score, decision, n_findings: the policy over each group's findings."""
    part = _lookup(WEIGHTS, F.col("category"), 0.2) * _lookup(MULTIPLIERS, F.col("severity"), 0.2) * F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) * 0.25
    always = F.coalesce(F.max(F.col("category").isin(*ALWAYS_BLOCK)), F.lit(False)) | F.coalesce(F.max(F.col("severity") == "BLOCK"), F.lit(False))
    out = findings.groupBy(*by).agg(F.bround(F.least(F.sum(part), F.lit(MOST)), 4).alias("raw"), always.alias("hard"), F.count(F.lit(1)).alias("n_findings"))
    score = F.when(F.col("hard"), F.greatest("raw", F.lit(BLOCK))).otherwise(F.col("raw"))
    return out.select(*by, score.alias("score"), F.when(F.col("hard") | (score >= BLOCK), "BLOCK").when(score >= REVIEW, "REVIEW").otherwise("ALLOW").alias("decision"), "n_findings")


def roll_up(files: DataFrame, by: list[str]) -> DataFrame:
    """The highest score and the strongest decision of a collection's files; a failed file (null decision) is for REVIEW."""
    decision = F.coalesce("decision", F.lit("REVIEW"))
    rank = _lookup({k: float(v) for k, v in RANKS.items()}, decision, 0.0)
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.when(F.col("decision").isNull(), F.lit(REVIEW)).otherwise(F.lit(0.0)))
    out = files.groupBy(*by).agg(F.max(score).alias("score"), F.max(rank).alias("r"), F.count(F.lit(1)).alias("n_files"))
    return out.select(*by, "score", F.when(F.col("r") == 2, "BLOCK").when(F.col("r") == 1, "REVIEW").otherwise("ALLOW").alias("decision"), "n_files")


def scan_status(decision: Column, errors: Column) -> Column:
    return F.when((decision == "ALLOW") & (errors == 0), "PASSED").when((decision == "REVIEW") & (errors == 0), "HAND_CHECK").otherwise("FAILED")


def final_decisions(results: DataFrame, by: list[str]) -> DataFrame:
    """by, risk_score, decision from scan results (position, category, status, reason, decision): the score is folded in
    order of position, since a block lifts it midway."""
    one = F.struct("position", "category", "status", F.coalesce("reason", F.lit("")).alias("reason"), F.upper(F.coalesce("decision", F.lit(""))).alias("explicit"))
    listed = results.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("x"))

    def step(s: Column, r: Column) -> Column:
        strong = r["category"].isin("sanity", "model")
        stats = r["category"] == "stats"
        failed, review = r["status"] == "FAILED", r["status"] == "HAND_CHECK"
        load = failed & r["reason"].isin("dataset_load_failed", "model_load_failed")
        block = failed & ~load & strong & (r["explicit"] == "BLOCK")
        score = (
            F.when(load, F.greatest(s["score"], F.lit(100.0)))
            .when(block, F.greatest(s["score"], F.lit(90.0)))
            .when(failed, s["score"] + F.when(strong, 35.0).when(stats, 12.0).otherwise(20.0))
            .when(review, s["score"] + F.when(strong, 25.0).otherwise(8.0))
            .otherwise(s["score"])
        )
        return F.struct(score.alias("score"), (s["hard"] | load | block).alias("hard"), (s["any"] | failed | review).alias("any"), (s["sf"] + (failed & stats).cast("int")).alias("sf"), (s["sr"] + (review & stats).cast("int")).alias("sr"))

    start = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("hard"), F.lit(False).alias("any"), F.lit(0).alias("sf"), F.lit(0).alias("sr"))
    folded = listed.select(*by, F.aggregate("x", start, step).alias("s"))
    total = F.least(F.lit(100.0), F.col("s.score") + F.when(F.col("s.sf") >= 3, 20.0).otherwise(0.0) + F.when((F.col("s.sf") >= 2) & (F.col("s.sr") >= 2), 15.0).otherwise(0.0))
    return folded.select(*by, F.bround(total / 100, 4).alias("risk_score"), F.when(F.col("s.hard") | (total >= 70), "BLOCK").when((total >= 25) | F.col("s.any"), "REVIEW").otherwise("ALLOW").alias("decision"))


def model_roll_up(findings: list[dict]) -> str:
    """Of model findings (status, role, calibrated, advisory): any BLOCK; else the calibrated ones; else those that vote; else all."""
    rank = {"PASSED": 0, "ALLOW": 0, "SKIPPED": 0, "ERROR": 0, "REVIEW": 1, "BLOCK": 2}
    if any(f["status"] == "BLOCK" and not f.get("advisory") for f in findings):
        return "BLOCK"
    live = [f for f in findings if f["status"] in ("PASSED", "REVIEW") and not f.get("advisory")]
    for group in ([f for f in live if f.get("calibrated")], [f for f in live if f.get("role") in ("primary", "corroborator")], live):
        if group:
            return "REVIEW" if max(rank[f["status"]] for f in group) else "ALLOW"
    return "ALLOW"


@dataclass
class Report:
    """A scan's results and what follows from them."""

    dataset: str
    results: list[dict] = field(default_factory=list)
    risk_score: float = 0.0
    decision: str = "ALLOW"

    @property
    def overall_status(self) -> str:
        return {"BLOCK": "failed", "REVIEW": "hand_check"}.get(self.decision, "passed")
