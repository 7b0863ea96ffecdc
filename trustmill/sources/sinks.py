"""Writing findings and reports."""

from __future__ import annotations

import csv
import datetime
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a findings file, in order.
FINDING_COLUMNS = ["file_path", "dataset", "version", "category", "subtype", "rule_id", "severity", "message", "detector", "confidence", "column", "row_index", "value_sha256", "evidence", "metadata"]


def write_findings_csv(findings: DataFrame, path: str) -> None:
    columns = [F.col(c).cast("string").alias(c) if c in findings.columns else F.lit(None).cast("string").alias(c) for c in FINDING_COLUMNS]
    findings.select(columns).write.mode("overwrite").csv(path, header=True, escape='"')


def write_findings_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def write_report(report: dict, folder: str, run_id: str) -> str:
    path = Path(folder) / f"scan_report_{run_id}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(report, indent=2, default=str))
    return str(path)


def read_reports(spark, paths) -> DataFrame:
    """report, name, category, status: reports to flat rows."""
    df = spark.read.json(paths, multiLine=True)
    return df.select(F.input_file_name().alias("report"), F.explode("results").alias("r")).select("report", "r.name", "r.category", "r.status")


#: Names of report files, in order of preference.
PATTERNS = ("scan_report_*.json", "*_report.json", "report*.json")


def find_reports(folder: str) -> list[str]:
    """Report files below a folder by the three patterns, each once."""
    found = {str(p.resolve()): None for pattern in PATTERNS for p in sorted(Path(folder).rglob(pattern))}
    return list(found)


def write_index(folder: str, row: dict) -> None:
    """Adds a run to index.json and index.csv, with the time; both are written anew."""
    at = Path(folder) / "index.json"
    rows = json.loads(at.read_text()) if at.exists() else []
    rows.append({**row, "at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")})
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(json.dumps(rows, indent=2, default=str))
    with (Path(folder) / "index.csv").open("w", newline="") as f:
        out = csv.DictWriter(f, list(dict.fromkeys(k for r in rows for k in r)))
        out.writeheader()
        out.writerows(rows)


def write_guard_report(report, counters: DataFrame, path: str) -> None:
    """A guard report as one tree: decision, score, counts, first findings, reasons, and what was looked at in each column."""
    tree = {"decision": report.decision, "score": report.score, "counts": report.counts, "findings": report.first, "reasons": report.reasons, "columns": [r.asDict() for r in counters.collect()]}  # a row a column
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(tree, indent=2, default=str))


def trigger_rows(spark, paths, most: int = 180) -> DataFrame:
    """report, name, status, rule_id, row_index: the first findings that reports name."""
    rows = spark.read.json(paths, multiLine=True).select(F.input_file_name().alias("report"), F.explode("results").alias("r"))
    shape = "array<struct<rule_id:string,row_index:long,column:string>>"
    first = F.from_json(F.get_json_object(F.to_json("r"), "$.details.first"), shape)
    return rows.select("report", "r.name", "r.status", F.explode(first).alias("f")).select("report", "name", "status", "f.rule_id", "f.row_index").limit(most)


def summary(reports: DataFrame) -> DataFrame:
    """n_reports, n_checks, n_failed, n_review, n_skipped over rows of read_reports()."""
    return reports.agg(F.count_distinct("report").alias("n_reports"), F.count(F.lit(1)).alias("n_checks"), F.count_if(F.col("status") == "FAILED").alias("n_failed"), F.count_if(F.col("status") == "HAND_CHECK").alias("n_review"), F.count_if(F.col("status") == "SKIPPED").alias("n_skipped"))
