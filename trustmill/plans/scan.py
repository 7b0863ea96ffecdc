"""Scan plans: which layers run, each check fenced, and the decision over their results."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import features
from ..operators import decision, gate, guard, rules, structural, text_quality, verdicts


@dataclass(frozen=True)
class Plan:
    """Categories in order; whether a failure stops the chain; whether the model layer needs the others to pass."""

    categories: tuple[str, ...]
    keep_going: bool
    model_needs_pass: bool


#: The modes of a scan.
MODES = {
    "default": Plan(("sanity", "stats", "model"), False, True),
    "all": Plan(("sanity", "stats", "model"), True, False),
    "sanity": Plan(("sanity",), True, False),
    "stats": Plan(("stats",), True, False),
    "model": Plan(("model",), True, False),
}

@dataclass(frozen=True)
class Context:
    """What a scan may have besides the table: weights of the model and of a trusted one, a trusted sample, embeddings (key, label, vector)."""

    weights: dict | None = None
    reference: dict | None = None
    clean: DataFrame | None = None
    embeddings: DataFrame | None = None
    clean_embeddings: DataFrame | None = None
    model_config: gate.GateConfig = gate.GateConfig()
    guard_config: guard.GuardConfig = guard.GuardConfig()
    #: What checks of one scan share; emptied at its end.
    held: dict = field(default_factory=dict)


Check = Callable[[DataFrame, str | None, Context], tuple[str, dict]]
REGISTRY: dict[str, dict[str, Check]] = {"sanity": {}, "stats": {}, "model": {}}


def register(category: str, name: str) -> Callable[[Check], Check]:
    """Adds a check: (df, label, context) -> (status, details)."""

    def add(f: Check) -> Check:
        REGISTRY[category][name] = f
        return f

    return add


def _worst(rows: list) -> str:
    found = [r["status"] for r in rows]
    return "FAILED" if "FAILED" in found else "HAND_CHECK" if "HAND_CHECK" in found else "PASSED"


@register("sanity", "dataset guard")
def _guard(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    report = guard.scan_table(rows, "__row", label, context.guard_config)
    return {"ALLOW": "PASSED", "REVIEW": "HAND_CHECK", "BLOCK": "FAILED"}[report.decision], {"decision": report.decision, "score": report.score, "counts": report.counts, "first": report.first, "reasons": report.reasons}


@register("sanity", "SQL-like payload")
def _payload(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    text = [c for c in C.string_columns(df) if c != label]
    if not text:
        return "SKIPPED", {"reason": "no string columns"}
    hits = {r["column"]: r["hits"] for r in rules.sql_like(df, text).collect() if r["hits"]}
    return "FAILED" if hits else "PASSED", {"hits": hits}


@register("stats", "missing values")
def _missing(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    rows = structural.missing_values(df).collect()
    return _worst(rows), {r["column"]: r["missing_rate"] for r in rows if r["n_missing"]}


@register("stats", "duplicate rows")
def _duplicates(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    row = structural.duplicate_rows(df).first()
    return row["status"], {"rate": row["duplicate_rate"]}


@register("stats", "label conflicts")
def _conflicts(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    if not label:
        return "SKIPPED", {"reason": "no label"}
    row = structural.label_conflicts(df, label).first()
    return row["status"], {"rate": row["conflict_rate"]}


@register("stats", "constant features")
def _constant(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    found = [r["column"] for r in structural.constant_features(df.drop(label) if label else df).collect() if r["constant"]]
    return "HAND_CHECK" if found else "PASSED", {"columns": found}


@register("stats", "class balance")
def _balance(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    if not label:
        return "SKIPPED", {"reason": "no label"}
    row = structural.class_balance(df, label).first()
    return row["status"], {"ratio": row["ratio"]}


@register("stats", "numeric sentinels")
def _sentinels(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    names = [c for c in C.numeric_columns(df) if c != label]
    found = structural.numeric_sentinels(df, names).collect() if names else []
    return "FAILED" if found else "PASSED", {r["column"]: r["value"] for r in found}


@register("stats", "empty texts")
def _empty(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    text = C.roles(df, label)["text"]
    if not text:
        return "SKIPPED", {"reason": "no text columns"}
    rows = text_quality.empty_texts(df, text).collect()
    return _worst(rows), {r["column"]: r["n_empty"] for r in rows}


@register("stats", "non-ASCII share")
def _charset(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    text = C.roles(df, label)["text"]
    if not text:
        return "SKIPPED", {"reason": "no text columns"}
    rows = [text_quality.non_ascii(df, c).first() for c in text]
    return _worst(rows), {c: r["rate"] for c, r in zip(text, rows, strict=True)}


@register("stats", "text length anomaly")
def _lengths(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    text = C.roles(df, label)["text"]
    if not text:
        return "SKIPPED", {"reason": "no text columns"}
    rows = [text_quality.length_anomalies(df, c).first() for c in text]
    return _worst(rows), {c: r["n_outside"] for c, r in zip(text, rows, strict=True)}


@register("stats", "text label conflicts")
def _text_conflicts(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    text = C.roles(df, label)["text"]
    if not text or not label:
        return "SKIPPED", {"reason": "no text columns or no label"}
    rows = [text_quality.text_label_conflicts(df, c, label).first() for c in text]
    return _worst(rows), {c: r["conflict_rate"] for c, r in zip(text, rows, strict=True)}


@register("stats", "suspicious tokens")
def _tokens(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    text = C.roles(df, label)["text"]
    if not text:
        return "SKIPPED", {"reason": "no text columns"}
    found = {c: [r["token"] for r in text_quality.suspicious_tokens(df, c).limit(20).collect()] for c in text}
    return "FAILED" if any(found.values()) else "PASSED", {"tokens": found}


def _from_verdict(rows: DataFrame) -> tuple[str, dict]:
    row = rows.first()
    return row["status"], {"n_judged": row["n_judged"], "n_flagged": row["n_flagged"], "flagged": row["flagged"]}


def _long(df: DataFrame, label: str) -> DataFrame | None:
    """Scaled numbers in long form under the label, with halves dealt out by a hash."""
    names = [c for c in C.numeric_columns(df) if c != label]
    if not names:
        return None
    stats = features.numeric_stats(df, names)
    flat = df.where(~C.is_missing(df, label)).select(F.col(f"`{label}`").cast("string").alias("label"), (F.xxhash64(*[F.col(f"`{c}`") for c in names]) % 2 == 0).alias("half"), *[v.alias(c) for c, v in zip(names, features.scaled(df, stats), strict=True)])
    return C.long_form(flat, names, ["label", "half"])


def _univariate(name: str, judge: Callable[[DataFrame], DataFrame]) -> None:
    @register("stats", name)
    def check(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
        long = _long(df, label) if label else None
        if long is None:
            return "SKIPPED", {"reason": "no label or no numbers"}
        if structural.class_counts(df, label).limit(verdicts.MOST_CLASSES + 1).count() > verdicts.MOST_CLASSES:
            return "SKIPPED", {"reason": "too many classes"}
        return _from_verdict(judge(long))


for _name, _judge in (("M1 modified z", verdicts.m01), ("M2 moments", verdicts.m02), ("M3 half-split KS", lambda x: verdicts.m03(x, "half")), ("M5 Jensen-Shannon", verdicts.m05), ("M6 Wasserstein", verdicts.m06)):
    _univariate(_name, _judge)


@register("stats", "M7 chi-square")
def _chi_square(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    names = C.roles(df, label)["categorical"]
    if not names or not label:
        return "SKIPPED", {"reason": "no label or no categories"}
    return _from_verdict(verdicts.m07(df, names, label))


def _vectors(name: str, judge: Callable[[DataFrame], DataFrame]) -> None:
    @register("stats", name)
    def check(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
        if not label:
            return "SKIPPED", {"reason": "no label"}
        counts = structural.class_counts(df, label).limit(verdicts.MOST_CLASSES + 1).count()
        if not 2 <= counts <= verdicts.MOST_CLASSES:
            return "SKIPPED", {"reason": f"{counts} classes"}
        if "vectors" not in context.held:
            rows = df.withColumn("__row", F.monotonically_increasing_id())
            flat = features.vectorize(rows, "__row", label).join(rows.select("__row", F.col(f"`{label}`").cast("string").alias("label")), "__row")
            context.held["vectors"] = flat.where(F.size("vector") > 0).persist()
        return _from_verdict(judge(context.held["vectors"]))


for _name, _judge in (
    ("M8 robust Mahalanobis", lambda x: verdicts.m08(x, "__row", "vector", "label")),
    ("M9 kNN consistency", lambda x: verdicts.m09(x, "__row", "vector", "label")),
    ("M10 near-duplicate conflicts", lambda x: verdicts.m10(x, "__row", "vector", "label")),
    ("M11 isolation forest", lambda x: verdicts.m11(x, "__row", "vector", "label")),
    ("M12 local outliers", lambda x: verdicts.m12(x, "__row", "vector", "label")),
    ("M13 density noise", lambda x: verdicts.m13(x, "__row", "vector", "label")),
    ("M14 spectral", lambda x: verdicts.m14(x, "vector", "label")),
    ("M15 PCA residuals", lambda x: verdicts.m15(x, "__row", "vector")),
    ("M16 separability", lambda x: verdicts.m16(x, "__row", "vector", "label")),
):
    _vectors(_name, _judge)


@register("model", "weights")
def _weights(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    if not context.weights:
        return "SKIPPED", {"reason": "no model"}
    bad = {k: v for k, v in context.weights.items() if not np.isfinite(v).all() or (v.size and np.abs(v).max() >= 1e6)}
    return "FAILED" if bad else "PASSED", {"layers": sorted(bad), "n_parameters": int(sum(v.size for v in context.weights.values()))}


@register("model", "model gate")
def _model(df: DataFrame, label: str | None, context: Context) -> tuple[str, dict]:
    if not context.weights and context.embeddings is None:
        return "SKIPPED", {"reason": "no model"}
    if not label:
        return "SKIPPED", {"reason": "no label"}
    found, verdict = gate.scan_model(df, label, context.weights, context.reference, context.clean, context.embeddings, context.clean_embeddings, context.model_config)
    compact = [{"name": f.name, "category": f.category, "status": f.status, "reason": f.reason, "rows": f.details.get("top_rows", [])[:20]} for f in found]
    return {"ALLOW": "PASSED", "REVIEW": "HAND_CHECK", "BLOCK": "FAILED"}[verdict], {"decision": verdict, "checks": compact}


def run(df: DataFrame, label: str | None = None, mode: str = "default", only: str | tuple[str, ...] | None = None, context: Context | None = None) -> list[dict]:
    """Results of the plan's checks in order (or of those named). A check materialises inside its fence: an exception is its failure."""
    plan, out, failed, context = MODES[mode], [], False, context or Context()
    for category in plan.categories:
        if category == "model" and plan.model_needs_pass and failed:
            break
        for name, check in REGISTRY[category].items():
            if only and name not in ((only,) if isinstance(only, str) else only):
                continue
            began = time.time()
            try:
                status, details = check(df, label, context)
            except Exception as error:  # noqa: BLE001 - the fence
                status, details = "FAILED", {"reason": "scanner_runtime_error", "error": str(error)[:500], "trace": traceback.format_exc()[-500:]}
            out.append({"position": len(out), "name": name, "category": category, "status": status, "details": details, "seconds": round(time.time() - began, 3)})
            failed |= status == "FAILED"
            if status == "FAILED" and not plan.keep_going:
                break
    for rows in context.held.values():
        rows.unpersist()
    context.held.clear()
    return out


def scan_table(df: DataFrame, name: str, label: str | None = None, mode: str = "stats", skip: tuple[str, ...] = (), only: tuple[str, ...] | None = None) -> DataFrame:
    """dataset, check, category, status, decision, risk_score: a row for each check, with the decision over all of them."""
    spark = df.sparkSession
    label = label or C.find_label(df)
    results = run(df.drop(*skip), label, mode, only)
    rows = spark.createDataFrame([(name, r["position"], r["name"], r["category"], r["status"], str(r["details"].get("reason", "")), r["details"].get("decision")) for r in results], "dataset string, position int, `check` string, category string, status string, reason string, decision string")
    final = decision.final_decisions(rows, ["dataset"])
    return rows.drop("decision", "reason").join(F.broadcast(final), "dataset")  # one row


def standardised(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing values to the median, then z-scores by the population deviation (1 where it is zero)."""
    stats = df.agg(*[x for i, c in enumerate(names) for x in (F.percentile(C.clean(df, c), F.lit(0.5)).alias(f"__m{i}"),)])
    filled = df.crossJoin(F.broadcast(stats))  # one row
    for i, c in enumerate(names):
        filled = filled.withColumn(c, F.coalesce(C.clean(df, c).cast("double"), F.col(f"__m{i}")))
    moments = filled.agg(*[x for i, c in enumerate(names) for x in (F.avg(c).alias(f"__a{i}"), F.stddev_pop(c).alias(f"__s{i}"))])
    out = filled.crossJoin(F.broadcast(moments))
    for i, c in enumerate(names):
        out = out.withColumn(c, (F.col(c) - F.col(f"__a{i}")) / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0))
    return out.select(df.columns)


def ordinal(df: DataFrame, name: str) -> DataFrame:
    """df with code: the place of the value among its sorted kinds (few: a category), missing ones as a kind of their own."""
    value = F.when(F.coalesce(F.col(name), F.lit("")).isin("", "nan", "None", "NaN", "<NA>"), "__missing__").otherwise(F.col(name))
    kinds = df.select(value.alias("__v")).distinct().withColumn("code", F.row_number().over(Window.orderBy("__v")) - 1)
    return df.withColumn("__v", value).join(kinds, "__v").drop("__v")
