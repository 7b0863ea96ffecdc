"""The model gate: seven checks of a trained model against its data, with a trusted sample or model (mode 2) or without (mode 1).

Hidden representations and probabilities are computed on the executors. Spectra, clusters and gaps are judged on CAP rows of each class,
drawn by a hash of the key: the parameter bounds what comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from . import decision, model
from .structural import stratified_sample


@dataclass(frozen=True)
class GateConfig:
    """The gates' parameters; any of them may be given."""

    expected_poison: float = 0.15
    min_rows: int = 20
    permutations: int = 12
    margin_silhouette: float = 0.05
    floor_silhouette: float = 0.5
    margin_gap: float = 0.30
    gap_separation: float = 1.2
    tv_flip: float = 0.50
    tv_broad: float = 0.40
    tv_strong: float = 0.70
    clean_quantile: float = 0.99
    clean_bootstrap: int = 200
    share_review: float = 0.03
    share_block: float = 0.10
    cap: int = 2000
    named_rows: int = 20


@dataclass
class Finding:
    name: str
    category: str
    status: str
    reason: str = ""
    advisory: bool = False
    calibrated: bool = False
    role: str = ""
    details: dict = field(default_factory=dict)


def _classes(y: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(y == c) for c in sorted(set(y))]


def spectre_all(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for rows in _classes(y):
        if len(rows) >= model.SPECTRE_LEAST:
            out[rows] = model.spectre_class(x[rows])
    return out


def spectre_predict(scores: np.ndarray, expected: float = 0.10) -> np.ndarray:
    """Flags of the scores at their upper quantile or above."""
    return scores >= np.quantile(scores, 1 - expected)


def clusters_all(x: np.ndarray, y: np.ndarray, least_silhouette: float = 0.10, most_minority: float = 0.45) -> tuple[np.ndarray, np.ndarray, float]:
    """Scores, flags of rows in a tight minority cluster's class whose centre is another than the majority's, and the largest silhouette of such a class."""
    scores, flags, best = np.zeros(len(x)), np.zeros(len(x), bool), -1.0
    for rows in _classes(y):
        if len(rows) >= model.SPECTRE_LEAST:
            score, silhouette, minority = model.cluster_class(x[rows])
            scores[rows] = score
            if 0 < minority <= most_minority:
                best = max(best, silhouette)
                if silhouette >= least_silhouette:
                    flags[rows] = score > np.quantile(score, 1 - minority)
    return scores, flags, best


def gap(scores: np.ndarray) -> float:
    return float(np.percentile(scores, 95) / (np.percentile(scores, 50) + 1e-9))


def _top(keys: np.ndarray, scores: np.ndarray, n: int) -> list[int]:
    return [int(k) for k in keys[np.lexsort((keys, -scores))][:n]]


def _calibrated(name: str, category: str, clean: np.ndarray, keys: np.ndarray, scores: np.ndarray, config: GateConfig) -> Finding:
    found = model.calibrated_gate(clean, scores)
    return Finding(name, category, found["status"], "against the clean sample", calibrated=True, details={**found, "n_clean": len(clean), "top_rows": _top(keys, scores, config.named_rows)})


def judge_spectre(category: str, keys, x, y, clean, config: GateConfig) -> Finding:
    name = "spectre"
    if clean is not None:
        both = spectre_all(np.vstack([clean[0], x]), np.concatenate([clean[1], y]))
        return _calibrated(name, category, both[: len(clean[0])], keys, both[len(clean[0]) :], config)
    found = model.permutation_gate(lambda labels: gap(spectre_all(x, labels)), y, config.margin_gap)
    # Ranks rows, does not vote.
    return Finding(name, category, "REVIEW" if found["flagged"] else "PASSED", "gap against permuted labels", advisory=True, role="advisory", details={**found, "top_rows": _top(keys, spectre_all(x, y), config.named_rows)})


def judge_clusters(category: str, keys, x, y, clean, config: GateConfig) -> Finding:
    name = "activation clusters"
    if clean is not None:
        both = clusters_all(np.vstack([clean[0], x]), np.concatenate([clean[1], y]))[0]
        return _calibrated(name, category, both[: len(clean[0])], keys, both[len(clean[0]) :], config)
    found = model.permutation_gate(lambda labels: clusters_all(x, labels)[2], y, config.margin_silhouette, config.floor_silhouette)
    return Finding(name, category, "REVIEW" if found["flagged"] else "PASSED", "silhouette against permuted labels", role="primary", details={**found, "top_rows": _top(keys, clusters_all(x, y)[0], config.named_rows)})


def judge_stability(category: str, keys, scores, clean, config: GateConfig) -> Finding:
    name = "prediction stability"
    if clean is not None:
        return _calibrated(name, category, clean, keys, scores, config)
    found = model.gap_gate(scores, separation=config.gap_separation)
    return Finding(name, category, "REVIEW" if found["flagged"] else "PASSED", "a stable minority apart" if found["flagged"] else "none apart", role="corroborator", details={**found, "top_rows": _top(keys, scores, config.named_rows)})


def judge_rank(name: str, category: str, keys, scores, config: GateConfig) -> Finding:
    """Always for REVIEW: the rows of the highest scores."""
    k = min(max(1, round(config.expected_poison * len(scores))), len(scores))
    flagged = scores >= np.sort(scores)[len(scores) - k]
    return Finding(name, category, "REVIEW", "rows of the highest scores", advisory=True, details={"n_flagged": int(flagged.sum()), "share": float(flagged.mean()), "top_rows": _top(keys, scores, config.named_rows)})


def _drawn(rows: DataFrame, config: GateConfig, columns: list[str]) -> tuple:
    held = stratified_sample(rows, "key", "label", config.cap).select("key", "label", *columns).orderBy("key").collect()  # cap rows a class
    return (np.array([r["key"] for r in held]), np.array([r["label"] for r in held], object), *[np.array([r[c] for r in held], float) for c in columns])


def _skipped(name: str, category: str, reason: str) -> Finding:
    return Finding(name, category, "SKIPPED", reason)


CHECKS = ("spectre", "activation clusters", "prediction stability")


def tabular(df: DataFrame, label: str, weights: dict | None, clean: DataFrame | None, config: GateConfig, row: str | None = None) -> list[Finding]:
    """The three checks of a network of plain layers over the table's numeric features."""
    category = "tabular-model"
    try:
        if not weights:
            raise ValueError("no model")
        net = model.layers(weights)
        rows, _ = features.extract_xy(df, label, row)
        width = net[0][0].shape[1]
        first = rows.select(F.size("vector")).first()
        if first is None or first[0] != width:
            raise ValueError(f"the model takes {width} features")
        n = rows.count()
        if n < config.min_rows:
            raise ValueError(f"too few rows ({n})")
        trusted = None
        if clean is not None:
            trusted, _ = features.extract_xy(clean, label)
            got = trusted.select(F.size("vector")).first()
            trusted = trusted if got and got[0] == width else None  # without it, mode 1
    except ValueError as reason:
        return [_skipped(name, category, str(reason)) for name in CHECKS]

    def judged(some: DataFrame, spread: np.ndarray):
        return _drawn(model.score_rows(some, net, spread), config, ["hidden", "score"])

    deviations = rows.select(F.posexplode("vector").alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("s")).orderBy("i").collect()  # a row a feature
    spread = np.array([r["s"] for r in deviations])
    keys, y, hidden, stability = judged(rows, spread)
    held = judged(trusted, spread) if trusted is not None else None
    reps = (held[2], held[1]) if held else None
    return [judge_spectre(category, keys, hidden, y, reps, config), judge_clusters(category, keys, hidden, y, reps, config), judge_stability(category, keys, stability, held[3] if held else None, config)]


def embedded(rows: DataFrame | None, clean: DataFrame | None, config: GateConfig) -> list[Finding]:
    """The same of a language model, over rows (key, label, vector and, if there are stability scores, score)."""
    category = "nlp-model"
    if rows is None:
        return [_skipped(name, category, "no embeddings") for name in CHECKS]
    n = rows.count()
    if n < config.min_rows:
        return [_skipped(name, category, f"too few rows ({n})") for name in CHECKS]
    scores = ["score"] if "score" in rows.columns else []
    keys, y, x, *more = _drawn(rows, config, ["vector", *scores])
    held = _drawn(clean, config, ["vector", *scores]) if clean is not None else None
    reps = (held[2], held[1]) if held else None
    last = judge_stability(category, keys, more[0], held[3] if held else None, config) if more else _skipped(CHECKS[2], category, "no stability scores")
    return [judge_spectre(category, keys, x, y, reps, config), judge_clusters(category, keys, x, y, reps, config), last]


def difference(df: DataFrame, label: str, weights: dict | None, reference: dict | None, row: str | None = None) -> Finding:
    """How far the probabilities of two models are apart, over all rows."""
    try:
        if not weights or not reference:
            raise ValueError("no reference model")
        new, old = model.layers(weights), model.layers(reference)
        rows, _ = features.extract_xy(df, label, row)
        first = rows.select(F.size("vector")).first()
        if any(first is None or net[0][0].shape[1] != first[0] for net in (new, old)):
            raise ValueError("the models take other features")
        found = model.total_variation(model.score_both(rows, old, new), "old", "new").first()
    except ValueError as reason:
        return _skipped("model difference", "model", str(reason))
    return Finding("model difference", "model", found["decision"], "against the reference model", calibrated=True, details=found.asDict())


def scan_model(df: DataFrame, label: str, weights: dict | None = None, reference: dict | None = None, clean: DataFrame | None = None, embeddings: DataFrame | None = None, clean_embeddings: DataFrame | None = None, config: GateConfig | None = None, row: str | None = None) -> tuple[list[Finding], str]:
    """Findings of all seven checks in order, and the decision. A check that breaks is an ERROR, and the others go on."""
    config = config or GateConfig()
    out: list[Finding] = []
    for category, check in (("tabular-model", lambda: tabular(df, label, weights, clean, config, row)), ("nlp-model", lambda: embedded(embeddings, clean_embeddings, config)), ("model", lambda: [difference(df, label, weights, reference, row)])):
        try:
            out += check()
        except Exception as error:  # noqa: BLE001 - the fence
            out += [Finding(name, category, "ERROR", f"{type(error).__name__}: {str(error)[:300]}") for name in (CHECKS if category != "model" else ("model difference",))]
    return out, decision.model_roll_up([{"status": f.status, "role": f.role, "calibrated": f.calibrated, "advisory": f.advisory} for f in out])
