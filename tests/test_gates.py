import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustmill.__main__ import main
from trustmill.functions import features
from trustmill.operators import evaluate, gate, guard, model, rules, structural, text_quality, vectors
from trustmill.plans import scan
from trustmill.sources import readers, sinks


def test_gap_gate():
    assert not model.gap_gate(np.arange(19.0))["flagged"]
    scores = np.concatenate([np.linspace(0, 1, 90), np.linspace(9, 10, 10)])
    found = model.gap_gate(scores)
    spread = np.sqrt((scores[:90].var() + scores[90:].var()) / 2 + 1e-12)
    assert found["flagged"] and found["share"] == 0.1 and found["separation"] == pytest.approx((scores[90:].mean() - scores[:90].mean()) / spread)


def test_calibrated_gate():
    assert model.calibrated_gate(np.array([1.0, 5.0]), np.array([4.0, 6.0]))["threshold"] == 5.0
    assert model.calibrated_gate(np.array([np.nan]), np.array([4.0]))["status"] == "PASSED"
    rng = np.random.default_rng(0)
    clean = rng.normal(0, 1, 1000)
    assert model.calibrated_gate(clean, rng.normal(0, 1, 1000))["status"] == "PASSED" and model.calibrated_gate(clean, rng.normal(4, 1, 1000))["status"] == "BLOCK"


def test_spectre_finds_a_shifted_part():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (200, 8)) @ np.diag(np.arange(1, 9))
    x[:16, 0] += 9
    score = model.spectre_class(x)
    assert (np.argsort(-score)[:16] < 16).mean() > 0.7
    assert not model.spectre_class(x[:9]).any() and gate.spectre_predict(score, 0.1).sum() == 20


def test_kth_largest(spark):
    values = [0.1, 5.0, 5.0, -3.0, 1e9, 2.5, 2.5, 2.5, float(np.nextafter(2.5, 3))]
    counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
    for k in range(1, len(values) + 1):
        assert model.kth_largest(counts, k) == sorted(values, reverse=True)[k - 1]


def test_trigger_and_charset(spark):
    rows = [(i, "plain words only sixsix 123456 cf7trg" if i < 6 else "Plain words ПриBет слово") for i in range(12)] + [(99, None)]
    df = spark.createDataFrame(rows, "i long, text string")
    assert [(r.token, r.n_docs) for r in text_quality.trigger_tokens(df, "text").collect()] == [("cf7trg", 6)]
    assert {r.i: r.n_tokens for r in text_quality.charset_scan(df, "text", "i").collect()} == {i: 1 for i in range(6, 12)}


def test_hints_never_hide_a_match(spark):
    texts = ["<ſcript>alert</script>", "<SCRIPT >", "JAVASCRIPT :x", "un\u0130on select", "UNION ALL SELECT", "sLeep (5)", "..\\..\\x", "C:\\WINDOWS\\win.ini", "Ignore ALL previous instruction", "do anything now", "DAN mode", "x -- ", "; rm", "a || id", "${jndi:ldap://x}", "{{ 7*7 }}", "<% Runtime.getRuntime().exec(", "(|(a=*))", ") (|", "waitfor delay (", "or 1=1", "onerror = x", "%2E%2E%2F"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = [F.col("text").rlike("(?imdU)" + p) for *_, p in rules.RULES]
    want = df.select("text", F.array(*plain).alias("m")).collect()
    got = {r.text: {x.rule_id for x in r.m} for r in df.select("text", rules.matching(F.col("text")).alias("m")).collect()}
    assert {r.text: {rule[0] for rule, hit in zip(rules.RULES, r.m, strict=True) if hit} for r in want} == got
    assert sum(map(bool, got.values())) > 18


def test_guard(spark):
    rows = [(i, f"ordinary note number {i}", float(i % 5), "k", "a" if i % 2 else "b") for i in range(40)]
    rows += [(100, "mail me at jo@home.org", 1.0, "k", "a"), (101, "&lt;script&gt;alert(1)&lt;/script&gt;", 1.0, "k", "a"), (102, "pаypal lоgin", 1.0, "k", "b"), (103, "zero\u200bwidth", 1e6, "k", "b"), (104, "card 4111 1111 1111 1111", 1.0, "k", "b"), (105, None, None, "k", "b"), (106, " ", 1.0, "k", "b")]
    df = spark.createDataFrame(rows, "row long, text string, x double, fixed string, label string")
    found = {(r.rule_id, r.row_index) for r in guard.findings(df, "row", "label").collect()}
    assert {("pii.regex.email", 100), ("xss.script_tag", 101), ("homoglyph.mixed_script_token", 102), ("homoglyph.invisible_unicode_control", 103), ("pii.regex.credit_card_luhn", 104), ("constant_feature", None)} <= found
    plain = guard.findings(df, "row", "label", guard.GuardConfig(variants=False)).where("rule_id = 'xss.script_tag'")
    assert plain.count() == 0
    report = guard.scan_table(df, "row", "label")
    assert report.decision == "BLOCK" and report.score >= 0.7 and report.counts["pii"] == 2 and report.reasons
    skipped = guard.findings(df, "row", "label", guard.GuardConfig(skip_columns=("TEX",)))
    assert skipped.where("column = 'text'").count() == 0
    c = {r["column"]: r for r in guard.counters(df, "row", "label").collect()}["text"]
    assert (c.n_cells, c.n_blank, c.n_checked) == (47, 2, 45)
    assert {d["name"] for d in guard.describe()} >= {"regex", "personal data", "duplicates"}
    assert guard.scan_table(df.limit(0), "row").decision == "ALLOW"


def test_plug_in(spark, monkeypatch):
    monkeypatch.setattr(guard, "CELL_DETECTORS", dict(guard.CELL_DETECTORS))

    @guard.cell_detector("own")
    def own(cells, config):
        """Texts with an x."""
        return cells.where("text LIKE '%x%'").select(*guard._finding("unknown", "own.x", "WARN", 0.5, "own"), *guard._PLACE)

    df = spark.createDataFrame([(1, "has x"), (2, "none")], "row long, text string")
    assert [r.row_index for r in guard.findings(df, "row", detectors=("own",)).collect()] == [1]


def test_config_from_environment():
    env = {"TRUSTMILL_TEXT_LENGTH": "-5", "TRUSTMILL_REVIEW": "7", "TRUSTMILL_VARIANTS": "no", "TRUSTMILL_SKIP_COLUMNS": "a, b", "TRUSTMILL_BLOCK": "x"}
    found = guard.GuardConfig.from_env(environ=env)
    assert (found.text_length, found.review, found.variants, found.skip_columns, found.block) == (0, 1.0, False, ("a", "b"), 0.70)


def test_vectorize_and_extract(spark):
    rows = [(0, 1.0, "b", "the quick brown fox jumps over"), (1, None, "a", "the lazy dog sleeps in the sun"), (2, 3.0, "a", "a quick dog runs by the lazy fox"), (3, 3.0, None, None)]
    df = spark.createDataFrame(rows, "row long, x double, c string, text string")
    got = {r.row: r.vector for r in features.vectorize(df, "row").collect()}
    x = np.array([1.0, 3.0, 3.0, 3.0])
    assert [got[i][0] for i in range(4)] == pytest.approx(list((x - x.mean()) / x.std()))
    code = np.array([2.0, 1.0, 1.0, 0.0])  # the missing kind sorts first
    assert [got[i][1] for i in range(4)] == pytest.approx(list((code - code.mean()) / code.std()))
    assert len({len(v) for v in got.values()}) == 1 and np.linalg.norm(got[0][2:]) == pytest.approx(1, abs=1e-5) and not any(got[3][2:])
    assert features.text_columns(df) == ["text"] and df.select(features.concat_text(["c", "x"])).collect()[3][0] == "None 3.0"
    rows, kinds = features.extract_xy(df.select("row", "x", "c"), "c", "row")
    assert kinds == ["a", "b"] and {(r.key, r.code, r.vector[0]) for r in rows.collect()} == {(0, 1, 1.0), (1, 0, 3.0), (2, 0, 3.0)}
    with pytest.raises(ValueError):
        features.extract_xy(df.where("c = 'a'"), "c", "row")


def _weights(rng, n, shift=0.0):
    return {"0.weight": rng.normal(0, 1, (6, n)) + shift, "0.bias": np.zeros(6), "2.weight": rng.normal(0, 1, (2, 6)), "2.bias": np.zeros(2)}


def test_model_gate(spark):
    rng = np.random.default_rng(0)
    table = [(i, *map(float, rng.normal(i % 2, 1, 4)), "ab"[i % 2]) for i in range(120)]
    df = spark.createDataFrame(table, "row long, a double, b double, c double, d double, label string")
    found, verdict = gate.scan_model(df, "label", row="row")
    assert [f.status for f in found] == ["SKIPPED"] * 7 and verdict == "ALLOW"
    weights = _weights(rng, 4)
    found, verdict = gate.scan_model(df, "label", weights, row="row")
    assert [f.category for f in found] == ["tabular-model"] * 3 + ["nlp-model"] * 3 + ["model"] and {f.status for f in found[:3]} <= {"PASSED", "REVIEW"} and found[0].role == "advisory"
    found, _ = gate.scan_model(df, "label", weights, weights, df.drop("row"), row="row")
    assert all(f.calibrated for f in found[:3]) and found[6].status == "PASSED"
    assert [f.status for f in gate.scan_model(df.limit(5), "label", weights, row="row")[0][:3]] == ["SKIPPED"] * 3
    flipped = {**weights, "2.weight": -weights["2.weight"] * 9}
    found, verdict = gate.scan_model(df, "label", weights, flipped, row="row")
    assert found[6].status in ("REVIEW", "BLOCK") and verdict != "ALLOW"
    assert gate.judge_rank("r", "c", np.arange(100), np.arange(100.0), gate.GateConfig()).details["n_flagged"] == 15


def test_lof_and_noise_by_class_with_components(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (90, 40)) * np.linspace(3, 0.1, 40)
    y = [("a", "b", "c")[i % 3] for i in range(90)]
    x[0] += 40
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], y[i]) for i in range(90)], "id long, v array<double>, y string")
    got = {r.key: r.lof for r in vectors.lof(rows, "id", "v", "y").collect()}
    for c in "abc":
        own = [i for i in range(90) if y[i] == c]
        z = vectors.reduce(x[own], 30)
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        near = np.argsort(d, 1)[:, :20]
        dist = np.take_along_axis(d, near, 1)
        lrd = 1 / (np.maximum(dist[:, -1][near], dist).mean(1) + 1e-10)
        assert [got[i] for i in own] == pytest.approx(list(lrd[near].mean(1) / lrd), abs=2e-6)
    assert got[0] > 1.5
    assert {r.label: r.n for r in vectors.noise(rows, "id", "v", "y").collect()} == {"a": 30, "b": 30, "c": 30}


def test_poison_mask_of_unequal_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, "n")], "i long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "q")], "i long, v string")
    assert {r.i: r.changed for r in structural.poison_mask(a, b, "i").collect()} == {1: False, 2: True, 3: True, 4: True}


def test_evaluation(spark):
    row = spark.createDataFrame([("critical", 0.1), ("low", 0.9), ("info", 0.9)], "s string, r double").select(F.round(evaluate.severity_risk(F.col("s"), F.col("r")), 2).alias("x")).collect()
    assert [r.x for r in row] == [0.7, 0.69, 0.0]


def test_scan_and_command_line(spark, tmp_path, capsys, monkeypatch):
    rng = np.random.default_rng(1)
    lines = ["x,y,kind,label"] + [f"{rng.normal():.4f},{rng.normal():.4f},{'uvw'[i % 3]},{'ab'[i % 2]}" for i in range(60)]
    data = tmp_path / "data.csv"
    data.write_text("\n".join(lines))
    np.savez(tmp_path / "m.npz", **_weights(rng, 2))
    monkeypatch.setattr(spark, "stop", lambda: None)
    code = main(["scan", "--dataset", str(data), "--mode", "model", "--model", "m.npz", "--models", str(tmp_path), "--clean-data", str(data), "--report", str(tmp_path / "out")])
    out = json.loads(capsys.readouterr().out)
    assert code in (0, 1) and [r["name"] for r in out["results"]] == ["weights", "model gate"] and len(out["results"][1]["details"]["checks"]) == 7
    assert len(sinks.find_reports(str(tmp_path / "out"))) == 1 and json.loads((tmp_path / "out" / "index.json").read_text())[0]["decision"] == out["decision"]
    main(["scan", "--dataset", str(data), "--mode", "model", "--model", "../m.npz", "--models", str(tmp_path)])
    assert json.loads(capsys.readouterr().out)["results"][0]["details"]["reason"] == "model_load_failed"
    main(["scan", "--dataset", str(data), "--target", str(data), "--mode", "stats", "--only", "M1 modified z"])
    assert json.loads(capsys.readouterr().out)["results"][0]["status"] in ("PASSED", "HAND_CHECK")
    assert main(["init-demo", str(tmp_path / "demo")]) == 0
    names = [n for c in ("sanity", "stats", "model") for n in scan.REGISTRY[c]]
    assert len([n for n in names if n.startswith("M")]) == 15
    df = readers.read_dataset(spark, str(data))
    got = {r["name"]: r for r in scan.run(df, "label", "stats", tuple(n for n in names if n.startswith("M")))}
    assert len(got) == 15 and not [r for r in got.values() if "error" in r["details"]], got
    assert scan.run(df, "label", "sanity")[0]["status"] in ("PASSED", "HAND_CHECK")


def test_bad_line_is_named_by_number(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n[1]\n')
    with pytest.raises(readers.ReadError, match="line 4"):
        readers.read_dataset(spark, str(tmp_path / "x.jsonl"))
