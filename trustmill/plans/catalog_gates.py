"""More queries: verdicts of the statistical checks, the sanity gate, the model gate, feature vectors and roll-ups."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import features
from ..operators import decision, evaluate, gate, guard, rules, verdicts
from . import catalog
from .catalog import FEATURES, _network, long_lineitem, query, t


def _verdict_sql(check: str, source: str, rows: str, bad: str, fail: str = "false", least: int = 1, most: int = 50) -> str:
    """A verdict over the SQL of a metric query: rows selects label and values of it."""
    return f"WITH q AS ({catalog._ORACLES[source]}), r AS ({rows}) SELECT '{check}' AS \"check\", CASE WHEN count(*) < {least} OR count(*) > {most} THEN 'SKIPPED' WHEN bool_or({fail}) THEN 'FAILED' WHEN count(*) FILTER ({bad}) > 0 THEN 'HAND_CHECK' ELSE 'PASSED' END AS status, count(*) AS n_judged, count(*) FILTER ({bad}) AS n_flagged, coalesce(string_agg(label, ',' ORDER BY label) FILTER ({bad}), '') AS flagged FROM r"


@query(_verdict_sql("m01", "m01_modified_z", "SELECT label, max(share) AS s FROM q WHERE n >= 10 GROUP BY label", "s >= 0.05"))
def m01_verdict(spark, sf_dir):
    return verdicts.m01(long_lineitem(spark, sf_dir))


@query(_verdict_sql("m02", "m02_moments", "SELECT label, count(*) FILTER (anomalous) / count(*) AS s FROM q WHERE n >= 20 GROUP BY label", "s >= 0.2"))
def m02_verdict(spark, sf_dir):
    return verdicts.m02(long_lineitem(spark, sf_dir))


@query(_verdict_sql("m03", "m03_ks_halves", "SELECT label, count(*) FILTER (d > 0.1) / count(*) AS s FROM q GROUP BY label", "s >= 0.2"))
def m03_verdict(spark, sf_dir):
    # where D is over its limit here, p is far below its own
    long = long_lineitem(spark, sf_dir, ("l_orderkey", "l_partkey")).withColumn("h", (F.col("l_orderkey") + F.col("l_partkey")) % 2 == 0)
    return verdicts.m03(long, "h")


@query(f"WITH q AS ({catalog._ORACLES['m05_js_distance']}), c AS (SELECT count(DISTINCT l_returnflag) AS k FROM lineitem), m AS (SELECT avg(distance) AS m FROM q) SELECT 'm05' AS \"check\", CASE WHEN k NOT BETWEEN 2 AND 10 THEN 'SKIPPED' WHEN m < 0.05 THEN 'HAND_CHECK' ELSE 'PASSED' END AS status, k AS n_judged, CAST(k BETWEEN 2 AND 10 AND m < 0.05 AS BIGINT) AS n_flagged, '' AS flagged FROM c, m")
def m05_verdict(spark, sf_dir):
    return verdicts.m05(long_lineitem(spark, sf_dir))


@query(_verdict_sql("m06", "m06_wasserstein", "SELECT label, avg(distance) AS s FROM q GROUP BY label", "s > 0.5"))
def m06_verdict(spark, sf_dir):
    return verdicts.m06(long_lineitem(spark, sf_dir))


@query()
def m07_verdict(spark, sf_dir):
    return verdicts.m07(t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


@query(f"WITH q AS ({catalog._ORACLES['m09_knn_consistency']}) SELECT 'm09' AS \"check\", CASE WHEN ratio >= 0.92 THEN 'FAILED' WHEN ratio >= 0.8 THEN 'HAND_CHECK' ELSE 'PASSED' END AS status, n AS n_judged, CAST(ratio >= 0.8 AS BIGINT) AS n_flagged, '' AS flagged FROM q")
def m09_verdict(spark, sf_dir):
    return verdicts.m09(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query(f"WITH q AS ({catalog._ORACLES['m10_near_conflicts']}) SELECT 'm10' AS \"check\", CASE WHEN n < 10 THEN 'SKIPPED' WHEN rate >= 0.08 THEN 'FAILED' WHEN rate >= 0.03 THEN 'HAND_CHECK' ELSE 'PASSED' END AS status, n AS n_judged, CAST(n >= 10 AND rate >= 0.03 AS BIGINT) AS n_flagged, '' AS flagged FROM q")
def m10_verdict(spark, sf_dir):
    return verdicts.m10(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


@query(_verdict_sql("m12", "m12_lof", "SELECT label, count(*) FILTER (lof > 1.5) / count(*) AS s FROM q GROUP BY label", "s > 0.2"))
def m12_verdict(spark, sf_dir):
    return verdicts.m12(catalog._twenty(spark, sf_dir), "vec_id", "embedding", "label")


@query(_verdict_sql("m13", "m13_noise", "SELECT label, rate AS s FROM q", "s > 0.25"))
def m13_verdict(spark, sf_dir):
    return verdicts.m13(catalog._twenty(spark, sf_dir), "vec_id", "embedding", "label")


@query()
def vector_verdicts(spark, sf_dir):
    rows = t(spark, sf_dir, "embeddings")
    out = verdicts.m08(rows, "vec_id", "embedding", "label")
    for x in (verdicts.m11(rows, "vec_id", "embedding", "label"), verdicts.m14(rows, "embedding", "label"), verdicts.m15(rows, "vec_id", "embedding"), verdicts.m16(rows, "vec_id", "embedding", "label")):
        out = out.unionByName(x)
    return out


_CELLS = "SELECT doc_id AS row_index, text FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '' AND length(text) <= 8192"


@query(f"WITH c AS ({_CELLS}) SELECT 'pii' AS category, count(*) AS n_findings, 'REVIEW' AS max_severity FROM (" + " UNION ALL ".join(f"SELECT row_index FROM c WHERE length(text) BETWEEN 3 AND 2048 AND length(text) - length(replace(text, chr(10), '')) <= 30 AND {x}" for x in (
    r"len(list_filter(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'), lambda m: lower(split_part(m, '@', -1)) NOT IN ('example.com', 'company.com', 'test.com', 'email.com'))) > 0",
    r"regexp_matches(text, '\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b')",
    r"regexp_matches(text, '(?:^|[^\w#])(?:\+\d{1,3}[\s.-]?(?:\(?\d{2,4}\)?[\s.-]?){1,3}\d{3,4}|\(\d{3}\)[\s.-]?\d{3}[\s.-]?\d{4}|\d{3}[\s.-]\d{3}[\s.-]\d{4})(?:$|[^\w])')",
    r"regexp_matches(text, '(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b')",
)) + ") HAVING count(*) > 0")
def guard_personal_data(spark, sf_dir):
    # cards apart: their checksum is not for SQL
    found = guard.findings(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", detectors=("personal data",))
    return guard.by_category(found.where("rule_id != 'pii.regex.credit_card_luhn'"))


@query(f"WITH c AS (SELECT row_index, replace(replace(text, 'o', 'о'), '.', '​') AS text FROM ({_CELLS})), h AS (SELECT row_index, len(list_filter(regexp_extract_all(text, '[A-Za-zЀ-ӿ]{{3,}}'), lambda m: regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[{rules.CYRILLIC}]'))) AS n FROM c) SELECT 'homoglyph.mixed_script_token' AS rule_id, row_index, CASE WHEN n >= 5 THEN 0.95 WHEN n >= 2 THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence FROM h WHERE n > 0 UNION ALL SELECT 'homoglyph.invisible_unicode_control', row_index, 0.85 FROM c WHERE contains(text, '​')")
def guard_look_alikes(spark, sf_dir):
    # the tables have none: letters and full stops are replaced
    docs = t(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit("o"), F.lit("о")), F.lit("."), F.lit("​")).alias("text"))
    return guard.findings(docs, "doc_id", detectors=("look-alikes", "invisible characters")).select("rule_id", "row_index", "confidence")


@query("WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS k, * FROM lineitem), z AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, max(abs(({c} - m) / s)) AS z FROM l, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM l)" for c in FEATURES) + "), b AS (SELECT max(n) / sum(n) AS s FROM (SELECT count(*) AS n FROM l GROUP BY l_returnflag)), d AS (SELECT 1 - count(*) / (SELECT count(*) FROM l) AS r FROM (SELECT DISTINCT " + ", ".join([*FEATURES, "l_returnflag"]) + " FROM l)) SELECT 'data_poisoning' AS category, 'numeric_extreme_outlier' AS rule_id, 'REVIEW' AS severity, round(least(1.0, z / 16), 4) AS confidence, c AS \"column\" FROM z WHERE z >= 8 UNION ALL SELECT CASE WHEN s >= 0.98 THEN 'data_poisoning' ELSE 'quality' END, 'class_imbalance', CASE WHEN s >= 0.98 THEN 'REVIEW' ELSE 'WARN' END, round(s, 4), 'l_returnflag' FROM b WHERE s >= 0.9 UNION ALL SELECT CASE WHEN r >= 0.5 THEN 'data_poisoning' ELSE 'quality' END, 'duplicate_rows', CASE WHEN r >= 0.5 THEN 'BLOCK' ELSE 'REVIEW' END, round(least(1.0, r + 0.25), 4), NULL FROM d WHERE r >= 0.2 UNION ALL SELECT 'quality', 'constant_feature', 'WARN', 0.8, 'fixed'")
def guard_profile(spark, sf_dir):
    # one constant column is added
    rows = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), *FEATURES, "l_returnflag", F.lit("x").alias("fixed"))
    found = guard.findings(rows, "k", "l_returnflag", detectors=("size", "duplicates", "constants", "outliers", "imbalance"))
    return found.select("category", "rule_id", "severity", F.round("confidence", 4).alias("confidence"), "column")


@query(r"""SELECT 'text' AS col, count(*) AS n_cells, count(*) FILTER (NOT b AND n <= 8192) AS n_checked, count(*) FILTER (b) AS n_blank, count(*) FILTER (NOT b AND n > 8192) AS n_too_long, count(*) FILTER (NOT b AND n BETWEEN 3 AND 2048 AND ends <= 30) AS n_pii_checked
 FROM (SELECT length(text) AS n, regexp_replace(coalesce(text, ''), '\s+', '', 'g') = '' AS b, length(text) - length(replace(text, chr(10), '')) AS ends FROM documents)""".replace(" AS col", ' AS "column"'))
def guard_counters(spark, sf_dir):
    return guard.counters(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("WITH s AS (SELECT median(l_quantity) AS m, avg(l_quantity) AS a, stddev_pop(l_quantity) AS d FROM lineitem), k AS (SELECT l_returnflag AS v, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem)), c AS (SELECT avg(code) AS a, stddev_pop(code) AS d FROM lineitem JOIN k ON v = l_returnflag) SELECT l_orderkey * 10 + l_linenumber AS k, round((l_quantity - s.a) / s.d, 5) AS x, round((code - c.a) / c.d, 5) AS y FROM lineitem JOIN k ON v = l_returnflag, s, c")
def vectorize(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_returnflag")
    return features.vectorize(rows, "k").select("k", F.round(F.col("vector")[0], 5).alias("x"), F.round(F.col("vector")[1], 5).alias("y"))


@query("WITH s AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS d FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, round((o_totalprice - a) / d, 6) AS z FROM orders, s")
def target_mode_features(spark, sf_dir):
    # the finished orders are the trusted sample
    orders = t(spark, sf_dir, "orders")
    stats = features.numeric_stats(orders.where("o_orderstatus = 'F'").select("o_totalprice"), ["o_totalprice"])
    return orders.select("o_orderkey", F.round(features.scaled(orders, stats)[0], 6).alias("z"))


@query("WITH k AS (SELECT c_mktsegment AS v, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey AS key, c_mktsegment AS label, CAST(code AS INT) AS code, round(c_acctbal, 6) AS x FROM customer JOIN k ON v = c_mktsegment")
def extract_xy(spark, sf_dir):
    rows, _ = features.extract_xy(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), "c_mktsegment", "c_custkey")
    return rows.select("key", "label", "code", F.round(F.col("vector")[0], 6).alias("x"))


@query("WITH r AS (SELECT o_custkey % 50 AS run, CASE o_orderstatus WHEN 'F' THEN 'stats' WHEN 'O' THEN 'sanity' ELSE 'model' END AS category, CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' WHEN o_orderkey % 5 = 0 THEN 'HAND_CHECK' WHEN o_orderkey % 3 = 0 THEN 'SKIPPED' ELSE 'PASSED' END AS status, CASE WHEN o_orderkey % 101 = 0 THEN 'ALLOW' END AS decision FROM orders), g AS (SELECT run, category, max(CASE decision WHEN 'BLOCK' THEN 2 WHEN 'REVIEW' THEN 1 WHEN 'ALLOW' THEN 0 END) AS e, max(CASE status WHEN 'FAILED' THEN 2 WHEN 'HAND_CHECK' THEN 1 ELSE 0 END) AS w, count(*) FILTER (status IN ('FAILED', 'HAND_CHECK')) AS n_bad, count(*) FILTER (status = 'SKIPPED') AS n_skipped FROM r GROUP BY ALL) SELECT run, category, ['ALLOW', 'REVIEW', 'BLOCK'][coalesce(e, w) + 1] AS decision, n_bad, n_skipped FROM g")
def layer_roll_up(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = t(spark, sf_dir, "orders")
    rows = orders.select((F.col("o_custkey") % 50).alias("run"), F.when(F.col("o_orderstatus") == "F", "stats").when(F.col("o_orderstatus") == "O", "sanity").otherwise("model").alias("category"), F.when(key % 11 == 0, "FAILED").when(key % 5 == 0, "HAND_CHECK").when(key % 3 == 0, "SKIPPED").otherwise("PASSED").alias("status"), F.when(key % 101 == 0, "ALLOW").alias("decision"))
    return evaluate.layer_roll_up(rows, ["run"])


@query("SELECT 'poison' AS threat, count(*) FILTER (regexp_matches(lower(text), 'poison|backdoor|trigger')) AS n FROM documents UNION ALL SELECT 'injection', count(*) FILTER (regexp_matches(lower(text), 'inject|jailbreak|prompt')) FROM documents UNION ALL SELECT 'code', count(*) FILTER (regexp_matches(lower(text), 'exec|eval|pickle|shell|import')) FROM documents UNION ALL SELECT 'leak', count(*) FILTER (regexp_matches(lower(text), 'secret|credential|pii|token')) FROM documents")
def threat_counts(spark, sf_dir):
    return evaluate.threat_counts(t(spark, sf_dir, "documents"), "text")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_orderkey % 7 = 0 THEN 'BLOCK' WHEN o_orderstatus = 'O' OR o_orderkey % 5 = 0 THEN 'REVIEW' ELSE 'ALLOW' END AS decision, o_orderkey % 6 <> 4 AS poisoned FROM orders")
def combined_decision(spark, sf_dir):
    key = F.col("o_orderkey")
    a = F.when(F.col("o_orderstatus") == "F", "BLOCK").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("ALLOW")
    b = F.when(key % 7 == 0, "BLOCK").when(key % 5 == 0, "REVIEW").otherwise("ALLOW")
    return t(spark, sf_dir, "orders").select("o_orderkey", evaluate.combined_decision(a, b).alias("decision"), evaluate.expected_poisoned(key % 6).alias("poisoned"))


@query("WITH f AS (SELECT o_custkey % 40 AS collection, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_totalprice > 300000 THEN 'BLOCK' WHEN o_totalprice > 200000 THEN 'REVIEW' ELSE 'ALLOW' END AS decision, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE least(1.0, o_totalprice / 500000) END AS score FROM orders), g AS (SELECT collection, max(greatest(coalesce(score, 0), CASE WHEN decision IS NULL THEN 0.35 ELSE 0 END)) AS score, max(CASE coalesce(decision, 'REVIEW') WHEN 'BLOCK' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END) AS r, count(*) AS n_files FROM f GROUP BY 1) SELECT collection, round(score, 6) AS score, ['ALLOW', 'REVIEW', 'BLOCK'][r + 1] AS decision, n_files FROM g")
def file_roll_up(spark, sf_dir):
    failed = F.col("o_orderkey") % 13 == 0
    price = F.col("o_totalprice")
    files = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("collection"), F.when(~failed, F.when(price > 300000, "BLOCK").when(price > 200000, "REVIEW").otherwise("ALLOW")).alias("decision"), F.when(~failed, F.least(F.lit(1.0), price / 500000)).alias("score"))
    return decision.roll_up(files, ["collection"]).withColumn("score", F.round("score", 6))


@query()
def model_gate(spark, sf_dir):
    """All seven checks over embeddings as features, a random network and another one as its reference."""
    rows = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    wide = rows.select("key", "label", *[F.col("vector")[i].alias(f"f{i}") for i in range(64)])
    names = ["0.weight", "0.bias", "2.weight", "2.bias"]
    net = dict(zip(names, [x for pair in _network() for x in pair], strict=True))
    rng = np.random.default_rng(1)
    other = {k: v + rng.normal(0, 0.05, v.shape) for k, v in net.items()}
    found, verdict = gate.scan_model(wide, "label", net, other, None, rows, row="key")
    return spark.createDataFrame([(f.name, f.category, f.status, f.role, verdict) for f in found], "name string, category string, status string, role string, decision string")

