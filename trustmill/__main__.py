"""python -m trustmill scan --dataset PATH [--label NAME] [--mode default|all|sanity|stats|model] [--only CHECK] [--drop A,B] [--report FOLDER]
    [--model WEIGHTS.npz] [--reference WEIGHTS.npz] [--clean-data PATH] [--target PATH] [--models FOLDER] [--continue-on-fail]
python -m trustmill init-demo FOLDER

--target takes a table to be judged against --clean-data: numbers are scaled by the clean table, and its rows are the trusted sample.

Exit code 0 if the scan passed, else 1.
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import features
from .operators import decision
from .plans import scan
from .sources import readers, sinks


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trustmill")
    verbs = parser.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("scan")
    one.add_argument("--dataset", required=True)
    one.add_argument("--label")
    one.add_argument("--mode", choices=list(scan.MODES), default="default")
    one.add_argument("--only")
    one.add_argument("--drop", default="")
    one.add_argument("--report")
    for name in ("--model", "--reference", "--clean-data", "--target"):
        one.add_argument(name)
    one.add_argument("--models", default="models", help="the folder that weights must lie in")
    one.add_argument("--continue-on-fail", action="store_true")
    demo = verbs.add_parser("init-demo")
    demo.add_argument("folder")
    options = parser.parse_args(argv)
    if options.verb == "init-demo":
        print(json.dumps(readers.init_demo(options.folder)))
        return 0
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        drop = [c for c in options.drop.split(",") if c]
        df = readers.read_dataset(spark, options.target or options.dataset).drop(*drop)
        clean_path = options.clean_data or (options.dataset if options.target else None)
        clean = readers.read_dataset(spark, clean_path).drop(*drop) if clean_path else None
        label = options.label or C.find_label(df)
        try:
            weights, reference = (readers.load_weights(readers.resolve_under(options.models, x)) if x else None for x in (options.model, options.reference))
        except Exception as error:  # noqa: BLE001
            raise RuntimeError(f"model_load_failed: {error}") from error
        if options.target and clean is not None:
            names = [c for c in C.numeric_columns(df) if c != label and c in clean.columns]
            stats = features.numeric_stats(clean, names)
            rest = [c for c in df.columns if c not in names]
            df, clean = (x.select(*[F.col(f"`{c}`") for c in rest if c in x.columns], *[v.alias(c) for c, v in zip(names, features.scaled(x, stats), strict=True)]) for x in (df, clean))
        mode = "all" if options.mode == "default" and options.continue_on_fail else options.mode
        results = scan.run(df, label, mode, options.only, scan.Context(weights, reference, clean))
    except Exception as error:  # noqa: BLE001 - a load failure is a result
        results = [{"position": 0, "name": "load", "category": "sanity", "status": "FAILED", "details": {"reason": "model_load_failed" if str(error).startswith("model_load_failed") else "dataset_load_failed", "error": str(error)[:500]}, "seconds": 0.0}]
    rows = spark.createDataFrame([("run", r["position"], r["category"], r["status"], str(r["details"].get("reason", "")), r["details"].get("decision")) for r in results], "run string, position int, category string, status string, reason string, decision string")
    found = decision.final_decisions(rows, ["run"]).first()
    report = decision.Report(options.dataset, results, found["risk_score"], found["decision"])
    out = {"dataset": report.dataset, "results": results, "decision": report.decision, "risk_score": report.risk_score, "overall_status": report.overall_status}
    if options.report:
        run_id = uuid.uuid4().hex[:12]
        path = sinks.write_report(out, options.report, run_id)
        sinks.write_index(options.report, {"run": run_id, "dataset": options.dataset, "decision": report.decision, "risk_score": report.risk_score, "report": path})
    print(json.dumps(out, indent=2, default=str))
    return 0 if report.overall_status == "passed" else 1


if __name__ == "__main__":
    sys.exit(main())
