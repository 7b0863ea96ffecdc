import json
import zipfile

import pytest

from trustmill import __main__ as cli
from trustmill.plans import scan
from trustmill.sources import readers, sinks
from trustmill.streaming import incremental


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"a, b"\n2,c\n')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "c.json").write_text('{"x": [1, 2, 3], "y": ["a", "b", "c"]}')
    (tmp_path / "d.json").write_text('[{"x": 1}, {"x": 2}]')
    spark.range(4).write.parquet(str(tmp_path / "e.parquet"))
    for name, n in (("a.csv", 2), ("b.jsonl", 2), ("c.json", 3), ("d.json", 2), ("e.parquet", 4)):
        assert readers.read_dataset(spark, str(tmp_path / name)).count() == n
    assert [p.rsplit("/", 1)[1] for p in readers.discover(str(tmp_path))] == ["a.csv", "b.jsonl", "c.json", "d.json", "e.parquet"]
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\n7\n')
    with pytest.raises(readers.ReadError):
        readers.read_dataset(spark, str(tmp_path / "bad.jsonl"))
    with pytest.raises(readers.ReadError):
        readers.read_dataset(spark, "x.txt")


def test_archives(tmp_path):
    good = tmp_path / "good.zip"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("in/a.csv", "x\n1\n")
    assert len(readers.extract_archive(str(good), str(tmp_path / "out"))) == 1
    for name, limits in (("../x.csv", {}), ("/x.csv", {}), ("x.csv", {"member_bytes": 10}), ("x.csv", {"ratio": 1.5}), ("x.csv", {"total_bytes": 10})):
        bad = tmp_path / "bad.zip"
        with zipfile.ZipFile(bad, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, "1" * 1000)
        with pytest.raises(readers.ReadError):
            readers.extract_archive(str(bad), str(tmp_path / "out2"), readers.ZipLimits(**limits))
    with pytest.raises(readers.ReadError):
        readers.resolve_under(str(tmp_path), "../x")


def test_scan_fences_checks(spark, monkeypatch):
    def broken(df, label, context):
        raise RuntimeError("no")

    monkeypatch.setitem(scan.REGISTRY["stats"], "broken", broken)
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "x long, label int")
    found = {r["name"]: r["status"] for r in scan.run(df, "label", "stats")}
    assert found["broken"] == "FAILED" and found["duplicate rows"] == "PASSED"


def test_cli_and_report(spark, tmp_path, capsys):
    (tmp_path / "d.jsonl").write_text("".join(json.dumps({"text": f"a perfectly ordinary sentence number {i}", "label": i % 2}) + "\n" for i in range(40)))
    code = cli.main(["scan", "--dataset", str(tmp_path / "d.jsonl"), "--mode", "sanity", "--report", str(tmp_path / "r")])
    out = json.loads(capsys.readouterr().out)
    assert code == 0 and out["decision"] == "ALLOW"
    assert sinks.read_reports(spark, str(tmp_path / "r" / "*.json")).count() == len(out["results"])


def test_streaming(spark, tmp_path):
    source, sink, kept = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).selectExpr("id", "cast(id as double) x", "timestamp_seconds(1000 + id * 600) ts").coalesce(1).write.mode("append").parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = stream.writeStream.foreachBatch(incremental.batch_sink(["x"], str(sink))).option("checkpointLocation", str(kept)).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    row = incremental.merged(spark.read.parquet(str(sink))).first()
    assert (row.n, row.mean, row.low, row.high) == (30, 14.5, 0.0, 29.0)
    counted = incremental.windowed(stream, "ts", "x", late="1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    assert counted.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == 30
