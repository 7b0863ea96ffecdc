"""Reading datasets: CSV, Parquet, JSON and JSON lines, alone, in folders or in archives."""

from __future__ import annotations

import os
import stat
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json"}


class ReadError(ValueError):
    """A dataset that can't be read."""


@dataclass(frozen=True)
class ZipLimits:
    """What an archive may hold."""

    members: int = 1000
    member_bytes: int = 1 << 30
    total_bytes: int = 4 << 30
    ratio: float = 100.0


def read_dataset(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A dataset by its suffix; limit takes the first rows only (a sample, off by default)."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = FORMATS.get(suffix)
    if kind is None:
        raise ReadError(f"unsupported format: {suffix or path}")
    if kind == "csv":
        df = spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"', multiLine=True)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "jsonl":
        df = read_json_lines(spark, path)
    else:
        df = read_json(spark, path)
    return df.limit(limit) if limit else df


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Blank lines are skipped; a line that is no object is an error that names it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = lines.where(~F.coalesce(F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) IS NOT NULL"), F.lit(False))).limit(1).collect()
    if bad:
        wrong = bad[0][0]
        # Only now lines are numbered, to name the first that is like it.
        number = spark.read.text(path).rdd.map(lambda r: r[0]).zipWithIndex().filter(lambda x: x[0] == wrong).map(lambda x: x[1] + 1).min()
        raise ReadError(f"line {number} is not a JSON object: {wrong[:80]}")
    return spark.read.json(path, mode="FAILFAST")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, one record, or an object of equally long lists (columns)."""
    df = spark.read.json(path, multiLine=True, mode="FAILFAST")
    fields = df.schema.fields
    if fields and all(isinstance(f.dataType, T.ArrayType) for f in fields) and df.limit(2).count() == 1:
        names = [f.name for f in fields]
        sizes = df.select(F.array_distinct(F.array(*[F.size(f"`{n}`") for n in names])).alias("s")).first()[0]
        if len(sizes) == 1:
            return df.select(F.inline(F.arrays_zip(*[F.col(f"`{n}`") for n in names])))
        raise ReadError("columns of different lengths")
    return df


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """df with a number for each row, in order of file and place: stable however the table is partitioned. Parquet gives it for free."""
    try:
        return df.select("*", F.col("_metadata.row_index").alias(name))
    except AnalysisException:  # no such metadata column in this source
        schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
        return df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def discover(path: str) -> list[str]:
    """Datasets under a folder, sorted, or the file itself."""
    root = Path(path)
    if root.is_file():
        return [str(root)] if root.suffix.lower() in FORMATS else []
    found = [p for p in root.rglob("*") if p.suffix.lower() in FORMATS and not any(q.suffix.lower() in FORMATS for q in p.relative_to(root).parents if q != Path("."))]
    return sorted(map(str, found))


def extract_archive(path: str, into: str, limits: ZipLimits = ZipLimits()) -> list[str]:
    """Checks a zip archive against the limits, extracts it and returns its datasets."""
    target = Path(into).resolve()
    with zipfile.ZipFile(path) as archive:
        members = [m for m in archive.infolist() if not m.is_dir()]
        if len(members) > limits.members:
            raise ReadError("too many members")
        if sum(m.file_size for m in members) > limits.total_bytes:
            raise ReadError("too large in total")
        for m in members:
            name = m.filename.replace("\\", "/")
            if name.startswith("/") or ":" in name.split("/")[0] or ".." in name.split("/") or stat.S_ISLNK(m.external_attr >> 16):
                raise ReadError(f"unsafe member: {m.filename}")
            if m.file_size > limits.member_bytes:
                raise ReadError(f"too large: {m.filename}")
            if m.file_size > limits.ratio * max(1, m.compress_size):
                raise ReadError(f"compressed too well: {m.filename}")
            place = (target / name).resolve()
            if target not in place.parents:
                raise ReadError(f"unsafe member: {m.filename}")
            place.parent.mkdir(parents=True, exist_ok=True)
            with archive.open(m) as source, place.open("wb") as sink:
                left = m.file_size
                while block := source.read(1 << 20):
                    left -= len(block)
                    if left < 0:
                        raise ReadError(f"longer than it says: {m.filename}")
                    sink.write(block)
    return discover(into)


def resolve_under(root: str, path: str) -> str:
    """path, if it stays under root."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise ReadError(f"outside {root}: {path}")
    return str(full)


def load_weights(path: str) -> dict:
    """Named arrays of a model, from .npz (order kept)."""
    import numpy as np

    if not path.endswith(".npz"):
        raise ReadError("weights are read from .npz")
    with np.load(path, allow_pickle=False) as held:
        return {name: held[name] for name in held.files}


def identity(path: str) -> tuple[str, str]:
    """Dataset (parent folder) and version (stem) of a file."""
    p = Path(path)
    return p.parent.name, p.stem


def init_demo(folder: str) -> dict[str, str]:
    """Writes a small table and a linear model to try a scan with."""
    import numpy as np

    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    (root / "demo.csv").write_text("size,weight,label\n1.0,2.0,a\n2.0,1.0,b\n3.0,4.0,a\n")
    np.savez(root / "demo.npz", **{"0.weight": np.eye(2), "0.bias": np.zeros(2), "2.weight": np.array([[1.0, -1.0], [-1.0, 1.0]]), "2.bias": np.zeros(2)})
    return {"dataset": str(root / "demo.csv"), "model": str(root / "demo.npz")}
