"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch sent to Python: documents may be long, so batches stay small.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20


def tune(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Bounds the Arrow batches that Python functions get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives free memory back: workers outlive their stage, and what they hold counts beside the next one's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
        if trim:
            trim(0)

    return wrapped


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, after which their JVMs give free heap back: what one stage has grown counts beside the next one's
    Python workers. A task for each core, so that every executor has one."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a run in one process (as in tests) gets one of its own;
    on a cluster that is an error, for executors would write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="trustmill-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Folders of the operators that are at work, innermost last.
_OPEN: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are deleted at its end; those kept are left to the scope around it, or stay. What is returned from it must read kept tables only."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table by Hadoop's file system, so any store that Spark writes will do."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, keep: bool = False, clean: bool = False) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it back: lineage ends there, lost executors recompute nothing above.
    With clean the shuffle files of the write go with it, instead of when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def training_fold(doc_id) -> F.Column:
    """True for held-out documents: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
