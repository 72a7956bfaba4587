"""The folder that the driver and every executor can see, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows, and bytes, that Python workers are sent at a time unless the session says otherwise: texts may be long.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = {BATCH_ROWS: "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}
ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package also where the driver's path was set in code."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "") or os.environ.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    for key, value in BATCH.items():
        if spark.conf.get(key, None) in (None, "10000", str(1 << 28)):  # Spark's own defaults
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none a temporary folder is set if executors share the driver's
    machine; on a cluster that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lociflow-")
        spark.conf.set("spark.checkpoint.dir", named)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_RECORDS: list[list[str]] = []
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths in the shared folder that are given out meanwhile."""
    own: list[str] = []
    _RECORDS.append(own)
    try:
        yield own
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not own]


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes tables that nothing will read again: what was made from them has been written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        own = jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(conf).delete(own, True)


def folder_of(table: DataFrame) -> str | None:
    """Where ``cut`` wrote this very table."""
    return _FOLDERS.get(table)


#: Rows of a narrow table that a file of it should hold at least, and the files that it has however few its rows are.
FILE_ROWS, LEAST_FILES = 250_000, 8


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for a narrow table of about so many rows: no more than shuffle partitions, of which most would be near empty."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(LEAST_FILES, rows // FILE_ROWS))


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation of what came before. ``rows``, if about known, bounds the files of a narrow table."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(files_for(spark, rows))
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out
