"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is written: two tasks' batches of long rows share an executor's memory.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set and all is one process (tests), a temporary one becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pumpline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    key, most = BATCH
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut, and lost executors don't lose it.

    The folder goes when it is discarded, at the latest when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pumpline-{name}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.parquet(path)
    files, where = _folder(spark, path)
    files.deleteOnExit(where)
    out = spark.read.parquet(path)
    out.shared_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables after their last use: no plan that is still to run may read them."""
    for table in tables:
        files, where = _folder(table.sparkSession, table.shared_folder)
        files.delete(where, True)
