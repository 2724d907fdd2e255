"""Folders that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; only where a session has none, as in
    tests, a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="riverseed-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut."""
    path = work_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes up to which a table in few files is dealt to all cores.
SMALL_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it comes from fewer files than there are cores and is
    small: a file of one row group is read by one task. Beyond that the scan's own tasks do."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = 0 < len(df.inputFiles()) < cores
    if not few or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(cores)
