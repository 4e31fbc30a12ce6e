"""Scratch folders of queries that write: where executors can reach them, and deleted once nothing is read from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Folders of this driver, in the order in which they were made.
_made: list[str] = []


def folder(spark: SparkSession, what: str) -> str:
    """A new folder where all executors can write; a temporary one only where none is named and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="matchlake-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def kept(spark: SparkSession, rows: DataFrame, what: str) -> DataFrame:
    """The rows as they are read back from a new folder, so that they are worked out once for all that comes from them."""
    path = folder(spark, what)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def fill(spark: SparkSession, path: str, files: int, schema: StructType) -> None:
    """Add Parquet files without rows to a folder until it holds so many."""
    conf, own = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(path)
    store = own.getFileSystem(conf)
    parquet = lambda at: [f.getPath() for f in store.listStatus(at) if f.getPath().getName().endswith(".parquet")]
    missing = files - len(parquet(own))
    if missing <= 0:
        return
    none = folder(spark, "none")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(none)
    (empty,) = parquet(spark._jvm.org.apache.hadoop.fs.Path(none))
    for _ in range(missing):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, empty, store, spark._jvm.org.apache.hadoop.fs.Path(own, f"none-{uuid.uuid4().hex}.parquet"), False, conf)


def delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def clear(spark: SparkSession) -> None:
    """Delete all folders; for when the results that come from them have been read."""
    while _made:
        delete(spark, _made.pop())
