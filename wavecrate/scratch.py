"""Intermediate tables in the folder that the whole cluster shares.

``materialize`` cuts lineage: the rows are written as Parquet under
``spark.checkpoint.dir`` and read again, so a lost executor costs a re-read and
never a re-run of what came before. The folder's name comes from the session;
where it is unset, a local one is chosen in local mode (tests, a laptop), and a
cluster is told to set it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables up to this many bytes of Parquet may be broadcast.
BROADCAST_BYTES = 8 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of this application's intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "wavecrate-scratch")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/wavecrate-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_bytes(df: DataFrame) -> int:
    """The optimizer's size of ``df``; for a scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table is proven to be within the broadcast bound."""
    return size_bytes(df) <= limit


def tables(spark: SparkSession) -> set[str]:
    """The intermediate tables that this application has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {str(f.getPath()) for f in fs.listStatus(path)} if fs.exists(path) else set()


def drop(spark: SparkSession, paths: set[str]) -> None:
    """Remove intermediate tables that no result needs any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once no result needs them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
