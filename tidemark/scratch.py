"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_USED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that spark.checkpoint.dir names.

    Where that is unset, below a temporary folder in local mode; on a cluster
    there is no folder that all machines are known to share, so that is an
    error. The folder goes when the driver ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not named:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        if not local:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", named)
    own = f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _USED:
        _USED.add(own)
        atexit.register(_remove, spark, own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends at files that outlive an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
