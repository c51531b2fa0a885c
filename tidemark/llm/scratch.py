"""Settings and sources that Python workers need, and the shared folder's tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.scratch import materialize
from tidemark.shipping import ship

__all__ = ["materialize", "n_shuffle", "ship", "small_batches"]

#: Rows of an Arrow batch: documents may be long, and a worker holds a batch several times over.
BATCH_ROWS = 1000


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
