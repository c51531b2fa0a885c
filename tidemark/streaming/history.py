"""Change history as a stream: the batch operator's counts kept up to date as commits arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)


def running_history(events: DataFrame) -> DataFrame:
    """(path, commits, fixes, churn): a running aggregate; its state is one row for each path."""
    return events.groupBy(F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("commits"), F.count_if(F.col("event_type") == "error").alias("fixes"), F.sum("value").alias("churn"))


def windowed_history(events: DataFrame, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """(window, path, commits): counts in tumbling windows; commits later than ``late`` behind the newest are not waited for."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), F.col("user_id").alias("path")).agg(F.count(F.lit(1)).alias("commits")).select("window.start", "path", "commits")


def write_latest(counts: DataFrame, path: str, checkpoint: str):
    """Starts a query that replaces the table at ``path`` with the whole result after each batch and ends when all input is read."""

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:09d}")

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(replace).start()
