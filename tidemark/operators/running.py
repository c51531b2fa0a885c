"""Row numbers and running sums over a whole table in a given order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import materialize

_PART = "__tidemark_part"


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], number: str | None = None) -> DataFrame:
    """``rows`` with, for each {new: column} of ``sums``, the column's sum over the rows before, and ``number``, the row's place from 0.

    ``order`` should leave no ties between rows that differ. Rows are dealt out
    by ranges of it; the ranges' totals, one row each, are summed in one task
    and broadcast. Null values add nothing.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    added = {new: F.coalesce(F.col(c), F.lit(0)) for new, c in sums.items()} | ({number: F.lit(1).cast("long")} if number else {})
    ranged = materialize(rows.repartitionByRange(parts, *order).withColumn(_PART, F.spark_partition_id()), "ranged")
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(_PART).agg(*(F.sum(x).alias(f"__base_{new}") for new, x in added.items()))
    bases = F.broadcast(totals.select(_PART, *(F.coalesce(F.sum(f"__base_{new}").over(before), F.lit(0)).alias(f"__base_{new}") for new in added)))
    within = Window.partitionBy(_PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *(F.coalesce(F.sum(x).over(within), F.lit(0)).alias(f"__local_{new}") for new, x in added.items()))
    return local.join(bases, _PART).select(*rows.columns, *((F.col(f"__base_{new}") + F.col(f"__local_{new}")).alias(new) for new in added))
