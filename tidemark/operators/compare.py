"""Snapshot comparison: what a second analysis resolved, improved, left and added, and the gates on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_last(snapshot: DataFrame, keys: list[str], order: list[str], score: str = "score") -> DataFrame:
    """(keys..., score): the last row of a repeated key counts."""
    return snapshot.groupBy(*keys).agg(F.max_by(score, F.struct(*order)).alias("score"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], critical: float = 8.0, least: float = 0.5) -> DataFrame:
    """(keys..., before, after, change) of one full join on unique keys.

    change: resolved (gone), new_critical (only after, critical), new, improved
    (fell by more than ``least``), unchanged_critical (critical in both, moved
    by less than ``least``), else other.
    """
    b, a = before.withColumnRenamed("score", "before"), after.withColumnRenamed("score", "after")
    drop = F.col("before") - F.col("after")
    kind = (
        F.when(F.col("after").isNull(), "resolved")
        .when(F.col("before").isNull() & (F.col("after") >= critical), "new_critical")
        .when(F.col("before").isNull(), "new")
        .when(drop > least, "improved")
        .when((F.abs(drop) < least) & (F.col("before") >= critical) & (F.col("after") >= critical), "unchanged_critical")
        .otherwise("other")
    )
    return b.join(a, keys, "full").withColumn("change", kind)


def summary(snapshot: DataFrame, critical: float = 8.0) -> DataFrame:
    return snapshot.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= critical).alias("critical"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean"))


def regressions(before: DataFrame, after: DataFrame, keys: list[str], cut: float = 60.0) -> DataFrame:
    """Items at or above ``cut`` after that were not at or above it before."""
    return after.where(F.col("score") >= cut).join(before.where(F.col("score") >= cut), keys, "left_anti")


def improvements(before: DataFrame, after: DataFrame, keys: list[str], cut: float = 40.0, share: float = 0.3) -> DataFrame:
    """(keys..., kind) of items at or above ``cut`` before: resolved if gone, reduced if the score fell by ``share`` or more."""
    b = before.where(F.col("score") >= cut)
    gone = b.join(after, keys, "left_anti").select(*keys, F.lit("resolved").alias("kind"))
    both = b.withColumnRenamed("score", "was").join(after, keys)
    return gone.unionByName(both.where((F.col("was") - F.col("score")) / F.col("was") >= share).select(*keys, F.lit("reduced").alias("kind")))


def target_status(before: Column, after: Column) -> Column:
    return F.when(before.isNull(), "new").when(after.isNull(), "resolved").when(after < before * 0.7, "improved").when(after > before * 1.1, "regressed").otherwise("unchanged")


def unchanged_penalty(score: Column, unchanged: Column, critical_left: Column) -> Column:
    """Unchanged critical items cost 5 % each, a quarter at most; if nothing critical was resolved, 10 % each, half at most."""
    share = F.when(critical_left, F.least(unchanged * 0.10, F.lit(0.5))).otherwise(F.least(unchanged * 0.05, F.lit(0.25)))
    return score * (1 - share)


def improvement_score(high: Column, overall: Column, complexity: Column, no_regression: Column) -> Column:
    """Parts of 0 to 100 by their weights."""
    return high * 0.4 + overall * 0.3 + complexity * 0.2 + no_regression * 0.1


def gate_status(score: Column, new_critical: Column, threshold: float) -> Column:
    return F.when((score >= threshold) & (new_critical == 0), "complete").when((score < 40) | (new_critical > 0), "failed").otherwise("incomplete")


def composite_score(target: Column, health: Column, no_regression: Column) -> Column:
    return F.least(F.greatest(target * 0.5 + health * 0.3 + no_regression * 0.2, F.lit(0.0)), F.lit(100.0))


def trend(score: Column, previous: Column) -> Column:
    """Against the run before: below -5 a regression, above 5 progress; null without one."""
    change = score - previous
    return F.when(change < -5, "regression").when(change > 5, "progress").when(change.isNotNull(), "stable")


def density_gate(density: Column, limit: float = 50.0) -> Column:
    return density <= limit
