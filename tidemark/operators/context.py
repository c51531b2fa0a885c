"""Context of findings: contributions of providers, histories of functions, code worth reading, recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A provider turns targets into rows (target, contribution).
Provider = Callable[[DataFrame], DataFrame]


class Registry:
    """Named providers with weights, analysers or stages: the engine's extension points are functions filed here."""

    def __init__(self) -> None:
        self._entries: dict[str, tuple[float, Provider]] = {}

    def register(self, name: str, provider: Provider, weight: float = 1.0) -> None:
        if name in self._entries:
            raise ValueError(f"{name} is registered already")
        self._entries[name] = weight, provider

    def contributions(self, targets: DataFrame) -> DataFrame:
        """(target, provider, weight, contribution) of all providers, in the order of their names."""
        out = None
        for name, (weight, provider) in sorted(self._entries.items()):
            part = provider(targets).select("target", F.lit(name).alias("provider"), F.lit(weight).alias("weight"), "contribution")
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError("no provider is registered")
        return out


def contextual_risk(contributions: DataFrame, base: DataFrame, most: float = 2.0) -> DataFrame:
    """(target, base, total, risk): the base raised by the weighted contributions, up to three times itself."""
    totals = contributions.groupBy("target").agg(F.sum(F.col("contribution") * F.col("weight")).alias("total"))
    joined = base.select("target", "base").join(totals, "target", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return joined.withColumn("risk", F.col("base") * (1 + F.least("total", F.lit(most))))


def function_history(changes: DataFrame, keys: list[str], at: str, author: str, is_fix: Column) -> DataFrame:
    """(keys..., introduced, changes, fixes, authors): the first change introduces a function and doesn't count as one."""
    first = F.min(at).over(Window.partitionBy(*keys))
    marked = changes.withColumn("__later", F.col(at) > first).withColumn("__fix", is_fix)
    return marked.groupBy(*keys).agg(F.min(at).alias("introduced"), F.count_if("__later").alias("changes"), F.count_if(F.col("__later") & F.col("__fix")).alias("fixes"), F.countDistinct(author).alias("authors"))


def reading_list(edges: DataFrame, limit: int) -> DataFrame:
    """(id, kind, place, other): for each node its first callers and callees in order, ``limit`` of each."""
    sides = edges.select(F.col("a").alias("id"), F.lit("callee").alias("kind"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("id"), F.lit("caller").alias("kind"), F.col("a").alias("other"))).distinct()
    return sides.withColumn("place", F.row_number().over(Window.partitionBy("id", "kind").orderBy("other"))).where(F.col("place") <= limit)


def recommendation(debt_type: Column, cyclomatic: Column, coverage: Column, nesting: Column) -> Column:
    """What to do about a finding; the first rule that holds."""
    return (
        F.when(debt_type == "GodObject", "split")
        .when(debt_type == "DeadCode", "remove")
        .when((cyclomatic > 20) & (coverage < 0.5), "test, then extract")
        .when(cyclomatic > 20, "extract functions")
        .when(nesting >= 4, "return early")
        .when(coverage < 0.5, "add tests")
        .otherwise("leave")
    )


def pipeline(df: DataFrame, stages: list[tuple[str, bool, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Runs the stages (name, whether it runs, function) in order; an error names its stage."""
    for name, runs, stage in stages:
        if runs:
            try:
                df = stage(df)
            except Exception as error:
                error.add_note(f"in stage {name}")
                raise
    return df


def all_errors(checks: list[tuple[str, bool]]) -> None:
    """ValueError with every failed check, not only the first."""
    failed = [message for message, holds in checks if not holds]
    if failed:
        raise ValueError("; ".join(failed))


def resumable(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str) -> DataFrame:
    """The stages in order, each written below ``folder`` on any store; one that a former run finished is read in place of being run again."""
    spark = df.sparkSession
    for name, stage in stages:
        path = f"{folder.rstrip('/')}/{name}"
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            stage(df).write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df
