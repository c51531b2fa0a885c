"""Sorting, limits, deduplication and set operations over item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import running


def sort_order(criterion: str, keys: list[str], score: str = "score", coverage: str = "coverage", complexity: str = "cognitive", path: str = "file", fn: str = "fn") -> list[Column]:
    """The view's five orders, with ``keys`` as the last word so that results repeat: score, coverage (unknown first), complexity, path, function."""
    first = {
        "score": [F.col(score).desc()],
        "coverage": [F.col(coverage).asc_nulls_first()],
        "complexity": [F.col(complexity).desc()],
        "path": [F.col(path).asc()],
        "function": [F.col(fn).asc()],
    }[criterion]
    return [*first, *(F.col(k).asc() for k in keys)]


def ranked(items: DataFrame, order: list[Column], n: int | None = None, to: str = "place") -> DataFrame:
    """The first ``n`` items with their place from 1. The limit is taken first, so that only ``n`` rows are numbered in one task; without one, rows are numbered range by range."""
    if n is None:
        return running(items, order, {}, to).withColumn(to, (F.col(to) + 1).cast("int"))
    return items.orderBy(*order).limit(n).withColumn(to, F.row_number().over(Window.orderBy(*order)))


def reverse_order(order: list[Column], keys: list[str], score: str = "score") -> list[Column]:
    return [F.col(score).asc(), *(F.col(k).desc() for k in keys)]


def bottom(items: DataFrame, n: int, keys: list[str], score: str = "score") -> DataFrame:
    """The last ``n`` of the score order, in that order (not reversed)."""
    return items.orderBy(*reverse_order([], keys, score)).limit(n).orderBy(F.col(score).desc(), *(F.col(k).asc() for k in keys))


def sorted_members(array: Column, by: str, n: int | None = None) -> Column:
    """An array of structs by a field, descending, cut to ``n``."""
    ordered = F.array_sort(array, lambda a, b: F.when(a[by] > b[by], -1).when(a[by] < b[by], 1).otherwise(0))
    return ordered if n is None else F.slice(ordered, 1, n)


def combined(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Function items, then file items, told apart by ``kind``; columns of one side are null on the other."""
    return functions.withColumn("kind", F.lit("function")).unionByName(files.withColumn("kind", F.lit("file")), allowMissingColumns=True)


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; null keys are equal."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def insertion_counts(reasoned: DataFrame, keys: list[str], order: list[Column], reason: str = "reason") -> DataFrame:
    """(outcome, n): rejected rows by reason, and of the others the first of each key (added) and the repeats (duplicate)."""
    place = F.row_number().over(Window.partitionBy(*keys, F.col(reason).isNull()).orderBy(*order))
    outcome = F.when(F.col(reason).isNotNull(), F.col(reason)).when(F.col("__n") == 1, "added").otherwise("duplicate")
    return reasoned.withColumn("__n", place).groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def merged_graph(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Union of call graphs: a node keeps the first graph's attributes, edges are distinct."""
    all_nodes = all_edges = None
    for i, (n, e) in enumerate(zip(nodes, edges, strict=True)):
        n = n.withColumn("__graph", F.lit(i))
        all_nodes, all_edges = (n, e) if all_nodes is None else (all_nodes.unionByName(n), all_edges.unionByName(e))
    columns = [F.min_by(c, "__graph").alias(c) for c in nodes[0].columns if c != "id"]
    return all_nodes.groupBy("id").agg(*columns), all_edges.distinct()


def multiset_similarity(left: Column, right: Column) -> Column:
    """Token overlap of two arrays: the left counts repeats, the right is a set; 0 for two empty ones."""
    common = F.size(F.filter(left, lambda t: F.array_contains(right, t)))
    union = F.size(left) + F.size(right) - common
    return F.when(union == 0, 0.0).otherwise(common / F.when(union != 0, union))


def tokens(text: Column) -> Column:
    """Lower-cased words of more than two bytes."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.octet_length(t) > 2)
