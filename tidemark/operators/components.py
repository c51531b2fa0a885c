"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hot import attach
from tidemark.scratch import materialize


def _edges_unless_stars(edges: DataFrame) -> int:
    """0 if each component of ``edges`` (a, b), a < b, is a star around its smallest id, else the number of edges."""
    ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("leaf")).unionByName(edges.select(F.col("b").alias("id"), F.lit(1).alias("leaf")))
    per = ends.groupBy("id").agg(F.sum("leaf").alias("leaves"), F.count(F.lit(1)).alias("n"))
    wrong = per.agg(F.count_if(F.expr("leaves > 1 or leaves > 0 and leaves < n")).alias("wrong"), F.sum("leaves").alias("n")).first()
    return wrong.n if wrong.wrong else 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every id of ``edges`` (a, b) with the smallest id it is connected with.

    Null ends and loops are left out; an empty table gives an empty result.
    Each turn keeps the edges' components and at most their number; about
    log(n)^2 turns at worst, one or two for stars. Links stay in tables, and
    ids with very many links are joined by broadcast, so no task gets them all.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while total := _edges_unless_stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = materialize(attach(both.where("v > u"), lowest, "u", 2 * total).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "edges")
        down = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = attach(large, down, "b", total).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = materialize(down.select(F.col("m").alias("a"), "b").unionByName(moved).distinct(), "edges")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
