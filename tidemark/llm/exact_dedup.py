"""Exact dedup by a heavy-hitter split.

A Misra-Gries summary (the frequent-items sketch behind ``approx_top_k``, which
is mergeable and of fixed size) finds the digests that many rows share. One
partially aggregated pass verifies their counts and winners; that table has at
most ``tracked`` rows and is broadcast, so copies in large groups are settled
where they are read. All other digests, whose groups are small by the summary's
error bound, go through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.membership import split
from tidemark.llm.scratch import materialize
from tidemark.llm.text import utf8

#: Digests that the summary tracks: a group above 2 / (0.75 * TRACKED) of all rows is always found.
TRACKED = 8192


def digest(text):
    """SHA-256 of the unchanged text in UTF-8, as lowercase hex; a null text counts as empty."""
    return F.sha2(utf8(text), 256)


def frequent_digests(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(digest) of the Misra-Gries summary over ``digests.digest``; at most ``tracked`` rows."""
    summary = digests.agg(F.expr(f"approx_top_k(digest, {tracked * 3 // 4}, {tracked})").alias("top"))
    return summary.select(F.explode("top.item").alias("digest"))


def winners(digests: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """(digest, keep_id, group_size), exact, of the frequent digests that more than one row has."""
    frequent = F.broadcast(frequent_digests(digests, tracked))
    exact = digests.join(frequent, "digest").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return materialize(exact.where("group_size > 1"), "winners")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size, kept, text_sha256).

    Of equal texts the largest id stays. Null texts equal the empty text. Null
    ids lose to any other id and a group of null ids keeps null. Rows that
    repeat both id and text share one decision. Other columns are not read, so
    their names cannot clash. An empty table gives an empty result.
    """
    digests = materialize(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")), "digests")
    heavy = winners(digests, tracked)
    split = digests.join(F.broadcast(heavy), "digest", "left")
    same = Window.partitionBy("digest")
    light = split.where("group_size is null").select("digest", "id", F.max("id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    settled = split.where("group_size is not null").select("digest", "id", "keep_id", "group_size")
    return settled.unionByName(light).select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: one for each distinct text, that with the largest id.

    Copies of heavy texts go at the scan. Which other rows lose is found on the
    digests; only those rows, and a few that the filter of losers marks too,
    are shuffled with their texts. Rows that repeat both id and text leave one.
    Nulls as for annotate(). An empty table gives an empty result. Columns of
    any name are kept.
    """
    at, won, mark = "__tidemark_digest", "__tidemark_keep", "__tidemark_mark"
    digests = materialize(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")), "digests")
    heavy = winners(digests, tracked)
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    best = light.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Of a light text with copies, each row but one is unsure; of a heavy one only the rows that hold the winner's id.
    losers = light.join(best.select("digest"), "digest").unionByName(heavy.select(F.col("keep_id").alias("id"), "digest"))
    unsure = materialize(losers.select(_mark(F.col("id"), F.col("digest")).alias("id")).distinct(), "unsure")
    told = docs.withColumn(at, digest(F.col(text_col))).join(F.broadcast(heavy.select(F.col("digest").alias(at), F.col("keep_id").alias(won), F.lit(True).alias(mark))), at, "left")
    told = told.where(F.col(mark).isNull() | F.col(id_col).eqNullSafe(F.col(won))).withColumn(mark, _mark(F.col(id_col), F.col(at)))
    sure, rest = split(told, F.col(mark), unsure)
    rank = F.row_number().over(Window.partitionBy(at).orderBy(F.col(id_col).desc_nulls_last()))
    return sure.select(docs.columns).unionByName(rest.withColumn(won, rank).where(F.col(won) == 1).select(docs.columns))


def _mark(id_col: Column, of: Column) -> Column:
    return F.xxhash64(id_col, of)
