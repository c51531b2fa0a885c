"""Window-shaped operators: boundaries, transitions, islands, sliding line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(rows: DataFrame, keys: list[str], order: list[str], starts: Column, label: Column, to: str) -> DataFrame:
    """``rows`` with the label of the last row, itself included, at which a segment starts; null before the first."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(F.when(starts, label), ignorenulls=True).over(upto))


def line_windows(lines: DataFrame, file: str, line: str, text: str, n: int, to: str = "chunk") -> DataFrame:
    """Every ``n`` consecutive lines, step 1: (file, line of the first, chunk); files shorter than ``n`` have none."""
    frame = Window.partitionBy(file).orderBy(line).rowsBetween(0, n - 1)
    return lines.select(file, line, F.collect_list(text).over(frame).alias(to)).where(F.size(to) == n)


def normalized_chunk(chunk: Column) -> Column:
    """Trimmed lines without empty ones and comments, joined."""
    trimmed = F.transform(chunk, lambda x: F.trim(x))
    return F.array_join(F.filter(trimmed, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#")), "\n")


def duplicate_windows(lines: DataFrame, file: str, line: str, text: str, n: int, drop_blank: bool = False) -> DataFrame:
    """(digest, file, line): normalised windows of ``n`` lines that occur more than once.

    Blank and comment-only windows are one group too, unless ``drop_blank``.
    Windows are grouped by digest: only (digest, count) meets the shuffle
    before the join, and a common window's count is summed where it is read.
    """
    chunk = normalized_chunk(F.col("chunk"))
    windows = line_windows(lines, file, line, text, n).select(F.md5(chunk).alias("digest"), (chunk == "").alias("blank"), file, line)
    if drop_blank:
        windows = windows.where("not blank")
    often = windows.groupBy("digest").count().where("count > 1").select("digest")
    return windows.drop("blank").join(often, "digest", "left_semi")


def merged_blocks(blocks: DataFrame, file: str, line: str, n: int) -> DataFrame:
    """(file, first, last): blocks of ``n`` lines, those that start exactly where another ends joined with it."""
    chains = blocks.select(file, line).distinct().withColumn("__rest", F.col(line) % n)
    order = Window.partitionBy(file, "__rest").orderBy(line)
    islands = chains.withColumn("__island", F.floor(F.col(line) / n) - F.row_number().over(order))
    return islands.groupBy(file, "__rest", "__island").agg(F.min(line).alias("first"), (F.max(line) + n - 1).alias("last")).select(file, "first", "last")


def compressed_ranges(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ranges): distinct sorted whole numbers as text like "1-3, 7"."""
    order = Window.partitionBy(key).orderBy(value)
    islands = rows.select(key, value).distinct().withColumn("__island", F.col(value) - F.row_number().over(order))
    spans = islands.groupBy(key, "__island").agg(F.min(value).alias("__from"), F.max(value).alias("__to"))
    text = F.when(F.col("__from") == F.col("__to"), F.col("__from").cast("string")).otherwise(F.concat_ws("-", "__from", "__to"))
    return spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__from", text.alias("t")))).alias("__s")).select(key, F.array_join("__s.t", ", ").alias("ranges"))


def trend(snapshots: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, change): the last snapshot's value less the first's; null with one snapshot."""
    at = F.struct(*order)
    change = F.max_by(value, at) - F.min_by(value, at)
    return snapshots.groupBy(key).agg(F.when(F.count(F.lit(1)) > 1, change).alias("change"))


def transitions(snapshots: DataFrame, key: str, order: list[str], flag: Column, to: str = "transition") -> DataFrame:
    """Snapshots at which the flag rises ("new") or falls ("resolved") against the one before."""
    before = F.lag(flag).over(Window.partitionBy(key).orderBy(*order))
    kind = F.when(flag & ~before, "new").when(~flag & before, "resolved")
    return snapshots.withColumn(to, kind).where(F.col(to).isNotNull())
