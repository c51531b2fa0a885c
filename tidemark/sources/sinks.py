"""Outputs: unified JSON, Markdown, DOT and tables.

JSON and tables are written by the executors. Markdown and DOT are reports of a
view that has been limited before; they are rendered on the driver row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT_VERSION = "3.0"


def unified_rows(items: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(json): one object for each item, the first of each key, with its type tag; absent and null are the same, so nulls are left out."""
    from tidemark.operators.relational import first_of_each

    tagged = first_of_each(items, keys, order)
    return tagged.select(F.to_json(F.struct(F.initcap("kind").alias("type"), *(c for c in tagged.columns if c != "kind"))).alias("json"))


def envelope(items: DataFrame, score: str = "score") -> DataFrame:
    """One row (json): format version and summary of the items."""
    sums = items.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.round(F.sum(score), 2), F.lit(0.0)).alias("total"))
    return sums.select(F.to_json(F.struct(F.lit(FORMAT_VERSION).alias("format_version"), F.struct("items", "total").alias("summary"))).alias("json"))


def write_json(items: DataFrame, path: str) -> None:
    items.write.mode("error").json(path)


def write_snapshot(items: DataFrame, path: str, snapshot: str) -> None:
    """Appends to a table of snapshots, one partition for each."""
    items.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(path)


def markdown(view: DataFrame, columns: list[str]) -> str:
    """A Markdown table of a limited view."""
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    for row in view.select(*columns).toLocalIterator():
        out.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |")
    return "\n".join(out) + "\n"


def dot(edges: DataFrame, least: float = 0.0) -> str:
    """A Graphviz digraph of a limited table (a, b, score): edges of at least that score, nodes in folders."""
    lines, folders = [], {}
    for row in edges.where(F.col("score") >= least).select(F.col("a").cast("string"), F.col("b").cast("string"), "score").toLocalIterator():
        a, b = (x.replace("\\", "\\\\").replace('"', '\\"') for x in row[:2])
        for x in (a, b):
            folders.setdefault(x.rpartition("/")[0], {})[x] = None
        lines.append(f'  "{a}" -> "{b}" [label="{row[2]:.1f}"];')
    clusters = []
    for i, (folder, names) in enumerate(sorted(folders.items())):
        members = " ".join(f'"{n}";' for n in sorted(names))
        clusters.append(f'  subgraph cluster_{i} {{ label="{folder}"; {members} }}')
    return "digraph dependencies {\n" + "\n".join([*clusters, *sorted(lines)]) + "\n}\n"
