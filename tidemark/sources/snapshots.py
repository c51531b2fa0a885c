"""Analysis snapshots, commit tables and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a snapshot's items hold; the reader never guesses it, so absent fields are null.
SNAPSHOT_SCHEMA = """
items array<struct<location struct<file string, function string, line int>, debt_type string, unified_score struct<complexity_factor double, coverage_factor double, dependency_factor double, role_multiplier double, final_score double>,
  function_role string, cyclomatic_complexity int, cognitive_complexity int, nesting_depth int, function_length int, upstream_dependencies int, downstream_dependencies int>>,
total_debt_score double, debt_density double, total_lines_of_code int, overall_coverage double
"""
COMMIT_SCHEMA = "sha string, ts timestamp, author_email string, message string, path string, churn bigint"
BLAME_SCHEMA = "path string, line int, author string, ts timestamp"


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(file, fn, line, debt_type, score, cyclomatic, cognitive, nesting, length) of a JSON snapshot's items; the debt type is its tag."""
    rows = spark.read.schema(SNAPSHOT_SCHEMA).json(path, multiLine=True).select(F.explode("items").alias("i"))
    kind = F.coalesce(F.regexp_extract(F.col("i.debt_type"), r'^\s*\{\s*"(\w+)"', 1), F.lit(""))
    return rows.select(F.regexp_replace("i.location.file", r"^(\./)+", "").alias("file"), F.col("i.location.function").alias("fn"), F.col("i.location.line").alias("line"), F.when(kind != "", kind).otherwise(F.col("i.debt_type")).alias("debt_type"), F.col("i.unified_score.final_score").alias("score"), F.col("i.cyclomatic_complexity").alias("cyclomatic"), F.col("i.cognitive_complexity").alias("cognitive"), F.col("i.nesting_depth").alias("nesting"), F.col("i.function_length").alias("length"))


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """An exported commit history: one row for each commit and path."""
    return spark.read.schema(COMMIT_SCHEMA).parquet(path)


def commits_of_log(log: DataFrame, text: str = "value") -> DataFrame:
    """(sha, at, message) of lines "sha|unix seconds|message" as a log command prints them; other lines are left out."""
    parts = F.split(F.col(text), r"\|", 3)
    return log.where(F.col(text).rlike(r"^[0-9a-f]{7,40}\|\d+\|")).select(parts[0].alias("sha"), F.timestamp_seconds(parts[1].cast("long")).alias("at"), parts[2].alias("message"))


def target_location(plan: Column) -> Column:
    """The location that a plan's text names after "**Location**:"; null if none."""
    return F.nullif(F.trim(F.regexp_extract(plan, r"(?m)^\s*\*\*Location\*\*:\s*(.+?)\s*$", 1)), F.lit(""))


def blame_of(blames: DataFrame) -> DataFrame:
    """(path, line, sha, author, at) from ``blames`` (path, text), each the line porcelain of one file's blame; native. Texts without blame give no row."""
    blocks = blames.select("path", F.explode(F.split("text", r"\n\t[^\n]*(?:\n|\z)")).alias("block")).where(F.col("block").rlike(r"^[0-9a-f]{40} \d+ \d+"))
    line, sha = F.regexp_extract("block", r"^[0-9a-f]{40} \d+ (\d+)", 1).cast("int"), F.substring("block", 1, 40)
    at = F.timestamp_seconds(F.regexp_extract("block", r"(?m)^author-time (\d+)$", 1).cast("long"))
    return blocks.select("path", line.alias("line"), sha.alias("sha"), F.regexp_extract("block", r"(?m)^author (.*)$", 1).alias("author"), at.alias("at"))
