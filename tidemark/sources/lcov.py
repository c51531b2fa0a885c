"""LCOV coverage text as tables.

Records are split at end_of_record by the reader, so files of any size are read
in parallel; within a record, the order of lines counts nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, tag, value): the lines of each record with its source file; records without one are left out."""
    records = spark.read.option("lineSep", "end_of_record").text(path).where(F.col("value").rlike(r"(?m)^SF:"))
    file = F.regexp_extract("value", r"(?m)^SF:(.*?)\r?$", 1)
    lines = records.select(file.alias("file"), F.explode(F.split("value", r"\r?\n")).alias("line"))
    return lines.select("file", F.substring_index("line", ":", 1).alias("tag"), F.expr("substring(line, instr(line, ':') + 1)").alias("value")).where(F.col("tag").isin("FN", "FNDA", "DA", "LF", "LH"))


def functions(records: DataFrame) -> DataFrame:
    """(file, name, start, calls, lines, hit, percent, uncovered) of each function.

    A function has the DA lines from its start to the next start in its file.
    percent is 0 to 100; a function without DA lines has 100 if it was called,
    else 0. A function that is named twice keeps its first start and most calls.
    """
    starts = records.where("tag = 'FN'").select("file", F.substring_index("value", ",", -1).alias("name"), F.substring_index("value", ",", 1).cast("int").alias("start")).groupBy("file", "name").agg(F.min("start").alias("start"))
    calls = records.where("tag = 'FNDA'").select("file", F.expr("substring(value, instr(value, ',') + 1)").alias("name"), F.substring_index("value", ",", 1).cast("long").alias("calls")).groupBy("file", "name").agg(F.max("calls").alias("calls"))
    data = lines(records)
    # As-of by union and window: each DA line belongs to the last start at or before it.
    marks = starts.select("file", F.col("start").alias("line"), F.lit(0).alias("side"), "name", F.lit(None).cast("long").alias("hits")).unionByName(data.select("file", "line", F.lit(1).alias("side"), F.lit(None).cast("string").alias("name"), "hits"))
    upto = Window.partitionBy("file").orderBy("line", "side", "name").rowsBetween(Window.unboundedPreceding, 0)
    owned = marks.withColumn("owner", F.last("name", ignorenulls=True).over(upto)).where("side = 1 and owner is not null")
    counted = owned.groupBy("file", F.col("owner").alias("name")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("hits") > 0).alias("hit"), F.sort_array(F.collect_list(F.when(F.col("hits") == 0, F.col("line")))).alias("uncovered"))
    joined = starts.join(calls, ["file", "name"], "left").join(counted, ["file", "name"], "left").na.fill(0, ["calls", "lines", "hit"])
    percent = F.when(F.col("lines") > 0, F.col("hit") * 100 / F.when(F.col("lines") > 0, F.col("lines"))).when(F.col("calls") > 0, 100.0).otherwise(0.0)
    return joined.select("file", "name", "start", "calls", "lines", "hit", percent.alias("percent"), F.coalesce("uncovered", F.array().cast("array<int>")).alias("uncovered"))


def lines(records: DataFrame) -> DataFrame:
    """(file, line, hits): repeated lines keep the most hits."""
    parts = F.split("value", ",")
    return records.where("tag = 'DA'").select("file", parts[0].cast("int").alias("line"), parts[1].cast("long").alias("hits")).groupBy("file", "line").agg(F.max("hits").alias("hits"))


def overall(records: DataFrame) -> DataFrame:
    """One row (percent): lines hit by lines found, 0 to 100; 0 without lines."""
    sums = records.agg(F.sum(F.when(F.col("tag") == "LH", F.col("value").cast("long"))).alias("hit"), F.sum(F.when(F.col("tag") == "LF", F.col("value").cast("long"))).alias("found"))
    return sums.select(F.coalesce(F.col("hit") * 100 / F.when(F.col("found") > 0, F.col("found")), F.lit(0.0)).alias("percent"))


def by_file(found: DataFrame) -> DataFrame:
    """(file, coverage): the unweighted mean of its functions, 0 to 1."""
    return found.groupBy("file").agg((F.avg("percent") / 100).alias("coverage"))


def diagnosis(records: DataFrame) -> DataFrame:
    """One row on a coverage file's health: files, functions, lines, and what has no data."""
    return records.agg(F.countDistinct("file").alias("files"), F.count_if(F.col("tag") == "FN").alias("functions"), F.count_if(F.col("tag") == "FNDA").alias("calls"), F.count_if(F.col("tag") == "DA").alias("lines"), F.count_if((F.col("tag") == "DA") & F.col("value").endswith(",0")).alias("unhit"))
