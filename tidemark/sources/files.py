"""Source trees as tables: one row per file, languages by extension, ignore patterns and .gitignore files honoured."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.classify import EXTENSIONS, language
from tidemark.operators.filters import glob_to_regex


def gitignore_regexes(lines: list[str]) -> list[tuple[bool, str]]:
    """(ignores, regex on the path below the root) of a .gitignore's patterns, in order; the last that matches decides."""
    out = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        ignores = not line.startswith("!")
        pattern = line.lstrip("!").lstrip("\\") if line[0] in "!\\" else line
        folder = pattern.endswith("/")
        anchored = "/" in pattern.rstrip("/")
        body = glob_to_regex(pattern.strip("/"))[1:-1]
        out.append((ignores, f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"))
    return out


def not_ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    verdict = None
    for ignores, regex in reversed(rules):
        hit = path.rlike(regex)
        verdict = F.when(hit, F.lit(not ignores)) if verdict is None else verdict.when(hit, F.lit(not ignores))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def root_gitignore(spark: SparkSession, root: str) -> list[str]:
    """The lines of ``root``/.gitignore, on any store that Spark reads; none if there is no such file. Spark's readers skip names with a leading dot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/.gitignore")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    stream = store.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def read_sources(spark: SparkSession, root: str, languages: list[str] | None = None, ignore: list[str] = (), gitignore: list[str] | None = None) -> DataFrame:
    """(path, language, text) of the files below ``root`` (a folder on any store that Spark reads, or one file).

    Files of unknown languages, files that are not UTF-8, empty files and those
    below .git are left out. ``gitignore`` are patterns in place of those of
    the root's own .gitignore. A pattern of
    ``ignore`` counts if it fits the whole path, the path below the root or the
    file's name; a root that is one file is not subject to them.
    """
    known = "*.{" + ",".join(sorted(EXTENSIONS)) + "}"
    single = bool(re.search(r"\.(" + "|".join(EXTENSIONS) + r")$", root))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader if single else reader.option("pathGlobFilter", known)).load(root)
    below = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/?", "")
    rows = files.where(F.length("content") > 0).select("path", below.alias("below"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), language(F.col("path")).alias("language"))
    rows = rows.where("text is not null")
    if languages:
        rows = rows.where(F.col("language").isin(*languages))
    if not single:
        rows = rows.where(~F.col("below").rlike(r"(^|/)\.git/"))
        for pattern in ignore:
            regex = glob_to_regex(pattern)
            rows = rows.where(~(F.col("path").rlike(regex) | F.col("below").rlike(regex) | F.element_at(F.split("below", "/"), -1).rlike(regex)))
        rows = rows.where(not_ignored(F.col("below"), gitignore_regexes(root_gitignore(spark, root) if gitignore is None else list(gitignore))))
    return rows.drop("below")


def count_lines(text: Column) -> Column:
    """Lines of a text: a final line break ends the last line and starts none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\r?\n\z", ""), "\n"))).cast("long")
