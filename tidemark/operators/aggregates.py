"""Aggregations: groups, summaries, coverage, history, entropy, coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
CATEGORY_SEVERITY = {"Testing": 0.8, "Resource": 1.2, "Organization": 1.0, "Duplication": 0.9}
PRIORITY_POINTS = {"Critical": 3.0, "High": 2.0, "Medium": 1.0, "Low": 0.5}


def density(score: Column, lines: Column) -> Column:
    """Score for 1000 lines; 0 without lines."""
    return F.when(lines > 0, score / lines * 1000).otherwise(0.0)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Rows with a weight of 0 or below don't count; 0 without any."""
    used = weight > 0
    return F.coalesce(F.sum(F.when(used, value * weight)) / F.sum(F.when(used, weight)), F.lit(0.0))


def integer_median(value: str) -> Column:
    """The median of whole numbers, the mean of the middle two rounded down."""
    return F.floor(F.median(value)).cast("long")


def pearson(x: str, y: str) -> Column:
    """Correlation; null with fewer than two rows or a constant column."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(F.lit(1)) > 1, F.covar_pop(x, y) / F.when(spread > 0, spread))


def piecewise_percentile(knots: list[tuple[float, float]], p: Column) -> Column:
    """The value at ``p`` on straight lines between (percentile, value) knots; the first or last value outside."""
    out = F.when(p <= knots[0][0], F.lit(knots[0][1]))
    for (p1, v1), (p2, v2) in zip(knots, knots[1:]):
        out = out.when(p <= p2, v1 + (p - p1) / (p2 - p1) * (v2 - v1))
    return out.otherwise(F.lit(knots[-1][1]))


def location_groups(items: DataFrame, score: str, rank: Column, keys: list[str]) -> DataFrame:
    """(keys..., total, worst, n): items of one place with the sum of scores and the highest severity rank."""
    return items.groupBy(*keys).agg(F.sum(score).alias("total"), F.max(rank).alias("worst"), F.count(F.lit(1)).alias("n"))


def category_score(n: Column, points: Column, severity: Column) -> Column:
    """Mean priority points times the category's severity, growing with the root of the count."""
    return F.when(n > 0, points / n * severity * F.sqrt(n)).otherwise(0.0)


def top_in_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, to: str = "place") -> DataFrame:
    """The first ``n`` rows of each group, with their place."""
    return rows.withColumn(to, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(to) <= n)


def module_coupling(edges: DataFrame) -> DataFrame:
    """(module, afferent, efferent, instability) of dependencies a on b; modules without any don't appear."""
    out, into = edges.groupBy(F.col("a").alias("module")).agg(F.countDistinct("b").alias("efferent")), edges.groupBy(F.col("b").alias("module")).agg(F.countDistinct("a").alias("afferent"))
    both = out.join(into, "module", "full").select("module", F.coalesce("afferent", F.lit(0)).alias("afferent"), F.coalesce("efferent", F.lit(0)).alias("efferent"))
    return both.withColumn("instability", F.col("efferent") / (F.col("afferent") + F.col("efferent")))


def file_history(commits: DataFrame, path: str, at: str, author: str, churn: str, is_fix: Column, now: Column) -> DataFrame:
    """One pass over commits: (path, commits, fixes, authors, churn, age_days, frequency, bug_density, stability).

    ``now`` is a timestamp; ages are whole days, 0 at least. A month has 30 days.
    """
    n = F.count(F.lit(1))
    base = commits.groupBy(path).agg(n.alias("commits"), F.count_if(is_fix).alias("fixes"), F.countDistinct(author).alias("authors"), F.sum(churn).alias("churn"), F.min(at).alias("first"))
    age = F.greatest(F.floor((F.unix_seconds(now) - F.unix_seconds(F.col("first").cast("timestamp"))) / 86400), F.lit(0))
    aged = base.withColumn("age_days", age.cast("long")).drop("first")
    monthly = F.col("commits") / F.when(F.col("age_days") > 0, F.col("age_days")) * 30
    bugs = F.col("fixes") / F.col("commits")
    calm = F.coalesce(1 / (1 + monthly), F.lit(0.5))
    stability = F.least(calm * 0.4 + (1 - F.least(bugs, F.lit(1.0))) * 0.4 + F.least(F.col("age_days") / 365, F.lit(1.0)) * 0.2, F.lit(1.0))
    return aged.select("*", F.coalesce(monthly, F.lit(0.0)).alias("frequency"), bugs.alias("bug_density"), stability.alias("stability"))


def token_statistics(tokens: DataFrame, key: str, token: str) -> DataFrame:
    """(key, n, distinct, diversity, entropy) of rows of tokens; entropy is normalised by log2 of all tokens and 0 for one distinct token."""
    counts = tokens.groupBy(key, token).agg(F.count(F.lit(1)).alias("c"))
    # H = log2 n - sum(c log2 c) / n: one pass over the counts.
    sums = counts.groupBy(key).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("distinct"), F.sum(F.col("c") * F.log2("c")).alias("clogc"))
    n, spread = F.col("n"), F.log2("n") - F.col("clogc") / F.col("n")
    return sums.select(key, "n", "distinct", (F.col("distinct") / n).alias("diversity"), F.when(F.col("distinct") > 1, spread / F.log2("n")).otherwise(0.0).alias("entropy"))


def category_entropy(tokens: DataFrame, key: str, category: Column, weight: Column) -> DataFrame:
    """(key, entropy) of the categories' weights, normalised by log2 of their number; 0 for one category."""
    weights = tokens.groupBy(key, category.alias("__k")).agg(F.sum(weight).alias("w"))
    sums = weights.groupBy(key).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("w") * F.log2("w")).alias("wlogw"))
    return sums.select(key, F.when(F.col("k") > 1, (F.log2("n") - F.col("wlogw") / F.col("n")) / F.log2("k")).otherwise(0.0).alias("entropy"))


def repeated_sequences(tokens: DataFrame, key: str, order: str, token: str, size: int) -> DataFrame:
    """(key, pattern, times): sequences of ``size`` tokens seen more than once, overlaps counted."""
    at = Window.partitionBy(key).orderBy(order)
    following = [F.lead(token, i).over(at) for i in range(size)]
    grams = tokens.select(key, F.when(following[-1].isNotNull(), F.array(*following)).alias("pattern")).where("pattern is not null")
    return grams.groupBy(key, "pattern").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def repetition_score(tokens: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """(key, repetition): the largest share of tokens in repeats over sizes 2 to 5 (half the tokens at most), and a bonus for patterns seen more than twice; 1 at most."""
    totals = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    parts = None
    for size in range(2, 6):
        found = repeated_sequences(tokens, key, order, token, size)
        part = found.groupBy(key).agg((F.sum(F.col("times") - 1) * size).alias("covered"), F.count_if(F.col("times") > 2).alias("frequent")).withColumn("size", F.lit(size))
        parts = part if parts is None else parts.unionByName(part)
    usable = totals.join(parts, key, "left").where("size is null or 2 * size <= n")
    scored = usable.groupBy(key).agg(F.max(F.col("covered") / F.col("n")).alias("share"), F.sum("frequent").alias("frequent"))
    score = F.least(F.coalesce("share", F.lit(0.0)) + F.least(F.coalesce(F.col("frequent"), F.lit(0)) / 10, F.lit(0.2)), F.lit(1.0))
    return totals.select(key).join(scored, key, "left").select(key, score.alias("repetition"))


def merged_coverage(rows: DataFrame, keys: list[str], percent: str, uncovered: str) -> DataFrame:
    """(keys..., percent, uncovered): the mean percentage and the lines that every instance leaves uncovered."""
    instances = rows.groupBy(*keys).agg(F.avg(percent).alias("percent"), F.count(F.lit(1)).alias("n"))
    lines = rows.select(*keys, F.explode(F.array_distinct(uncovered)).alias("line")).groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("hits"))
    shared = lines.join(instances.select(*keys, "n"), keys).where("hits = n").groupBy(*keys).agg(F.sort_array(F.collect_list("line")).alias("uncovered"))
    return instances.drop("n").join(shared, keys, "left").withColumn("uncovered", F.coalesce("uncovered", F.array().cast("array<int>")))


def silhouette(coherence: Column, separation: Column) -> Column:
    """Mean of (b - a) / max(a, b), a = 1 - coherence, b = separation; 0 where both are 0."""
    a, b = 1 - coherence, separation
    top = F.greatest(a, b)
    return F.avg(F.when(top == 0, 0.0).otherwise((b - a) / F.when(top != 0, top)))


def cohesion(edges: DataFrame, file_of: DataFrame, least: int) -> DataFrame:
    """(file, internal, external, score) of files with at least ``least`` functions; 1 without calls.

    ``edges`` are calls (a, b), ``file_of`` rows (id, file).
    """
    sizes = file_of.groupBy("file").agg(F.countDistinct("id").alias("functions")).where(F.col("functions") >= least)
    calls = edges.join(file_of.select(F.col("id").alias("a"), "file"), "a").join(file_of.select(F.col("id").alias("b"), F.col("file").alias("other")), "b")
    counted = calls.groupBy("file").agg(F.count_if(F.col("file") == F.col("other")).alias("internal"), F.count_if(F.col("file") != F.col("other")).alias("external"))
    joined = sizes.join(counted, "file", "left").na.fill(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return joined.select("file", "internal", "external", F.when(total == 0, 1.0).otherwise(F.col("internal") / F.when(total > 0, total)).alias("score"))


def repeated_strings(lines: DataFrame, file: str, text: str, length: int = 20, more_than: int = 2) -> DataFrame:
    """(file, literal, times): quoted strings of at least ``length`` characters seen more often than ``more_than`` in a file."""
    found = lines.select(file, F.explode(F.regexp_extract_all(text, F.lit(f'"([^"]{{{length},}})"'), F.lit(1))).alias("literal"))
    return found.groupBy(file, "literal").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > more_than)
