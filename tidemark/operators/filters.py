"""Filter stacks. They differ in their rules on purpose, so each has its own name."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scoring import lookup

# Fixed values.
COMPLEXITY_EXEMPT = ("TestComplexityHotspot", "TestTodo", "TestDuplication", "GodObject", "ErrorSwallowing")
PRIORITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}


def with_reason(df: DataFrame, rules: list[tuple[str, Column]], to: str = "reason") -> DataFrame:
    """``df`` with the name of the first rule that rejects a row; null where none does. A rule that is null rejects."""
    reason = None
    for name, keeps in rules:
        rejected = ~F.coalesce(keeps, F.lit(False))
        reason = F.when(rejected, name) if reason is None else reason.when(rejected, name)
    return df.withColumn(to, reason if reason is not None else F.lit(None).cast("string"))


def kept(reasoned: DataFrame, reason: str = "reason") -> DataFrame:
    return reasoned.where(F.col(reason).isNull()).drop(reason)


def reason_counts(reasoned: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n); kept rows count as included."""
    return reasoned.groupBy(F.coalesce(reason, F.lit("included")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def view_rules(score: Column, tier: Column, threshold: float, hide_t4: bool) -> list[tuple[str, Column]]:
    """The view's filter: scores of 0 or below never pass; then tier 4, if it is hidden."""
    return [("score", (score > 0) & (score >= threshold)), ("tier", (tier != "T4") if hide_t4 else F.lit(True))]


def bypass_reason(score: Column, tier: Column, threshold: float, show_t4: bool) -> Column:
    """The item list's filter: tiers 1 and 2 pass whatever their score (those below it are counted as bypass)."""
    critical = tier.isin("T1", "T2")
    return F.when(critical, F.when(score < threshold, "bypass")).when((tier == "T4") & F.lit(not show_t4), "tier").when(score < threshold, "score")


def insert_rules(score: Column, debt_type: Column, risk: Column, cyclomatic: Column, cognitive: Column, least: dict) -> list[tuple[str, Column]]:
    """The filter at insertion: score, then risk (risk items only), then both complexities unless the type is exempt."""
    enough = (cyclomatic >= least["cyclomatic"]) & (cognitive >= least["cognitive"])
    return [("score", score >= least["score"]), ("risk", (debt_type != "Risk") | (risk >= least["risk"])), ("complexity", debt_type.isin(*COMPLEXITY_EXEMPT) | enough)]


def by_categories(df: DataFrame, kind: Column, category: Column, wanted: list[str]) -> DataFrame:
    """Items of the wanted categories; every file item counts as Architecture."""
    return df.where(F.when(kind == "file", F.lit("Architecture" in wanted)).otherwise(category.isin(*wanted)))


def glob_to_regex(pattern: str) -> str:
    """A glob as a regular expression for whole paths: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or ("\\" + c if c in r"\.+()|^$[]{}" else c)
            i += 1
    return f"^{out}$"


def path_matches(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(glob_to_regex(p)) for p in patterns), F.lit(False))


def all_of(predicates: list[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def at_least_priority(priority: Column, least: str) -> Column:
    return lookup(priority, PRIORITY_RANK, -1) >= PRIORITY_RANK[least]


def display_filter(severity: Column | None = None, severities: list[str] = (), coverage: Column | None = None, band: str | None = None, complexity: Column | None = None, least: int | None = None) -> Column:
    """AND of the filters that are set: severities, a coverage band (none, low below 30 %, medium below 70 %, high) and least complexity."""
    bands = {"none": F.lit(None), "low": None, "medium": None, "high": None}
    out = [severity.isin(*severities)] if severities else []
    if band:
        assert band in bands
        out.append({"none": coverage.isNull(), "low": coverage < 0.3, "medium": (coverage >= 0.3) & (coverage < 0.7), "high": coverage >= 0.7}[band])
    if least is not None:
        out.append(complexity >= least)
    return all_of(out)


def search_rank(query: str, fields: list[Column]) -> Column:
    """The first field, in order, that holds the query's letters in order (case ignored); null if none does."""
    pattern = "(?i)" + ".*".join("\\" + c if not c.isalnum() else c for c in query)
    return F.coalesce(*(F.when(f.rlike(pattern), i) for i, f in enumerate(fields)))


def nearest_annotation(lines: DataFrame, file: str, line: str, annotation: Column, reach: int = 5, to: str = "annotation") -> DataFrame:
    """``lines`` with the nearest annotation on one of the ``reach`` lines above; one row for each line of a file, gaps allowed."""
    above = Window.partitionBy(file).orderBy(line).rangeBetween(-reach, -1)
    return lines.withColumn(to, F.last(annotation, ignorenulls=True).over(above))


def suppressed(lines: DataFrame, file: str, line: str, text: Column, kind: str, to: str = "suppressed") -> DataFrame:
    """``lines`` marked where a directive covers them: a block from start to end, the directive's own line, or the line after "next-line".

    Directives are "<kind>:ignore", "<kind>:ignore-next-line", "<kind>:ignore-start" and "<kind>:ignore-end".
    """
    order = Window.partitionBy(file).orderBy(line)
    starts, ends = text.rlike(f"{kind}:ignore-start"), text.rlike(f"{kind}:ignore-end")
    depth = F.sum(F.when(starts, 1).when(ends, -1).otherwise(0)).over(order)
    following = F.lag(text.rlike(f"{kind}:ignore-next-line"), 1, False).over(order)
    return lines.withColumn(to, (depth > 0) | ends | following | text.rlike(f"{kind}:ignore(?![-\\w])"))
