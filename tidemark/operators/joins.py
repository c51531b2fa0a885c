"""Joins that Spark has no word for, all as equi joins or windows: as-of, band, ladder, suffix and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """``left`` with the columns ``take`` of the right row of its key with the greatest ``right_at`` not above ``left_at``; null if none.

    One union and one window: no row meets more than its own key's rows. Of
    right rows at one place the one with the greatest ``take`` counts.
    """
    packed = F.struct(*take)
    a = left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("__take"))
    b = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), packed.alias("__take"))
    order = Window.partitionBy(*keys).orderBy("__at", "__side", "__take").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__last", F.last("__take", ignorenulls=True).over(order)).where("__side = 1")
    return found.select("__row.*", *(F.col(f"__last.{c}").alias(c) for c in take))


def nearest_within(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, tolerance: int, row: list[str], take: list[str]) -> DataFrame:
    """``left`` with the columns ``take`` of the right row of its key nearest to it within ``tolerance``; the lower place wins a tie.

    Places fall into cells of tolerance + 1, and a left row looks into its own
    and both neighbouring cells, so the band is an equi join. ``row`` tells
    left rows apart.
    """
    width = tolerance + 1
    a = left.withColumn("__cell", F.explode(F.array(*(F.floor(F.col(left_at) / width) + i for i in (-1, 0, 1)))))
    b = right.select(*key, F.col(right_at).alias("__place"), F.floor(F.col(right_at) / width).alias("__cell"), F.struct(*take).alias("__take"))
    gap = F.abs(F.col("__place") - F.col(left_at))
    best = a.join(b, [*key, "__cell"]).where(gap <= tolerance).groupBy(*row).agg(F.min_by("__take", F.struct(gap, "__place", "__take")).alias("__take"))
    return left.join(best, row, "left").select(left["*"], *(F.col(f"__take.{c}").alias(c) for c in take))


def ladder(left: DataFrame, row: list[str], steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows (row..., found, step) of the first step that has an answer.

    ``steps`` are named tables (row..., found), one row at most for each left
    row, from most to least trusted: a later one only counts where no earlier
    one has an answer. Rows without any answer have nulls.
    """
    tagged = None
    for rank, (name, found) in enumerate(steps):
        part = found.where(F.col("found").isNotNull()).select(*row, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("step"), F.col("found")).alias("__hit"))
        tagged = part if tagged is None else tagged.unionByName(part)
    best = tagged.groupBy(*row).agg(F.min_by("__hit", "__hit.rank").alias("__hit"))
    return left.select(*row).join(best, row, "left").select(*row, F.col("__hit.found").alias("found"), F.col("__hit.step").alias("step"))


def nearest(left: DataFrame, right: DataFrame, on: list[str], row: list[str], left_at: str, right_at: str, answer: str) -> DataFrame:
    """(row..., found): of the right rows with equal ``on``, the answer of the one nearest by place; the lowest (place, answer) wins a tie.

    One union of both sides' distinct places and two windows over it, each in
    one pass: every place sees the right one just before and just after it, and
    left rows join their place's answer, so no row meets all of its key's rows.
    """
    packed = F.struct(F.col("__at").alias("place"), F.col("__answer").alias("answer"))
    b = right.select(*on, F.col(right_at).alias("__at"), F.col(answer).alias("__answer")).groupBy(*on, "__at").agg(F.min("__answer").alias("__answer"))
    asked = left.select(*on, F.col(left_at).alias("__at"), *(F.col(r).alias(f"__row_{r}") for r in row))
    a = asked.select(*on, "__at").distinct().select(*on, "__at", F.lit(1).alias("__side"), F.lit(None).cast(b.select(packed).schema[0].dataType).alias("__hit"))
    marks = a.unionByName(b.select(*on, "__at", F.lit(0).alias("__side"), packed.alias("__hit")))

    def last_hit(*order: Column) -> Column:
        return F.last("__hit", ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    seen = marks.withColumn("__before", last_hit(F.col("__at"), F.col("__side"))).withColumn("__after", last_hit(F.col("__at").desc(), F.col("__side").desc())).where("__side = 1")
    closer = F.col("__before").isNotNull() & (F.col("__after").isNull() | (F.col("__at") - F.col("__before.place") <= F.col("__after.place") - F.col("__at")))
    found = seen.select(*on, "__at", F.when(closer, F.col("__before.answer")).otherwise(F.col("__after.answer")).alias("found")).where("found is not null")
    return asked.join(found, [*on, "__at"]).select(*(F.col(f"__row_{r}").alias(r) for r in row), "found")


def path_components(path: Column) -> Column:
    """A path's parts, either separator, without empty parts and dots."""
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))


def _suffixes(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "/"))


def suffix_match(queries: DataFrame, paths: DataFrame, suffix_first: bool = False) -> DataFrame:
    """(query, path, strategy) for the paths that the queries name; rows without a match are left out.

    Strategies: the same parts ("exact"), the query ends the path ("query
    suffix"), the path ends the query ("path suffix"); with ``suffix_first``
    the exact one comes last. Within a strategy the first path in order wins.
    Every suffix is a row, so that each strategy is an equi join.
    """
    q = queries.select("query", path_components(F.col("query")).alias("q")).where(F.size("q") > 0)
    p = paths.select("path", path_components(F.col("path")).alias("p")).where(F.size("p") > 0)
    whole_q, whole_p = q.select("query", F.array_join("q", "/").alias("k")), p.select("path", F.array_join("p", "/").alias("k"))
    ends_p, ends_q = p.select("path", F.explode(_suffixes(F.col("p"))).alias("k")), q.select("query", F.explode(_suffixes(F.col("q"))).alias("k"))
    found = [("exact", whole_q.join(whole_p, "k")), ("query suffix", whole_q.join(ends_p, "k")), ("path suffix", ends_q.join(whole_p, "k"))]
    if suffix_first:
        found = [*found[1:], found[0]]
    ranked = None
    for rank, (name, pairs) in enumerate(found):
        part = pairs.select("query", F.struct(F.lit(rank).alias("rank"), "path", F.lit(name).alias("strategy")).alias("hit"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.groupBy("query").agg(F.min("hit").alias("hit")).select("query", "hit.path", "hit.strategy")


def in_ranges(points: DataFrame, ranges: DataFrame, key: list[str], at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Points joined with the ranges [start, end] of their key that hold them; ranges are cut into cells, so this is an equi join."""
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, [*key, "__cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__cell")


def resolve_calls(calls: DataFrame, definitions: DataFrame, stop_names: list[str]) -> DataFrame:
    """(call, definition): each call's definition by name, its own file's first, then the lowest key; calls of stop names and unknown names have none.

    Definitions are reduced to the lowest of each name and file and of each
    name before calls meet them, so a call has two matches at most.
    """
    known = definitions.where(~F.col("name").isin(*stop_names))
    own = known.groupBy("name", "file").agg(F.min("definition").alias("own"))
    any_file = known.groupBy("name").agg(F.min("definition").alias("any"))
    return calls.join(own, ["name", "file"], "left").join(any_file, "name", "left").select("call", F.coalesce("own", "any").alias("definition"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, callers, callees): sorted distinct lists for every end of the edges (a calls b)."""
    out = edges.groupBy(F.col("a").alias("id")).agg(F.sort_array(F.collect_set("b")).alias("callees"))
    back = edges.groupBy(F.col("b").alias("id")).agg(F.sort_array(F.collect_set("a")).alias("callers"))
    none = F.array().cast("array<bigint>")
    return out.join(back, "id", "full").select("id", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def mutual_pairs(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, that depend on each other."""
    return edges.where("a < b").join(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi").distinct()


def data_clumps(functions: DataFrame, order: list[str], least: int = 30) -> DataFrame:
    """(file, order..., partner_<order>...): of the functions of one file that are longer than ``least``, each but the last with the next one."""
    following = Window.partitionBy("file").orderBy(*order)
    paired = functions.where(F.col("length") > least).select("file", *order, *(F.lead(x).over(following).alias(f"partner_{x}") for x in order))
    return paired.where(F.col(f"partner_{order[0]}").isNotNull())
