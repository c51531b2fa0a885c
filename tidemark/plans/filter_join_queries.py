"""Queries of filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import classify as K
from tidemark.functions import scoring as S
from tidemark.operators import filters as L
from tidemark.operators import joins as J
from tidemark.plans.registry import register, table
from tidemark.plans.score_queries import CPLX, TIER_SQL
from tidemark.plans.stand_ins import EDGES_SQL, FUNCTIONS_SQL, edges, functions

c = F.col


def _tiered(spark, sf_dir):
    tier = K.tier(c("debt_type"), c("score") / 10, c("cyclomatic"), c("cognitive"), c("nesting"), S.complexity_factor(c("cyclomatic")), c("production_callers") + c("callees"), c("role"))
    return functions(spark, sf_dir).withColumn("tier", tier)


TIERED_SQL = f"{FUNCTIONS_SQL}, tiered AS (SELECT *, {TIER_SQL} AS tier FROM fns)"


@register("view_filter", f"WITH {TIERED_SQL} SELECT fn, line, file, tier FROM tiered WHERE score > 0 AND score >= 30 AND tier <> 'T4'")
def view_filter(spark, sf_dir):
    return L.kept(L.with_reason(_tiered(spark, sf_dir), L.view_rules(c("score"), c("tier"), 30.0, True))).select("fn", "line", "file", "tier")


INSERT = "CASE WHEN score < 20 THEN 'score' WHEN debt_type = 'Risk' AND coverage < 0.5 THEN 'risk' WHEN debt_type NOT IN ('TestComplexityHotspot', 'TestTodo', 'TestDuplication', 'GodObject', 'ErrorSwallowing') AND (cyclomatic < 5 OR cognitive < 3) THEN 'complexity' ELSE 'included' END"


@register("filter_reasons", f"""WITH {TIERED_SQL}
SELECT 'view' AS stack, CASE WHEN score <= 0 OR score < 30 THEN 'score' WHEN tier = 'T4' THEN 'tier' ELSE 'included' END AS reason, count(*) AS n FROM tiered GROUP BY ALL
UNION ALL SELECT 'bypass', CASE WHEN tier IN ('T1', 'T2') THEN CASE WHEN score < 30 THEN 'bypass' ELSE 'included' END WHEN tier = 'T4' THEN 'tier' WHEN score < 30 THEN 'score' ELSE 'included' END, count(*) FROM tiered GROUP BY ALL
UNION ALL SELECT 'insert', {INSERT}, count(*) FROM tiered GROUP BY ALL""")
def filter_reasons(spark, sf_dir):
    df = _tiered(spark, sf_dir)
    least = {"score": 20, "risk": 0.5, "cyclomatic": 5, "cognitive": 3}
    stacks = {
        "view": L.with_reason(df, L.view_rules(c("score"), c("tier"), 30.0, True)),
        "bypass": df.withColumn("reason", L.bypass_reason(c("score"), c("tier"), 30.0, False)),
        "insert": L.with_reason(df, L.insert_rules(c("score"), c("debt_type"), c("coverage"), c("cyclomatic"), c("cognitive"), least)),
    }
    out = [L.reason_counts(r).select(F.lit(name).alias("stack"), "reason", "n") for name, r in stacks.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("category_filter", f"""WITH {FUNCTIONS_SQL}, k AS (SELECT CASE WHEN line = 1 THEN 'file' ELSE 'function' END AS kind, score, debt_type FROM fns)
SELECT kind, count(*) AS n, round(sum(CASE WHEN kind = 'function' THEN score ELSE 0 END), 2) AS total FROM k
WHERE kind = 'file' OR debt_type IN ('GodObject', 'TestingGap', 'TestTodo') GROUP BY kind""")
def category_filter(spark, sf_dir):
    df = functions(spark, sf_dir).withColumn("kind", F.when(c("line") == 1, "file").otherwise("function"))
    found = L.by_categories(df, c("kind"), K.category(c("debt_type")), ["Architecture", "Testing"])
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(c("kind") == "function", c("score")).otherwise(0.0)), 2).alias("total"))


@register("metric_filters", f"""WITH {FUNCTIONS_SQL} SELECT
count(*) FILTER (cyclomatic >= 10) AS min_complexity, count(*) FILTER (cyclomatic <= 10) AS max_complexity, count(*) FILTER (role IN ('Debug', 'Unknown')) AS by_language,
count(*) FILTER (length >= 30) AS by_length, count(*) FILTER (NOT is_test) AS not_test, count(*) FILTER (line % 4 >= 2) AS by_priority, count(*) FILTER (debt_type IN ('Todo', 'Risk')) AS by_type,
count(*) FILTER (debt_type = 'Todo' AND line = 3) AS by_type_and_payload, count(*) FILTER (cyclomatic >= 10 AND NOT is_test AND length >= 30) AS composed,
count(*) FILTER (score >= 50 AND coverage >= 0.3 AND coverage < 0.7 AND cyclomatic >= 5) AS displayed,
CAST(sum((cyclomatic > 20)::INT + (cognitive > 20)::INT) AS BIGINT) AS nested_kept FROM fns""")
def metric_filters(spark, sf_dir):
    priority = F.when(c("line") % 4 == 0, "Low").when(c("line") % 4 == 1, "Medium").when(c("line") % 4 == 2, "High").otherwise("Critical")
    rules = {
        "min_complexity": c("cyclomatic") >= 10,
        "max_complexity": c("cyclomatic") <= 10,
        "by_language": c("role").isin("Debug", "Unknown"),
        "by_length": c("length") >= 30,
        "not_test": ~c("is_test"),
        "by_priority": L.at_least_priority(priority, "High"),
        "by_type": c("debt_type").isin("Todo", "Risk"),
        "by_type_and_payload": F.struct("debt_type", "line") == F.struct(F.lit("Todo"), F.lit(3)),
        "composed": L.all_of([c("cyclomatic") >= 10, ~c("is_test"), c("length") >= 30]),
        "displayed": L.display_filter(K.severity_100(c("score")), ["High", "Critical"], c("coverage"), "medium", c("cyclomatic"), 5),
    }
    nested = F.size(F.filter(F.array("cyclomatic", "cognitive"), lambda x: x > 20))
    return functions(spark, sf_dir).agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()), F.sum(nested).alias("nested_kept"))


@register("path_filters", r"""SELECT page_id, regexp_matches(url, '^https://[^/]*[.]org/en/[^/]*$') AS included, NOT regexp_matches(url, '^(.*/)?[^/]*[.]html$') AS not_excluded,
CASE WHEN regexp_matches(url, '.*s.*p.*a.*m.*', 'i') THEN 0 WHEN regexp_matches(html, '.*s.*p.*a.*m.*', 'i') THEN 1 END AS search_rank FROM pages""")
def path_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", L.path_matches(c("url"), ["https://*.org/en/*"]).alias("included"), (~L.path_matches(c("url"), ["**/*.html"])).alias("not_excluded"), L.search_rank("spam", [c("url"), c("html")]).alias("search_rank"))


LINES_SQL = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"


def lines_of(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n"))).select("doc_id", (c("pos") + 1).cast("long").alias("line"), c("col").alias("txt"))


@register("annotations_above", f"""WITH {LINES_SQL}, m AS (SELECT doc_id, line, CASE WHEN regexp_matches(txt, 'icensed?|opyright') THEN line END AS mark FROM lines)
SELECT doc_id, line, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS annotation FROM m""")
def annotations_above(spark, sf_dir):
    mark = F.when(c("txt").rlike("icensed?|opyright"), c("line"))
    return L.nearest_annotation(lines_of(spark, sf_dir), "doc_id", "line", mark).select("doc_id", "line", "annotation")


@register("asof_latest", """WITH t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), d AS (SELECT event_id AS definition, user_id, ts FROM events WHERE event_type = 'signup')
SELECT t.event_id, (SELECT max_by(definition, (d.ts, d.definition)) FROM d WHERE d.user_id = t.user_id AND d.ts <= t.ts) AS definition FROM t""")
def asof_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    targets = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    definitions = events.where("event_type = 'signup'").select(c("event_id").alias("definition"), "user_id", "ts")
    return J.asof(targets, definitions, ["user_id"], "ts", "ts", ["definition"]).select("event_id", "definition")


@register("band_nearest", """WITH t AS (SELECT event_id, user_id FROM events WHERE event_type = 'error'), d AS (SELECT event_id AS found, user_id FROM events WHERE event_type = 'click')
SELECT t.event_id, (SELECT min_by(found, (abs(d.found - t.event_id), d.found)) FROM d WHERE d.user_id = t.user_id AND abs(d.found - t.event_id) <= 200) AS found FROM t""")
def band_nearest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'error'").select("event_id", "user_id")
    right = events.where("event_type = 'click'").select(c("event_id").alias("found"), "user_id")
    return J.nearest_within(left, right, ["user_id"], "event_id", "found", 200, ["event_id"], ["found"]).select("event_id", "found")


@register("lookup_ladder", """WITH q AS (SELECT o_orderkey AS q, o_custkey AS file, o_orderpriority AS name, o_orderkey % 100 AS line, o_custkey % 10 AS module FROM orders WHERE o_orderstatus = 'O'),
d AS (SELECT o_orderkey AS found, o_custkey AS file, o_orderpriority AS name, o_orderkey % 100 AS line, o_custkey % 10 AS module FROM orders WHERE o_orderstatus = 'F'),
s1 AS (SELECT q, min(found) AS f FROM q JOIN d USING (file, name, line) GROUP BY q),
s2 AS (SELECT q, min_by(found, (abs(d.line - q.line), d.line, found)) AS f FROM q JOIN d ON q.file = d.file AND q.name = d.name GROUP BY q),
s3 AS (SELECT q, min_by(found, (abs(d.line - q.line), d.line, found)) AS f FROM q JOIN d ON q.name = d.name AND q.module = d.module GROUP BY q)
SELECT q.q, coalesce(s1.f, s2.f, s3.f) AS found, CASE WHEN s1.f IS NOT NULL THEN 'exact' WHEN s2.f IS NOT NULL THEN 'line' WHEN s3.f IS NOT NULL THEN 'module' END AS step
FROM q LEFT JOIN s1 USING (q) LEFT JOIN s2 USING (q) LEFT JOIN s3 USING (q)""")
def lookup_ladder(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("file"), c("o_orderpriority").alias("name"), (c("o_orderkey") % 100).alias("line"), (c("o_custkey") % 10).alias("module"), "o_orderstatus")
    q = orders.where("o_orderstatus = 'O'").withColumnRenamed("o_orderkey", "q")
    d = orders.where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "definition")
    keys = d.withColumnRenamed("line", "place")
    exact = q.join(d.select("file", "name", "line", "definition"), ["file", "name", "line"]).groupBy("q").agg(F.min("definition").alias("found"))
    by_line = J.nearest(q, keys, ["file", "name"], ["q"], "line", "place", "definition")
    by_module = J.nearest(q, keys, ["name", "module"], ["q"], "line", "place", "definition")
    return J.ladder(q, ["q"], [("exact", exact), ("line", by_line), ("module", by_module)])


@register("suffix_paths", r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path0 FROM pages), pp AS (SELECT rtrim(path0, '/') AS k, path0 AS path FROM p),
q AS (SELECT DISTINCT regexp_extract(rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), '[^/]+/[^/]+$') AS query FROM pages),
h AS (SELECT query, path, CASE WHEN k = query THEN 0 ELSE 1 END AS r FROM q JOIN pp ON k = query OR ends_with(k, '/' || query))
SELECT query, min_by(path, (r, path)) AS path, CASE min(r) WHEN 0 THEN 'exact' ELSE 'query suffix' END AS strategy FROM h GROUP BY query""")
def suffix_paths(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages")
    queries = pages.select(F.regexp_extract(F.rtrim(path, F.lit("/")), "[^/]+/[^/]+$", 0).alias("query")).distinct()
    return J.suffix_match(queries, pages.select(path.alias("path")).distinct())


@register("range_join", """WITH p AS (SELECT user_id AS path, event_id % 1000 AS line, event_type AS author FROM events), r AS (SELECT DISTINCT user_id AS path, user_id % 700 AS first, user_id % 700 + 150 AS last FROM events)
SELECT path, first, last, count(*) AS n, count(DISTINCT author) AS authors FROM p JOIN r USING (path) WHERE line BETWEEN first AND last AND author <> 'view' GROUP BY ALL""")
def range_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.select(c("user_id").alias("path"), (c("event_id") % 1000).alias("line"), c("event_type").alias("author"))
    ranges = events.select(c("user_id").alias("path"), (c("user_id") % 700).alias("first"), (c("user_id") % 700 + 150).alias("last")).distinct()
    return J.in_ranges(points, ranges, ["path"], "line", "first", "last").where("author <> 'view'").groupBy("path", "first", "last").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("authors"))


@register("call_resolution", """WITH k AS (SELECT event_id AS call, user_id AS file, event_type || '_' || (event_id % 40) AS name FROM events WHERE event_id % 2 = 0),
d AS (SELECT event_id AS definition, user_id AS file, event_type || '_' || (event_id % 40) AS name FROM events WHERE event_id % 2 = 1)
SELECT k.call, h.definition FROM k LEFT JOIN (SELECT call, min_by(definition, (k.file <> d.file, definition)) AS definition FROM k JOIN d USING (name) WHERE name NOT IN ('view_1', 'click_2') GROUP BY call) h USING (call)""")
def call_resolution(spark, sf_dir):
    named = table(spark, sf_dir, "events").select("event_id", c("user_id").alias("file"), F.concat_ws("_", "event_type", c("event_id") % 40).alias("name"))
    calls = named.where("event_id % 2 = 0").withColumnRenamed("event_id", "call")
    definitions = named.where("event_id % 2 = 1").withColumnRenamed("event_id", "definition")
    return J.resolve_calls(calls, definitions, ["view_1", "click_2"])


@register("call_neighbours", f"""WITH {EDGES_SQL}, n AS (SELECT a AS id FROM edges UNION SELECT b FROM edges)
SELECT id, coalesce((SELECT string_agg(a::VARCHAR, ',' ORDER BY a) FROM edges WHERE b = id), '') AS callers, coalesce((SELECT string_agg(b::VARCHAR, ',' ORDER BY b) FROM edges WHERE a = id), '') AS callees FROM n""")
def call_neighbours(spark, sf_dir):
    found = J.neighbours(edges(spark, sf_dir))
    return found.select("id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@register("mutual_dependencies", f"WITH {EDGES_SQL} SELECT x.a, x.b FROM edges x JOIN edges y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b")
def mutual_dependencies(spark, sf_dir):
    return J.mutual_pairs(edges(spark, sf_dir))


@register("data_clumps", f"""WITH {FUNCTIONS_SQL}, k AS (SELECT file, fn, line, lead(fn) OVER w AS partner, lead(line) OVER w AS partner_line FROM fns WHERE length > 30 WINDOW w AS (PARTITION BY file ORDER BY fn, line))
SELECT file, fn, line, partner, partner_line FROM k WHERE partner IS NOT NULL""")
def data_clumps(spark, sf_dir):
    return J.data_clumps(functions(spark, sf_dir), ["fn", "line"]).select("file", "fn", "line", c("partner_fn").alias("partner"), "partner_line")



@register("coverage_boundaries", """WITH e AS (SELECT user_id, ts, event_id, value, CASE WHEN event_type = 'signup' THEN event_id END AS start FROM events),
f AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fn FROM e)
SELECT user_id, fn, count(*) AS lines, count(*) FILTER (value > 50) AS hit, round(100.0 * count(*) FILTER (value > 50) / count(*), 4) AS pct FROM f WHERE fn IS NOT NULL GROUP BY ALL""")
def coverage_boundaries(spark, sf_dir):
    from tidemark.operators.windows import segments

    marked = segments(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], c("event_type") == "signup", c("event_id"), "fn").where("fn is not null")
    hit = F.count_if(c("value") > 50)
    return marked.groupBy("user_id", "fn").agg(F.count(F.lit(1)).alias("lines"), hit.alias("hit"), F.round(100 * hit / F.count(F.lit(1)), 4).alias("pct"))
