"""Queries of aggregations and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import classify as K
from tidemark.functions import scoring as S
from tidemark.operators import aggregates as A
from tidemark.operators import windows as W
from tidemark.plans.filter_join_queries import LINES_SQL, TIERED_SQL, _tiered, lines_of
from tidemark.plans.registry import register, table
from tidemark.plans.score_queries import _case
from tidemark.plans.stand_ins import EDGES_SQL, FUNCTIONS_SQL, ITEMS_SQL, edges, functions, items

c = F.col


@register("view_summary", f"""WITH {TIERED_SQL} SELECT count(*) AS items, round(sum(score), 2) AS total, count(*) FILTER (score >= 70) AS critical, count(*) FILTER (score >= 50 AND score < 70) AS high,
count(*) FILTER (score >= 30 AND score < 50) AS medium, count(*) FILTER (score < 30) AS low, count(*) FILTER ({_case('debt_type', K.CATEGORY, 'CodeQuality')} = 'Architecture') AS architecture,
count(*) FILTER (tier = 'T1') AS t1, round(sum(score) / sum(length) * 1000, 4) AS density FROM tiered""")
def view_summary(spark, sf_dir):
    severity = K.severity_100(c("score"))
    return _tiered(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("items"), F.round(F.sum("score"), 2).alias("total"),
        *(F.count_if(severity == s).alias(s.lower()) for s in ("Critical", "High", "Medium", "Low")),
        F.count_if(K.category(c("debt_type")) == "Architecture").alias("architecture"), F.count_if(c("tier") == "T1").alias("t1"),
        F.round(A.density(F.sum("score"), F.sum("length")), 4).alias("density"),
    )


@register("location_groups", f"""WITH {FUNCTIONS_SQL} SELECT file, line, round(sum(score), 4) AS total, CAST(max(CASE WHEN score >= 70 THEN 3 WHEN score >= 50 THEN 2 WHEN score >= 30 THEN 1 ELSE 0 END) AS INT) AS worst, count(*) AS n,
max(cognitive) AS cognitive, max(nesting) AS nesting, max(length) AS length, min_by(coverage, (fn, score)) AS first_coverage FROM fns GROUP BY file, line""")
def location_groups(spark, sf_dir):
    df = functions(spark, sf_dir)
    groups = A.location_groups(df, "score", K.severity_rank(K.severity_100(c("score"))), ["file", "line"])
    extra = df.groupBy("file", "line").agg(F.max("cognitive").alias("cognitive"), F.max("nesting").alias("nesting"), F.max("length").alias("length"), F.min_by("coverage", F.struct("fn", "score")).alias("first_coverage"))
    return groups.join(extra, ["file", "line"]).withColumn("total", F.round("total", 4))


CATEGORY_SQL = _case("debt_type", K.CATEGORY, "CodeQuality")


@register("category_summary", f"""WITH {FUNCTIONS_SQL}, k AS (SELECT *, {CATEGORY_SQL} AS category FROM fns), g AS (SELECT category, sum(score) AS total, count(*) AS n, avg(score) AS mean FROM k GROUP BY category)
SELECT category, round(total, 2) AS total, n, round(mean, 4) AS mean, CAST(n * (CASE category WHEN 'Architecture' THEN CASE WHEN mean >= 90 THEN 16 WHEN mean >= 70 THEN 8 ELSE 4 END WHEN 'Performance' THEN CASE WHEN mean >= 70 THEN 8 ELSE 4 END ELSE CASE WHEN mean >= 70 THEN 4 ELSE 2 END END) AS BIGINT) AS hours FROM g""")
def category_summary(spark, sf_dir):
    groups = functions(spark, sf_dir).groupBy(K.category(c("debt_type")).alias("category")).agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"))
    return groups.select("category", F.round("total", 2).alias("total"), "n", F.round("mean", 4).alias("mean"), (c("n") * S.effort_hours(c("category"), c("mean"))).cast("long").alias("hours"))


@register("category_top", f"""WITH {FUNCTIONS_SQL}, k AS (SELECT *, {CATEGORY_SQL} AS category FROM fns), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, fn, line, file) AS place FROM k)
SELECT category, CAST(place AS INT) AS place, fn, line FROM r WHERE place <= 5""")
def category_top(spark, sf_dir):
    df = functions(spark, sf_dir).withColumn("category", K.category(c("debt_type")))
    return A.top_in_group(df, ["category"], [c("score").desc(), c("fn"), c("line"), c("file")], 5).select("category", "place", "fn", "line")


@register("tiered_display", f"WITH {TIERED_SQL} SELECT tier, debt_type, count(*) AS n, round(sum(score), 2) AS total, round(max(score), 6) AS best FROM tiered GROUP BY tier, debt_type")
def tiered_display(spark, sf_dir):
    return _tiered(spark, sf_dir).groupBy("tier", "debt_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("total"), F.round(F.max("score"), 6).alias("best"))


AGG_CATEGORY = _case("debt_type", K.AGGREGATION_CATEGORY, "Organization")


@register("debt_aggregation", f"""WITH {FUNCTIONS_SQL}, k AS (SELECT {AGG_CATEGORY} AS category, debt_type, line, CASE line % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 ELSE 3.0 END AS points, CASE line % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 10 END AS w FROM fns)
SELECT category, count(*) AS n, round(sum(points) / count(*) * {_case('category', A.CATEGORY_SEVERITY, 1.0)} * sqrt(count(*)), 4) AS category_score, CAST(sum(w * {_case('debt_type', S.TYPE_WEIGHT, 3)}) AS BIGINT) AS debt_score FROM k GROUP BY category""")
def debt_aggregation(spark, sf_dir):
    priority = F.when(c("line") % 4 == 0, "Low").when(c("line") % 4 == 1, "Medium").when(c("line") % 4 == 2, "High").otherwise("Critical")
    df = functions(spark, sf_dir).select(K.aggregation_category(c("debt_type")).alias("category"), S.lookup(priority, A.PRIORITY_POINTS, 0.0).alias("points"), S.debt_score(priority, c("debt_type")).alias("debt"))
    groups = df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("points").alias("points"), F.sum("debt").alias("debt_score"))
    return groups.select("category", "n", F.round(A.category_score(c("n"), c("points"), S.lookup(c("category"), A.CATEGORY_SEVERITY, 1.0)), 4).alias("category_score"), "debt_score")


@register("impact_totals", f"""WITH {FUNCTIONS_SQL}, files AS (SELECT file, max(length) AS lines FROM fns GROUP BY file)
SELECT round(sum(score), 2) AS total, count(*) FILTER (1 - coverage > 0) AS to_test, round(sum(CASE WHEN 1 - coverage > 0 THEN (1 - coverage) / 100 ELSE 0 END), 4) AS coverage_gain, CAST(sum(line) AS BIGINT) AS lines_saved,
(SELECT CAST(sum(lines) AS BIGINT) FROM files) AS total_lines, round(sum(score) / (SELECT sum(lines) FROM files) * 1000, 4) AS density FROM fns""")
def impact_totals(spark, sf_dir):
    df = functions(spark, sf_dir)
    lines = df.groupBy("file").agg(F.max("length").alias("lines")).agg(F.sum("lines").alias("total_lines"))
    gain = 1 - c("coverage")
    sums = df.agg(F.sum("score").alias("t"), F.count_if(gain > 0).alias("to_test"), F.round(F.sum(F.when(gain > 0, gain / 100).otherwise(0.0)), 4).alias("coverage_gain"), F.sum("line").alias("lines_saved"))
    return sums.crossJoin(F.broadcast(lines)).select(F.round("t", 2).alias("total"), "to_test", "coverage_gain", "lines_saved", "total_lines", F.round(A.density(c("t"), c("total_lines")), 4).alias("density"))


@register("file_aggregates", f"""WITH {FUNCTIONS_SQL}, g AS (SELECT file, count(*) AS functions, CAST(sum(cyclomatic) AS BIGINT) AS total, avg(cyclomatic) AS mean, max(cyclomatic) AS highest, CAST(sum(cognitive) AS BIGINT) AS cognitive, max(nesting) AS nesting, CAST(floor(median(cyclomatic)) AS BIGINT) AS median,
 count(*) FILTER (cyclomatic > 15) AS exceeding, count(*) FILTER (length > 50) AS long_functions, sum(coverage * length) / sum(length) AS coverage, count(DISTINCT line) AS lines, avg(score) AS risk, CAST(sum(length) AS BIGINT) AS length, sum(score) AS scores FROM fns GROUP BY file)
SELECT file, functions, total, round(mean, 4) AS mean, highest, cognitive, nesting, median, exceeding, long_functions, round(coverage, 6) AS coverage, lines, round(risk, 4) AS risk,
CASE WHEN highest * 1.0 / total > 0.5 THEN 'Concentrated' WHEN highest * 1.0 / total > 0.2 THEN 'Mixed' ELSE 'Distributed' END AS spread,
round(sqrt(length / 100.0) * least(mean / 5, 3) * sqrt(total / 50.0) * (1 + 2 * (1 - coverage)) * (CASE WHEN functions > 50 THEN 1 + (functions - 50) * 0.02 ELSE 1 END) * greatest(scores / 10, 1), 3) AS file_score FROM g""")
def file_aggregates(spark, sf_dir):
    g = functions(spark, sf_dir).groupBy("file").agg(
        F.count(F.lit(1)).alias("functions"), F.sum("cyclomatic").alias("total"), F.avg("cyclomatic").alias("mean"), F.max("cyclomatic").alias("highest"), F.sum("cognitive").alias("cognitive"), F.max("nesting").alias("nesting"),
        A.integer_median("cyclomatic").alias("median"), F.count_if(c("cyclomatic") > 15).alias("exceeding"), F.count_if(c("length") > 50).alias("long_functions"), A.weighted_mean(c("coverage"), c("length")).alias("coverage"),
        F.countDistinct("line").alias("lines"), F.avg("score").alias("risk"), F.sum("length").alias("length"), F.sum("score").alias("scores"))
    factors = S.file_score_factors(c("length"), c("mean"), c("total"), c("coverage"), c("functions"), F.lit(1.0), c("scores"))
    return g.select("file", "functions", "total", F.round("mean", 4).alias("mean"), "highest", "cognitive", "nesting", "median", "exceeding", "long_functions", F.round("coverage", 6).alias("coverage"), "lines", F.round("risk", 4).alias("risk"), K.distribution(c("highest"), c("total")).alias("spread"), F.round(S.file_score(factors), 3).alias("file_score"))


@register("project_statistics", f"""WITH {FUNCTIONS_SQL}, m AS (SELECT max(cyclomatic) AS m FROM fns) SELECT round(avg(cyclomatic), 4) AS mean, max(cyclomatic) AS highest, count(*) FILTER (cyclomatic > 40) AS high, round(sum(score) / (50.0 * count(*)) * 100, 4) AS codebase_risk,
round(covar_pop(cyclomatic, coverage) / (stddev_pop(cyclomatic) * stddev_pop(coverage)), 6) AS correlation, round(greatest((SELECT m FROM m) * 1.2, 10), 4) AS maximum, round(avg(least(cyclomatic / greatest((SELECT m FROM m) * 1.2, 10), 1) * 100), 4) AS mean_percent, count(*) FILTER (cyclomatic >= 10 OR cognitive >= 15) AS is_complex FROM fns""")
def project_statistics(spark, sf_dir):
    df = functions(spark, sf_dir)
    top = df.agg(S.complexity_maximum(F.max("cyclomatic")).alias("maximum"))
    out = df.crossJoin(F.broadcast(top)).agg(F.round(F.avg("cyclomatic"), 4).alias("mean"), F.max("cyclomatic").alias("highest"), F.count_if(c("cyclomatic") > 40).alias("high"), F.round(F.sum("score") / (50.0 * F.count(F.lit(1))) * 100, 4).alias("codebase_risk"), F.round(A.pearson("cyclomatic", "coverage"), 6).alias("correlation"), F.round(F.max("maximum"), 4).alias("maximum"), F.round(F.avg(S.percent_of_maximum(c("cyclomatic"), c("maximum"))), 4).alias("mean_percent"), F.count_if((c("cyclomatic") >= 10) | (c("cognitive") >= 15)).alias("is_complex"))
    return out


@register("risk_distribution", f"""WITH {FUNCTIONS_SQL} SELECT CASE WHEN score / 10 >= 8 THEN 'Critical' WHEN score / 10 >= 6 THEN 'High' WHEN score / 10 >= 4 THEN 'Medium' ELSE 'Low' END AS risk, count(*) AS n,
round(avg(CASE WHEN score <= 10 THEN 1 WHEN score <= 50 THEN 1 + (score - 10) / 40 * 2 WHEN score <= 90 THEN 3 + (score - 50) / 40 * 7 ELSE 10 END), 4) AS interpolated FROM fns GROUP BY ALL""")
def risk_distribution(spark, sf_dir):
    at = A.piecewise_percentile([(10.0, 1.0), (50.0, 3.0), (90.0, 10.0)], c("score"))
    return functions(spark, sf_dir).groupBy(K.severity_10(c("score") / 10).alias("risk")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(at), 4).alias("interpolated"))


HISTORY_SQL = """h AS (SELECT user_id AS path, count(*) AS commits, count(*) FILTER (event_type = 'error') AS fixes, count(DISTINCT event_type) AS authors, sum(value) AS churn, min(ts) AS first FROM events GROUP BY user_id),
a AS (SELECT *, CAST(floor((epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(first))) / 86400) AS BIGINT) AS age_days FROM h)"""


@register("file_history", f"""WITH {HISTORY_SQL}, f AS (SELECT *, CASE WHEN age_days > 0 THEN commits * 1.0 / age_days * 30 ELSE 0 END AS frequency, fixes * 1.0 / commits AS bug_density FROM a)
SELECT path, commits, fixes, authors, round(churn, 4) AS churn, age_days, round(frequency, 6) AS frequency, round(bug_density, 6) AS bug_density,
round(least((CASE WHEN age_days > 0 THEN 1 / (1 + frequency) ELSE 0.5 END) * 0.4 + (1 - least(bug_density, 1)) * 0.4 + least(age_days / 365.0, 1) * 0.2, 1), 6) AS stability,
CASE WHEN frequency > 5 AND bug_density > 0.3 THEN 'HighlyUnstable' WHEN frequency > 2 THEN 'FrequentlyChanged' WHEN bug_density > 0.2 THEN 'BugProne' WHEN age_days > 365 THEN 'MatureStable' ELSE 'RelativelyStable' END AS status,
round(least(bug_density * 1.5 + least(frequency / 20, 0.5), 2), 6) AS contribution FROM f""")
def file_history(spark, sf_dir):
    history = A.file_history(table(spark, sf_dir, "events").withColumnRenamed("user_id", "path"), "path", "ts", "event_type", "value", c("event_type") == "error", F.lit("2024-01-31 00:00:00").cast("timestamp"))
    status = K.stability_status(c("frequency"), c("bug_density"), c("age_days"))
    return history.select("path", "commits", "fixes", "authors", F.round("churn", 4).alias("churn"), "age_days", F.round("frequency", 6).alias("frequency"), F.round("bug_density", 6).alias("bug_density"), F.round("stability", 6).alias("stability"), status.alias("status"), F.round(S.risk_contribution(c("frequency"), c("bug_density")), 6).alias("contribution"))


@register("module_coupling", f"""WITH {EDGES_SQL}, o AS (SELECT a AS module, count(*) AS efferent FROM edges GROUP BY a), i AS (SELECT b AS module, count(*) AS afferent FROM edges GROUP BY b)
SELECT module, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent, round(coalesce(efferent, 0) * 1.0 / (coalesce(afferent, 0) + coalesce(efferent, 0)), 6) AS instability,
coalesce(efferent, 0) * 1.0 / (coalesce(afferent, 0) + coalesce(efferent, 0)) > 0.8 AND coalesce(afferent, 0) > 2 AS unstable_depended_on, coalesce(afferent, 0) + coalesce(efferent, 0) > 5 AS high_coupling FROM o FULL JOIN i USING (module)""")
def module_coupling(spark, sf_dir):
    found = A.module_coupling(edges(spark, sf_dir))
    return found.select("module", "afferent", "efferent", F.round("instability", 6).alias("instability"), ((c("instability") > 0.8) & (c("afferent") > 2)).alias("unstable_depended_on"), (c("afferent") + c("efferent") > 5).alias("high_coupling"))


@register("token_statistics", """WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[^\\s]+')) AS tok FROM conversations WHERE text IS NOT NULL), n AS (SELECT conv_id, tok, count(*) AS k FROM t GROUP BY ALL), s AS (SELECT conv_id, CAST(sum(k) AS BIGINT) AS n, count(*) AS d FROM n GROUP BY conv_id),
e AS (SELECT conv_id, -sum(k * 1.0 / s.n * log2(k * 1.0 / s.n)) AS h FROM n JOIN s USING (conv_id) GROUP BY conv_id)
SELECT conv_id, n, d AS distinct_tokens, round(d * 1.0 / n, 6) AS diversity, round(CASE WHEN d > 1 THEN h / log2(n) ELSE 0 END, 6) AS entropy FROM s JOIN e USING (conv_id)""".replace("[^\\\\s]", "[^\\s]"))
def token_statistics(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[^\s]+"), F.lit(0))).alias("tok"))
    return A.token_statistics(tokens, "conv_id", "tok").select("conv_id", "n", c("distinct").alias("distinct_tokens"), F.round("diversity", 6).alias("diversity"), F.round("entropy", 6).alias("entropy"))


@register("category_entropy", """WITH w AS (SELECT user_id, event_type, count(*) * (CASE event_type WHEN 'error' THEN 2.0 ELSE 1.0 END) AS w FROM events GROUP BY user_id, event_type), s AS (SELECT user_id, sum(w) AS n, count(*) AS k FROM w GROUP BY user_id)
SELECT user_id, round(CASE WHEN any_value(k) > 1 THEN -sum(w / n * log2(w / n)) / log2(any_value(k)) ELSE 0 END, 6) AS entropy FROM w JOIN s USING (user_id) GROUP BY user_id""")
def category_entropy(spark, sf_dir):
    found = A.category_entropy(table(spark, sf_dir, "events"), "user_id", c("event_type"), F.when(c("event_type") == "error", 2.0).otherwise(1.0))
    return found.select("user_id", F.round("entropy", 6).alias("entropy"))


@register("repetition", """WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS k FROM events), n AS (SELECT user_id, count(*) AS n FROM t GROUP BY user_id),
g AS (SELECT user_id, s, string_agg(k, ' ' ORDER BY i) AS pattern, start FROM (SELECT b.user_id, s.s, a.i AS start, b.i, b.k FROM t a JOIN (SELECT unnest([2, 3, 4, 5]) AS s) s ON true JOIN t b ON a.user_id = b.user_id AND b.i BETWEEN a.i AND a.i + s.s - 1) GROUP BY user_id, s, start HAVING count(*) = s),
r AS (SELECT user_id, s, pattern, count(*) AS times FROM g GROUP BY ALL HAVING count(*) > 1), p AS (SELECT user_id, s, sum(times - 1) * s AS covered, count(*) FILTER (times > 2) AS frequent FROM r GROUP BY user_id, s)
SELECT n.user_id, round(least(coalesce(max(covered * 1.0 / n), 0) + least(coalesce(sum(frequent), 0) / 10.0, 0.2), 1), 6) AS repetition FROM n LEFT JOIN p ON n.user_id = p.user_id AND 2 * s <= n GROUP BY n.user_id""")
def repetition(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return A.repetition_score(events, "user_id", "at", "event_type").select("user_id", F.round("repetition", 6).alias("repetition"))


CHUNK_SQL = "array_to_string([trim(x) FOR x IN [a, b, d] IF trim(x) <> '' AND NOT starts_with(trim(x), '//') AND NOT starts_with(trim(x), '#')], chr(10))"


@register("duplicate_windows", f"""WITH {LINES_SQL}, w AS (SELECT doc_id, line, txt AS a, lead(txt, 1) OVER o AS b, lead(txt, 2) OVER o AS d FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
k AS (SELECT doc_id, line, md5({CHUNK_SQL}) AS digest FROM w WHERE d IS NOT NULL) SELECT digest, doc_id, line FROM k WHERE digest IN (SELECT digest FROM k GROUP BY digest HAVING count(*) > 1)""")
def duplicate_windows(spark, sf_dir):
    return W.duplicate_windows(lines_of(spark, sf_dir), "doc_id", "line", "txt", 3)


@register("merged_blocks", """WITH r AS (SELECT DISTINCT user_id, event_id // 10 * 3 + event_id % 3 AS line FROM events WHERE event_type = 'click'), i AS (SELECT user_id, line, line % 3 AS rest, line // 3 - row_number() OVER (PARTITION BY user_id, line % 3 ORDER BY line) AS island FROM r)
SELECT user_id, min(line) AS first, max(line) + 2 AS last FROM i GROUP BY user_id, rest, island""")
def merged_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", F.expr("event_id div 10 * 3 + event_id % 3").alias("line"))
    return W.merged_blocks(rows, "user_id", "line", 3)


@register("compressed_ranges", """WITH r AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS v FROM lineitem), i AS (SELECT k, v, v - row_number() OVER (PARTITION BY k ORDER BY v) AS island FROM r), s AS (SELECT k, min(v) AS f, max(v) AS t FROM i GROUP BY k, island)
SELECT k, string_agg(CASE WHEN f = t THEN f::VARCHAR ELSE f || '-' || t END, ', ' ORDER BY f) AS ranges FROM s GROUP BY k""")
def compressed_ranges(spark, sf_dir):
    return W.compressed_ranges(table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("v")), "k", "v")


@register("snapshot_trend", f"WITH {ITEMS_SQL} SELECT file, CASE WHEN count(*) > 1 THEN round(max_by(score, (is_before, item)) - min_by(score, (is_before, item)), 6) END AS change FROM items GROUP BY file")
def snapshot_trend(spark, sf_dir):
    return W.trend(items(spark, sf_dir), "file", ["is_before", "item"], "score").select("file", F.round("change", 6).alias("change"))


@register("god_transitions", f"""WITH {ITEMS_SQL}, t AS (SELECT file, item, score > 30 AS god, lag(score > 30) OVER (PARTITION BY file ORDER BY item) AS before FROM items)
SELECT file, item, CASE WHEN god THEN 'new' ELSE 'resolved' END AS transition FROM t WHERE god <> before""")
def god_transitions(spark, sf_dir):
    return W.transitions(items(spark, sf_dir), "file", ["item"], c("score") > 30).select("file", "item", "transition")


@register("merged_coverage", """WITH r AS (SELECT l_partkey AS fn, l_tax * 1000 AS pct, [l_linenumber, CAST(l_quantity % 7 AS INT), 3] AS lines FROM lineitem), n AS (SELECT fn, count(*) AS n, avg(pct) AS percent FROM r GROUP BY fn),
u AS (SELECT fn, line, count(*) AS hits FROM (SELECT fn, unnest(list_distinct(lines)) AS line FROM r) GROUP BY fn, line) SELECT fn, round(any_value(percent), 6) AS percent, coalesce(string_agg(CASE WHEN hits = n THEN line::VARCHAR END, ',' ORDER BY line), '') AS uncovered FROM n LEFT JOIN u USING (fn) GROUP BY fn""")
def merged_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("fn"), (c("l_tax") * 1000).alias("pct"), F.array("l_linenumber", (c("l_quantity") % 7).cast("int"), F.lit(3)).alias("lines"))
    return A.merged_coverage(rows, ["fn"], "pct", "lines").select("fn", F.round("percent", 6).alias("percent"), F.array_join("uncovered", ",").alias("uncovered"))


@register("silhouette", f"""WITH {FUNCTIONS_SQL} SELECT role, round(avg(CASE WHEN greatest(1 - coverage, cyclomatic / 50.0) = 0 THEN 0 ELSE (cyclomatic / 50.0 - (1 - coverage)) / greatest(1 - coverage, cyclomatic / 50.0) END), 6) AS silhouette FROM fns GROUP BY role""")
def silhouette(spark, sf_dir):
    return functions(spark, sf_dir).groupBy("role").agg(F.round(A.silhouette(c("coverage"), c("cyclomatic") / 50), 6).alias("silhouette"))


@register("file_cohesion", f"""WITH {EDGES_SQL}, n AS (SELECT a AS id, a % 12 AS file FROM edges UNION SELECT b, b % 12 FROM edges), s AS (SELECT file FROM n GROUP BY file HAVING count(*) >= 3), k AS (SELECT a % 12 AS file, count(*) FILTER (a % 12 = b % 12) AS internal, count(*) FILTER (a % 12 <> b % 12) AS external FROM edges GROUP BY 1)
SELECT file, coalesce(internal, 0) AS internal, coalesce(external, 0) AS external, round(CASE WHEN coalesce(internal + external, 0) = 0 THEN 1 ELSE internal * 1.0 / (internal + external) END, 6) AS score FROM s LEFT JOIN k USING (file)""")
def file_cohesion(spark, sf_dir):
    calls = edges(spark, sf_dir)
    nodes = calls.select(c("a").alias("id")).union(calls.select("b")).distinct().withColumn("file", c("id") % 12)
    return A.cohesion(calls, nodes, 3).select("file", "internal", "external", F.round("score", 6).alias("score"))


@register("repeated_strings", """WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"]{20,})"', 1)) AS literal FROM documents) SELECT doc_id, literal, count(*) AS times FROM l GROUP BY ALL""")
def repeated_strings(spark, sf_dir):
    return A.repeated_strings(table(spark, sf_dir, "documents"), "doc_id", "text", more_than=0)
