"""Queries of sorts, sets, comparisons and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import classify as K
from tidemark.functions import text as X
from tidemark.operators import compare as C
from tidemark.operators import filters as L
from tidemark.operators import joins as J
from tidemark.operators import relational as R
from tidemark.plans.filter_join_queries import INSERT, LINES_SQL, TIERED_SQL, _tiered, lines_of
from tidemark.plans.registry import register, table
from tidemark.plans.stand_ins import FUNCTIONS_SQL, ITEMS_SQL, functions, items

c = F.col
KEYS = ["fn", "line", "file"]


@register("ranked_view", f"""WITH {TIERED_SQL}, kept AS (SELECT * FROM tiered WHERE score > 0 AND score >= 30 AND tier <> 'T4' ORDER BY score DESC, fn, line, file LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY score DESC, fn, line, file) AS INT) AS place, fn, line, file, tier, round(score, 6) AS score, CASE WHEN score >= 70 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END AS severity FROM kept""")
def ranked_view(spark, sf_dir):
    """The flagship: scored, tiered, filtered, sorted and limited items."""
    found = L.kept(L.with_reason(_tiered(spark, sf_dir), L.view_rules(c("score"), c("tier"), 30.0, True)))
    return R.ranked(found, R.sort_order("score", KEYS), 20).select("place", *KEYS, "tier", F.round("score", 6).alias("score"), K.severity_100(c("score")).alias("severity"))


def _ordered(name: str, order: str) -> str:
    return f"SELECT '{name}' AS criterion, CAST(row_number() OVER (ORDER BY {order}, fn, line, file) AS INT) AS place, fn, line, file FROM fns QUALIFY place <= 10"


@register("sort_criteria", f"WITH {FUNCTIONS_SQL} SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(_ordered(n, o) for n, o in (("score", "score DESC"), ("coverage", "CASE WHEN fn % 7 <> 0 THEN coverage END ASC NULLS FIRST"), ("complexity", "cognitive DESC"), ("path", "file"), ("function", "fn"))) + ")")
def sort_criteria(spark, sf_dir):
    df = functions(spark, sf_dir).withColumn("coverage", F.when(c("fn") % 7 != 0, c("coverage")))
    out = None
    for criterion in ("score", "coverage", "complexity", "path", "function"):
        part = R.ranked(df, R.sort_order(criterion, KEYS), 10).select(F.lit(criterion).alias("criterion"), "place", *KEYS)
        out = part if out is None else out.unionByName(part)
    return out


@register("bottom_items", f"WITH {FUNCTIONS_SQL} SELECT fn, line, file, round(score, 6) AS score FROM fns ORDER BY score, fn DESC, line DESC, file DESC LIMIT 15")
def bottom_items(spark, sf_dir):
    return R.bottom(functions(spark, sf_dir), 15, KEYS).select(*KEYS, F.round("score", 6).alias("score"))


@register("nested_top", f"""WITH {FUNCTIONS_SQL}, r AS (SELECT fn, line, row_number() OVER (PARTITION BY fn ORDER BY cyclomatic DESC, line) AS n, cyclomatic FROM fns)
SELECT fn, string_agg(cyclomatic::VARCHAR, ',' ORDER BY n) AS best FROM r WHERE n <= 2 GROUP BY fn""")
def nested_top(spark, sf_dir):
    nested = functions(spark, sf_dir).groupBy("fn").agg(F.collect_list(F.struct("line", "cyclomatic")).alias("members"))
    return nested.select("fn", F.array_join(F.transform(R.sorted_members(c("members"), "cyclomatic", 2), lambda m: m["cyclomatic"].cast("string")), ",").alias("best"))


@register("union_dedup", f"""WITH {FUNCTIONS_SQL}, u AS (SELECT 'function' AS kind, file, line, role AS fn, fn AS ordinal, score FROM fns UNION ALL SELECT 'file', file, NULL, NULL, min(fn), sum(score) FROM fns GROUP BY file)
SELECT kind, file, line, fn, ordinal, round(score, 4) AS score FROM u QUALIFY row_number() OVER (PARTITION BY kind, file, line, fn ORDER BY ordinal, score DESC) = 1""")
def union_dedup(spark, sf_dir):
    df = functions(spark, sf_dir)
    fns = df.select("file", "line", c("role").alias("fn"), c("fn").alias("ordinal"), "score")
    files = df.groupBy("file").agg(F.min("fn").alias("ordinal"), F.sum("score").alias("score"))
    return R.first_of_each(R.combined(fns, files), ["kind", "file", "line", "fn"], [c("ordinal"), c("score").desc()]).select("kind", "file", "line", "fn", "ordinal", F.round("score", 4).alias("score"))


@register("insertion_counts", f"""WITH {TIERED_SQL}, r AS (SELECT *, {INSERT} AS reason FROM tiered), n AS (SELECT *, row_number() OVER (PARTITION BY file, line, debt_type, reason = 'included' ORDER BY fn, score) AS n FROM r)
SELECT CASE WHEN reason <> 'included' THEN reason WHEN n = 1 THEN 'added' ELSE 'duplicate' END AS outcome, count(*) AS n FROM n GROUP BY ALL""")
def insertion_counts(spark, sf_dir):
    least = {"score": 20, "risk": 0.5, "cyclomatic": 5, "cognitive": 3}
    reasoned = L.with_reason(_tiered(spark, sf_dir), L.insert_rules(c("score"), c("debt_type"), c("coverage"), c("cyclomatic"), c("cognitive"), least))
    return R.insertion_counts(reasoned, ["file", "line", "debt_type"], [c("fn"), c("score")])


@register("text_similarity", """WITH t AS (SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(lower(text), '\\s+') IF strlen(x) > 2] AS t FROM conversations WHERE text IS NOT NULL), p AS (SELECT conv_id, turn, t AS a, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t),
s AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, len([x FOR x IN a IF list_contains(b, x)]) AS k FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN na + nb - k = 0 THEN 0 ELSE k * 1.0 / (na + nb - k) END, 6) AS similarity FROM s""")
def text_similarity(spark, sf_dir):
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").where("text is not null").withColumn("a", R.tokens(c("text")))
    pairs = turns.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return pairs.select("conv_id", "turn", F.round(R.multiset_similarity(c("a"), c("b")), 6).alias("similarity"))


SNAPSHOTS_SQL = f"""{ITEMS_SQL}, b AS (SELECT file, fn, max_by(score, item) AS score FROM items WHERE is_before GROUP BY file, fn), a AS (SELECT file, fn, max_by(score, item) AS score FROM items WHERE NOT is_before GROUP BY file, fn)"""


def _snapshots(spark, sf_dir):
    df = items(spark, sf_dir)
    return tuple(C.unique_last(df.where(side), ["file", "fn"], ["item"]) for side in (c("is_before"), ~c("is_before")))


@register("snapshot_changes", f"""WITH {SNAPSHOTS_SQL} SELECT file, fn, round(b.score, 6) AS before, round(a.score, 6) AS after, CASE WHEN a.score IS NULL THEN 'resolved' WHEN b.score IS NULL AND a.score >= 40 THEN 'new_critical' WHEN b.score IS NULL THEN 'new' WHEN b.score - a.score > 2 THEN 'improved'
WHEN abs(b.score - a.score) < 2 AND b.score >= 40 AND a.score >= 40 THEN 'unchanged_critical' ELSE 'other' END AS change,
CASE WHEN b.score IS NULL THEN 'new' WHEN a.score IS NULL THEN 'resolved' WHEN a.score < b.score * 0.7 THEN 'improved' WHEN a.score > b.score * 1.1 THEN 'regressed' ELSE 'unchanged' END AS target FROM b FULL JOIN a USING (file, fn)""")
def snapshot_changes(spark, sf_dir):
    found = C.changes(*_snapshots(spark, sf_dir), ["file", "fn"], 40.0, 2.0)
    return found.select("file", "fn", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "change", C.target_status(c("before"), c("after")).alias("target"))


@register("snapshot_regressions", f"""WITH {SNAPSHOTS_SQL} SELECT file, fn, 'regression' AS kind FROM a WHERE score >= 60 AND NOT EXISTS (SELECT 1 FROM b WHERE b.score >= 60 AND b.file = a.file AND b.fn = a.fn)
UNION ALL SELECT file, fn, 'resolved' FROM b WHERE score >= 40 AND NOT EXISTS (SELECT 1 FROM a WHERE b.file = a.file AND b.fn = a.fn)
UNION ALL SELECT file, fn, 'reduced' FROM b JOIN a USING (file, fn) WHERE b.score >= 40 AND (b.score - a.score) / b.score >= 0.3""")
def snapshot_regressions(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    return C.regressions(before, after, ["file", "fn"]).select("file", "fn", F.lit("regression").alias("kind")).unionByName(C.improvements(before, after, ["file", "fn"]))


GATE = "((resolved * 100.0 / n) * 0.4 + (improved * 100.0 / n) * 0.3 + (mean_drop * 10) * 0.2 + (CASE WHEN new_critical = 0 THEN 100 ELSE 0 END) * 0.1)"


@register("snapshot_gate", f"""WITH {SNAPSHOTS_SQL}, j AS (SELECT b.score AS s, a.score AS t FROM b FULL JOIN a USING (file, fn)), k AS (SELECT count(*) AS n, count(*) FILTER (t IS NULL) AS resolved, count(*) FILTER (s IS NOT NULL AND t IS NOT NULL AND s - t > 2) AS improved, count(*) FILTER (s IS NULL AND t >= 40) AS new_critical,
count(*) FILTER (abs(s - t) < 2 AND s >= 40 AND t >= 40) AS unchanged, avg(greatest(coalesce(s - t, 0), 0)) AS mean_drop FROM j)
SELECT round({GATE}, 4) AS score, round({GATE} * (1 - least(unchanged * 0.05, 0.25)), 4) AS penalised, CASE WHEN {GATE} >= 70 AND new_critical = 0 THEN 'complete' WHEN {GATE} < 40 OR new_critical > 0 THEN 'failed' ELSE 'incomplete' END AS status,
round(least(greatest({GATE} * 0.5 + mean_drop * 0.3 + 100 * 0.2, 0), 100), 4) AS composite, CASE WHEN {GATE} - 30 < -5 THEN 'regression' WHEN {GATE} - 30 > 5 THEN 'progress' ELSE 'stable' END AS trend, mean_drop <= 50 AS density_ok FROM k""")
def snapshot_gate(spark, sf_dir):
    found = C.changes(*_snapshots(spark, sf_dir), ["file", "fn"], 40.0, 2.0)

    def share(kind):
        return F.count_if(c("change") == kind)

    drop = F.avg(F.greatest(F.coalesce(c("before") - c("after"), F.lit(0.0)), F.lit(0.0)))
    k = found.agg(F.count(F.lit(1)).alias("n"), share("resolved").alias("resolved"), share("improved").alias("improved"), share("new_critical").alias("new_critical"), share("unchanged_critical").alias("unchanged"), drop.alias("drop"))
    score = C.improvement_score(c("resolved") * 100 / c("n"), c("improved") * 100 / c("n"), c("drop") * 10, F.when(c("new_critical") == 0, 100).otherwise(0))
    return k.select(F.round(score, 4).alias("score"), F.round(C.unchanged_penalty(score, c("unchanged"), F.lit(False)), 4).alias("penalised"), C.gate_status(score, c("new_critical"), 70.0).alias("status"), F.round(C.composite_score(score, c("drop"), F.lit(100.0)), 4).alias("composite"), C.trend(score, F.lit(30.0)).alias("trend"), C.density_gate(c("drop")).alias("density_ok"))


@register("snapshot_summary", f"""WITH {SNAPSHOTS_SQL} SELECT 'before' AS side, count(*) AS n, count(*) FILTER (score >= 40) AS critical, round(avg(score), 4) AS mean FROM b UNION ALL SELECT 'after', count(*), count(*) FILTER (score >= 40), round(avg(score), 4) FROM a""")
def snapshot_summary(spark, sf_dir):
    out = [C.summary(s, 40.0).select(F.lit(side).alias("side"), "n", "critical", F.round("mean", 4).alias("mean")) for side, s in zip(("before", "after"), _snapshots(spark, sf_dir), strict=True)]
    return out[0].unionByName(out[1])


NAMES = "(CASE p_partkey % 5 WHEN 0 THEN 'crate::' || p_name WHEN 1 THEN p_name || '<T>' WHEN 2 THEN p_name || '::{{closure}}' WHEN 3 THEN p_brand ELSE p_name END)"


@register("name_functions", f"""WITH n AS (SELECT p_partkey, p_size, p_name AS q, {NAMES} AS k, p_brand || '/./' || p_type || chr(92) || p_name AS path FROM part)
SELECT p_partkey, trim(split_part(k, '<', 1)) AS normalized, CASE WHEN contains(k, '::') THEN split_part(k, '::', -1) END AS method, CASE WHEN contains(k, '::{{{{closure}}}}') THEN nullif(split_part(k, '::{{{{closure}}}}', 1), '') END AS parent,
CASE p_partkey % 5 WHEN 0 THEN 'Medium' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' WHEN 3 THEN CASE WHEN contains(q, k) OR contains(k, q) THEN 'Low' ELSE 'None' END ELSE 'High' END AS matched,
replace(path, chr(92), '/') AS separators, array_to_string([x FOR x IN string_split(replace(path, chr(92), '/'), '/') IF x <> '' AND x <> '.'], '/') AS components, translate(path, '/' || chr(92) || '. ', '____') || '_' || p_size AS item_id,
CASE WHEN strlen(q) < 3 THEN 'short' WHEN strlen(q) > 30 THEN 'long' WHEN regexp_matches(q, '^[A-Z]') THEN 'capital' END AS violation FROM n""".replace("{{{{", "{{").replace("}}}}", "}}"))
def name_functions(spark, sf_dir):
    q = c("p_name")
    k = F.expr(NAMES)
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", q.alias("q"), k.alias("k"), F.concat(c("p_brand"), F.lit("/./"), c("p_type"), F.lit("\\"), q).alias("path"))
    return df.select("p_partkey", X.normalized_name(c("k")).alias("normalized"), X.method_name(c("k")).alias("method"), X.closure_parent(c("k")).alias("parent"), X.name_match(c("q"), c("k")).alias("matched"), X.normalized_separators(c("path")).alias("separators"), F.array_join(J.path_components(c("path")), "/").alias("components"), X.item_id(c("path"), c("p_size")).alias("item_id"), X.name_violation(c("q"), 3, 30).alias("violation"))


@register("line_kinds", f"""WITH {LINES_SQL} SELECT doc_id, count(*) AS lines, count(*) FILTER (trim(txt) = '') AS blank, count(*) FILTER (regexp_matches(trim(txt), '^(//|/[*]|[*])')) AS comments, count(*) FILTER (regexp_matches(txt, 'icensed?|opyright')) AS marked,
count(*) FILTER (strlen(txt) > 500) AS long_lines FROM lines GROUP BY doc_id""")
def line_kinds(spark, sf_dir):
    kind = X.line_kind(c("txt"), F.lit("Rust"))
    marker = X.marker_priority(c("txt"), {"icensed?": "High", "opyright": "Medium"})
    return lines_of(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(kind == "blank").alias("blank"), F.count_if(kind == "comment").alias("comments"), F.count(marker).alias("marked"), F.count_if(X.line_smell(c("txt"), 500, 10_000) == "long").alias("long_lines"))


@register("ages_and_rounding", """SELECT o_orderkey, CAST(greatest(floor((epoch(TIMESTAMP '2001-01-01 00:00:00') - epoch(o_orderdate)) / 86400), 0) AS BIGINT) AS age_days, round(o_totalprice / 3, 2) AS score, round(o_totalprice / 300007, 4) AS ratio FROM orders""")
def ages_and_rounding(spark, sf_dir):
    now = F.lit("2001-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.age_days(c("o_orderdate").cast("timestamp"), now).alias("age_days"), X.round_score(c("o_totalprice") / 3).alias("score"), X.round_ratio(c("o_totalprice") / 300007).alias("ratio"))


MESSAGE = "(CASE event_id % 8 WHEN 0 THEN 'Fix crash in parser' WHEN 1 THEN 'style: fix spaces' WHEN 2 THEN 'add prefix table' WHEN 3 THEN 'refactor: hotfix path' WHEN 4 THEN 'refactor: move code' WHEN 5 THEN 'fixed bug-12' WHEN 6 THEN 'Fix typo' ELSE 'docs: bugs' END)"


@register("commit_kinds", f"""WITH m AS (SELECT event_id, {MESSAGE} AS msg, event_id % 8 AS k FROM events) SELECT event_id, k IN (0, 3, 5) AS is_fix FROM m""")
def commit_kinds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", K.is_bug_fix(F.expr(MESSAGE)).alias("is_fix"))


PATHS = "(CASE page_id % 9 WHEN 0 THEN 'src/tests/a.rs' WHEN 1 THEN 'src/core/b.rs' WHEN 2 THEN 'src/api/handler.py' WHEN 3 THEN 'src/utils/c.go' WHEN 4 THEN 'src/db/d.ts' WHEN 5 THEN 'src/lib.rs' WHEN 6 THEN 'src/main.rs' WHEN 7 THEN 'cli/run.pyw' ELSE 'web/x.sol' END)"
FUNCTION_NAMES = "(CASE page_id % 7 WHEN 0 THEN 'main' WHEN 1 THEN 'cmd_run' WHEN 2 THEN 'get_item' WHEN 3 THEN 'route_all' WHEN 4 THEN 'on_click' WHEN 5 THEN 'test_it' ELSE 'other' END)"


@register("path_kinds", f"""WITH m AS (SELECT page_id, {PATHS} AS path, {FUNCTION_NAMES} AS name FROM pages) SELECT page_id,
CASE WHEN regexp_matches(path, '/tests/|_test[.]rs') THEN 'Test' WHEN regexp_matches(path, '/core/|/domain/') THEN 'Core' WHEN regexp_matches(path, '/api/|/handlers/') THEN 'Api' WHEN regexp_matches(path, '/utils/|/helpers/') THEN 'Util' WHEN regexp_matches(path, '/infra/|/db/') THEN 'Infrastructure' WHEN regexp_matches(path, '(mod|lib)[.]rs$') THEN 'Core' WHEN contains(path, 'main.rs') THEN 'Infrastructure' ELSE 'Util' END AS module,
CASE WHEN name = 'main' THEN 'Main' WHEN regexp_matches(path, 'cli|command') AND regexp_matches(name, '^(cmd|command)_|_command$') THEN 'CliCommand' WHEN regexp_matches(path, 'api|handler|route') AND regexp_matches(name, '^(handle|get|post|put|delete)_|_handler$') THEN 'ApiEndpoint' WHEN regexp_matches(path, 'web|http') AND regexp_matches(name, 'route|handler') THEN 'WebHandler' WHEN regexp_matches(name, '^on_|_listener$|event') THEN 'EventHandler' WHEN contains(path, 'test') OR contains(name, 'test') THEN 'TestEntry' END AS entry,
CASE split_part(path, '.', -1) WHEN 'rs' THEN 'Rust' WHEN 'py' THEN 'Python' WHEN 'pyw' THEN 'Python' WHEN 'go' THEN 'Go' WHEN 'ts' THEN 'TypeScript' WHEN 'sol' THEN 'Solidity' ELSE 'Unknown' END AS language FROM m""")
def path_kinds(spark, sf_dir):
    df = table(spark, sf_dir, "pages").select("page_id", F.expr(PATHS).alias("path"), F.expr(FUNCTION_NAMES).alias("name"))
    return df.select("page_id", K.module_type(c("path")).alias("module"), K.entry_type(c("name"), c("path")).alias("entry"), K.language(c("path")).alias("language"))


@register("signal_vote", """WITH s AS (SELECT l_orderkey AS fn, l_returnflag AS category, l_tax * 10 AS confidence, CASE l_linenumber WHEN 1 THEN 0.35 WHEN 2 THEN 0.25 WHEN 3 THEN 0.15 WHEN 4 THEN 0.15 ELSE 0.05 END AS w FROM lineitem), v AS (SELECT fn, category, round(sum(w * confidence), 9) AS score FROM s GROUP BY ALL)
SELECT fn, max_by(category, (score, category)) AS category, round(max(score), 6) AS score FROM v GROUP BY fn""")
def signal_vote(spark, sf_dir):
    from tidemark.operators.graph import weighted_vote

    weight = F.when(c("l_linenumber") == 1, 0.35).when(c("l_linenumber") == 2, 0.25).when(c("l_linenumber").isin(3, 4), 0.15).otherwise(0.05)
    signals = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("fn"), c("l_returnflag").alias("category"), (c("l_tax") * 10).alias("confidence"), weight.alias("weight"))
    return weighted_vote(signals, "fn").select("fn", "category", F.round("score", 6).alias("score"))
