"""Queries of context operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import context as X
from tidemark.plans.registry import register, table
from tidemark.plans.stand_ins import EDGES_SQL, FUNCTIONS_SQL, edges, functions

c = F.col


@register("contextual_risk", """WITH k AS (SELECT l_orderkey AS target, l_tax * 5 AS contribution, 0.5 AS weight FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, l_discount * 10, 1.5 FROM lineitem WHERE l_linenumber = 2), t AS (SELECT target, sum(contribution * weight) AS total FROM k GROUP BY target)
SELECT o_orderkey AS target, round(coalesce(total, 0), 6) AS total, round(o_totalprice / 9973 * (1 + least(coalesce(total, 0), 2)), 5) AS risk FROM orders LEFT JOIN t ON target = o_orderkey""")
def contextual_risk(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    registry = X.Registry()
    registry.register("history", lambda targets: lineitem.where("l_linenumber = 1").select(c("l_orderkey").alias("target"), (c("l_tax") * 5).alias("contribution")), 0.5)
    registry.register("dependencies", lambda targets: lineitem.where("l_linenumber = 2").select(c("l_orderkey").alias("target"), (c("l_discount") * 10).alias("contribution")), 1.5)
    base = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("target"), (c("o_totalprice") / 9973).alias("base"))
    return X.contextual_risk(registry.contributions(base), base).select("target", F.round("total", 6).alias("total"), F.round("risk", 5).alias("risk"))


@register("function_history", """WITH e AS (SELECT user_id, event_id % 5 AS fn, ts, event_type, min(ts) OVER (PARTITION BY user_id, event_id % 5) AS introduced FROM events)
SELECT user_id, fn, strftime(introduced, '%Y-%m-%d %H:%M:%S') AS introduced, count(*) FILTER (ts > introduced) AS changes, count(*) FILTER (ts > introduced AND event_type = 'error') AS fixes, count(DISTINCT event_type) AS authors FROM e GROUP BY user_id, fn, e.introduced""")
def function_history(spark, sf_dir):
    changes = table(spark, sf_dir, "events").withColumn("fn", c("event_id") % 5)
    found = X.function_history(changes, ["user_id", "fn"], "ts", "event_type", c("event_type") == "error")
    return found.withColumn("introduced", F.date_format("introduced", "yyyy-MM-dd HH:mm:ss"))


@register("reading_list", f"WITH {EDGES_SQL}, s AS (SELECT a AS id, 'callee' AS kind, b AS other FROM edges UNION SELECT b, 'caller', a FROM edges) SELECT id, kind, other, CAST(row_number() OVER (PARTITION BY id, kind ORDER BY other) AS INT) AS place FROM s QUALIFY place <= 2")
def reading_list(spark, sf_dir):
    return X.reading_list(edges(spark, sf_dir), 2)


@register("recommendations", f"""WITH {FUNCTIONS_SQL} SELECT CASE WHEN debt_type = 'GodObject' THEN 'split' WHEN debt_type = 'DeadCode' THEN 'remove' WHEN cyclomatic > 20 AND coverage < 0.5 THEN 'test, then extract' WHEN cyclomatic > 20 THEN 'extract functions' WHEN nesting >= 4 THEN 'return early' WHEN coverage < 0.5 THEN 'add tests' ELSE 'leave' END AS advice, count(*) AS n FROM fns GROUP BY ALL""")
def recommendations(spark, sf_dir):
    return functions(spark, sf_dir).groupBy(X.recommendation(c("debt_type"), c("cyclomatic"), c("coverage"), c("nesting")).alias("advice")).agg(F.count(F.lit(1)).alias("n"))
