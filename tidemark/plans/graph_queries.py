"""Queries of graph operators over the sparse call graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import clusters as M
from tidemark.operators import graph as G
from tidemark.plans.registry import register, table
from tidemark.plans.stand_ins import DENSE_SQL, EDGES_SQL, dense_edges, edges

c = F.col
DENSE_NODES_SQL = f"{DENSE_SQL}, nodes AS (SELECT a AS id FROM edges UNION SELECT b FROM edges)"
NODES_SQL = f"{EDGES_SQL}, nodes AS (SELECT a AS id FROM edges UNION SELECT b FROM edges)"
REACH_SQL = """reach AS (SELECT source, target, min(hops) AS hops FROM walk GROUP BY ALL)"""
#: All pairs of nodes of which one reaches the other.
PAIRS_SQL = f"WITH RECURSIVE {NODES_SQL}, reach AS (SELECT a AS source, b AS target FROM edges UNION SELECT source, b FROM reach JOIN edges ON target = a)"
#: On top of PAIRS_SQL: each node's component, and its layer among them.
LEVELS_SQL = """own AS (SELECT n.id, least(n.id, coalesce(min(x.target), n.id)) AS component FROM nodes n LEFT JOIN (SELECT p.source, p.target FROM reach p JOIN reach q ON p.source = q.target AND p.target = q.source) x ON x.source = n.id GROUP BY n.id),
between AS (SELECT DISTINCT x.component AS ca, y.component AS cb FROM edges JOIN own x ON x.id = a JOIN own y ON y.id = b WHERE x.component <> y.component),
climb AS (SELECT DISTINCT component AS c, 0 AS level FROM own UNION SELECT ca, level + 1 FROM climb JOIN between ON cb = c),
levels AS (SELECT id, max(level) AS level FROM own JOIN climb ON c = component GROUP BY id)"""


def _walk(depth: int, nodes: str = NODES_SQL) -> str:
    """Recursive walks without repeats of (source, target, hops)."""
    return f"WITH RECURSIVE {nodes}, walk AS (SELECT a AS source, b AS target, 1 AS hops FROM edges UNION SELECT source, b, hops + 1 FROM walk JOIN edges ON target = a WHERE hops < {depth}), {REACH_SQL}"


@register("closure_inclusive", f"{_walk(3)} SELECT source, target, hops FROM reach")
def closure_inclusive(spark, sf_dir):
    return G.closure(edges(spark, sf_dir), 3)


@register("closure_exclusive", f"{_walk(2)} SELECT source, target, hops FROM reach")
def closure_exclusive(spark, sf_dir):
    return G.closure(edges(spark, sf_dir), 3, inclusive=False)


@register("blast_radius", f"{PAIRS_SQL} SELECT n.id, count(r.source) + 1 AS radius FROM nodes n LEFT JOIN reach r ON r.target = n.id AND r.source <> n.id GROUP BY n.id")
def blast_radius(spark, sf_dir):
    return G.blast_radius(edges(spark, sf_dir))


ENTRY = "(SELECT id FROM nodes WHERE id % 10 = 1)"


@register("depth_from_entries", f"WITH RECURSIVE {NODES_SQL}, w AS (SELECT id, 0 AS depth FROM nodes WHERE id % 10 = 1 UNION SELECT b, depth + 1 FROM w JOIN edges ON id = a WHERE depth < 60) SELECT id, min(depth) AS depth FROM w GROUP BY id")
def depth_from_entries(spark, sf_dir):
    calls = edges(spark, sf_dir)
    return G.depth_from(G.nodes_of(calls).where("id % 10 = 1"), calls)


@register("cycles", f"{PAIRS_SQL}, on_it AS (SELECT source AS id FROM reach WHERE source = target) SELECT id, id IN (SELECT id FROM on_it) AS in_cycle, id IN (SELECT source FROM reach WHERE target IN (SELECT id FROM on_it)) AS reaches_cycle FROM nodes")
def cycles(spark, sf_dir):
    return G.cyclic(edges(spark, sf_dir))


@register("strong_components", f"{PAIRS_SQL}, {LEVELS_SQL} SELECT id, component FROM own")
def strong_components(spark, sf_dir):
    return G.strong_components(edges(spark, sf_dir))


@register("test_reach", f"""WITH RECURSIVE {NODES_SQL}, t AS (SELECT id FROM nodes WHERE id % 4 = 0), e AS (SELECT id FROM nodes WHERE id NOT IN (SELECT b FROM edges) AND id % 4 <> 0),
wt AS (SELECT id FROM t UNION SELECT b FROM wt JOIN edges ON id = a), we AS (SELECT id FROM e UNION SELECT b FROM we JOIN edges ON id = a)
SELECT 'test only' AS kind, id FROM wt WHERE id NOT IN (SELECT id FROM we) AND id NOT IN (SELECT id FROM t) UNION ALL SELECT 'helper', b FROM edges GROUP BY b HAVING bool_and(a % 4 = 0)""")
def test_reach(spark, sf_dir):
    calls = edges(spark, sf_dir)
    nodes = G.nodes_of(calls).withColumn("is_test", c("id") % 4 == 0)
    return G.test_only(nodes, calls).select(F.lit("test only").alias("kind"), "id").unionByName(G.test_helpers(nodes, calls).select(F.lit("helper").alias("kind"), "id"))


@register("delegation", f"WITH {NODES_SQL}, m AS (SELECT a AS id, count(*) AS n, avg(b % 9) AS mean FROM edges GROUP BY a) SELECT id FROM m WHERE id % 9 <= 3 AND n >= 2 AND mean > (id % 9) * 1.5")
def delegation(spark, sf_dir):
    calls = edges(spark, sf_dir)
    return G.delegators(G.nodes_of(calls).withColumn("complexity", c("id") % 9), calls)


COVERED = "(CASE id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 ELSE 0.9 END)"


@register("transitive_coverage", f"WITH {NODES_SQL}, m AS (SELECT a AS id, avg(CASE WHEN b % 3 = 2 THEN 1.0 ELSE 0.0 END) AS share FROM edges GROUP BY a) SELECT n.id, round(CASE WHEN {COVERED.replace('id', 'n.id')} > 0 THEN {COVERED.replace('id', 'n.id')} ELSE coalesce(share, 0) END, 6) AS transitive FROM nodes n LEFT JOIN m USING (id)")
def transitive_coverage(spark, sf_dir):
    calls = edges(spark, sf_dir)
    nodes = G.nodes_of(calls).withColumn("coverage", F.when(c("id") % 3 == 0, 0.0).when(c("id") % 3 == 1, 0.5).otherwise(0.9))
    return G.transitive_coverage(nodes, calls).select("id", F.round("transitive", 6).alias("transitive"))


COVER = "(CASE WHEN {0} % 5 = 0 THEN 0.9 ELSE 0.1 END)"


@register("indirect_coverage", f"""WITH {NODES_SQL}, h1 AS (SELECT DISTINCT b AS id, a AS c FROM edges WHERE b % 5 <> 0), h2 AS (SELECT DISTINCT h1.id, e.a AS c FROM h1 JOIN edges e ON e.b = h1.c WHERE h1.c % 5 <> 0), h3 AS (SELECT DISTINCT h2.id, e.a AS c FROM h2 JOIN edges e ON e.b = h2.c WHERE h2.c % 5 <> 0),
g AS (SELECT id, 0.9 AS gain FROM h1 WHERE c % 5 = 0 UNION ALL SELECT id, 0.9 * 0.7 FROM h2 WHERE c % 5 = 0 UNION ALL SELECT id, 0.9 * 0.49 FROM h3 WHERE c % 5 = 0) SELECT n.id, round(coalesce(max(gain), 0), 6) AS indirect FROM nodes n LEFT JOIN g USING (id) GROUP BY n.id""")
def indirect_coverage(spark, sf_dir):
    calls = edges(spark, sf_dir)
    nodes = G.nodes_of(calls).withColumn("coverage", F.when(c("id") % 5 == 0, 0.9).otherwise(0.1))
    return G.indirect_coverage(nodes, calls).select("id", F.round("indirect", 6).alias("indirect"))


def _risk_rounds(n: int) -> str:
    parts = ["r0 AS (SELECT id, (id % 7) / 7.0::DOUBLE AS own, (id % 7) / 7.0::DOUBLE AS risk FROM nodes)"]
    for i in range(1, n + 1):
        parts.append(f"i{i} AS (SELECT a AS id, sum(risk * 0.5) AS s FROM edges JOIN r{i - 1} ON b = id GROUP BY a), r{i} AS (SELECT r.id, own, CASE WHEN abs(own + 0.3 * coalesce(s, 0) - risk) > 0.01 THEN own + 0.3 * coalesce(s, 0) ELSE risk END AS risk FROM r{i - 1} r LEFT JOIN i{i} USING (id))")
    return ", ".join(parts)


@register("propagated_risk", f"WITH {NODES_SQL}, {_risk_rounds(10)} SELECT id, round(risk, 6) AS risk FROM r10")
def propagated_risk(spark, sf_dir):
    calls = edges(spark, sf_dir)
    nodes = G.nodes_of(calls).withColumn("risk", (c("id") % 7) / 7.0)
    return G.propagated_risk(nodes, calls.withColumn("coupling", F.lit(0.5))).select("id", F.round("risk", 6).alias("risk"))


@register("betweenness", f"{_walk(20, DENSE_NODES_SQL)}, d AS (SELECT * FROM reach WHERE source <> target), n AS (SELECT count(*) AS n FROM nodes), p AS (SELECT x.target AS id, count(*) AS pairs FROM d x JOIN d y ON x.target = y.source AND x.source <> y.target JOIN d z ON z.source = x.source AND z.target = y.target AND z.hops = x.hops + y.hops GROUP BY 1) SELECT id, round(coalesce(pairs, 0) * 1.0 / ((n - 1) * (n - 2)), 6) AS betweenness FROM nodes LEFT JOIN p USING (id), n")
def betweenness(spark, sf_dir):
    return G.betweenness(dense_edges(spark, sf_dir)).select("id", F.round("betweenness", 6).alias("betweenness"))


@register("clustering", f"""WITH {NODES_SQL}, k AS (SELECT a AS id, count(*) AS n FROM edges GROUP BY a), t AS (SELECT x.a AS id, count(*) AS closed FROM edges x JOIN edges y ON x.a = y.a AND x.b <> y.b JOIN edges z ON z.a = x.b AND z.b = y.b GROUP BY x.a),
m AS (SELECT x.a AS id, count(*) AS closed FROM edges x JOIN edges y ON x.a = y.a AND x.b < y.b JOIN edges z ON z.a = x.b AND z.b = y.b JOIN edges v ON v.a = y.b AND v.b = x.b GROUP BY x.a)
SELECT id, round(CASE WHEN n >= 2 THEN coalesce(t.closed, 0) * 1.0 / (n * (n - 1)) ELSE 0 END, 6) AS clustering, round(CASE WHEN n >= 2 THEN coalesce(m.closed, 0) * 2.0 / (n * (n - 1)) ELSE 0 END, 6) AS mutual FROM nodes LEFT JOIN k USING (id) LEFT JOIN t USING (id) LEFT JOIN m USING (id)""")
def clustering(spark, sf_dir):
    calls = edges(spark, sf_dir)
    both = G.clustering(calls).join(G.clustering(calls, mutual=True).withColumnRenamed("clustering", "mutual"), "id")
    return both.select("id", F.round("clustering", 6).alias("clustering"), F.round("mutual", 6).alias("mutual"))


@register("cascade_impact", f"{_walk(3)} SELECT n.id, round(coalesce(sum((source % 5) * pow(0.7, hops)), 0), 6) AS impact FROM nodes n LEFT JOIN reach r ON r.target = n.id AND source <> target GROUP BY n.id")
def cascade_impact(spark, sf_dir):
    calls = edges(spark, sf_dir)
    return G.cascade_impact(G.nodes_of(calls).withColumn("weight", c("id") % 5), calls).select("id", F.round("impact", 6).alias("impact"))


@register("modification_impact", f"WITH {NODES_SQL} SELECT id, (SELECT count(*) FROM edges WHERE b = id) AS callers, (SELECT count(*) FROM edges WHERE a = id) AS callees FROM nodes")
def modification_impact(spark, sf_dir):
    return G.modification_impact(edges(spark, sf_dir))


@register("acyclic_levels", f"""WITH RECURSIVE {NODES_SQL}, dag AS (SELECT a, b FROM edges WHERE a > b), w AS (SELECT id, 0 AS level FROM nodes UNION SELECT a, level + 1 FROM w JOIN dag ON b = id) SELECT id, max(level) AS level FROM w WHERE id IN (SELECT a FROM dag UNION SELECT b FROM dag) GROUP BY id""")
def acyclic_levels(spark, sf_dir):
    return G.levels(edges(spark, sf_dir).where("a > b"))


@register("layering", f"""{PAIRS_SQL}, {LEVELS_SQL}, k AS (SELECT count(*) FILTER (WHERE x.level > y.level) AS forward, count(*) FILTER (WHERE x.level <= y.level) AS backward FROM edges JOIN levels x ON x.id = a JOIN levels y ON y.id = b)
SELECT round(CASE WHEN forward + backward = 0 THEN 1.0 ELSE forward * 1.0 / (forward + backward) END, 6) AS score, forward, backward FROM k""")
def layering(spark, sf_dir):
    return G.layering_score(edges(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("propagated_purity", f"""{PAIRS_SQL}, {LEVELS_SQL}, bad AS (SELECT id FROM nodes WHERE id % 11 = 0 UNION SELECT source FROM reach WHERE target % 11 = 0), round AS (SELECT source AS id FROM reach WHERE source = target), loops AS (SELECT id FROM round UNION SELECT source FROM reach WHERE target IN (SELECT id FROM round))
SELECT id, id NOT IN (SELECT id FROM bad) AS is_pure, round(CASE WHEN id IN (SELECT id FROM bad) THEN 0.9 WHEN id IN (SELECT id FROM loops) THEN 0.9 * 0.7 WHEN level > 0 THEN least(greatest(0.9 * pow(0.9, level), 0.5), 1.0) ELSE 0.9 END, 6) AS confidence FROM levels""")
def propagated_purity(spark, sf_dir):
    calls = edges(spark, sf_dir)
    nodes = G.nodes_of(calls).select("id", (c("id") % 11 != 0).alias("is_pure"), F.lit(0.9).alias("confidence"))
    return G.propagated_purity(nodes, calls).withColumn("confidence", F.round("confidence", 6))


def _methods(spark, sf_dir):
    """A user's events as the methods of a type, each calling the next."""
    named = table(spark, sf_dir, "events").select(c("user_id").alias("grp"), F.concat_ws("_", "event_type", c("event_id") % 12).alias("method"), "ts", "event_id")
    following = F.lead("method").over(Window.partitionBy("grp").orderBy("ts", "event_id"))
    calls = named.select("grp", c("method").alias("a"), following.alias("b")).groupBy("grp", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return named.select("grp", "method"), calls


@register("method_communities")
def method_communities(spark, sf_dir):
    return M.method_clusters(*_methods(spark, sf_dir))


@register("method_hybrid_clusters")
def method_hybrid_clusters(spark, sf_dir):
    return M.method_clusters(*_methods(spark, sf_dir), hybrid=True)


@register("communities")
def communities(spark, sf_dir):
    return G.communities(edges(spark, sf_dir))


@register("reaching_definitions", f"""WITH RECURSIVE {NODES_SQL}, into_block AS (SELECT b AS block, a % 3 AS variable, a AS definition FROM edges UNION SELECT b, variable, definition FROM into_block JOIN edges ON block = a WHERE a % 3 <> variable)
SELECT block, variable, definition FROM into_block""")
def reaching_definitions(spark, sf_dir):
    calls = edges(spark, sf_dir)
    blocks = G.nodes_of(calls).select(c("id").alias("block"), (c("id") % 3).alias("variable"), c("id").alias("definition"))
    return G.reaching_definitions(blocks, calls)


@register("caller_clusters", f"""WITH RECURSIVE {NODES_SQL}, s AS (SELECT a, count(*) AS n FROM edges GROUP BY a), p AS (SELECT x.a AS x, y.a AS y, count(*) AS k FROM edges x JOIN edges y ON x.b = y.b AND x.a <> y.a GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s sx ON sx.a = x JOIN s sy ON sy.a = y WHERE k * 1.0 / (sx.n + sy.n - k) >= 0.3), w AS (SELECT id, id AS r FROM nodes UNION SELECT l.y, w.r FROM w JOIN l ON w.id = l.x) SELECT id, min(r) AS cluster FROM w GROUP BY id""")
def caller_clusters(spark, sf_dir):
    calls = edges(spark, sf_dir)
    return G.linked_clusters(G.nodes_of(calls), G.similar_callers(calls, 0.3))
