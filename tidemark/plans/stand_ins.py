"""Stand-ins for the engine's inputs, derived from the driver's tables: each as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.registry import table

ROLES = ("EntryPoint", "PureLogic", "Orchestrator", "IOWrapper", "PatternMatch", "Debug", "Unknown")
DEBT_TYPES = ("GodObject", "ComplexityHotspot", "TestingGap", "DeadCode", "ErrorSwallowing", "MagicValues", "Duplication", "Todo", "NestedLoops", "TestTodo", "Risk", "Dependency")

_ROLE = "CASE l_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES)) + " END"
_TYPE = "CASE (l_orderkey + l_linenumber) % 12 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(DEBT_TYPES)) + " END"

#: A line item as a function's metrics. The text is valid in both engines.
FUNCTION_COLUMNS = f"""
l_orderkey AS fn, l_linenumber AS line, l_partkey AS file, l_suppkey AS owner,
CAST(l_quantity AS INT) AS cyclomatic, CAST(floor(l_quantity * l_discount * 10 + 0.000001) AS INT) AS cognitive,
CAST(l_linenumber AS INT) AS nesting, CAST(l_linenumber * 10 AS INT) AS length,
CAST(100 - floor(l_tax * 1000 + 0.5) AS DOUBLE) / 100 AS coverage, l_returnflag = 'R' AS is_test,
CAST(l_suppkey % 25 AS INT) AS production_callers, CAST(l_partkey % 13 AS INT) AS test_callers, CAST(l_orderkey % 9 AS INT) AS callees,
{_ROLE} AS role, {_TYPE} AS debt_type, l_extendedprice / 997 AS score
"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = _split(FUNCTION_COLUMNS)
    return table(spark, sf_dir, "lineitem").selectExpr(*columns)


def _split(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


FUNCTIONS_SQL = f"fns AS (SELECT {FUNCTION_COLUMNS} FROM lineitem)"

#: An order as a debt item: orders before the split are the snapshot before, the others the snapshot after.
ITEM_COLUMNS = """
o_orderkey AS item, o_custkey AS file, CAST(o_custkey % 17 AS INT) AS line, o_orderpriority AS fn,
o_totalprice / 4999 AS score, o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AS is_before, o_orderstatus AS status
"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c.replace("TIMESTAMP '", "TIMESTAMP_NTZ '") for c in _split(ITEM_COLUMNS)]
    return table(spark, sf_dir, "orders").selectExpr(*columns)


ITEMS_SQL = f"items AS (SELECT {ITEM_COLUMNS} FROM orders)"

#: Sparse call graph of all sign-ups: each calls the next of its day. A node is a user in one of eight modules.
EDGES_SQL = """
edges AS (
  SELECT DISTINCT a, b FROM (
    SELECT user_id * 8 + event_id % 8 AS a, lead(user_id * 8 + event_id % 8) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS b
    FROM events WHERE event_type = 'signup'
  ) WHERE b IS NOT NULL AND a <> b
)
"""
#: The same with users as nodes: few nodes, many edges.
DENSE_SQL = EDGES_SQL.replace("user_id * 8 + event_id % 8", "user_id")


def edges(spark: SparkSession, sf_dir: str, sql: str = EDGES_SQL) -> DataFrame:
    """(a, b): a calls b."""
    table(spark, sf_dir, "events").createOrReplaceTempView("tidemark_events")
    return spark.sql(f"WITH {sql.replace('FROM events', 'FROM tidemark_events')} SELECT a, b FROM edges")


def dense_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): users; for what costs as much as there are pairs of nodes."""
    return edges(spark, sf_dir, DENSE_SQL)


def columns_of(text: str) -> list[str]:
    return _split(text)
