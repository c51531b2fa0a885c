"""Queries of readers, detectors and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.text import marker_priority
from tidemark.operators import detectors as D
from tidemark.operators import organization as O
from tidemark.operators.code_facts import facts
from tidemark.plans.registry import register, table
from tidemark.scratch import materialize, shared_dir
from tidemark.sources import lcov
from tidemark.streaming import history

c = F.col


def _folder(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


LCOV_ROWS = "SELECT l_partkey AS file, l_orderkey % 4 AS fn, l_linenumber AS line, CAST(max(CASE WHEN l_quantity > 25 THEN 3 ELSE 0 END) AS BIGINT) AS hits FROM lineitem GROUP BY ALL"


def _lcov(spark, sf_dir):
    """The stand-in as LCOV text, written and read back: four functions to a file, function f at line 10 f, its lines after it."""
    rows = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("file"), (c("l_orderkey") % 4).alias("fn"), c("l_linenumber").alias("line")).agg(F.max(F.when(c("l_quantity") > 25, 3).otherwise(0)).alias("hits"))
    at = c("fn") * 10 + c("line")
    da = F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(F.lit("DA:"), at.cast("string"), F.lit(","), c("hits").cast("string")))))
    fns = F.concat_ws("\n", *(F.lit(f"FN:{10 * i},f{i}\nFNDA:{i},f{i}") for i in range(4)))
    record = F.concat(F.lit("SF:src/"), c("file").cast("string"), F.lit(".rs\n"), fns, F.lit("\n"), da, F.lit("\nLF:"), F.count(F.lit(1)).cast("string"), F.lit("\nLH:"), F.count_if(c("hits") > 0).cast("string"), F.lit("\nend_of_record"))
    path = _folder(spark, "lcov")
    rows.groupBy("file").agg(record.alias("value")).select("value").write.text(path)
    return lcov.read_records(spark, path)


@register("lcov_functions", f"""WITH r AS ({LCOV_ROWS}), f AS (SELECT DISTINCT file, unnest([0, 1, 2, 3]) AS fn FROM r)
SELECT 'src/' || f.file || '.rs' AS file, 'f' || f.fn AS name, CAST(f.fn AS BIGINT) AS calls, count(r.line) AS lines, count(*) FILTER (r.hits > 0) AS hit, round(CASE WHEN count(r.line) > 0 THEN 100.0 * count(*) FILTER (r.hits > 0) / count(r.line) WHEN f.fn > 0 THEN 100 ELSE 0 END, 6) AS percent,
coalesce(string_agg(CASE WHEN r.hits = 0 THEN (f.fn * 10 + r.line)::VARCHAR END, ',' ORDER BY r.line), '') AS uncovered FROM f LEFT JOIN r ON r.file = f.file AND r.fn = f.fn GROUP BY f.file, f.fn""")
def lcov_functions(spark, sf_dir):
    return lcov.functions(_lcov(spark, sf_dir)).select("file", "name", "calls", "lines", "hit", F.round("percent", 6).alias("percent"), F.array_join("uncovered", ",").alias("uncovered"))


@register("lcov_totals", f"WITH r AS ({LCOV_ROWS}) SELECT round(100.0 * count(*) FILTER (hits > 0) / count(*), 6) AS percent, count(DISTINCT file) AS files, count(*) AS lines, count(*) FILTER (hits = 0) AS unhit FROM r")
def lcov_totals(spark, sf_dir):
    records = _lcov(spark, sf_dir)
    return lcov.overall(records).crossJoin(F.broadcast(lcov.diagnosis(records))).select(F.round("percent", 6).alias("percent"), "files", "lines", "unhit")


#: Every event stands for a Python file: one of these, by its id.
MODULES = (
    "import os\n\nclass Order:\n    def __init__(self, store: Store, order_key: str):\n        self.store = store\n        self.order_key = order_key\n    def total(self, other):\n        a = other.price()\n        b = other.tax()\n        c = other.rate()\n        d = other.fee()\n        e = other.cost()\n        return a + b + c + d + e\n",
    "def load(user_id: str, item_key: str, code: str):\n    \"\"\"Loads one item of a user by its key and code.\"\"\"\n    data = open('f')\n    return [x for x in data if x if x != 42]\n\ndef save(user_id: str, item_key: str, code: str):\n    limit = 42\n    return limit\n",
    "def kind(x):\n    match x:\n        case 1:\n            return 'a'\n        case 2:\n            return 'b'\n        case 3:\n            return 'c'\n        case _:\n            return 'd'\n\ndef rank(x):\n    if x == 1:\n        return 7\n    elif x == 2:\n        return 8\n    elif x == 3:\n        return 9\n    else:\n        return 6\n",
    "class Bus:\n    def subscribe(self, handler):\n        self.items.append(handler)\n    def notify(self, event):\n        for item in event:\n            self.items.append(item)\n    def get_size(self):\n        return self.size\n",
    "def broken(:\n",
)
_MODULE_OF = "event_id % 5"


def _modules(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, MODULES)), (c("event_id") % len(MODULES) + 1).cast("int"))
    # Reading sources is the work, so their ids go to all cores, however few row groups the table has.
    ids = table(spark, sf_dir, "events").select("event_id").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    return ids.select(c("event_id").cast("string").alias("path"), F.lit("Python").alias("language"), text.alias("text"))


def _by_module(columns: str, rows: dict[int, list[tuple]]) -> str:
    """SQL that gives each event the rows of its module."""
    values = ", ".join("(" + ", ".join([str(m), *("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).upper() if isinstance(x, bool) else str(x) for x in row)]) + ")" for m, found in rows.items() for row in found)
    return f"SELECT event_id::VARCHAR AS path, {columns} FROM events JOIN (VALUES {values}) AS v(module, {columns}) ON module = {_MODULE_OF}"


#: Stand-ins for languages: a document is taken for a file of one of them.
LANGUAGE_OF = "CASE doc_id % 6 WHEN 0 THEN 'Rust' WHEN 1 THEN 'TypeScript' WHEN 2 THEN 'JavaScript' WHEN 3 THEN 'Go' WHEN 4 THEN 'Solidity' ELSE 'Python' END"


def _line_sql() -> str:
    """Every pattern as a branch; look-aheads, which this SQL lacks, are written out."""
    plain = {r"\bas\s+(?!const\b)[A-Z]\w*": r"\bas\s+[A-Z]\w*"}
    parts = [f"SELECT path, line, '{kind}' AS kind, '{priority}' AS priority FROM l WHERE language = '{language}' AND regexp_matches(txt, '{plain.get(pattern, pattern)}')" for language, kind, priority, pattern in D.LINE_PATTERNS]
    parts += [f"SELECT path, line, '{kind}', '{priority}' FROM l WHERE regexp_matches(txt, '{pattern}')" for kind, priority, pattern in D.MARKERS]
    return " UNION ALL ".join(parts)


@register("line_findings", f"""WITH s AS (SELECT doc_id::VARCHAR AS path, {LANGUAGE_OF} AS language, text FROM documents),
l AS (SELECT path, language, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM s) {_line_sql()}""")
def line_findings(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS STRING) AS path", f"{LANGUAGE_OF} AS language", "text")
    return D.line_findings(documents).withColumn("line", c("line").cast("long"))


#: What the modules hold, told by hand.
METRICS = {
    0: [("__init__", 4, 3, 1, 0, 0, 3), ("total", 7, 7, 1, 0, 0, 2)], 1: [("load", 1, 4, 2, 1, 0, 3), ("save", 6, 3, 1, 0, 0, 3)], 2: [("kind", 1, 10, 5, 8, 1, 1), ("rank", 12, 9, 4, 3, 1, 1)],
    3: [("subscribe", 2, 2, 1, 0, 0, 2), ("notify", 4, 3, 2, 1, 1, 2), ("get_size", 7, 2, 1, 0, 0, 1)],
}
FINDINGS = {
    0: [("Order", "", "dependency_injection", "", 1), ("Order", "total", "feature_envy", "other", 5)],
    1: [("", "", "hidden_type", "CodeParams", 2), ("", "", "magic_value", "42", 2), ("", "", "parameter_clump", "code,item_key,user_id", 2), ("", "", "primitive_obsession", "str:identifier", 6), ("", "load", "open_resource", "open", 1), ("", "load", "pipeline", "ListComp", 3)],
    2: [("", "", "magic_value", "3", 2), ("", "kind", "match", "top", 4), ("", "rank", "if_else_chain", "value", 3), ("", "rank", "pure_mapping", "", 3)],
    3: [("Bus", "", "observer", "", 1), ("Bus", "notify", "unbounded_collection", "self.items", 1), ("Bus", "subscribe", "callback", "handler", 1)],
}
CLASSES = {0: [("Order", "__init__", "Boilerplate"), ("Order", "total", "Substantive")], 3: [("Bus", "subscribe", "Delegating"), ("Bus", "notify", "Substantive"), ("Bus", "get_size", "TrivialAccessor")]}
API = {0: [("Order", "__init__", 0.255, False), ("Order", "total", 0.24, False)], 1: [("", "load", 0.805, True), ("", "save", 0.605, True)], 2: [("", "kind", 0.24, False), ("", "rank", 0.24, False)], 3: [("Bus", "subscribe", 0.24, False), ("Bus", "notify", 0.24, False), ("Bus", "get_size", 0.375, False)]}
PURITY = {0: [("__init__", False, 1.0), ("total", True, 1.0)], 1: [("load", False, 0.95), ("save", True, 0.95)], 2: [("kind", True, 0.95), ("rank", True, 0.95)], 3: [("subscribe", True, 0.8), ("notify", True, 0.8), ("get_size", True, 0.8)]}
COUNTS = {0: [(1, 0, 2, 1, False)], 1: [(0, 2, 0, 0, False)], 2: [(0, 2, 0, 0, False)], 3: [(1, 0, 3, 0, False)], 4: [(0, 0, 0, 0, False)]}
ADJUSTED = {0: [("__init__", 1), ("total", 1)], 1: [("load", 2), ("save", 1)], 2: [("kind", 4), ("rank", 4)], 3: [("subscribe", 1), ("notify", 2), ("get_size", 1)]}


@register("python_functions", _by_module("name, line, length, cyclomatic, cognitive, nesting, parameters", METRICS))
def python_functions(spark, sf_dir):
    return D.python_functions(_modules(spark, sf_dir)).where("error is null").select("path", "name", "line", "length", "cyclomatic", "cognitive", "nesting", "parameters")


#: Besides, the two classes are scattered over all files that stand for their modules.
_SCATTERED = " UNION ALL ".join(f"SELECT min(event_id::VARCHAR), '{name}', '', 'scattered_type', '{name}', count(*) FROM events WHERE {_MODULE_OF} = {m} HAVING count(*) > 1" for m, name in ((0, "Order"), (3, "Bus")))


@register("code_structure", f"{_by_module('owner, fn, kind, detail, n', FINDINGS)} UNION ALL {_SCATTERED}")
def code_structure(spark, sf_dir):
    return O.all_findings(materialize(facts(_modules(spark, sf_dir)), "facts"))


@register("method_classes", _by_module("owner, fn, detail", CLASSES))
def method_classes(spark, sf_dir):
    return O.method_classes(materialize(facts(_modules(spark, sf_dir)), "facts")).select("path", "owner", "fn", "detail")


@register("public_api", _by_module("owner, fn, score, is_public", API))
def public_api(spark, sf_dir):
    return O.public_api(materialize(facts(_modules(spark, sf_dir)), "facts"))


@register("purity_verdicts", _by_module("fn, is_pure, confidence", PURITY))
def purity_verdicts(spark, sf_dir):
    found = facts(_modules(spark, sf_dir), kinds=O.PURITY_FACTS)
    return O.purity(found, D.python_functions(_modules(spark, sf_dir)).where("error is null")).withColumn("confidence", F.round("confidence", 6))


@register("module_structure", _by_module("classes, functions, methods, imports, split", COUNTS))
def module_structure(spark, sf_dir):
    return O.module_structure(facts(_modules(spark, sf_dir)))


@register("adjusted_cyclomatic", _by_module("fn, adjusted", ADJUSTED))
def adjusted_cyclomatic(spark, sf_dir):
    found = facts(_modules(spark, sf_dir), kinds=("match",))
    return O.adjusted_cyclomatic(D.python_functions(_modules(spark, sf_dir)).where("error is null"), found)


@register("natspec_debt", "SELECT event_id::VARCHAR AS path, 2 AS line, 'missing_natspec' AS kind FROM events WHERE event_id % 3 = 0")
def natspec_debt(spark, sf_dir):
    contracts = F.array(F.lit("contract A {\n function f() public {}\n}"), F.lit("/// Pays.\nfunction g() external {}"), F.lit("function h() private {}"))
    sources = table(spark, sf_dir, "events").select(c("event_id").cast("string").alias("path"), F.lit("Solidity").alias("language"), F.element_at(contracts, (c("event_id") % 3 + 1).cast("int")).alias("text"))
    return D.natspec_debt(sources).drop("priority")


@register("todo_markers", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id::VARCHAR AS path, line, CASE WHEN regexp_matches(txt, '\\bFIXME\\b') THEN 'High' ELSE 'Medium' END AS priority FROM l WHERE regexp_matches(txt, '\\b(FIXME|HACK|TODO)\\b')""")
def todo_markers(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "txt"))
    priority = marker_priority(c("txt"), {pattern: priority for _, priority, pattern in D.MARKERS})
    return lines.select("path", (c("at") + 1).cast("long").alias("line"), priority.alias("priority")).where("priority is not null")


@register("marker_findings", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS txt, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id::VARCHAR AS path, line, 'license' AS kind FROM l WHERE regexp_matches(txt, 'icensed?|opyright')""")
def marker_findings(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(c("doc_id").cast("string").alias("path"), c("lang").alias("language"), "text")
    found = D.line_findings(documents, (("license", "Low", "icensed?|opyright"),))
    return found.select("path", c("line").cast("long").alias("line"), "kind")


@register("streamed_history", "SELECT user_id AS path, count(*) AS commits, count(*) FILTER (event_type = 'error') AS fixes, round(sum(value), 4) AS churn FROM events GROUP BY user_id")
def streamed_history(spark, sf_dir):
    folder = _folder(spark, "stream")
    counts = history.running_history(history.read_events(spark, sf_dir))
    history.write_latest(counts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{folder}/out").groupBy("path").agg(F.max("commits").alias("commits"), F.max_by("fixes", "commits").alias("fixes"), F.round(F.max_by("churn", "commits"), 4).alias("churn"))
