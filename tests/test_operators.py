"""Operators on hand-made inputs: graphs, paths, suppression, sources, sinks, detectors."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detectors as D
from tidemark.operators import filters as L
from tidemark.operators import graph as G
from tidemark.operators import joins as J
from tidemark.operators import windows as W
from tidemark.sources import config, files, lcov, sinks, snapshots

GRAPHS = {
    "self loop": [(1, 1)],
    "two cycle": [(1, 2), (2, 1)],
    "diamond": [(1, 2), (1, 3), (2, 4), (3, 4)],
    "chain": [(i, i + 1) for i in range(1, 10)],
    "apart": [(1, 2), (3, 4)],
}

SOURCES = [
    ("a.py", "Python", "import os\n\ndef load(path, a, b, c, d, e):\n    try:\n        return open(path).read()\n    except OSError:\n        pass\n\ndef test_load():\n    load('x', 1, 2, 3, 4, 5)\n"),
    ("b.py", "Python", "def broken(:\n"),
    ("c.rs", "Rust", "fn main() {\n    let x = f().unwrap(); // TODO check\n    let _ = g();\n    todo!()\n}\n"),
    ("d.ts", "TypeScript", "const x: any = y as Foo;\np.then(a).then(b).then(c);\n"),
    ("e.go", "Go", "v, _ := f()\npanic(1)\n"),
    ("f.sol", "Solidity", "require(tx.origin == owner);\naddr.call{value: 1}(\"\");\n"),
]


def _sources(spark):
    return spark.createDataFrame(SOURCES, "path string, language string, text string")


def edges(spark, name):
    return spark.createDataFrame(GRAPHS[name], "a long, b long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_closure_bounds(spark):
    chain = edges(spark, "chain")
    assert len(rows(G.closure(chain, 3))) == 9 + 8 + 7
    assert len(rows(G.closure(chain, 3, inclusive=False))) == 9 + 8
    assert rows(G.closure(edges(spark, "self loop"), 5)) == [(1, 1, 1)]
    assert rows(G.closure(edges(spark, "two cycle"), 5)) == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 2)]
    assert (1, 4, 2) in rows(G.closure(edges(spark, "diamond"), 5))


def test_cycles_and_components(spark):
    assert rows(G.cyclic(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "a long, b long"))) == [(1, False, True), (2, True, True), (3, True, True), (4, False, False)]
    assert rows(G.strong_components(edges(spark, "two cycle"))) == [(1, 1), (2, 1)]
    assert rows(G.strong_components(edges(spark, "apart"))) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_levels_and_layers(spark):
    assert rows(G.levels(edges(spark, "diamond"))) == [(1, 2), (2, 1), (3, 1), (4, 0)]
    assert rows(G.layering_score(edges(spark, "diamond"))) == [(1.0, 4, 0)]
    assert rows(G.layering_score(edges(spark, "two cycle"))) == [(0.0, 0, 2)]


def test_purity_spreads_upwards(spark):
    nodes = spark.createDataFrame([(1, True, 0.9), (2, True, 0.9), (3, False, 0.8), (4, True, 0.9), (5, True, 0.9)], "id long, is_pure boolean, confidence double")
    got = rows(G.propagated_purity(nodes, spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")))
    assert [r[:2] for r in got] == [(1, False), (2, False), (3, False), (4, True), (5, True)]
    assert got[3][2] == pytest.approx(0.81)


def test_communities_end(spark):
    two = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (10, 11), (11, 12), (10, 12)], "a long, b long")
    assert rows(G.communities(two)) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10)]


def test_reaching_definitions(spark):
    blocks = spark.createDataFrame([(1, "x", 10), (2, "x", 20), (3, "y", 30)], "block long, variable string, definition long")
    flow = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long")
    assert rows(G.reaching_definitions(blocks, flow)) == [(2, "x", 10), (3, "x", 10), (3, "x", 20), (4, "x", 10), (4, "x", 20), (4, "y", 30)]


def test_reaching_definitions_pass_as_bits(spark):
    """Against brute force, with more than 64 definitions to a variable and several to a block; cycles; steps hold no row for each definition."""
    import random

    rng = random.Random(5)
    own = sorted({(i, "xy"[rng.randrange(2)], rng.randrange(300)) for i in range(150)} | {(7, "x", -1), (7, "x", -2), (7, "y", -1)})
    pairs = sorted({(rng.randrange(160), rng.randrange(160)) for _ in range(330)} | {(3, 3), (8, 9), (9, 8)})
    into = {(b, v, d) for a, b in pairs for block, v, d in own if block == a}
    while True:
        more = into | {(b, v, d) for block, v, d in into for a, b in pairs if a == block and not any(o[:2] == (a, v) for o in own)}
        if more == into:
            break
        into = more
    written = []
    step, G.step = G.step, lambda df: written.append(df.count()) or step(df)
    try:
        got = rows(G.reaching_definitions(spark.createDataFrame(own, "block long, variable string, definition long"), spark.createDataFrame(pairs, "a long, b long")))
    finally:
        G.step = step
    assert got == sorted(into) and max(written) < len(got) / 4
    none = G.reaching_definitions(spark.createDataFrame([], "block long, variable string, definition long"), spark.createDataFrame(pairs, "a long, b long"))
    assert none.count() == 0


def test_reaching_definitions_pass_in_workers(spark, monkeypatch):
    """Steps that are written don't grow with the hops; by workers as by joins, with nulls, several definitions and blocks to one, loops, names for ids."""
    import random

    written = []
    step = G.step
    monkeypatch.setattr(G, "step", lambda df: written.append(1) or step(df))
    chain = spark.range(40).selectExpr("id a", "id + 1 b")
    assert rows(G.reaching_definitions(spark.createDataFrame([(0, "x", 7), (20, "x", 8)], "block long, variable string, definition long"), chain)) == sorted([(i, "x", 7) for i in range(1, 21)] + [(i, "x", 8) for i in range(21, 41)])
    assert len(written) <= 2
    rng = random.Random(9)
    own = [(f"b{rng.randrange(150)}", "xyz"[rng.randrange(3)], rng.randrange(900) * 10**15 + 1) for _ in range(1500)] + [(None, "x", 5), ("b1", None, 6), ("b2", "x", None), ("b3", "x", 7), ("b4", "x", 7), ("b4", "y", 7)]
    pairs = [(f"b{rng.randrange(160)}", f"b{rng.randrange(160)}") for _ in range(300)] + [("b3", None), (None, "b5"), ("b5", "b5")]
    own, pairs = spark.createDataFrame(own, "block string, variable string, definition long").distinct(), spark.createDataFrame(pairs, "a string, b string").distinct()
    by_workers, by_joins = G.definitions_by_bits(own, pairs), G._definitions_by_joins(own, pairs)
    assert by_workers.dtypes == by_joins.dtypes == [("block", "string"), ("variable", "string"), ("definition", "bigint")]
    ordered = [sorted(map(tuple, x.collect()), key=repr) for x in (by_workers, by_joins)]
    assert ordered[0] == ordered[1] and len(ordered[0]) > 3000 and any(r[0] is None for r in ordered[0])


def test_suffix_order(spark):
    q, p = spark.createDataFrame([("src/a.rs",), ("x/src/a.rs",)], "query string"), spark.createDataFrame([("src/a.rs",), ("y/src/a.rs",), ("./x/src\\a.rs",)], "path string")
    first = {r.query: (r.path, r.strategy) for r in J.suffix_match(q, p).collect()}
    assert first == {"src/a.rs": ("src/a.rs", "exact"), "x/src/a.rs": ("./x/src\\a.rs", "exact")}
    other = {r.query: r.strategy for r in J.suffix_match(q, p, suffix_first=True).collect()}
    assert other["src/a.rs"] == "query suffix"


def test_nearest_prefers_the_lower_place(spark):
    left, right = spark.createDataFrame([(1, "f", 10), (2, "f", 50)], "id int, k string, at int"), spark.createDataFrame([("f", 8, "a"), ("f", 12, "b")], "k string, p int, name string")
    assert [(r.id, r.name) for r in J.nearest_within(left, right, ["k"], "at", "p", 2, ["id"], ["name"]).orderBy("id").collect()] == [(1, "a"), (2, None)]


def test_nearest_passes_once_over_places(spark):
    """Against brute force; windows see each place of a key once and only look back."""
    import random

    rng = random.Random(4)
    left = [(i, rng.choice("ab"), rng.randrange(40)) for i in range(400)] + [(400, "c", 1), (401, None, 1), (402, "a", None)]
    right = [(rng.choice("abd"), rng.randrange(40), rng.randrange(1000)) for _ in range(25)] + [(None, 1, 5)]
    want = {i: min((abs(p - at), p, n) for key, p, n in right if key == k)[2] for i, k, at in left if k in ("a", "b") and at is not None}
    found = J.nearest(spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, p int, n int"), ["k"], ["id"], "at", "p", "n")
    assert dict(rows(found)) == want
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_suppression(spark):
    text = ["x", "// debt:ignore-start", "a", "b", "// debt:ignore-end", "c", "// debt:ignore-next-line", "d", "e // debt:ignore"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text, 1)], "file string, line int, txt string")
    got = [r.line for r in L.suppressed(df, "file", "line", F.col("txt"), "debt").where("suppressed").orderBy("line").collect()]
    assert {3, 4, 8, 9} <= set(got) and not {1, 6} & set(got)


def test_blocks_and_ranges(spark):
    df = spark.createDataFrame([("f", 1), ("f", 4), ("f", 5), ("g", 2)], "file string, line long")
    assert rows(W.merged_blocks(df, "file", "line", 3)) == [("f", 1, 6), ("f", 5, 7), ("g", 2, 4)]
    assert rows(W.compressed_ranges(df, "file", "line")) == [("f", "1, 4-5"), ("g", "2")]


def test_source_tree(spark, tmp_path):
    for name, text in {"a.rs": "fn a() {}\n", "b.py": "x = 1\ny = 2", "target/c.rs": "", "d.txt": "no", ".git/e.rs": "", "keep/f.rs": "1\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.read_sources(spark, str(tmp_path), ignore=["b.py"], gitignore=["target/", "*.rs", "!keep/*.rs"])
    assert [Path(r.path).name for r in found.collect()] == ["f.rs"]
    every = files.read_sources(spark, str(tmp_path), ["Rust", "Python"])
    assert {Path(r.path).name: r.n for r in every.select("path", files.count_lines(F.col("text")).alias("n")).collect()} == {"a.rs": 1, "b.py": 2, "f.rs": 1}


def test_lcov(spark, tmp_path):
    (tmp_path / "c.info").write_text("TN:\nSF:/p/a.rs\nFN:1,main\nFN:5,h\nFNDA:2,main\nFNDA:0,h\nDA:2,2\nDA:3,0\nDA:6,0\nLF:3\nLH:1\nend_of_record\nSF:b.rs\nend_of_record\n")
    records = lcov.read_records(spark, str(tmp_path / "c.info"))
    assert rows(lcov.functions(records).select("file", "name", "calls", "percent", F.array_join("uncovered", ","))) == [("/p/a.rs", "h", 0, 0.0, "6"), ("/p/a.rs", "main", 2, 50.0, "3")]
    assert rows(lcov.overall(records))[0][0] == pytest.approx(100 / 3)
    assert rows(lcov.by_file(lcov.functions(records))) == [("/p/a.rs", 0.25)]


def test_snapshot_and_plan(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"items": [{"location": {"file": "./a.rs", "function": "f", "line": 3}, "debt_type": {"GodObject": {"methods": 3}}, "unified_score": {"final_score": 85.5}}], "total_debt_score": 1.0}')
    row = snapshots.read_snapshot(spark, str(tmp_path / "s.json")).first()
    assert (row["file"], row["fn"], row["line"], row["debt_type"], row["score"], row["nesting"]) == ("a.rs", "f", 3, "GodObject", 85.5, None)
    plan = spark.createDataFrame([("# Plan\n**Location**: ./a.rs:f:3 \n",), ("none",)], "t string")
    assert [r[0] for r in plan.select(snapshots.target_location(F.col("t"))).collect()] == ["./a.rs:f:3", None]
    log = spark.createDataFrame([("abcdef1|1700000000|fix: a|b",), ("junk",)], "value string")
    assert [r.message for r in snapshots.commits_of_log(log).collect()] == ["fix: a|b"]


def test_config_layers(tmp_path):
    (tmp_path / "p.toml").write_text("[thresholds]\nscore = 5.0\n")
    values, source = config.load([tmp_path / "p.toml"], {"TIDEMARK_THRESHOLDS_SCORE": "7.5", "OTHER": "1"})
    assert values["thresholds"]["score"] == 7.5 and source["thresholds.score"] == "environment" and source["view.hide_t4"] == "defaults"
    with pytest.raises(ValueError, match="missing.toml"):
        config.load([tmp_path / "missing.toml"], {})


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("function", "a|b.rs", 1, 5.0), ("function", "a|b.rs", 1, 4.0), ("file", "c.rs", None, 3.0)], "kind string, file string, line int, score double")
    out = [r.json for r in sinks.unified_rows(items, ["kind", "file", "line"], [F.col("score").desc()]).collect()]
    assert sorted(out) == ['{"type":"File","file":"c.rs","score":3.0}', '{"type":"Function","file":"a|b.rs","line":1,"score":5.0}']
    assert "a\\|b.rs" in sinks.markdown(items, ["file", "score"])
    graph = sinks.dot(spark.createDataFrame([("x/a", "y/b", 2.0), ("x/a", "x/c", 0.5)], "a string, b string, score double"), 1.0)
    assert '"x/a" -> "y/b"' in graph and "x/c" not in graph
    sinks.write_snapshot(items, str(tmp_path / "s"), "one")
    sinks.write_snapshot(items, str(tmp_path / "s"), "two")
    assert spark.read.parquet(str(tmp_path / "s")).where("snapshot = 'two'").count() == 3


def test_python_metrics():
    source = "def f(a, b):\n    if a and b:\n        for x in a:\n            if x:\n                return 7\n    elif b:\n        return 7\n    return open('x')\n"
    (m,) = D.function_metrics(source)
    assert (m["cyclomatic"], m["nesting"], m["length"], m["io"], m["is_pure"], m["magic"]) == (6, 3, 8, ["file"], False, 1)
    assert D.function_metrics("") == []
    deep = "def g():\n    return " + "(" * 50 + "1" + ")" * 50
    assert D.function_metrics(deep)[0]["cyclomatic"] == 1


def test_detectors(spark):
    lines = rows(D.line_findings(_sources(spark)).select("path", "line", "kind"))
    assert {("c.rs", 2, "panic"), ("c.rs", 2, "TODO"), ("c.rs", 3, "error_swallowing"), ("d.ts", 1, "any_type"), ("e.go", 1, "ignored_error"), ("f.sol", 1, "tx_origin")} <= set(lines)
    functions = D.python_functions(_sources(spark)).cache()
    assert [r.path for r in functions.where("error is not null").collect()] == ["b.py"]
    assert {("a.py", 3, "long_parameter_list"), ("a.py", 3, "error_swallowing"), ("a.py", 9, "no_assertion")} <= set(rows(D.metric_findings(functions).select("path", "line", "kind")))
    assert [D.test_kind(n, p, "") for n, p in (("test_a", "src/a.py"), ("test_b", "tests/b.py"), ("bench_c", "c"), ("prop_d", "d"), ("e", "e"))] == ["unit", "integration", "benchmark", "property", None]


def test_copies_of_a_source_are_read_once(spark):
    from tidemark.plans.source_queries import _modules

    read = []
    reader = D.reading_once(lambda text: read.append(text) or [text], most=6)
    assert [reader(x) for x in ("ab", "cd", "ab", "efg", "cd", "ab", "too long", "too long")] == [["ab"], ["cd"], ["ab"], ["efg"], ["cd"], ["ab"], ["too long"], ["too long"]]
    assert read == ["ab", "cd", "efg", "ab", "too long", "too long"]
    assert _modules(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    twice = _sources(spark).unionByName(_sources(spark)).coalesce(1)
    assert [r.path for r in D.python_functions(twice).where("error is not null").collect()] == ["b.py", "b.py"]
    assert rows(D.python_functions(twice).select("path", "name", "line")) == sorted(2 * rows(D.python_functions(_sources(spark)).select("path", "name", "line")), key=lambda r: (r[0], r[1] or ""))


def test_facts_of_some_kinds(spark):
    from tidemark.operators.code_facts import facts

    every = facts(_sources(spark))
    assert rows(facts(_sources(spark), kinds=("call", "signature"))) == rows(every.where("kind IN ('call', 'signature', 'error')")) != rows(every)


def test_purity_reads_no_other_facts(spark):
    from tidemark.operators import organization as O
    from tidemark.operators.code_facts import facts

    text = "class A:\n    def put(self, x):\n        self.x = x\n    def get(self):\n        return self.x\ndef g():\n    global n\n    n = 1\n"
    sources = spark.createDataFrame([("a.py", "Python", text)], "path string, language string, text string").unionByName(_sources(spark))
    functions = D.python_functions(sources).where("error is null").cache()
    few = rows(O.purity(facts(sources, kinds=O.PURITY_FACTS), functions))
    assert few == rows(O.purity(facts(sources), functions)) and {("a.py", "put", False), ("a.py", "get", True), ("a.py", "g", False)} <= {r[:3] for r in few}


def test_line_patterns_take_words_as_ascii(spark):
    lines = [("a", "TypeScript", "déas Foo"), ("b", "Solidity", "énow\nnowé\nnowx"), ("c", "Python", "xTODO\néTODO"), ("d", "TypeScript", ".then(\u2028.then(\r.then("), ("e", "Rust", "tokio::spawn(x);\x0b"), ("f", "Python", "except :\r")]
    got = rows(D.line_findings(spark.createDataFrame(lines, "path string, language string, text string")).select("path", "line", "kind"))
    assert got == [("a", 1, "type_assertion"), ("b", 1, "timestamp"), ("b", 2, "timestamp"), ("c", 2, "TODO"), ("d", 1, "promise_chain"), ("f", 1, "bare_except")]


def test_demangled_names(spark):
    from tidemark.functions.demangle import demangled, readable

    names = {"_ZN3foo3bar17h0123456789abcdefE": "foo::bar", "_ZN4core3fmt9Formatter3fooE": "core::fmt::Formatter::foo", "plain": "plain", "_ZN3fo": "_ZN3fo", "_ZN16_$LT$T$u20$as$GT$1fE": "_ZN16_$LT$T$u20$as$GT$1fE", "_ZN13Vec$LT$T$GT$x1fE": "Vec<T>x::f"}
    assert {n: readable(n) for n in names} == names
    assert readable(None) is None
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r[0] for r in df.select(demangled(F.col("s"))).collect()] == list(names.values())


def test_extension_points(spark):
    from tidemark.operators import context as X

    registry = X.Registry()
    with pytest.raises(ValueError):
        registry.contributions(spark.range(1))
    registry.register("b", lambda t: t.select("target", F.lit(1.0).alias("contribution")), 5.0)
    with pytest.raises(ValueError):
        registry.register("b", lambda t: t)
    base = spark.createDataFrame([(1, 2.0)], "target long, base double")
    assert X.contextual_risk(registry.contributions(base), base).first().risk == 6.0
    out = X.pipeline(spark.range(5), [("drop", True, lambda d: d.where("id > 1")), ("skipped", False, lambda d: d.where("false"))])
    assert out.count() == 3
    with pytest.raises(ValueError, match="one; three"):
        X.all_errors([("one", False), ("two", True), ("three", False)])


CODE = {
    "a.py": "import threading\n__all__ = ['run']\nT = {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10}\nclass Builder:\n    def with_a(self, a):\n        self.a = a\n        return self\n    def with_b(self, b):\n        self.b = b\n        return self\n    def build(self):\n        return self.a\n@app.route('/')\nasync def run(p: int, q: int) -> int:\n    f = open('x')\n    threading.Thread(target=worker)\n    return f\ndef worker():\n    while True:\n        items.append(1)\n",
    "b.py": "class A(Base):\n    pass\nclass B(Base):\n    pass\nclass C(Base):\n    def fill(self):\n        self.a = 1\n        self.b = 3\n        self.c = 4\n        self.d = 5\n        self.e = 6\ndef use(x: Builder):\n    return visit_all(x)\ndef visit_all(x):\n    if isinstance(x, A):\n        return 1\n    elif isinstance(x, B):\n        return 2\n    elif isinstance(x, C):\n        return 3\n",
    "utils.py": "class A:\n    pass\ndef f(a, b, c, d, e, g):\n    return a\ndef h(a, b, c, d, e, g):\n    return b\n",
    "bad.py": "def (",
}


def test_organization(spark):
    from tidemark.operators import organization as O
    from tidemark.operators.code_facts import facts

    found = facts(spark.createDataFrame([(p, "Python", t) for p, t in CODE.items()] + [("none.py", "Python", None), ("x.rs", "Rust", "def (")], "path string, language string, text string")).cache()
    assert rows(found.where("kind = 'error'").select("path", "name")) == [("bad.py", "SyntaxError")]
    kinds = {(r.path, r.owner, r.fn, r.kind) for r in O.all_findings(found).collect()}
    assert {
        ("a.py", "", "", "registry"), ("a.py", "Builder", "", "builder"), ("a.py", "", "run", "framework_managed"), ("a.py", "", "run", "async_resource"), ("a.py", "", "run", "parallel_execution"), ("a.py", "", "worker", "function_value"), ("a.py", "", "worker", "unbounded_collection"),
        ("b.py", "", "", "boilerplate"), ("b.py", "C", "fill", "struct_initialization"), ("b.py", "Base", "", "strategy"), ("b.py", "", "visit_all", "visitor"), ("b.py", "Builder", "use", "orphaned_function"), ("b.py", "A", "", "scattered_type"),
        ("utils.py", "", "", "utility_sprawl"), ("utils.py", "", "f", "parameter_list"), ("utils.py", "", "", "parameter_clump"), ("utils.py", "", "", "hidden_type"),
    } <= kinds
    assert {(r.owner, r.methods, r.fields) for r in O.classes(found).where("path = 'a.py'").collect()} == {("Builder", 3, 2)}
    assert rows(O.god_objects(found, most_methods=2).select("owner")) == [("Builder",)]
    assert ("b.py", "use", "visit_all", "b.py") in rows(O.call_edges(found))
    assert O.all_findings(found.where("false")).count() == 0


def test_splits_and_scores(spark):
    from tidemark.operators import organization as O

    splits = spark.createDataFrame([("Utils", ["get_a", "get_b"], [], 4), ("Order", ["add_item", "drop_item", "total"], ["Order"], 1)], "split string, methods array<string>, types array<string>, most_parameters int")
    assert rows(O.split_problems(splits)) == [("Utils", "lack_of_type_ownership", "Medium"), ("Utils", "parameter_passing", "Medium"), ("Utils", "technical_grouping", "High"), ("Utils", "utilities_module", "Critical")]
    big = [f"read_row_{i}" for i in range(12)]
    groups = spark.createDataFrame([("g", "big", big, 20, 0.9), ("g", "small", [f"read_row_{i}" for i in range(9)], 5, None), ("g", "other", ["zap"], 5, None), ("g", "loose", [f"x{i}" for i in range(11)], 5, 0.1)], "group string, split string, methods array<string>, lines int, cohesion double")
    assert [(r.split, len(r.methods), r.lines, r.merged) for r in O.refined_splits(groups).collect()] == [("big", 21, 25, 1)]
    one = spark.range(1)
    values = one.select(
        O.mapping_adjusted(F.lit(10), F.lit(2), F.lit(True), F.lit(0.5)).alias("a"), O.mapping_adjusted(F.lit(10), F.lit(2), F.lit(False), F.lit(0.5)).alias("b"), O.should_flag(F.lit(4), F.lit(4), F.lit(19), F.lit("CoreLogic")).alias("c"), O.should_flag(F.lit(4), F.lit(4), F.lit(20), F.lit("CoreLogic")).alias("d"),
        O.should_flag(F.lit(5), F.lit(0), F.lit(1), F.lit("Test")).alias("e"), O.composition_score(F.lit(0), F.lit(0), F.lit(1.0)).alias("f"), O.composition_score(F.lit(2), F.lit(4), F.lit(1.0)).alias("g"), O.purity_confidence(F.lit(True), F.lit(False), F.lit(1), F.lit(2), F.lit(2), F.lit(True), F.lit(False)).alias("h"),
    ).first()
    assert values[:7] == pytest.approx((10 * 0.5 * 0.3 + 1.4, 10.0, False, True, False, 0.0, 0.4 + 0.3)) and values.h == pytest.approx(max(0.5, 0.8 * 0.85 * 0.95 * 0.95**2 * 0.85))
    raw = spark.createDataFrame([("f", 5, 7), ("g", 1, 0)], "fn string, cyclomatic int, cognitive int")
    assert rows(O.attribution(raw, spark.createDataFrame([("f", 4, 6), ("g", 1, 1)], raw.schema))) == [("f", 10, 2), ("g", 2, 0)]


def reach_of(pairs):
    out = {x: {b for a, b in pairs if a == x} for x in {x for p in pairs for x in p}}
    while True:
        more = {x: ys | {z for y in ys for z in out[y]} for x, ys in out.items()}
        if more == out:
            return out
        out = more


@pytest.mark.parametrize("seed", range(3))
def test_graphs_by_brute_force(spark, seed):
    """Bow ties, tails and islands: components, radii, cycles, levels, clustering and betweenness."""
    import itertools
    import random

    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(48)} | {(50, 51), (51, 50), (51, 52), (60, 60)})
    got, reach = spark.createDataFrame(pairs, "a long, b long"), reach_of(pairs)
    nodes = sorted(reach)
    component = {x: min([x, *(y for y in reach[x] if x in reach[y])]) for x in nodes}
    assert dict(rows(G.strong_components(got))) == component
    assert dict(rows(G.blast_radius(got))) == {x: len({y for y in nodes if x in reach[y]} | {x}) for x in nodes}
    assert {r[0]: r[1:] for r in rows(G.cyclic(got))} == {x: (x in reach[x], any(y in reach[y] for y in reach[x] | {x})) for x in nodes}
    level = {x: 0 for x in nodes}
    for _ in nodes:
        level = {x: max(level[y] for y in nodes if component[y] == component[x]) for x in nodes}
        level = {x: max([level[x], *(level[b] + 1 for a, b in pairs if component[a] == component[x] != component[b])]) for x in nodes}
    assert dict(rows(G.levels(got))) == level
    calls = {x: {b for a, b in pairs if a == x} for x in nodes}
    for mutual in (False, True):
        want = {}
        for x in nodes:
            k = calls[x]
            closed = sum((q in calls[p]) + (p in calls[q]) if not mutual else (q in calls[p] and p in calls[q]) for p, q in itertools.combinations(sorted(k - {x}), 2))
            want[x] = closed / (len(k) * (len(k) - 1) / (2 if mutual else 1)) if len(k) >= 2 else 0.0
        assert dict(rows(G.clustering(got, mutual))) == pytest.approx(want)


def test_pairs_on_shortest_paths(spark):
    """By matrix against the walk and by hand; more nodes than a block or a word has, self loops, parts apart, over 126 hops, names for ids."""
    import random

    from tidemark.operators.centrality import pairs_by_matrix, pairs_through

    rng = random.Random(3)
    pairs = sorted({(rng.randrange(200), rng.randrange(200)) for _ in range(320)} | {(3, 3), (300, 301), (301, 300), (400, 400)})
    got = spark.createDataFrame(pairs, "a long, b long")
    walked = dict(rows(G._pairs_by_walk(got)))
    assert {k: n for k, n in rows(pairs_by_matrix(got)) if n} == walked and len(walked) > 100
    n = 200
    chain = np.arange(n - 1)
    assert (pairs_through(n, chain, chain + 1, 0, 2) + pairs_through(n, chain, chain + 1, 1, 2)).tolist() == [i * (n - 1 - i) for i in range(n)]
    assert rows(G.betweenness(spark.createDataFrame([("x", "y"), ("y", "z")], "a string, b string"))) == [("x", 0.0), ("y", 0.5), ("z", 0.0)]
    assert rows(G.betweenness(spark.createDataFrame([], "a long, b long"))) == []


def test_pairs_of_larger_graphs_are_not_written(spark, monkeypatch):
    """Above the matrix's bound, walks by sources equal the matrix: chains, cycles alone and with tails, lengths that differ, fronts that are split; no table of pairs is written."""
    import random

    from tidemark.operators import centrality

    rng = random.Random(4)
    base = sorted({(x, y) for x, y in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if x != y})
    # Each third link passes a new node, each node below 20 is drawn out to a chain of three.
    drawn = [link for i, (x, y) in enumerate(base) for link in ([(x, 100 + i), (100 + i, y)] if i % 3 == 0 else [(x, y)])]
    drawn = [(x + 1000 if x < 20 else x, y) for x, y in drawn] + [link for x in range(20) for link in ((x, x + 500), (x + 500, x + 1000))]
    pairs = sorted({*drawn, (7000, 7001), (7001, 7002), (7002, 7000), (8000, 8001), (8001, 8000), (8001, 8002), (9, 9)})
    got = spark.createDataFrame(pairs, "a long, b long")
    want = rows(G.betweenness(got))
    monkeypatch.setattr(G, "MOST_NODES", 5)
    written = []
    step = G.step
    monkeypatch.setattr(G, "step", lambda df: written.append(1) or step(df))
    assert rows(G.betweenness(got)) == want and len(written) == 1
    order = np.unique(pairs, return_inverse=True)[1].reshape(-1, 2)
    order = order[order[:, 0] != order[:, 1]]
    chain, place, between = centrality.chains(int(order.max()) + 1, *order.T)
    assert 3 in np.bincount(chain) and place.max() >= 2
    links = chain[order[between]]
    links = links[np.argsort(links[:, 0], kind="stable")]
    n = int(chain.max()) + 1
    through = lambda: sum(centrality.pairs_walked(n, np.searchsorted(links[:, 0], np.arange(n + 1)), links[:, 1], chain, place, first, 2) for first in range(2))
    whole = through().tolist()
    monkeypatch.setattr(centrality, "MADE", 20)
    assert through().tolist() == whole and sum(whole) > 1000
    named = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "a string, b string")
    assert dict(rows(G.betweenness(named))) == pytest.approx({f"n{i}": i * (9 - i) / 72 for i in range(10)})


def test_ranges_number_all_rows(spark):
    from tidemark.operators.relational import ranked
    from tidemark.operators.running import running

    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k long, v long")
    assert [(r.k, r.place) for r in ranked(df, [F.col("k").desc()]).orderBy("place").collect()] == [(999 - i, i + 1) for i in range(1000)]
    got = running(df, [F.col("k")], {"before": "v"}, "n").orderBy("k").collect()
    total = 0
    for i, r in enumerate(got):
        assert (r.n, r.before) == (i, total)
        total += r.v
    assert running(df.where("false"), [F.col("k")], {"before": "v"}).count() == 0


def test_source_tree_leaves_out_bad_bytes(spark, tmp_path):
    (tmp_path / "good.rs").write_text("fn a() {}\n")
    (tmp_path / "bad.rs").write_bytes(b"fn \xff\xfe")
    (tmp_path / "out.rs").write_text("x")
    (tmp_path / ".gitignore").write_text("out.*\n")
    assert [Path(r.path).name for r in files.read_sources(spark, str(tmp_path)).collect()] == ["good.rs"]


def test_calls_meet_one_definition(spark):
    calls = spark.createDataFrame([(1, "a.py", "f"), (2, "b.py", "f"), (3, "c.py", "g"), (4, "c.py", "stop")], "call long, file string, name string")
    known = spark.createDataFrame([(10, "b.py", "f"), (9, "x.py", "f"), (11, "b.py", "f"), (12, "c.py", "stop")], "definition long, file string, name string")
    assert rows(J.resolve_calls(calls, known, ["stop"])) == [(1, 9), (2, 10), (3, None), (4, None)]


def test_method_clusters(spark):
    from tidemark.operators import clusters as M

    methods = [("t", f"read_{i}") for i in range(4)] + [("t", f"write_{i}") for i in range(4)] + [("t", "alone"), ("t", None), ("big", "x")] + [("big", f"m{i}") for i in range(250)]
    calls = [("t", f"{w}_{i}", f"{w}_{j}", 1) for w in ("read", "write") for i in range(4) for j in range(i)] + [("t", "read_0", "write_0", 1), ("big", "m1", "m2", 1), ("t", None, "read_0", 1)]
    known, edges_ = spark.createDataFrame(methods, "grp string, method string"), spark.createDataFrame(calls, "grp string, a string, b string, n long")
    found = M.method_clusters(known, edges_).collect()
    clusters = {}
    for r in found:
        clusters.setdefault((r.grp, r.cluster, r.category, r.cohesion), set()).add(r.method)
    assert {k[2]: v for k, v in clusters.items()} == {w: {f"{w}_{i}" for i in range(4)} for w in ("read", "write")}
    assert {k[3] for k in clusters} == {round(6 / 7, 6)} and {k[0] for k in clusters} == {"t"}
    hybrid = M.method_clusters(known, edges_, hybrid=True).collect()
    assert {r.category for r in hybrid} == {"read", "write", "alone"} and len(hybrid) == 9
    assert M.method_clusters(known.where("false"), edges_).count() == 0
    many = [f"a_{i}" for i in range(12)]
    links = {m: M.Counter() for m in many}
    for lot in (many[:4], many[4:8]):
        for x in lot:
            links[x].update({y: 1 for y in lot if y != x})
    assert M.hybrid_of(many, links) == [("a", many[:4]), ("a", many[4:8]), ("a", many[8:])]


def test_blame(spark):
    head = "0123456789012345678901234567890123456789 3 {} 1\nauthor A B\nauthor-mail <a@b>\nauthor-time 1700000000\nfilename f\n\t{}\n"
    got = snapshots.blame_of(spark.createDataFrame([("f", head.format(1, "x = 1") + head.format(2, "author fake")), ("g", ""), ("h", None)], "path string, text string"))
    assert [(r.path, r.line, r.author, r["at"].year) for r in got.orderBy("line").collect()] == [("f", 1, "A B", 2023), ("f", 2, "A B", 2023)]


def test_resumed_stages(spark, tmp_path):
    from tidemark.operators import context as X

    runs = []

    def stage(name):
        def run(df):
            runs.append(name)
            if name == "b" and runs.count("b") == 1:
                raise RuntimeError("lost")
            return df.withColumn(name, F.lit(1))

        return name, run

    stages = [stage("a"), stage("b")]
    with pytest.raises(RuntimeError):
        X.resumable(spark.range(3), stages, str(tmp_path))
    assert X.resumable(spark.range(3), stages, str(tmp_path)).columns == ["id", "a", "b"] and runs == ["a", "b", "b"]


def test_parse_time_is_bounded(spark):
    from tidemark.operators.code_facts import facts

    slow = "x = 1\n" + "def f(a):\n    return [a, a, a]\n" * 20_000
    got = facts(spark.createDataFrame([("slow.py", "Python", slow), ("ok.py", "Python", "def f():\n    return 1\n")], "path string, language string, text string").coalesce(1), seconds=0.05)
    assert {(r.path, r.name) for r in got.where("kind = 'error'").collect()} == {("slow.py", "TimeoutError")} and got.where("path = 'ok.py'").count() > 0


def test_readers_of_other_languages():
    from tidemark.operators import braces as B

    (only,) = B.function_metrics("fn f() { let c = '{'; let s = r#\"}\"#; /* { */ let l: &'static str = \"}\"; if c == '}' { g::<u8>(); } }", "Rust")
    assert (only["cyclomatic"], only["nesting"], only["calls"]) == (2, 1, [])
    names = [r["name"] for r in B.function_metrics("const a = function () { return /[/\"]}/ }\nconst b = x => x ? 1 : 2\nclass K { get v() { return `}` } if(x) {} }\nf(() => 1)", "JavaScript")]
    assert names[:3] == ["a", "b", "v"]
    chain = "func f(a int) {\n" + " else ".join(f"if a == {i} {{ g() }}" for i in range(3000)) + "\n}"
    assert B.function_metrics(chain, "Go")[0]["cyclomatic"] == 3001
    flat = B.function_metrics(chain.replace("func f(a int)", "fn f(a: i32)"), "Rust")[0]
    assert (flat["cyclomatic"], flat["cognitive"], flat["nesting"]) == (3001, 3000, 1)
    assert len(B.function_metrics("/* a /* b */ } */ fn f() {}", "Rust")) == 1
    for bad in ("fn f( {", "fn f() { \"abc }", "/* never", "/* /* */ fn f() {}", "}"):
        with pytest.raises(ValueError):
            B.function_metrics(bad, "Rust")
    for language in B.RULES:
        assert B.function_metrics("", language) == [] and B.facts_of("\n \n", language) == []


def test_reader_time_is_linear():
    import time

    from tidemark.operators import braces as B

    one = "#[inline]\npub fn f(a: i32) -> i32 { if a > 1 { g(a) } else { match a { 1 => h(|x| x), _ => 2 } } }\n"

    def took(n):
        began = time.perf_counter()
        assert len(B.function_metrics(one * n, "Rust")) == n
        return time.perf_counter() - began

    took(100)
    assert took(4000) < 12 * max(took(1000), 0.02)


def test_readers_on_odd_tables(spark):
    from tidemark.operators import parsers as P

    rows = [("a.rs", "Rust", None, 1), ("b.go", "Go", "func f() {", 2), ("c.rs", "Rust", "fn f() {}", 3), ("c.rs", "Rust", "fn f() {}", 3), ("d.txt", "Text", "fn f() {}", 4), (None, "Python", "def g(): pass", 5), ("e.rs", None, "fn h() {}", 6), ("g.sol", "Solidity", "((((" * 5000 + "))))" * 5000, 7)]
    sources = spark.createDataFrame(rows, "path string, language string, text string, name int")
    found = P.functions(sources).collect()
    assert sorted((str(r["path"]), r["name"]) for r in found if not r["error"]) == [("None", "g"), ("c.rs", "f"), ("c.rs", "f")]
    assert {r["path"] for r in found if r["error"]} == {"b.go", "g.sol"}
    assert {r["path"] for r in P.facts(sources).where("kind = 'error'").collect()} == {"b.go", "g.sol"}
    empty = sources.limit(0)
    assert P.functions(empty).count() == P.facts(empty).count() == P.error_prone(empty).count() == P.structural_patterns(P.functions(empty), P.facts(empty)).count() == 0
    prone = P.error_prone(spark.createDataFrame([("x.rs", "Rust", 'a.expect("why").expect("failed")\nb.expect("error")\nlet x: Result<u8> = f();\n#[test]\npanic!("x")'), ("y.rs", "Rust", None)], "path string, language string, text string"))
    assert sorted((r["line"], r["kind"], r["col"]) for r in prone.collect()) == [(2, "bare_expect", 2), (3, "ignored_result", 8)]


def test_facts_of_other_languages():
    from tidemark.operators import braces as B

    def of(language, text, *kinds):
        return [(r[1], r[2], r[3], r[4]) for r in sorted(B.facts_of(text, language), key=lambda r: (r[6], r[0], r[5])) if r[0] in kinds]

    assert of("Go", "func (s *S) F(a, b int, c string, d ...[]int) { s.x = 1\n s.y.Get(s.z) }", "parameter", "field_write", "field_read", "call") == [
        ("S", "F", "x", ""), ("S", "F", "a", "int"), ("S", "F", "b", "int"), ("S", "F", "c", "str"), ("S", "F", "d", "[]int"), ("S", "F", "Get", "self.y"), ("S", "F", "y", ""), ("S", "F", "z", "")]
    assert of("Rust", "impl A { fn f(&mut self, id: &str, m: HashMap<u8, (i32, i32)>) -> &Self { self.g(self.n); self } }", "parameter", "call", "function") == [
        ("A", "f", "g", "self"), ("A", "f", "self", "plain"), ("A", "f", "id", "str"), ("A", "f", "m", "HashMap<u8,(i32,i32)>")]
    assert of("Solidity", "contract C { function f(uint256 n, string memory s) public { } }", "parameter") == [("C", "f", "n", "int"), ("C", "f", "s", "str")]
    assert of("TypeScript", "const f = async (a?: boolean, b: string = 'x') => { switch (a) { case 1: { switch (b) { default: } } } }", "parameter", "match", "visibility") == [
        ("", "f", "default", "inner"), ("", "f", "open", "top"), ("", "f", "a", "bool"), ("", "f", "b", "str"), ("", "f", "private", "")]
    (arrow,) = B.function_metrics("const f = async (a) => { await g(a) }", "JavaScript")
    assert arrow["is_async"] and arrow["cognitive"] == 1
