"""Debt detectors: rows (path, line, kind, priority, message) from source text.

Python is parsed with its own parser, file by file, on the executors. For the
other languages, detectors are line patterns: native, and approximations of
what a parser would say.
"""

from __future__ import annotations

import ast
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shipping import ship

# Language, kind, priority, pattern of a line.
LINE_PATTERNS = (
    ("Rust", "panic", "Medium", r"\.unwrap\(\)|\.expect\(|\bpanic!|\bunreachable!"),
    ("Rust", "todo", "Low", r"\btodo!|\bunimplemented!"),
    ("Rust", "error_swallowing", "High", r"\blet\s+_\s*=|\.ok\(\)\s*;|if let Ok\(|\.unwrap_or_default\(\)"),
    ("Rust", "async_error", "High", r"tokio::spawn\([^;]*\);\s*$|\.await\.ok\(\)"),
    ("Rust", "error_context_lost", "Medium", r"map_err\(\|_\|"),
    ("Rust", "error_type_erased", "Low", r"Box<dyn\s+(std::error::)?Error|Result<[^>]*,\s*String>"),
    ("Rust", "flaky", "Medium", r"thread::sleep|Instant::now|SystemTime::now|rand::|env::var"),
    ("TypeScript", "any_type", "Medium", r":\s*any\b|<any>|\bas\s+any\b"),
    ("TypeScript", "type_assertion", "Low", r"\bas\s+(?!const\b)[A-Z]\w*"),
    ("TypeScript", "non_null", "Low", r"\w!\.|\w!\)|\w!;"),
    ("TypeScript", "promise_chain", "Medium", r"\.then\(.*\.then\(.*\.then\("),
    ("JavaScript", "promise_chain", "Medium", r"\.then\(.*\.then\(.*\.then\("),
    ("JavaScript", "loose_equality", "Low", r"[^=!]==[^=]"),
    ("Go", "ignored_error", "High", r",\s*_\s*:?=|^\s*_\s*=\s*\w+\("),
    ("Go", "panic", "Medium", r"\bpanic\("),
    ("Go", "goroutine", "Low", r"\bgo\s+func\("),
    ("Solidity", "tx_origin", "High", r"\btx\.origin\b"),
    ("Solidity", "low_level_call", "High", r"\.(call|delegatecall)\s*[({]"),
    ("Solidity", "timestamp", "Low", r"\bblock\.timestamp\b|\bnow\b"),
    ("Solidity", "selfdestruct", "High", r"\bselfdestruct\s*\("),
    ("Python", "bare_except", "High", r"^\s*except\s*:"),
)
MARKERS = (("FIXME", "High", r"\bFIXME\b"), ("HACK", "Medium", r"\bHACK\b"), ("TODO", "Medium", r"\bTODO\b"))
IO_WORDS = {"file": ("open(", "read_text", "write_text", "Path("), "network": ("requests.", "urlopen", "socket."), "console": ("print(", "input("), "database": ("cursor(", "execute(", "connect("), "process": ("subprocess.", "os.system")}


def _ascii_pattern(pattern: str) -> str:
    """A line's pattern with ASCII words and spaces and no line ends but newlines, whatever the JVM's version takes them for: older ones count letters like é into words at a boundary.

    A boundary before a letter is looked for behind that letter, so most places fail at one comparison.
    """
    plain = {r"\b": r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))", r"\s": r"[\t\n\f\r ]"}
    return "(?d)" + re.sub(r"\\b([A-Za-z0-9_])(?![*+?{])|\\.", lambda m: rf"{m[1]}(?<!\w{m[1]})" if m[1] else plain.get(m[0], m[0]), pattern)


def line_findings(sources: DataFrame, markers: tuple[tuple[str, str, str], ...] = MARKERS) -> DataFrame:
    """(path, line, kind, priority) of ``sources`` (path, language, text) by line patterns and markers; native."""
    lines = sources.select("path", "language", F.posexplode(F.split("text", "\n")).alias("at", "txt"))
    hits = [F.when((F.col("language") == language) & F.col("txt").rlike(_ascii_pattern(pattern)), F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))) for language, kind, priority, pattern in LINE_PATTERNS]
    hits += [F.when(F.col("txt").rlike(_ascii_pattern(pattern)), F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))) for kind, priority, pattern in markers]
    return lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("path", "line", "hit.*")


def natspec_debt(sources: DataFrame) -> DataFrame:
    """(path, line, kind, priority): public and external Solidity functions whose line before is no doc comment; native."""
    lines = sources.where("language = 'Solidity'").select("path", F.posexplode(F.split("text", "\n")).alias("at", "txt"))
    before = F.lag(F.trim("txt")).over(Window.partitionBy("path").orderBy("at"))
    bare = F.col("txt").rlike(r"^\s*function\s+\w+.*\b(public|external)\b") & ~F.coalesce(F.col("before").rlike(r"^(///|\*/|\*)"), F.lit(False))
    return lines.withColumn("before", before).where(bare).select("path", (F.col("at") + 1).alias("line"), F.lit("missing_natspec").alias("kind"), F.lit("Low").alias("priority"))


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _inside(function: ast.AST) -> Iterator[tuple[ast.AST, int]]:
    """Nodes of a function with their nesting depth, those of functions within it left out; iterative."""
    stack = [(child, 0) for child in ast.iter_child_nodes(function)]
    while stack:
        node, depth = stack.pop()
        yield node, depth
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            continue
        deeper = depth + isinstance(node, _NESTING)
        for child in ast.iter_child_nodes(node):
            # elif continues its if, so it is no deeper.
            chained = isinstance(node, ast.If) and isinstance(child, ast.If) and node.orelse == [child]
            stack.append((child, depth if chained else deeper))


def function_metrics(text: str) -> list[dict]:
    """Metrics of each function of a Python source, in order of their lines; SyntaxError if it can't be parsed."""
    tree = ast.parse(text)
    lines = text.split("\n")
    out = []
    for node in ast.walk(tree):
        if not isinstance(node, _FUNCTIONS):
            continue
        cyclomatic, cognitive, deepest, swallowed, literals = 1, 0, 0, 0, Counter()
        calls, impure, tokens, decided, statements = [], False, [], 0, 0
        for inner, depth in _inside(node):
            deepest = max(deepest, depth + isinstance(inner, _NESTING))
            tokens.append(type(inner).__name__)
            statements += isinstance(inner, ast.stmt)
            decided += isinstance(inner, (*_BRANCHES, ast.BoolOp))
            if isinstance(inner, _BRANCHES):
                cyclomatic += 1
                cognitive += 1 + depth
            elif isinstance(inner, ast.BoolOp):
                cyclomatic += len(inner.values) - 1
                cognitive += 1
            if isinstance(inner, ast.ExceptHandler) and all(isinstance(x, (ast.Pass, ast.Continue)) for x in inner.body):
                swallowed += 1
            if isinstance(inner, ast.Call):
                calls.append(inner.func.attr if isinstance(inner.func, ast.Attribute) else getattr(inner.func, "id", ""))
            if isinstance(inner, (ast.Global, ast.Nonlocal)) or isinstance(inner, (ast.Assign, ast.AugAssign)) and any(isinstance(t, (ast.Attribute, ast.Subscript)) for t in ([inner.target] if isinstance(inner, ast.AugAssign) else inner.targets)):
                impure = True
            if isinstance(inner, ast.Constant) and isinstance(inner.value, (int, float)) and not isinstance(inner.value, bool) and inner.value not in (0, 1, -1):
                literals[inner.value] += 1
        body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
        kinds = [k for k, words in IO_WORDS.items() if any(w in body for w in words)]
        counts, n = Counter(tokens), max(1, len(tokens))
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) / math.log2(n) if len(counts) > 1 else 0.0
        arguments = node.args.posonlyargs + node.args.args + node.args.kwonlyargs
        out.append({
            "name": node.name, "line": node.lineno, "end_line": node.end_lineno, "length": node.end_lineno - node.lineno + 1, "cyclomatic": cyclomatic, "cognitive": cognitive, "normalized": decided, "nesting": deepest, "statements": statements,
            "parameters": len(arguments), "is_test": node.name.startswith("test_"), "is_pure": not impure and not kinds, "io": kinds, "calls": sorted({c for c in calls if c}), "swallowed": swallowed, "magic": sum(1 for c in literals.values() if c > 1), "entropy": round(entropy, 6),
            "asserts": sum(1 for t in tokens if t == "Assert"), "documented": ast.get_docstring(node) is not None,
        })
    return sorted(out, key=lambda r: (r["line"], r["name"]))


def reading_once(read: Callable[[str], list], most: int = 1 << 18) -> Callable[[str], list]:
    """``read``, with its results kept for copies of a text; for ``most`` characters of text, the oldest go first."""
    kept: dict[str, list] = {}
    size = 0

    def reader(text: str) -> list:
        nonlocal size
        found = kept.get(text)
        if found is None:
            found = kept[text] = read(text)
            size += len(text)
            while size > most:
                oldest = next(iter(kept))
                size -= len(oldest)
                del kept[oldest]
        return found

    return reader


METRICS_SCHEMA = "path string, name string, line int, end_line int, length int, cyclomatic int, cognitive int, nesting int, parameters int, is_test boolean, is_pure boolean, io array<string>, calls array<string>, swallowed int, magic int, entropy double, asserts int, documented boolean, error string"


def python_functions(sources: DataFrame) -> DataFrame:
    """A row for each function of the Python files in ``sources`` (path, language, text); a file that can't be parsed has one row with its error."""

    ship(sources.sparkSession)
    columns = [c.split()[0] for c in METRICS_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        metrics = reading_once(lambda text: [[r.get(c) for c in columns[1:]] for r in function_metrics(text)])
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    rows += [[path, *r] for r in metrics(text)]
                except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
                    told = {"path": path, "error": f"{type(error).__name__}: {error}"[:200]}
                    rows.append([told.get(c) for c in columns])
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return sources.where("language = 'Python'").select("path", "text").mapInPandas(run, METRICS_SCHEMA)


def metric_findings(functions: DataFrame) -> DataFrame:
    """(path, line, kind, priority) from metrics: long methods, long parameter lists, deep nesting, swallowed errors, magic values, names."""
    from tidemark.functions.text import name_violation

    def graded(value: str, limit: int, high: int, kind: str):
        return F.when(F.col(value) > limit, F.struct(F.lit(kind).alias("kind"), F.when(F.col(value) > high, "High").otherwise("Medium").alias("priority")))

    def plain(holds, kind: str, priority: str):
        return F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority")))

    rules = [
        graded("length", 50, 100, "long_method"), graded("parameters", 5, 10, "long_parameter_list"), graded("nesting", 4, 8, "deep_nesting"),
        plain(F.col("swallowed") > 0, "error_swallowing", "High"), plain(F.col("magic") > 0, "magic_value", "Low"),
        plain(name_violation(F.col("name")).isNotNull(), "name", "Low"), plain(F.col("is_test") & (F.col("asserts") == 0), "no_assertion", "Medium"),
        plain(~F.col("documented") & ~F.col("name").startswith("_") & ~F.col("is_test"), "undocumented", "Low"),
    ]
    return functions.where("error is null").select("path", "line", F.explode(F.array_compact(F.array(*rules))).alias("hit")).select("path", "line", "hit.*")


def file_findings(sources: DataFrame) -> DataFrame:
    """(path, kind, priority): modules above 300 lines, High above 600."""
    from tidemark.sources.files import count_lines

    lines = count_lines(F.col("text"))
    return sources.where(lines > 300).select("path", F.lit("large_module").alias("kind"), F.when(lines > 600, "High").otherwise("Medium").alias("priority"))


def test_kind(name: str, path: str, source: str) -> str | None:
    """benchmark, property, integration or unit; None if it is no test."""
    if not name.startswith(("test", "bench", "prop")) and "@pytest" not in source:
        return None
    if name.startswith("bench"):
        return "benchmark"
    if name.startswith("prop") or "@given" in source:
        return "property"
    return "integration" if re.search(r"(^|/)tests?/", path) else "unit"
