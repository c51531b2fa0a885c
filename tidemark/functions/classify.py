"""Classifications as CASE Columns; the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scoring import instability, lookup

# Categories and names that results depend on.
CATEGORY = {
    **dict.fromkeys(("GodObject", "FeatureEnvy", "PrimitiveObsession", "ScatteredType", "OrphanedFunctions", "UtilitiesSprawl"), "Architecture"),
    **dict.fromkeys(("TestingGap", "TestComplexityHotspot", "TestTodo", "TestDuplication", "AssertionComplexity", "FlakyTestPattern"), "Testing"),
    **dict.fromkeys(("AsyncMisuse", "CollectionInefficiency", "NestedLoops", "BlockingIO", "AllocationInefficiency", "StringConcatenation", "SuboptimalDataStructure", "ResourceLeak"), "Performance"),
}
AGGREGATION_CATEGORY = {
    **dict.fromkeys(("TestComplexity", "TestTodo", "TestDuplication", "TestQuality", "TestingGap", "TestComplexityHotspot", "AssertionComplexity", "FlakyTestPattern"), "Testing"),
    **dict.fromkeys(("ErrorSwallowing", "ResourceManagement", "Risk", "AllocationInefficiency", "StringConcatenation", "NestedLoops", "BlockingIO", "SuboptimalDataStructure", "AsyncMisuse", "ResourceLeak", "CollectionInefficiency"), "Resource"),
    "Duplication": "Duplication",
}
#: Role: cyclomatic and cognitive complexity above which a function is a hotspot.
HOTSPOT_LIMITS = {"Orchestrator": (8, 12), "PureLogic": (10, 15), "EntryPoint": (7, 10), "IOWrapper": (5, 8), "PatternMatch": (15, 20), "Debug": (20, 25), "Unknown": (10, 15)}
SIGNAL_WEIGHTS = {"io": 0.35, "call_graph": 0.25, "types": 0.15, "purity": 0.15, "framework": 0.05, "name": 0.05}
FRAMEWORK_OVERRIDE = 0.70
SEVERITY_RANK = {"Low": 0, "Medium": 1, "High": 2, "Critical": 3}
EXTENSIONS = {
    "rs": "Rust", "py": "Python", "pyw": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript",
    "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "TypeScript", "go": "Go", "sol": "Solidity",
}
FIX_WORDS = ("bug", "fix", "fixes", "fixed", "fixing", "hotfix")


def _bands(score: Column, *limits: float) -> Column:
    names = ("Critical", "High", "Medium")
    out = F.when(score >= limits[0], names[0])
    for limit, name in zip(limits[1:], names[1:], strict=True):
        out = out.when(score >= limit, name)
    return out.otherwise("Low")


def severity_10(score: Column) -> Column:
    return _bands(score, 8, 6, 4)


def severity_100(score: Column) -> Column:
    return _bands(score, 70, 50, 30)


def priority_open(score: Column) -> Column:
    """For scores without an upper end."""
    return _bands(score, 100, 50, 20)


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANK, -1)


def tier(debt_type: Column, score: Column, cyclomatic: Column, cognitive: Column, nesting: Column, complexity_factor: Column, dependencies: Column, role: Column) -> Column:
    structural = debt_type.isin("GodObject", "ErrorSwallowing", "AsyncMisuse")
    extreme = (score > 10) | (cyclomatic > 50) | (cognitive >= 20) | (nesting >= 5) | (complexity_factor > 5)
    gap = (debt_type == "TestingGap") & ((cyclomatic >= 15) | (dependencies >= 10) | (role == "EntryPoint"))
    hotspot = (debt_type == "ComplexityHotspot") & ((complexity_factor >= 2) | (cognitive >= 12) | (nesting >= 3) | cyclomatic.between(8, 50))
    return F.when(structural | extreme, "T1").when(gap | hotspot, "T2").when((debt_type == "TestingGap") & (cyclomatic >= 10), "T3").otherwise("T4")


def category(debt_type: Column) -> Column:
    return lookup(debt_type, CATEGORY, "CodeQuality")


def aggregation_category(debt_type: Column) -> Column:
    return lookup(debt_type, AGGREGATION_CATEGORY, "Organization")


def function_role(name: Column, is_entry: Column, is_impure: Column, does_io: Column, callees: Column, cyclomatic: Column, length: Column) -> Column:
    """Entry point, debug helper, constructor or accessor, IO wrapper, orchestrator; else pure logic unless the function is known to be impure."""
    debug = name.rlike("(?i)^(debug|dump|print|trace)_|_(debug|dump)$|^diagnos")
    plain = name.rlike("^(new|default|with_|from_|get_|is_|has_|as_|to_)") & (cyclomatic <= 2) & (length <= 10)
    return F.when(is_entry, "EntryPoint").when(debug, "Debug").when(plain & ~does_io, "IOWrapper").when(does_io & (length < 50), "IOWrapper").when((callees >= 2) & (cyclomatic <= 5), "Orchestrator").when(is_impure, "Unknown").otherwise("PureLogic")


def test_debt(cyclomatic: Column, cognitive: Column) -> Column:
    return F.when((cyclomatic > 15) | (cognitive > 20), "TestComplexityHotspot").otherwise("TestingGap")


def is_hotspot(cyclomatic: Column, cognitive: Column, role: Column) -> Column:
    by_role = [lookup(role, {k: v[i] for k, v in HOTSPOT_LIMITS.items()}, HOTSPOT_LIMITS["Unknown"][i]) for i in (0, 1)]
    return (cyclomatic > 10) | (cognitive > 15) | (cyclomatic > by_role[0]) | (cognitive > by_role[1])


def is_dead(callers: Column, used_as_value: Column, excluded: Column) -> Column:
    return (callers == 0) & ~F.coalesce(used_as_value, F.lit(False)) & ~F.coalesce(excluded, F.lit(False))


def simple_risk(cyclomatic: Column, cognitive: Column, role: Column) -> Column:
    """Risk of a simple function; null for others."""
    harmless = role.isin("IOWrapper", "EntryPoint", "PatternMatch", "Debug", "PureLogic")
    return F.when((cyclomatic <= 3) & (cognitive <= 5), F.when(harmless, 0.0).otherwise(0.1))


def debt_types(is_test: Column, cyclomatic: Column, cognitive: Column, role: Column, testing_gap: Column, dead: Column) -> Column:
    """Array: one type for a test, else those that apply, else Risk for simple functions."""
    found = F.array_compact(F.array(F.when(testing_gap, "TestingGap"), F.when(is_hotspot(cyclomatic, cognitive, role), "ComplexityHotspot"), F.when(dead, "DeadCode")))
    fallback = F.array_compact(F.array(F.when(simple_risk(cyclomatic, cognitive, role).isNotNull(), "Risk")))
    return F.when(is_test, F.array(test_debt(cyclomatic, cognitive))).when(F.size(found) > 0, found).otherwise(fallback)


def coupling(afferent: Column, efferent: Column) -> Column:
    total, share = afferent + efferent, instability(afferent, efferent)
    return F.when(total > 15, "HighlyCoupled").when(total < 3, "Isolated").when((share < 0.3) & (afferent >= 3), "StableCore").when((share > 0.7) & (afferent <= 2), "LeafModule").otherwise("UtilityModule")


def coupling_pattern(share: Column, production: Column, tests: Column, callees: Column) -> Column:
    """``share`` is the instability."""
    callers = production + tests
    tested = F.when(callers > 0, tests / callers).otherwise(0.0)
    stable, few = share <= 0.35, callers < 3
    return (
        F.when(stable & (callers > 5) & (tested > 0.7), "WellTestedCore")
        .when(stable & (production > 10), "StableFoundation")
        .when(stable & (callers > 5), "StableCore")
        .when((share > 0.7) & (production > 5), "UnstableHighCoupling")
        .when((share > 0.3) & (share < 0.7) & (callers > 10), "ArchitecturalHub")
        .when(few & (callees < 3), "Isolated")
        .otherwise("LeafModule")
    )


def cohesion(score: Column) -> Column:
    return F.when(score >= 0.7, "High").when(score >= 0.4, "Medium").otherwise("Low")


def distribution(highest: Column, total: Column) -> Column:
    share = highest / F.when(total > 0, total)
    return F.when(share > 0.5, "Concentrated").when(share > 0.2, "Mixed").otherwise("Distributed")


def risk_category(cyclomatic: Column, cognitive: Column, percent: Column, risk: Column, is_test: Column) -> Column:
    mean = F.floor((cyclomatic + cognitive) / 2)
    by_test = F.when(mean > 20, "High").when(mean > 10, "Medium").otherwise("Low")
    by_mean = F.when(mean > 15, "Critical").when(mean > 10, "High").when(mean > 5, "Medium").otherwise("Low")
    return F.when(is_test, by_test).when(percent.isNull(), by_mean).when((mean > 10) & (percent > 80), "WellTested").otherwise(severity_10(risk))


def stability_status(frequency: Column, bugs: Column, age_days: Column) -> Column:
    return F.when((frequency > 5) & (bugs > 0.3), "HighlyUnstable").when(frequency > 2, "FrequentlyChanged").when(bugs > 0.2, "BugProne").when(age_days > 365, "MatureStable").otherwise("RelativelyStable")


def blast_radius_contribution(radius: Column) -> Column:
    return F.when(radius > 10, 1.5).when(radius > 5, 1.0).when(radius > 2, 0.5).when(radius == 2, 0.2).otherwise(0.0)


def _word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("(^|[^\\p{L}\\p{N}])(" + "|".join(words) + ")([^\\p{L}\\p{N}]|$)")


def is_bug_fix(message: Column) -> Column:
    """A whole word that names a fix, unless the message marks style, chore, docs, test or refactoring work or names formatting."""
    low = F.lower(message)
    excluded = low.rlike("style:|chore:|docs:|test:|formatting|linting|whitespace|typo") | (low.contains("refactor:") & ~_word(low, (*FIX_WORDS, "issue")))
    return ~excluded & _word(low, FIX_WORDS)


def language(path: Column) -> Column:
    return lookup(F.regexp_extract(path, r"\.([^./]+)$", 1), EXTENSIONS, "Unknown")


def test_file_context(naming: Column, attributes: Column, functions: Column, imports: Column, directory: Column) -> tuple[Column, Column]:
    """(context, confidence) from signals of 0 to 1; three strong ones raise the confidence to 0.85."""
    mean = directory * 0.20 + attributes * 0.35 + naming * 0.25 + functions * 0.15 + imports * 0.05
    strong = (naming >= 0.7) & (attributes >= 0.7) & (functions >= 0.7)
    confidence = F.when(strong, F.greatest(mean, F.lit(0.85))).otherwise(mean)
    return F.when(confidence > 0.5, "Test").otherwise("Production"), confidence


def module_type(path: Column) -> Column:
    return (
        F.when(path.rlike("/tests/|_test[.]rs"), "Test")
        .when(path.rlike("/core/|/domain/"), "Core")
        .when(path.rlike("/api/|/handlers/"), "Api")
        .when(path.rlike("/utils/|/helpers/"), "Util")
        .when(path.rlike("/infra/|/db/"), "Infrastructure")
        .when(path.rlike("(mod|lib)[.]rs$"), "Core")
        .when(path.contains("main.rs"), "Infrastructure")
        .otherwise("Util")
    )


def entry_type(name: Column, path: Column) -> Column:
    """Kind of entry point by name and path; null if none."""
    return (
        F.when(name == "main", "Main")
        .when(path.rlike("cli|command") & name.rlike("^(cmd|command)_|_command$"), "CliCommand")
        .when(path.rlike("api|handler|route") & name.rlike("^(handle|get|post|put|delete)_|_handler$"), "ApiEndpoint")
        .when(path.rlike("web|http") & name.rlike("route|handler"), "WebHandler")
        .when(name.rlike("^on_|_listener$|event"), "EventHandler")
        .when(path.contains("test") | name.contains("test"), "TestEntry")
    )


def caller_type(name: Column, known_test: Column) -> Column:
    looks = name.rlike("(^|::)test_|::tests?::|_tests?$")
    return F.when(F.coalesce(known_test, F.lit(False)) | looks, "Test").otherwise("Production")


def file_type(source: Column, path: Column) -> Column:
    head = F.substring(source, 1, 2000)
    return (
        F.when(head.rlike("(?i)@generated|do not edit|automatically generated|code generated by"), "GeneratedCode")
        .when(path.rlike(r"(^|/)tests?/|_tests?\.[a-z]+$|(^|/)test_[^/]*$"), "TestCode")
        .when(path.rlike("(^|/)[^/]*(config|settings|schema)[^/]*$"), "DeclarativeConfig")
        .when(path.rlike("proc[-_]macro|_derive/"), "ProceduralMacro")
        .when(path.rlike(r"(^|/)build\.rs$"), "BuildScript")
        .otherwise("BusinessLogic")
    )
