"""Scoring formulas as Column expressions: one function for each formula, no UDFs.

Coverage is a fraction (0 to 1) unless a name says percent. Null handling is
stated where a formula has a rule for it; else nulls propagate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, thresholds and tables that results depend on.
DEBT_TYPE_MULTIPLIER = {
    "GodObject": 1.4, "ComplexityHotspot": 1.2, "Complexity": 1.2, "TestComplexityHotspot": 1.2, "TestComplexity": 1.2,
    "FeatureEnvy": 1.15, "ScatteredType": 1.15, "CodeOrganization": 1.15, "Dependency": 1.1, "OrphanedFunctions": 1.1,
    "UtilitiesSprawl": 1.1, "ResourceLeak": 1.1, "ErrorSwallowing": 1.1, "AsyncMisuse": 1.1, "BlockingIO": 1.1,
    "PrimitiveObsession": 1.05, "MagicValues": 1.05, "SuboptimalDataStructure": 1.05, "CollectionInefficiency": 1.05,
    "AllocationInefficiency": 1.05, "StringConcatenation": 1.05, "NestedLoops": 1.05, "DeadCode": 0.9,
}
ROLE_MULTIPLIER = {"EntryPoint": 1.3, "PureLogic": 0.7, "Orchestrator": 0.8, "IOWrapper": 1.2, "PatternMatch": 0.6, "Debug": 0.3}
ROLE_COVERAGE_WEIGHT = {"EntryPoint": 0.6, "Orchestrator": 0.8, "PureLogic": 1.0, "IOWrapper": 0.5, "PatternMatch": 1.0, "Debug": 1.0}
COUPLING_MULTIPLIER = {
    "WellTestedCore": 0.2, "StableFoundation": 0.5, "StableCore": 0.6, "LeafModule": 0.8, "Isolated": 0.9,
    "UtilityModule": 1.0, "ArchitecturalHub": 1.0, "HighlyCoupled": 1.2, "UnstableHighCoupling": 1.5,
}
DISTRIBUTION_DAMPENING = {"Distributed": 0.4, "Mixed": 0.7, "Concentrated": 1.0}
SPECTRUM_MULTIPLIER = {"StrictlyPure": 0.0, "LocallyPure": 0.3, "IOIsolated": 0.6, "IOMixed": 0.9, "Impure": 1.0}
FACADE_QUALITY = {"Excellent": 0.1, "Good": 0.3, "Poor": 0.6, "Monolithic": 1.0}
#: Role: lowest accepted, target and full coverage in percent.
COVERAGE_EXPECTATIONS = {
    "Pure": (90.0, 95.0, 100.0), "BusinessLogic": (80.0, 90.0, 95.0), "StateManagement": (75.0, 85.0, 90.0),
    "IoOperations": (60.0, 70.0, 80.0), "Validation": (85.0, 92.0, 98.0), "ErrorHandling": (70.0, 80.0, 90.0),
    "Configuration": (60.0, 70.0, 80.0), "Initialization": (50.0, 65.0, 75.0), "Orchestration": (65.0, 75.0, 85.0),
    "Utilities": (75.0, 85.0, 95.0), "Debug": (20.0, 30.0, 40.0), "Performance": (40.0, 50.0, 60.0),
}
ROLE_IMPORTANCE = {
    "Pure": 1.3, "BusinessLogic": 1.3, "Validation": 1.3, "StateManagement": 1.2, "ErrorHandling": 1.2, "Utilities": 1.2,
    "Initialization": 0.8, "Performance": 0.8, "Debug": 0.8,
}
PRIORITY_WEIGHT = {"Low": 1, "Medium": 3, "High": 5, "Critical": 10}
TYPE_WEIGHT = {
    "Todo": 1, "TestTodo": 1, "Fixme": 2, "TestComplexity": 2, "TestDuplication": 2, "Duplication": 4,
    "ErrorSwallowing": 4, "ResourceManagement": 4, "Complexity": 5,
}
GOD_LIMITS = {"methods": 20, "fields": 15, "responsibilities": 5, "lines": 1000}
RISK_WEIGHTS = {"complexity": 0.3, "cognitive": 0.45, "coverage": 0.5}
DATA_FLOW_WEIGHTS = {"purity": 0.4, "refactorability": 0.3, "pattern": 0.3}


def lookup(key: Column, table: dict, default) -> Column:
    """The table's value for ``key``, else the default.

    A map literal, not a CASE: generated methods stay small enough to be compiled.
    """
    if not table:
        return F.lit(default)
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def coverage_multiplier(coverage: Column, is_test: Column) -> Column:
    return F.when(is_test, 0.0).otherwise(1 - coverage)


def coverage_factor(coverage: Column, is_test: Column) -> Column:
    gap = 1 - coverage
    return F.when(is_test, 0.1).when(coverage == 0, 10.0).when(coverage < 0.2, 5 + 3 * gap).when(coverage < 0.5, 2 + 2 * gap).otherwise(F.greatest(F.pow(gap, F.lit(1.5)) + 0.1, F.lit(0.1)))


def complexity_factor(raw: Column) -> Column:
    return clamp(raw / 2, 0.0, 10.0)


def dependency_factor(callers: Column) -> Column:
    return F.least(callers / 2, F.lit(10.0))


def instability(afferent: Column, efferent: Column) -> Column:
    """Ce / (Ca + Ce); 0 without couplings."""
    return F.when(afferent + efferent > 0, efferent / (afferent + efferent)).otherwise(0.0)


def main_sequence_distance(abstractness: Column, unstable: Column) -> Column:
    return F.abs(abstractness + unstable - 1)


def instability_aware_dependency_factor(production_callers: Column, coupling: Column) -> Column:
    return F.least(dependency_factor(production_callers) * lookup(coupling, COUPLING_MULTIPLIER, 1.0), F.lit(10.0))


def base_score(coverage: Column, complexity: Column, dependency: Column) -> Column:
    return 10 * (0.4 * coverage + 0.4 * complexity + 0.2 * dependency)


def base_score_without_coverage(complexity: Column, dependency: Column) -> Column:
    """The weights sum to 0.75 on purpose: what coverage would add is missing."""
    return 10 * (0.5 * complexity + 0.25 * dependency)


def base_score_with_multiplier(multiplier: Column, complexity: Column, dependency: Column) -> Column:
    return base_score_without_coverage(complexity, dependency) * multiplier


def base_score_for(has_coverage: Column, is_test: Column, coverage: Column, weight: Column, complexity: Column, dependency: Column) -> Column:
    """With coverage data, the multiplier of the uncovered share as far as the role's weight counts it; else no coverage term."""
    multiplier = coverage_multiplier(coverage, is_test) * weight
    return F.when(has_coverage, base_score_with_multiplier(multiplier, complexity, dependency)).otherwise(base_score_without_coverage(complexity, dependency))


def normalized_final_score(raw: Column) -> Column:
    return F.when(raw <= 0, 0.0).when(raw < 10, raw).when(raw < 100, 10 + 3.33 * F.sqrt(F.greatest(raw - 10, F.lit(0.0)))).otherwise(41.59 + 10 * F.log(F.greatest(raw, F.lit(1e-9)) / 100))


def denormalized_score(score: Column) -> Column:
    """Inverse of normalized_final_score."""
    return F.when(score <= 0, 0.0).when(score < 10, score).when(score < 41.59, 10 + F.pow((score - 10) / 3.33, F.lit(2.0))).otherwise(100 * F.exp((score - 41.59) / 10))


def normalized_complexity(cyclomatic: Column, cognitive: Column) -> Column:
    mean = (cyclomatic + cognitive) / 2
    return F.when(mean <= 5, mean * 0.6).when(mean <= 10, 3 + (mean - 5) * 0.6).otherwise(6 + F.least((mean - 10) * 0.2, F.lit(4.0)))


def weighted_complexity(cyclomatic: Column, cognitive: Column, is_orchestrator: Column) -> Column:
    return F.when(is_orchestrator, 0.25 * cyclomatic + 0.75 * cognitive).otherwise(0.4 * cyclomatic + 0.6 * cognitive)


def file_scope_complexity_factor(total: Column, distribution: Column, highest: Column) -> Column:
    return complexity_factor(total) * lookup(distribution, DISTRIBUTION_DAMPENING, 1.0) * F.when(highest < 15, 0.5).when(highest < 30, 0.75).otherwise(1.0)


def debt_type_multiplier(debt_type: Column) -> Column:
    return lookup(debt_type, DEBT_TYPE_MULTIPLIER, 1.0)


def scaling_exponent(debt_type: Column, cyclomatic: Column) -> Column:
    hot, gap = debt_type == "ComplexityHotspot", debt_type == "TestingGap"
    return F.when(debt_type == "GodObject", 1.4).when(hot & (cyclomatic > 30), 1.2).when(hot & (cyclomatic > 15), 1.1).when(gap & (cyclomatic > 20), 1.1).otherwise(1.0)


def exponential_scaling(score: Column, exponent: Column) -> Column:
    """Scores below 1, 0 too, are raised to 1 first."""
    return F.pow(F.greatest(score, F.lit(1.0)), exponent)


def risk_boost(dependencies: Column, is_entry_point: Column, untested_complex: Column, swallows_errors: Column) -> Column:
    one = F.lit(1.0)
    return F.when(dependencies > 15, 1.2).otherwise(one) * F.when(is_entry_point, 1.15).otherwise(one) * F.when(untested_complex, 1.25).otherwise(one) * F.when(swallows_errors, 1.15).otherwise(one)


def final_score(score: Column, debt_type: Column, cyclomatic: Column, boost: Column) -> Column:
    return exponential_scaling(score, scaling_exponent(debt_type, cyclomatic)) * debt_type_multiplier(debt_type) * boost


def is_trivial(cyclomatic: Column, cognitive: Column, length: Column, role: Column) -> Column:
    simple = role.isin("IOWrapper", "EntryPoint", "PatternMatch", "Debug")
    return (cyclomatic <= 3) & (cognitive <= 5) & (simple | ((role == "PureLogic") & (length <= 10)))


def skipped_as_no_debt(trivial: Column, covered: Column) -> Column:
    return trivial & covered


def purity_adjustment(level: Column, is_pure: Column, confidence: Column) -> Column:
    """By purity level if there is one, else by the purity flag; missing confidence counts as 0."""
    sure = F.coalesce(confidence, F.lit(0.0)) > 0.8
    by_level = F.when(level == "StrictlyPure", F.when(sure, 0.70).otherwise(0.80)).when(level == "LocallyPure", F.when(sure, 0.75).otherwise(0.85)).when(level == "ReadOnly", 0.90).otherwise(1.0)
    by_flag = F.when(F.coalesce(is_pure, F.lit(False)), F.when(sure, 0.70).otherwise(0.85)).otherwise(1.0)
    return F.when(level.isNotNull(), by_level).otherwise(by_flag)


def truncated(x: Column, factor: Column) -> Column:
    """x * factor towards zero, as an integer."""
    return (x * factor).cast("long")


def structural_multiplier(nesting: Column, cyclomatic: Column) -> Column:
    """By nesting levels for each decision: flat code gains, deeply nested code loses; 1 without decisions."""
    ratio = nesting / F.when(cyclomatic > 0, cyclomatic)
    return F.when(cyclomatic == 0, 1.0).when(ratio < 0.1, 0.7).when(ratio < 0.2, 0.85).when(ratio < 0.4, 1.0).when(ratio < 0.5, 1.15).when(ratio < 0.6, 1.3).otherwise(1.5)


def role_multiplier(role: Column) -> Column:
    return lookup(role, ROLE_MULTIPLIER, 1.0)


def role_coverage_weight(role: Column) -> Column:
    return lookup(role, ROLE_COVERAGE_WEIGHT, 1.0)


def debt_adjustment(testing: Column, resource: Column, duplication: Column) -> Column:
    return (testing + resource + duplication) / 50


def io_isolation(kinds: Column, operations: Column) -> Column:
    """Purity spectrum from the numbers of distinct kinds of IO and of IO operations."""
    return F.when(F.coalesce(operations, F.lit(0)) == 0, "Impure").when((kinds <= 2) & (operations <= 3), "IOIsolated").otherwise("IOMixed")


def purity_spectrum(known: Column, is_pure: Column, confidence: Column, mutates: Column, io: Column) -> Column:
    pure = F.when(confidence > 0.8, F.when(F.coalesce(mutates, F.lit(False)), "LocallyPure").otherwise("StrictlyPure")).otherwise("LocallyPure")
    return F.when(~known, "Impure").when(is_pure, pure).otherwise(io)


def purity_factor(spectrum: Column) -> Column:
    return lookup(spectrum, SPECTRUM_MULTIPLIER, 1.0)


def pattern_factor(transforms: Column, dependencies: Column) -> Column:
    ratio = transforms / F.greatest(dependencies, F.lit(1))
    return F.when((transforms <= 0) | (dependencies <= 0), 1.0).when(ratio > 0.5, 0.7).when(ratio > 0.3, 0.85).otherwise(1.0)


def data_flow_adjusted(score: Column, purity: Column, pattern: Column) -> Column:
    """The refactorability factor is constantly 1."""
    w = DATA_FLOW_WEIGHTS
    return score * ((purity * w["purity"] + w["refactorability"] + pattern * w["pattern"]) / sum(w.values()))


def god_object_multiplier(is_god: Column, god_score: Column) -> Column:
    return F.when(is_god, 3.0 + god_score / 50).otherwise(1.0)


def file_god_object_multiplier(is_god: Column, god_score: Column) -> Column:
    return F.when(is_god, 1 + clamp(god_score, 0.0, 100.0) / 50).otherwise(1.0)


def contextual_score(score: Column, base_risk: Column, contextual_risk: Column) -> Column:
    return F.when(base_risk <= 0, score).otherwise(F.greatest(score * (contextual_risk / base_risk), F.lit(0.0)))


def composition_quality(callees: Column, delegation: Column, local_complexity: Column) -> Column:
    by_callees = F.when(callees <= 1, 0.0).when(callees == 2, 0.1).when(callees == 3, 0.2).when(callees == 4, 0.3).when(callees == 5, 0.35).otherwise(0.4)
    by_delegation = F.when(delegation >= 0.5, 0.4).when(delegation >= 0.2, (delegation - 0.2) / 0.3 * 0.4).otherwise(0.0)
    by_complexity = F.when(local_complexity <= 2, 0.2).when(local_complexity == 3, 0.15).when(local_complexity == 4, 0.1).when(local_complexity == 5, 0.05).otherwise(0.0)
    return clamp(by_callees + by_delegation + by_complexity, 0.5, 1.0)


def delegation_ratio(callees: Column, length: Column) -> Column:
    return F.when(length > 0, callees / length).otherwise(0.0)


def orchestrator_adjusted(score: Column, role: Column, callees: Column, quality: Column) -> Column:
    """Orchestrators with callees lose 20 to 31 %, but never fall below twice their callees, which can raise a low score."""
    reduced = F.greatest(score * (1 - F.least(0.2 + 0.1 * quality, F.lit(0.31))), callees * 2.0)
    return F.when((role == "Orchestrator") & (callees > 0), reduced).otherwise(score)


def file_context_adjusted(score: Column, context: Column, confidence: Column) -> Column:
    test = context == "Test"
    return F.when(test & (confidence > 0.8), score * 0.2).when(test & (confidence > 0.5), score * 0.6).when(context == "Generated", score * 0.1).otherwise(score)


def weighted_total(complexity: Column, coverage: Column, structure: Column, size: Column, smells: Column, weights: tuple[float, ...] = (1.0, 1.0, 0.8, 0.3, 0.6)) -> Column:
    """Components by their weights, brought from a scale of 237 to one of 200."""
    parts = (complexity, coverage, structure, size, smells)
    return sum((p * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0)) / 237.0 * 200.0


def facade_adjusted(score: Column, is_facade: Column, quality: Column, submodules: Column, methods: Column, lines: Column) -> Column:
    modules = F.greatest(submodules, F.lit(1))
    mean_lines, mean_methods = F.floor(lines / modules), F.floor(methods / modules)
    bonus = F.when(submodules <= 4, 0.9).when(submodules <= 9, 0.7).otherwise(0.5)
    size = F.when((mean_lines < 300) & (mean_methods < 15), 0.5).when((mean_lines < 500) & (mean_methods < 25), 0.7).otherwise(0.9)
    return F.when(is_facade, score * lookup(quality, FACADE_QUALITY, 1.0) * bonus * size).otherwise(score)


def _expected(role: Column, place: int) -> Column:
    return lookup(role, {k: v[place] for k, v in COVERAGE_EXPECTATIONS.items()}, COVERAGE_EXPECTATIONS["BusinessLogic"][place])


def coverage_gap_severity(percent: Column, role: Column) -> Column:
    low, target = _expected(role, 0), _expected(role, 1)
    return F.when(percent >= target, "None").when(percent >= low, "Minor").when(percent >= low * 0.5, "Moderate").otherwise("Critical")


def coverage_gap_score(percent: Column, role: Column) -> Column:
    top = F.lit(100.0)
    gap = F.least(F.greatest(_expected(role, 1) - percent, F.lit(0.0)) * 1.5, top)
    severe = F.least(gap * lookup(coverage_gap_severity(percent, role), {"Critical": 2.0, "Moderate": 1.5, "Minor": 1.2}, 1.0), top)
    return F.least(severe * lookup(role, ROLE_IMPORTANCE, 1.0), top)


def file_score_factors(lines: Column, mean_complexity: Column, total_complexity: Column, coverage: Column, functions: Column, god: Column, function_scores: Column) -> dict[str, Column]:
    return {
        "size_factor": F.sqrt(lines / 100),
        "complexity_factor": F.least(mean_complexity / 5, F.lit(3.0)) * F.sqrt(total_complexity / 50),
        "coverage_factor": 1 + 2 * (1 - coverage),
        "density_factor": F.when(functions > 50, 1 + (functions - 50) * 0.02).otherwise(1.0),
        "god_object_multiplier": god,
        "function_factor": F.greatest(function_scores / 10, F.lit(1.0)),
    }


def file_score(factors: dict[str, Column]) -> Column:
    out = F.lit(1.0)
    for factor in factors.values():
        out = out * factor
    return out


def god_object_sizes(methods: Column, fields: Column, responsibilities: Column, lines: Column) -> tuple[Column, Column]:
    """(product, violations): the four sizes' ratios to their limits, each 3 at most, multiplied; and how many sizes pass their limit."""
    sizes = {"methods": methods, "fields": fields, "responsibilities": responsibilities, "lines": lines}
    product = F.lit(1.0)
    for name, size in sizes.items():
        product = product * F.least(size / (3.0 if name == "responsibilities" else float(GOD_LIMITS[name])), F.lit(3.0))
    return product, sum((F.when(size > GOD_LIMITS[name], 1).otherwise(0) for name, size in sizes.items()), F.lit(0))


def god_object_score(product: Column, violations: Column, mean_complexity: Column | None = None) -> Column:
    """From god_object_sizes(): violations raise the score and give it a floor.

    With ``mean_complexity``, methods are weighted and simple or complex ones change the score.
    """
    ease = F.lit(1.0) if mean_complexity is None else F.when(mean_complexity < 3, 0.7).when(mean_complexity > 10, 1.5).otherwise(1.0)
    floor = F.when(violations == 1, 30.0).when(violations == 2, 50.0).otherwise(70.0)
    return F.when(violations > 0, F.greatest(product * 20 * ease * violations, floor)).otherwise(product * 10 * ease)


def god_complexity_factor(mean: Column, highest: Column, total: Column, variance: Column) -> Column:
    combined = clamp(mean / 5, 0.5, 2.0) * 0.4 + clamp(highest / 15, 0.5, 2.5) * 0.3 + clamp(total / 75, 0.5, 2.0) * 0.2 + clamp(variance / 5, 0.8, 1.5) * 0.1
    return F.when(total == 0, 1.0).otherwise(clamp(combined, 0.5, 3.0))


def effective_methods(weighted: Column, mean_complexity: Column) -> Column:
    return weighted * F.when(mean_complexity < 3, 0.8).when(mean_complexity > 10, 1.5).otherwise(1.0)


def percent_of_maximum(value: Column, maximum: Column) -> Column:
    return F.least(value / maximum, F.lit(1.0)) * 100


def complexity_maximum(highest: Column) -> Column:
    """What counts as 100 %: a fifth above the data's maximum, 10 at least."""
    return F.greatest(highest * 1.2, F.lit(10.0))


def entropy_dampening(entropy: Column, repetition: Column) -> Column:
    return F.when(entropy < 0.5, clamp(1 - repetition * 0.3, 0.5, 1.0)).otherwise(1.0)


def entropy_adjusted(entropy: Column, patterns: Column, similarity: Column) -> Column:
    adjusted = entropy * (1 - patterns * 0.3) * (1 - similarity * 0.2)
    return F.when(adjusted < 0.5, adjusted * 0.5).otherwise(adjusted)


def cognitive_penalty(nesting: Column) -> Column:
    return F.when(nesting <= 2, nesting).when(nesting == 3, 4).otherwise(8).cast("int")


def base_risk(cyclomatic: Column, cognitive: Column, percent: Column, is_test: Column) -> Column:
    """Coverage in percent; tests and unknown coverage add no coverage term."""
    w = RISK_WEIGHTS
    uncovered = F.when(is_test | percent.isNull(), 0.0).otherwise((100 - percent) / 100 * w["coverage"])
    return ((cyclomatic * w["complexity"] + cognitive * w["cognitive"]) / 50 + uncovered) * 5


def coverage_penalty(percent: Column) -> Column:
    return F.when(percent.isNull(), 1.0).when(percent < 20, 3.0).when(percent < 40, 2.0).when(percent < 60, 1.5).when(percent < 80, 1.2).otherwise(0.8)


def debt_factor(score: Column, threshold: Column) -> Column:
    ratio = score / F.when(threshold > 0, threshold)
    return F.when(ratio.isNull(), 1.0).when(ratio <= 1, 1.0).when(ratio <= 2, 1.2).when(ratio <= 5, 1.5).when(ratio <= 10, 2.0).otherwise(2.5)


def risk_score(base: Column, debt: Column, pattern: Column, penalty: Column, coverage: Column, cognitive: Column) -> Column:
    """The product of the factors; very tangled functions have 3 at least."""
    product = base * debt * pattern * penalty * coverage
    return F.when(cognitive > 40, F.greatest(product, F.lit(3.0))).otherwise(product)


def risk_contribution(change_frequency: Column, bug_density: Column) -> Column:
    return F.least(bug_density * 1.5 + F.least(change_frequency / 20, F.lit(0.5)), F.lit(2.0))


def bug_density(fixes: Column, commits: Column) -> Column:
    return F.when(commits > 0, fixes / commits).otherwise(0.0)


def scaled_roi(raw: Column) -> Column:
    """Discontinuous at 10 and 20, as published."""
    return F.when(raw > 20, 10 + F.log(F.greatest(raw - 20, F.lit(1e-300)))).when(raw > 10, 5 + (raw - 10) * 0.5).otherwise(raw)


def roi(impact: Column, dependents: Column, weight: Column, effort: Column, confidence: Column) -> Column:
    worth = impact * (1 + F.least(dependents * 0.1, F.lit(1.0))) * weight
    return F.greatest(scaled_roi(worth / F.when(effort > 0, effort).otherwise(1.0)) * confidence, F.lit(0.1))


def criticality(is_entry: Column, dependencies: Column, called_by_entry: Column) -> Column:
    return F.when(is_entry, 2.0).otherwise(1.0) * F.when(dependencies > 5, 1.5).when(dependencies > 2, 1.2).otherwise(1.0) * F.when(called_by_entry, 1.3).otherwise(1.0)


def coverage_urgency(direct: Column, transitive: Column, complexity: Column) -> Column:
    gap = 1 - clamp(direct * 0.7 + transitive * 0.3, 0.0, 1.0)
    weight = F.when(complexity == 0, 0.5).otherwise(F.least(F.log(complexity + 1.0) / 3 + 0.5, F.lit(2.0)))
    return gap * weight * 10


def debt_score(priority: Column, debt_type: Column) -> Column:
    return (lookup(priority, PRIORITY_WEIGHT, 1) * lookup(debt_type, TYPE_WEIGHT, 3)).cast("long")


def effort_hours(category: Column, severity: Column) -> Column:
    high = severity >= 70
    return F.when(category == "Architecture", F.when(severity >= 90, 16).when(high, 8).otherwise(4)).when(category == "Performance", F.when(high, 8).otherwise(4)).otherwise(F.when(high, 4).otherwise(2))
