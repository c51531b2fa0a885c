"""Queries of the scoring formulas and classifications over the function stand-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import classify as K
from tidemark.functions import scoring as S
from tidemark.plans.registry import register
from tidemark.plans.stand_ins import FUNCTIONS_SQL, functions

c = F.col
KEYS = ("fn", "line", "file")


def _case(key: str, values: dict, default) -> str:
    quoted = {k: f"'{v}'" if isinstance(v, str) else v for k, v in values.items()}
    rest = f"'{default}'" if isinstance(default, str) else default
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quoted.items()) + f" ELSE {rest} END)"


def _select(df: DataFrame, doubles: dict[str, Column], others: dict[str, Column] | None = None) -> DataFrame:
    return df.select(*KEYS, *(F.round(v, 6).alias(k) for k, v in doubles.items()), *(v.alias(k) for k, v in (others or {}).items()))


def _sql(doubles: dict[str, str], others: dict[str, str] | None = None, source: str = "fns", before: str = FUNCTIONS_SQL) -> str:
    parts = [*KEYS, *(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in doubles.items()), *(f"{v} AS {k}" for k, v in (others or {}).items())]
    return f"WITH {before} SELECT {', '.join(parts)} FROM {source}"


CPLX = "least(greatest(cyclomatic / 2.0, 0), 10)"
DEP = "least(production_callers / 2.0, 10)"
INSTABILITY = "(CASE WHEN production_callers + test_callers + callees > 0 THEN callees * 1.0 / (production_callers + test_callers + callees) ELSE 0 END)"
BASE = f"(10 * (0.5 * {CPLX} + 0.25 * {DEP}))"
CF = "(CASE WHEN is_test THEN 0.1 WHEN coverage = 0 THEN 10 WHEN coverage < 0.2 THEN 5 + 3 * (1 - coverage) WHEN coverage < 0.5 THEN 2 + 2 * (1 - coverage) ELSE greatest(pow(1 - coverage, 1.5) + 0.1, 0.1) END)"


@register("scoring_factors", _sql({
    "coverage_multiplier": "CASE WHEN is_test THEN 0 ELSE 1 - coverage END",
    "coverage_factor": CF,
    "complexity_factor": CPLX,
    "dependency_factor": DEP,
    "base_score": f"10 * (0.4 * {CF} + 0.4 * {CPLX} + 0.2 * {DEP})",
    "base_score_no_coverage": BASE,
    "base_score_with_multiplier": f"{BASE} * (CASE WHEN is_test THEN 0 ELSE 1 - coverage END)",
    "base_score_dispatched": f"{BASE} * CASE WHEN coverage >= 0.9 THEN 1 WHEN is_test THEN 0 ELSE (1 - coverage) * " + _case("role", S.ROLE_COVERAGE_WEIGHT, 1.0) + " END",
    "normalized_final": "CASE WHEN score < 10 THEN score WHEN score < 100 THEN 10 + 3.33 * sqrt(score - 10) ELSE 41.59 + 10 * ln(score / 100) END",
    "normalized_complexity": "CASE WHEN cyclomatic + cognitive <= 10 THEN (cyclomatic + cognitive) * 0.3 WHEN cyclomatic + cognitive <= 20 THEN 3 + ((cyclomatic + cognitive) / 2.0 - 5) * 0.6 ELSE 6 + least(((cyclomatic + cognitive) / 2.0 - 10) * 0.2, 4) END",
    "weighted_complexity": "CASE WHEN role = 'Orchestrator' THEN 0.25 * cyclomatic + 0.75 * cognitive ELSE 0.4 * cyclomatic + 0.6 * cognitive END",
    "denormalized": "CASE WHEN score < 10 THEN score WHEN score < 41.59 THEN 10 + pow((score - 10) / 3.33, 2) ELSE 100 * exp((score - 41.59) / 10) END",
}))
def scoring_factors(spark, sf_dir):
    cplx, dep = S.complexity_factor(c("cyclomatic")), S.dependency_factor(c("production_callers"))
    multiplier = S.coverage_multiplier(c("coverage"), c("is_test"))
    factor = S.coverage_factor(c("coverage"), c("is_test"))
    return _select(functions(spark, sf_dir), {
        "coverage_multiplier": multiplier,
        "coverage_factor": factor,
        "complexity_factor": cplx,
        "dependency_factor": dep,
        "base_score": S.base_score(factor, cplx, dep),
        "base_score_no_coverage": S.base_score_without_coverage(cplx, dep),
        "base_score_with_multiplier": S.base_score_with_multiplier(multiplier, cplx, dep),
        "base_score_dispatched": S.base_score_for(c("coverage") < 0.9, c("is_test"), c("coverage"), S.role_coverage_weight(c("role")), cplx, dep),
        "normalized_final": S.normalized_final_score(c("score")),
        "normalized_complexity": S.normalized_complexity(c("cyclomatic"), c("cognitive")),
        "weighted_complexity": S.weighted_complexity(c("cyclomatic"), c("cognitive"), c("role") == "Orchestrator"),
        "denormalized": S.denormalized_score(c("score")),
    })


PATTERN_SQL = f"""(CASE WHEN {INSTABILITY} <= 0.35 AND production_callers + test_callers > 5 AND test_callers * 1.0 / (production_callers + test_callers) > 0.7 THEN 'WellTestedCore'
 WHEN {INSTABILITY} <= 0.35 AND production_callers > 10 THEN 'StableFoundation'
 WHEN {INSTABILITY} <= 0.35 AND production_callers + test_callers > 5 THEN 'StableCore'
 WHEN {INSTABILITY} > 0.7 AND production_callers > 5 THEN 'UnstableHighCoupling'
 WHEN {INSTABILITY} > 0.3 AND {INSTABILITY} < 0.7 AND production_callers + test_callers > 10 THEN 'ArchitecturalHub'
 WHEN production_callers + test_callers < 3 AND callees > 5 THEN 'LeafModule'
 WHEN production_callers + test_callers < 3 AND callees < 3 THEN 'Isolated'
 ELSE 'LeafModule' END)"""


@register("coupling_scores", _sql({
    "instability": INSTABILITY,
    "aware_dependency_factor": f"least({DEP} * " + _case(PATTERN_SQL, S.COUPLING_MULTIPLIER, 1.0) + ", 10)",
    "main_sequence_distance": f"abs((cyclomatic % 10) / 10.0 + {INSTABILITY} - 1)",
}, {
    "coupling_pattern": PATTERN_SQL,
    "coupling_class": f"""CASE WHEN production_callers + test_callers + callees > 15 THEN 'HighlyCoupled' WHEN production_callers + test_callers + callees < 3 THEN 'Isolated'
 WHEN {INSTABILITY} < 0.3 AND production_callers + test_callers >= 3 THEN 'StableCore' WHEN {INSTABILITY} > 0.7 AND production_callers + test_callers <= 2 THEN 'LeafModule' ELSE 'UtilityModule' END""",
    "zone_of_pain": f"(cyclomatic % 10) / 10.0 < 0.2 AND {INSTABILITY} < 0.2 AND production_callers + test_callers > 3",
    "zone_of_uselessness": f"(cyclomatic % 10) / 10.0 > 0.8 AND {INSTABILITY} > 0.8",
}))
def coupling_scores(spark, sf_dir):
    afferent = c("production_callers") + c("test_callers")
    share = S.instability(afferent, c("callees"))
    pattern = K.coupling_pattern(share, c("production_callers"), c("test_callers"), c("callees"))
    abstractness = (c("cyclomatic") % 10) / 10
    return _select(functions(spark, sf_dir), {
        "instability": share,
        "aware_dependency_factor": S.instability_aware_dependency_factor(c("production_callers"), pattern),
        "main_sequence_distance": S.main_sequence_distance(abstractness, share),
    }, {
        "coupling_pattern": pattern,
        "coupling_class": K.coupling(afferent, c("callees")),
        "zone_of_pain": (abstractness < 0.2) & (share < 0.2) & (afferent > 3),
        "zone_of_uselessness": (abstractness > 0.8) & (share > 0.8),
    })


RATIO = "nesting * 1.0 / cyclomatic"
EXPONENT = "(CASE WHEN debt_type = 'GodObject' THEN 1.4 WHEN debt_type = 'ComplexityHotspot' AND cyclomatic > 30 THEN 1.2 WHEN debt_type = 'ComplexityHotspot' AND cyclomatic > 15 THEN 1.1 WHEN debt_type = 'TestingGap' AND cyclomatic > 20 THEN 1.1 ELSE 1 END)"
TYPE_MULT = _case("debt_type", S.DEBT_TYPE_MULTIPLIER, 1.0)
BOOST = "((CASE WHEN production_callers + callees > 15 THEN 1.2 ELSE 1 END) * (CASE WHEN role = 'EntryPoint' THEN 1.15 ELSE 1 END) * (CASE WHEN coverage <= 0.4 AND cyclomatic > 20 THEN 1.25 ELSE 1 END) * (CASE WHEN fn % 5 = 0 THEN 1.15 ELSE 1 END))"
QUALITY = """least(greatest((CASE WHEN callees <= 1 THEN 0 WHEN callees = 2 THEN 0.1 WHEN callees = 3 THEN 0.2 WHEN callees = 4 THEN 0.3 WHEN callees = 5 THEN 0.35 ELSE 0.4 END)
 + (CASE WHEN callees * 1.0 / length >= 0.5 THEN 0.4 WHEN callees * 1.0 / length >= 0.2 THEN (callees * 1.0 / length - 0.2) / 0.3 * 0.4 ELSE 0 END)
 + (CASE WHEN cyclomatic <= 2 THEN 0.2 WHEN cyclomatic = 3 THEN 0.15 WHEN cyclomatic = 4 THEN 0.1 WHEN cyclomatic = 5 THEN 0.05 ELSE 0 END), 0.5), 1.0)"""


@register("score_scaling", _sql({
    "debt_type_multiplier": TYPE_MULT,
    "exponent": EXPONENT,
    "scaled": f"pow(greatest(score, 1), {EXPONENT})",
    "boost": BOOST,
    "final_score": f"pow(greatest(score, 1), {EXPONENT}) * {TYPE_MULT} * {BOOST}",
    "structural_multiplier": f"CASE WHEN cyclomatic = 0 THEN 1 WHEN {RATIO} >= 0.6 THEN 1.5 WHEN {RATIO} >= 0.5 THEN 1.3 WHEN {RATIO} >= 0.4 THEN 1.15 WHEN {RATIO} >= 0.2 THEN 1 WHEN {RATIO} >= 0.1 THEN 0.85 ELSE 0.7 END",
    "role_multiplier": _case("role", S.ROLE_MULTIPLIER, 1.0),
    "role_coverage_weight": _case("role", S.ROLE_COVERAGE_WEIGHT, 1.0),
    "composition_quality": QUALITY,
    "delegation_ratio": "CASE WHEN length > 0 THEN callees * 1.0 / length ELSE 0 END",
    "orchestrator_adjusted": f"CASE WHEN role = 'Orchestrator' AND callees > 0 THEN greatest(score * (1 - least(0.2 + 0.1 * {QUALITY}, 0.31)), callees * 2.0) ELSE score END",
    "context_adjusted": "CASE WHEN is_test AND coverage > 0.8 THEN score * 0.2 WHEN is_test AND coverage > 0.5 THEN score * 0.6 WHEN NOT is_test AND fn % 11 = 0 THEN score * 0.1 ELSE score END",
    "contextual": "CASE WHEN fn % 10 <= 0 THEN score ELSE greatest(score * ((line + 1.0) / (fn % 10)), 0) END",
    "debt_adjustment": "(line + callees + test_callers) / 50.0",
    "god_boost": "CASE WHEN debt_type = 'GodObject' THEN 3 + score / 50 ELSE 1 END",
    "file_god_boost": "CASE WHEN debt_type = 'GodObject' THEN 1 + least(greatest(score, 0), 100) / 50 ELSE 1 END",
}))
def score_scaling(spark, sf_dir):
    exponent = S.scaling_exponent(c("debt_type"), c("cyclomatic"))
    boost = S.risk_boost(c("production_callers") + c("callees"), c("role") == "EntryPoint", (c("coverage") <= 0.4) & (c("cyclomatic") > 20), c("fn") % 5 == 0)
    delegation = S.delegation_ratio(c("callees"), c("length"))
    context = F.when(c("is_test"), "Test").when(c("fn") % 11 == 0, "Generated").otherwise("Production")
    is_god = c("debt_type") == "GodObject"
    staged = functions(spark, sf_dir).withColumns({"exponent": exponent, "boost": boost, "delegation": delegation}).withColumn("quality", S.composition_quality(c("callees"), c("delegation"), c("cyclomatic")))
    exponent, boost, delegation, quality = c("exponent"), c("boost"), c("delegation"), c("quality")
    return _select(staged, {
        "debt_type_multiplier": S.debt_type_multiplier(c("debt_type")),
        "exponent": exponent,
        "scaled": S.exponential_scaling(c("score"), exponent),
        "boost": boost,
        "final_score": S.exponential_scaling(c("score"), exponent) * S.debt_type_multiplier(c("debt_type")) * boost,
        "structural_multiplier": S.structural_multiplier(c("nesting"), c("cyclomatic")),
        "role_multiplier": S.role_multiplier(c("role")),
        "role_coverage_weight": S.role_coverage_weight(c("role")),
        "composition_quality": quality,
        "delegation_ratio": delegation,
        "orchestrator_adjusted": S.orchestrator_adjusted(c("score"), c("role"), c("callees"), quality),
        "context_adjusted": S.file_context_adjusted(c("score"), context, c("coverage")),
        "contextual": S.contextual_score(c("score"), c("fn") % 10, c("line") + 1.0),
        "debt_adjustment": S.debt_adjustment(c("line"), c("callees"), c("test_callers")),
        "god_boost": S.god_object_multiplier(is_god, c("score")),
        "file_god_boost": S.file_god_object_multiplier(is_god, c("score")),
    })


LEVEL = "(CASE fn % 5 WHEN 0 THEN 'StrictlyPure' WHEN 1 THEN 'LocallyPure' WHEN 2 THEN 'ReadOnly' WHEN 3 THEN 'Impure' END)"
PURITY = f"""(CASE WHEN {LEVEL} = 'StrictlyPure' THEN CASE WHEN coverage > 0.8 THEN 0.7 ELSE 0.8 END WHEN {LEVEL} = 'LocallyPure' THEN CASE WHEN coverage > 0.8 THEN 0.75 ELSE 0.85 END
 WHEN {LEVEL} = 'ReadOnly' THEN 0.9 WHEN {LEVEL} = 'Impure' THEN 1 WHEN is_test THEN CASE WHEN coverage > 0.8 THEN 0.7 ELSE 0.85 END ELSE 1 END)"""
IO = "(CASE WHEN callees = 0 THEN 'Impure' WHEN callees % 4 <= 2 AND callees <= 3 THEN 'IOIsolated' ELSE 'IOMixed' END)"
SPECTRUM = f"(CASE WHEN fn % 6 = 0 THEN 'Impure' WHEN is_test AND coverage > 0.8 THEN CASE WHEN line % 2 = 0 THEN 'LocallyPure' ELSE 'StrictlyPure' END WHEN is_test THEN 'LocallyPure' ELSE {IO} END)"
PATTERN = "(CASE WHEN line <= 0 OR callees <= 0 THEN 1 WHEN line * 1.0 / callees > 0.5 THEN 0.7 WHEN line * 1.0 / callees > 0.3 THEN 0.85 ELSE 1 END)"


@register("purity_and_flow", _sql({
    "purity_adjustment": PURITY,
    "purity_factor": _case(SPECTRUM, S.SPECTRUM_MULTIPLIER, 1.0),
    "pattern_factor": PATTERN,
    "data_flow_adjusted": "score * (" + _case(SPECTRUM, S.SPECTRUM_MULTIPLIER, 1.0) + f" * 0.4 + 0.3 + {PATTERN} * 0.3)",
    "entropy_dampening": "CASE WHEN coverage < 0.5 THEN least(greatest(1 - (line / 7.0) * 0.3, 0.5), 1) ELSE 1 END",
    "entropy_adjusted": "CASE WHEN coverage * (1 - (line / 7.0) * 0.3) * (1 - (callees / 9.0) * 0.2) < 0.5 THEN coverage * (1 - (line / 7.0) * 0.3) * (1 - (callees / 9.0) * 0.2) * 0.5 ELSE coverage * (1 - (line / 7.0) * 0.3) * (1 - (callees / 9.0) * 0.2) END",
}, {
    "io_isolation": IO,
    "purity_spectrum": SPECTRUM,
    "truncated_cyclomatic": f"CAST(trunc(cyclomatic * CAST({PURITY} AS DOUBLE)) AS BIGINT)",
    "is_trivial": "cyclomatic <= 3 AND cognitive <= 5 AND (role IN ('IOWrapper', 'EntryPoint', 'PatternMatch', 'Debug') OR (role = 'PureLogic' AND length <= 10))",
    "no_debt": "cyclomatic <= 3 AND cognitive <= 5 AND (role IN ('IOWrapper', 'EntryPoint', 'PatternMatch', 'Debug') OR (role = 'PureLogic' AND length <= 10)) AND coverage > 0",
    "cognitive_penalty": "CAST(CASE nesting WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 ELSE 8 END AS INT)",
}))
def purity_and_flow(spark, sf_dir):
    level = F.when(c("fn") % 5 == 0, "StrictlyPure").when(c("fn") % 5 == 1, "LocallyPure").when(c("fn") % 5 == 2, "ReadOnly").when(c("fn") % 5 == 3, "Impure")
    purity = S.purity_adjustment(level, c("is_test"), c("coverage"))
    io = S.io_isolation(c("callees") % 4, c("callees"))
    spectrum = S.purity_spectrum(c("fn") % 6 != 0, c("is_test"), c("coverage"), c("line") % 2 == 0, io)
    pattern = S.pattern_factor(c("line"), c("callees"))
    trivial = S.is_trivial(c("cyclomatic"), c("cognitive"), c("length"), c("role"))
    repetition, similarity = c("line") / 7, c("callees") / 9
    return _select(functions(spark, sf_dir), {
        "purity_adjustment": purity,
        "purity_factor": S.purity_factor(spectrum),
        "pattern_factor": pattern,
        "data_flow_adjusted": S.data_flow_adjusted(c("score"), S.purity_factor(spectrum), pattern),
        "entropy_dampening": S.entropy_dampening(c("coverage"), repetition),
        "entropy_adjusted": S.entropy_adjusted(c("coverage"), repetition, similarity),
    }, {
        "io_isolation": io,
        "purity_spectrum": spectrum,
        "truncated_cyclomatic": S.truncated(c("cyclomatic"), purity),
        "is_trivial": trivial,
        "no_debt": S.skipped_as_no_debt(trivial, c("coverage") > 0),
        "cognitive_penalty": S.cognitive_penalty(c("nesting")),
    })


EXPECTED_ROLE = "(CASE fn % 4 WHEN 0 THEN 'Pure' WHEN 1 THEN 'IoOperations' WHEN 2 THEN 'Debug' ELSE 'Utilities' END)"
LOW = "(CASE fn % 4 WHEN 0 THEN 90.0 WHEN 1 THEN 60.0 WHEN 2 THEN 20.0 ELSE 75.0 END)"
TARGET = "(CASE fn % 4 WHEN 0 THEN 95.0 WHEN 1 THEN 70.0 WHEN 2 THEN 30.0 ELSE 85.0 END)"
SEVERE = f"(CASE WHEN coverage * 100 >= {TARGET} THEN 'None' WHEN coverage * 100 >= {LOW} THEN 'Minor' WHEN coverage * 100 >= {LOW} * 0.5 THEN 'Moderate' ELSE 'Critical' END)"
VIOLATIONS = "((CASE WHEN cyclomatic > 20 THEN 1 ELSE 0 END) + (CASE WHEN production_callers > 15 THEN 1 ELSE 0 END) + (CASE WHEN callees > 5 THEN 1 ELSE 0 END) + (CASE WHEN length * 20 > 1000 THEN 1 ELSE 0 END))"
PRODUCT = "(least(cyclomatic / 20.0, 3) * least(production_callers / 15.0, 3) * least(callees / 3.0, 3) * least(length * 20 / 1000.0, 3))"
EASE = "(CASE WHEN cognitive < 3 THEN 0.7 WHEN cognitive > 10 THEN 1.5 ELSE 1 END)"
FLOOR = f"(CASE {VIOLATIONS} WHEN 1 THEN 30 WHEN 2 THEN 50 ELSE 70 END)"


@register("structure_scores", _sql({
    "god_score": f"CASE WHEN {VIOLATIONS} > 0 THEN greatest({PRODUCT} * 20 * {VIOLATIONS}, {FLOOR}) ELSE {PRODUCT} * 10 END",
    "god_score_weighted": f"CASE WHEN {VIOLATIONS} > 0 THEN greatest({PRODUCT} * 20 * {EASE} * {VIOLATIONS}, {FLOOR}) ELSE {PRODUCT} * 10 * {EASE} END",
    "god_complexity": "CASE WHEN cyclomatic = 0 THEN 1 ELSE least(greatest(least(greatest(cognitive / 5.0, 0.5), 2.0) * 0.4 + least(greatest(cyclomatic / 15.0, 0.5), 2.5) * 0.3 + least(greatest(cyclomatic * 3 / 75.0, 0.5), 2.0) * 0.2 + least(greatest(nesting / 5.0, 0.8), 1.5) * 0.1, 0.5), 3.0) END",
    "effective_methods": "cyclomatic * (CASE WHEN cognitive < 3 THEN 0.8 WHEN cognitive > 10 THEN 1.5 ELSE 1 END)",
    "weighted_total": "(cyclomatic + coverage * 100 + nesting * 0.8 + length * 0.3 + callees * 0.6) / 237.0 * 200.0",
    "facade_adjusted": "CASE WHEN fn % 2 = 0 THEN score * (CASE line % 4 WHEN 0 THEN 0.1 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 ELSE 1.0 END) * (CASE WHEN callees <= 4 THEN 0.9 WHEN callees <= 9 THEN 0.7 ELSE 0.5 END) * (CASE WHEN length * 20 // greatest(callees, 1) < 300 AND cyclomatic // greatest(callees, 1) < 15 THEN 0.5 WHEN length * 20 // greatest(callees, 1) < 500 AND cyclomatic // greatest(callees, 1) < 25 THEN 0.7 ELSE 0.9 END) ELSE score END",
    "coverage_gap_score": f"least(least(least(greatest({TARGET} - coverage * 100, 0) * 1.5, 100) * (CASE {SEVERE} WHEN 'Critical' THEN 2.0 WHEN 'Moderate' THEN 1.5 WHEN 'Minor' THEN 1.2 ELSE 1 END), 100) * (CASE fn % 4 WHEN 0 THEN 1.3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 ELSE 1.2 END), 100)",
    "file_scope_complexity": f"{CPLX} * (CASE fn % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.7 ELSE 1.0 END) * (CASE WHEN cognitive < 15 THEN 0.5 WHEN cognitive < 30 THEN 0.75 ELSE 1.0 END)",
    "percent_of_maximum": "least(cyclomatic / 60.0, 1) * 100",
}, {"coverage_gap_severity": SEVERE}))
def structure_scores(spark, sf_dir):
    role = F.when(c("fn") % 4 == 0, "Pure").when(c("fn") % 4 == 1, "IoOperations").when(c("fn") % 4 == 2, "Debug").otherwise("Utilities")
    quality = F.when(c("line") % 4 == 0, "Excellent").when(c("line") % 4 == 1, "Good").when(c("line") % 4 == 2, "Poor").otherwise("Monolithic")
    spread = F.when(c("fn") % 3 == 0, "Distributed").when(c("fn") % 3 == 1, "Mixed").otherwise("Concentrated")
    product, violations = S.god_object_sizes(c("cyclomatic"), c("production_callers"), c("callees"), c("length") * 20)
    # What several formulas use is a column first: the generated method stays small enough to be compiled.
    staged = functions(spark, sf_dir).withColumns({"product": product, "violations": violations, "expected": role, "quality": quality, "spread": spread})
    role, quality, spread = c("expected"), c("quality"), c("spread")
    return _select(staged, {
        "god_score": S.god_object_score(c("product"), c("violations")),
        "god_score_weighted": S.god_object_score(c("product"), c("violations"), c("cognitive")),
        "god_complexity": S.god_complexity_factor(c("cognitive"), c("cyclomatic"), c("cyclomatic") * 3, c("nesting")),
        "effective_methods": S.effective_methods(c("cyclomatic"), c("cognitive")),
        "weighted_total": S.weighted_total(c("cyclomatic"), c("coverage") * 100, c("nesting"), c("length"), c("callees")),
        "facade_adjusted": S.facade_adjusted(c("score"), c("fn") % 2 == 0, quality, c("callees"), c("cyclomatic"), c("length") * 20),
        "coverage_gap_score": S.coverage_gap_score(c("coverage") * 100, role),
        "file_scope_complexity": S.file_scope_complexity_factor(c("cyclomatic"), spread, c("cognitive")),
        "percent_of_maximum": S.percent_of_maximum(c("cyclomatic"), F.lit(60.0)),
    }, {"coverage_gap_severity": S.coverage_gap_severity(c("coverage") * 100, role)})


PERCENT = "(CASE WHEN fn % 7 = 0 THEN NULL ELSE coverage * 100 END)"
BASE_RISK = f"(((cyclomatic * 0.3 + cognitive * 0.45) / 50 + CASE WHEN is_test OR {PERCENT} IS NULL THEN 0 ELSE (100 - {PERCENT}) / 100 * 0.5 END) * 5)"
PENALTY = f"(CASE WHEN {PERCENT} IS NULL THEN 1 WHEN {PERCENT} < 20 THEN 3 WHEN {PERCENT} < 40 THEN 2 WHEN {PERCENT} < 60 THEN 1.5 WHEN {PERCENT} < 80 THEN 1.2 ELSE 0.8 END)"
DEBT = "(CASE WHEN line = 1 THEN 1 WHEN score / line <= 1 THEN 1 WHEN score / line <= 2 THEN 1.2 WHEN score / line <= 5 THEN 1.5 WHEN score / line <= 10 THEN 2 ELSE 2.5 END)"
RISK = f"(CASE WHEN cognitive > 40 THEN greatest({BASE_RISK} * {DEBT} * {PENALTY}, 3) ELSE {BASE_RISK} * {DEBT} * {PENALTY} END)"
RAW_ROI = "(score * (1 + least(callees * 0.1, 1)) * 0.9 / (line * 1.0))"


@register("risk_scores", _sql({
    "base_risk": BASE_RISK,
    "coverage_penalty": PENALTY,
    "debt_factor": DEBT,
    "risk_score": RISK,
    "risk_contribution": "least(coverage * 1.5 + least(cyclomatic / 20.0, 0.5), 2)",
    "bug_density": "CASE WHEN callees > 0 THEN line * 1.0 / callees ELSE 0 END",
    "roi": f"greatest((CASE WHEN {RAW_ROI} > 20 THEN 10 + ln(greatest({RAW_ROI} - 20, 1e-300)) WHEN {RAW_ROI} > 10 THEN 5 + ({RAW_ROI} - 10) * 0.5 ELSE {RAW_ROI} END) * 0.8, 0.1)",
    "criticality": "(CASE WHEN role = 'EntryPoint' THEN 2.0 ELSE 1 END) * (CASE WHEN callees > 5 THEN 1.5 WHEN callees > 2 THEN 1.2 ELSE 1 END) * (CASE WHEN is_test THEN 1.3 ELSE 1 END)",
    "coverage_urgency": "(1 - least(greatest(coverage * 0.7 + (callees / 10.0) * 0.3, 0), 1)) * (CASE WHEN cyclomatic = 0 THEN 0.5 ELSE least(ln(cyclomatic + 1.0) / 3 + 0.5, 2) END) * 10",
}, {
    "debt_score": "CAST((CASE line % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 10 END) * " + _case("debt_type", S.TYPE_WEIGHT, 3) + " AS BIGINT)",
    "effort_hours": "CAST(CASE fn % 4 WHEN 0 THEN CASE WHEN score >= 90 THEN 16 WHEN score >= 70 THEN 8 ELSE 4 END WHEN 1 THEN CASE WHEN score >= 70 THEN 8 ELSE 4 END ELSE CASE WHEN score >= 70 THEN 4 ELSE 2 END END AS INT)",
    "risk_category": f"CASE WHEN is_test THEN CASE WHEN (cyclomatic + cognitive) // 2 > 20 THEN 'High' WHEN (cyclomatic + cognitive) // 2 > 10 THEN 'Medium' ELSE 'Low' END WHEN {PERCENT} IS NULL THEN CASE WHEN (cyclomatic + cognitive) // 2 > 15 THEN 'Critical' WHEN (cyclomatic + cognitive) // 2 > 10 THEN 'High' WHEN (cyclomatic + cognitive) // 2 > 5 THEN 'Medium' ELSE 'Low' END WHEN (cyclomatic + cognitive) // 2 > 10 AND {PERCENT} > 80 THEN 'WellTested' WHEN score >= 8 THEN 'Critical' WHEN score >= 6 THEN 'High' WHEN score >= 4 THEN 'Medium' ELSE 'Low' END",
}))
def risk_scores(spark, sf_dir):
    staged = functions(spark, sf_dir).withColumn("percent", F.when(c("fn") % 7 != 0, c("coverage") * 100))
    percent = c("percent")
    base, penalty = S.base_risk(c("cyclomatic"), c("cognitive"), percent, c("is_test")), S.coverage_penalty(percent)
    debt = S.debt_factor(c("score"), F.when(c("line") > 1, c("line")))
    priority = F.when(c("line") % 4 == 0, "Low").when(c("line") % 4 == 1, "Medium").when(c("line") % 4 == 2, "High").otherwise("Critical")
    category = F.when(c("fn") % 4 == 0, "Architecture").when(c("fn") % 4 == 1, "Performance").when(c("fn") % 4 == 2, "Testing").otherwise("CodeQuality")
    staged = staged.withColumns({"base": base, "penalty": penalty, "debt": debt})
    return _select(staged, {
        "base_risk": c("base"),
        "coverage_penalty": c("penalty"),
        "debt_factor": c("debt"),
        "risk_score": S.risk_score(c("base"), c("debt"), F.lit(1.0), c("penalty"), F.lit(1.0), c("cognitive")),
        "risk_contribution": S.risk_contribution(c("cyclomatic"), c("coverage")),
        "bug_density": S.bug_density(c("line"), c("callees")),
        "roi": S.roi(c("score"), c("callees"), F.lit(0.9), c("line"), F.lit(0.8)),
        "criticality": S.criticality(c("role") == "EntryPoint", c("callees"), c("is_test")),
        "coverage_urgency": S.coverage_urgency(c("coverage"), c("callees") / 10, c("cyclomatic")),
    }, {
        "debt_score": S.debt_score(priority, c("debt_type")),
        "effort_hours": S.effort_hours(category, c("score")),
        "risk_category": K.risk_category(c("cyclomatic"), c("cognitive"), percent, c("score"), c("is_test")),
    })


DEPS = "(production_callers + callees)"
HOT = "(cyclomatic > 10 OR cognitive > 15 OR cyclomatic > " + _case("role", {k: v[0] for k, v in K.HOTSPOT_LIMITS.items()}, 10) + " OR cognitive > " + _case("role", {k: v[1] for k, v in K.HOTSPOT_LIMITS.items()}, 15) + ")"
TIER_SQL = f"""CASE WHEN debt_type IN ('GodObject', 'ErrorSwallowing', 'AsyncMisuse') OR score / 10 > 10 OR cyclomatic > 50 OR cognitive >= 20 OR nesting >= 5 OR {CPLX} > 5 THEN 'T1'
 WHEN (debt_type = 'TestingGap' AND (cyclomatic >= 15 OR {DEPS} >= 10 OR role = 'EntryPoint')) OR (debt_type = 'ComplexityHotspot' AND ({CPLX} >= 2 OR cognitive >= 12 OR nesting >= 3 OR cyclomatic BETWEEN 8 AND 50)) THEN 'T2'
 WHEN debt_type = 'TestingGap' AND cyclomatic >= 10 THEN 'T3' ELSE 'T4' END"""
SIMPLE = "(CASE WHEN cyclomatic <= 3 AND cognitive <= 5 THEN CASE WHEN role IN ('IOWrapper', 'EntryPoint', 'PatternMatch', 'Debug', 'PureLogic') THEN 0.0 ELSE 0.1 END END)"


@register("classifications", _sql({"simple_risk": SIMPLE}, {
    "tier": TIER_SQL,
    "severity_10": "CASE WHEN score >= 8 THEN 'Critical' WHEN score >= 6 THEN 'High' WHEN score >= 4 THEN 'Medium' ELSE 'Low' END",
    "severity_100": "CASE WHEN score >= 70 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 30 THEN 'Medium' ELSE 'Low' END",
    "priority_open": "CASE WHEN score >= 100 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 20 THEN 'Medium' ELSE 'Low' END",
    "category": _case("debt_type", K.CATEGORY, "CodeQuality"),
    "aggregation_category": _case("debt_type", K.AGGREGATION_CATEGORY, "Organization"),
    "test_debt": "CASE WHEN cyclomatic > 15 OR cognitive > 20 THEN 'TestComplexityHotspot' ELSE 'TestingGap' END",
    "is_hotspot": HOT,
    "is_dead": "production_callers = 0 AND NOT (fn % 3 = 0) AND NOT (line = 7)",
    "debt_types": f"CASE WHEN is_test THEN CASE WHEN cyclomatic > 15 OR cognitive > 20 THEN 'TestComplexityHotspot' ELSE 'TestingGap' END WHEN coverage < 0.5 OR {HOT} OR production_callers = 0 THEN concat_ws('+', CASE WHEN coverage < 0.5 THEN 'TestingGap' END, CASE WHEN {HOT} THEN 'ComplexityHotspot' END, CASE WHEN production_callers = 0 THEN 'DeadCode' END) WHEN {SIMPLE} IS NOT NULL THEN 'Risk' ELSE '' END",
    "cohesion": "CASE WHEN coverage >= 0.7 THEN 'High' WHEN coverage >= 0.4 THEN 'Medium' ELSE 'Low' END",
    "distribution": "CASE WHEN cyclomatic = 0 THEN 'Distributed' WHEN cognitive * 1.0 / cyclomatic > 0.5 THEN 'Concentrated' WHEN cognitive * 1.0 / cyclomatic > 0.2 THEN 'Mixed' ELSE 'Distributed' END",
    "stability_status": "CASE WHEN callees > 5 AND coverage > 0.3 THEN 'HighlyUnstable' WHEN callees > 2 THEN 'FrequentlyChanged' WHEN coverage > 0.2 THEN 'BugProne' WHEN length * 10 > 365 THEN 'MatureStable' ELSE 'RelativelyStable' END",
    "blast_contribution": "CAST(CASE WHEN callees > 10 THEN 1.5 WHEN callees > 5 THEN 1.0 WHEN callees > 2 THEN 0.5 WHEN callees = 2 THEN 0.2 ELSE 0.0 END AS DOUBLE)",
    "severity_rank": "CASE WHEN score >= 8 THEN 3 WHEN score >= 6 THEN 2 WHEN score >= 4 THEN 1 ELSE 0 END",
    "test_context": "CASE WHEN (CASE WHEN coverage >= 0.7 AND line >= 5 AND callees >= 7 THEN greatest(0.2 * (fn % 2) + 0.35 * line / 7.0 + 0.25 * coverage + 0.15 * callees / 10.0 + 0.049, 0.85) ELSE 0.2 * (fn % 2) + 0.35 * line / 7.0 + 0.25 * coverage + 0.15 * callees / 10.0 + 0.049 END) > 0.5 THEN 'Test' ELSE 'Production' END",
}))
def classifications(spark, sf_dir):
    score, cyc, cog, role, debt = c("score"), c("cyclomatic"), c("cognitive"), c("role"), c("debt_type")
    types = K.debt_types(c("is_test"), cyc, cog, role, c("coverage") < 0.5, K.is_dead(c("production_callers"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")))
    return _select(functions(spark, sf_dir), {"simple_risk": K.simple_risk(cyc, cog, role)}, {
        "tier": K.tier(debt, score / 10, cyc, cog, c("nesting"), S.complexity_factor(cyc), c("production_callers") + c("callees"), role),
        "severity_10": K.severity_10(score),
        "severity_100": K.severity_100(score),
        "priority_open": K.priority_open(score),
        "category": K.category(debt),
        "aggregation_category": K.aggregation_category(debt),
        "test_debt": K.test_debt(cyc, cog),
        "is_hotspot": K.is_hotspot(cyc, cog, role),
        "is_dead": K.is_dead(c("production_callers"), c("fn") % 3 == 0, c("line") == 7),
        "debt_types": F.array_join(types, "+"),
        "cohesion": K.cohesion(c("coverage")),
        "distribution": K.distribution(cog, cyc),
        "stability_status": K.stability_status(c("callees"), c("coverage"), c("length") * 10),
        "blast_contribution": K.blast_radius_contribution(c("callees")),
        "severity_rank": K.severity_rank(K.severity_10(score)),
        "test_context": K.test_file_context(c("coverage"), c("line") / 7, c("callees") / 10, F.lit(0.98), c("fn") % 2)[0],
    })
