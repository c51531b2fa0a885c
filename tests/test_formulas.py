"""Thresholds below, at and above each edge, and properties of the formulas."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import classify as K
from tidemark.functions import scoring as S
from tidemark.functions import text as X


def column(spark, build, values, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


@pytest.mark.parametrize("build, edges", [(K.severity_10, (4, 6, 8)), (K.severity_100, (30, 50, 70)), (K.priority_open, (20, 50, 100))])
def test_severity_edges(spark, build, edges):
    values = [v for e in edges for v in (e - 1e-6, float(e), e + 1e-6)]
    low, mid, high, top = "Low", "Medium", "High", "Critical"
    assert column(spark, build, values) == [low, mid, mid, mid, high, high, high, top, top]


def test_roi_breaks(spark):
    got = column(spark, S.scaled_roi, [10.0, 10.0001, 20.0, 20.0001, 21.0])
    assert got[0] == 10 and got[1] == pytest.approx(5.00005) and got[2] == 10 and got[3] < 1 and got[4] == pytest.approx(10)


def test_scaling_lifts_scores_below_one(spark):
    assert column(spark, lambda x: S.exponential_scaling(x, F.lit(1.4)), [0.0, 0.5, 1.0, 2.0]) == [1.0, 1.0, 1.0, pytest.approx(2**1.4)]


def test_structural_edges(spark):
    assert column(spark, lambda x: S.structural_multiplier(x, F.lit(100)), [0.0, 10.0, 20.0, 40.0, 50.0, 60.0]) == [0.7, 0.85, 1.0, 1.15, 1.3, 1.5]


def test_coverage_factor_edges(spark):
    got = column(spark, lambda x: S.coverage_factor(x, F.lit(False)), [0.0, 0.1999, 0.2, 0.4999, 0.5, 1.0])
    assert got == [10.0, pytest.approx(5 + 3 * 0.8001), pytest.approx(3.6), pytest.approx(2 + 2 * 0.5001), pytest.approx(0.5**1.5 + 0.1), 0.1]


def test_nulls(spark):
    assert column(spark, S.coverage_penalty, [None, 19.9, 20.0, 80.0]) == [1.0, 3.0, 2.0, 0.8]
    assert column(spark, lambda x: S.debt_factor(x, F.lit(None).cast("double")), [5.0]) == [1.0]
    assert column(spark, lambda x: S.purity_adjustment(F.lit(None).cast("string"), F.lit(True), x), [None, 0.81]) == [0.85, 0.70]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 5000), min_size=2, max_size=30))
def test_normalisation_rises_and_inverts(spark, values):
    values = sorted(values)
    scores = column(spark, S.normalized_final_score, values)
    # At 100 the published constants leave a step down of 0.002.
    assert all(b >= a - 0.01 for a, b in zip(scores, scores[1:]))
    back = column(spark, lambda x: S.denormalized_score(S.normalized_final_score(x)), values)
    assert all(math.isclose(a, b, rel_tol=1e-3, abs_tol=1e-6) for a, b in zip(values, back))


@pytest.mark.parametrize("message, fix", [("Fix crash", True), ("prefix work", False), ("style: fix", False), ("refactor: hotfix", True), ("refactor: move", False), ("fix typo", False), ("bug-12", True), ("debug", False)])
def test_bug_fix(spark, message, fix):
    assert column(spark, K.is_bug_fix, [message], "string") == [fix]


def test_names(spark):
    assert column(spark, X.closure_parent, ["a::{{closure}}", "::{{closure}}", "a"], "string") == ["a", None, None]
    assert column(spark, lambda x: F.array_join(X.name_variants(x), "|"), ["a::b<T>", "f"], "string") == ["a::b<T>|a::b|b<T>|b", "f"]
    assert column(spark, X.without_trailing_generics, ["f<A<B>>", "g::<T>", "h<T>::i"], "string") == ["f", "g", "h<T>::i"]
    assert [tuple(r) for r in column(spark, X.location_parts, ["f.rs", "f.rs:g", "f.rs:g:3", "f.rs:*:4", "f.rs:7"], "string")] == [("f.rs", None, None), ("f.rs", "g", None), ("f.rs", "g", 3), ("f.rs", None, 4), ("f.rs", None, 7)]
    assert column(spark, lambda x: X.location_similarity(x, F.lit("abcd")), ["ABCD", "ab", "abxy", "zz"], "string") == [1.0, 0.5, 0.5, 0.0]
