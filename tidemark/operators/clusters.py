"""Clusters of methods within a type or file: by their calls, or by their names first and their calls then."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import ship

# The largest group that is clustered, rounds, the smallest cluster and least cohesion that count, the largest category that is left whole.
MOST_METHODS, ROUNDS, LEAST_METHODS, LEAST_COHESION, SMALL_CATEGORY = 200, 10, 3, 0.2, 5


def moved(methods: list[str], links: dict[str, Counter]) -> dict[str, int]:
    """Each method's cluster: one by one, methods go where the largest share of their calls is, until none gains or ROUNDS are over; of equals the smallest cluster, then the lowest."""
    at = {m: i for i, m in enumerate(methods)}
    size = Counter(at.values())
    for _ in range(ROUNDS):
        still = True
        for m in methods:
            pull = Counter()
            for other, n in links[m].items():
                if other != m and other in at:
                    pull[at[other]] += n
            if pull:
                best = min(pull, key=lambda c: (-pull[c], size[c], c))
                if best != at[m] and pull[best] > pull[at[m]]:
                    size[at[m]] -= 1
                    size[best] += 1
                    at[m], still = best, False
        if still:
            break
    return at


def cohesion(members: set[str], links: dict[str, Counter]) -> float:
    """Calls inside as a share of all calls of the members; 0 without calls."""
    inside = sum(n for m in members for o, n in links[m].items() if o in members and o != m) / 2
    outside = sum(n for m in members for o, n in links[m].items() if o not in members)
    return inside / (inside + outside) if inside + outside else 0.0


def communities_of(methods: list[str], links: dict[str, Counter]) -> list[list[str]]:
    """Clusters of LEAST_METHODS or more with a cohesion above LEAST_COHESION, in the order of their first methods."""
    groups = defaultdict(list)
    for m, c in moved(methods, links).items():
        groups[c].append(m)
    return [g for g in groups.values() if len(g) >= LEAST_METHODS and cohesion(set(g), links) > LEAST_COHESION] if any(links.values()) else []


def hybrid_of(methods: list[str], links: dict[str, Counter]) -> list[tuple[str, list[str]]]:
    """(category, methods): methods by the first word of their names; categories above SMALL_CATEGORY are cut by their calls, and what that leaves over stays together."""
    by_word = defaultdict(list)
    for m in methods:
        by_word[m.split("_")[0]].append(m)
    out = []
    for word, members in by_word.items():
        parts = communities_of(members, links) if len(members) > SMALL_CATEGORY else []
        rest = [m for m in members if not any(m in p for p in parts)]
        out += [(word, p) for p in [*parts, rest] if p]
    return out


def method_clusters(methods: DataFrame, calls: DataFrame, hybrid: bool = False) -> DataFrame:
    """(grp, cluster, category, method, cohesion) for methods (grp, method) and calls (grp, a, b, n).

    A group is a type or file; one of more than MOST_METHODS methods is left
    out, so what a task holds is bounded. Without ``hybrid``, methods in no
    cluster are left out and ``category`` is the most frequent first word.
    Repeated methods count once; null methods or ends don't count. An empty
    table gives an empty result.
    """
    ship(methods.sparkSession)
    known = methods.where("method is not null").select("grp", "method").distinct()
    small = known.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= MOST_METHODS).select("grp")
    summed = calls.where("a is not null and b is not null").groupBy(F.col("grp").alias("of"), "a", "b").agg(F.sum("n").alias("n")).join(small.withColumnRenamed("grp", "of"), "of", "left_semi")

    def run(key: tuple, members: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        names, links = sorted(members["method"]), defaultdict(Counter)
        for a, b, n in zip(edges["a"], edges["b"], edges["n"], strict=True):
            links[a][b] += int(n)
            links[b][a] += int(n)
        found = hybrid_of(names, links) if hybrid else [(min(c := Counter(m.split("_")[0] for m in g), key=lambda w: (-c[w], w)), g) for g in communities_of(names, links)]
        rows = [(key[0], i, word, m, round(cohesion(set(g), links), 6)) for i, (word, g) in enumerate(found) for m in g]
        return pd.DataFrame(rows, columns=["grp", "cluster", "category", "method", "cohesion"])

    kind = known.schema["grp"].dataType.simpleString()
    grouped = known.join(small, "grp", "left_semi").groupBy("grp").cogroup(summed.groupBy("of"))
    return grouped.applyInPandas(run, f"grp {kind}, cluster int, category string, method string, cohesion double")
