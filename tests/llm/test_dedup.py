import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import exact_dedup, minhash
from tidemark.operators.components import components
from tests.llm.brute import linked, shingle_set, smallest

SCHEMA = "doc_id long, text string, digest string, keep_id int, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", 0, 0) for i, t in rows], SCHEMA)


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(i, f"text {i % 90}") for i in range(300)] + [(1000 + i, "hot") for i in range(400)] + [(5000, None), (5001, ""), (5002, " "), (5003, "Text 1"), (5004, "é" * 50_000), (5005, "é" * 50_000), (None, "hot"), (None, "alone")]


def test_exact_annotation(spark):
    got = exact_dedup.annotate(frame(spark, ROWS))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(ROWS)


def test_exact_with_a_small_summary(spark):
    """Few tracked digests: what the summary loses is settled by the shuffle."""
    got = exact_dedup.annotate(frame(spark, ROWS), tracked=16)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_exact(ROWS)


def test_exact_deduplicate(spark):
    docs = frame(spark, [*ROWS, (7, "text 7"), (7, "text 7"), (1399, "hot"), (1399, "hot")])
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert len(rows) == len({t or "" for _, t in ROWS})
    want = {t: keep for (i, t) in ROWS if (keep := max((x for x, u in ROWS if (u or "") == (t or "") and x is not None), default=None)) == i}
    assert {t: i for i, t in rows} == want


def test_exact_empty(spark):
    assert exact_dedup.annotate(frame(spark, [])).count() == 0 == exact_dedup.deduplicate(frame(spark, [])).count()


def words(*ranges):
    return " ".join(f"w{k}" for r in ranges for k in r)


NEAR = [
    (10, words(range(100))), (11, words(range(100)).upper()), (12, words(range(3, 100))), (13, words(range(90), range(500, 510))), (14, words(range(200, 300))),
    (3, words(range(100)).replace(" ", "\n\t")), (20, "a b"), (21, "A  b"), (22, "a b c"), (23, ""), (24, None), (25, " \n"), (26, "ß É"), (27, "ß é"), (28, words(range(1000, 21000))), (29, words(range(1000, 20990))),
    (None, words(range(100))), (None, "only here"), (None, ""),
]


def brute_near(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    named = [(i, s) for (i, _), s in zip(rows, sets, strict=True) if i is not None]
    comp = dict(zip((i for i, _ in named), smallest([i for i, _ in named], linked([s for _, s in named], percent)), strict=True))
    by_set = {}
    for i, s in named:
        if s:
            by_set[s] = min(comp[i], by_set.get(s, comp[i]))
    return sorted(((i, len(s), c := comp[i] if i is not None else by_set.get(s), i == c) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def test_near_components(spark):
    got = minhash.classes(frame(spark, NEAR))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_near(NEAR, 85)


def chains(seed):
    """Families of edited copies: many pairs just above and below the threshold, links that only chains show."""
    import random

    rng, out = random.Random(seed), []
    for family in range(6):
        text = [f"f{family}w{k}" for k in range(120)]
        for _ in range(25):
            copy = list(text)
            for _ in range(rng.choice((1, 2, 3, 4))):
                copy[rng.randrange(len(copy))] = f"e{rng.random()}"
            out.append((rng.randrange(10**9), " ".join(copy)))
            if rng.random() < 0.2:
                text = copy
    return out


def test_near_copies_around_the_threshold(spark):
    for seed in (1, 2):
        rows = chains(seed)
        got = sorted((tuple(r) for r in minhash.classes(frame(spark, rows)).collect()), key=str)
        assert got == brute_near(rows, 85)


def test_near_deduplicate(spark):
    docs = frame(spark, NEAR)
    got = minhash.deduplicate(docs, percent=80)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id for r in got.collect()), key=str)
    assert kept == sorted((i for i, _, c, k in brute_near(NEAR, 80) if k or i is None), key=str)
    assert minhash.deduplicate(frame(spark, [])).count() == 0


def test_rows_of_one_id_are_one_node(spark):
    rows = [(1, words(range(50))), (1, words(range(100, 150))), (2, words(range(50))), (3, words(range(100, 150))), (4, words(range(300, 350)))]
    assert {(r.doc_id, r.component_id) for r in minhash.classes(frame(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, pairs):
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    at = {x: i for i, x in enumerate(nodes)}
    want = dict(zip(nodes, smallest(nodes, [(at[a], at[b]) for a, b in pairs if a != b]), strict=True))
    got = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == want
