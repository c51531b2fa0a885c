from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, start long, block string"


def rows(n=300):
    out = [(i, " ".join(f"w{i}x{k}" for k in range(i % 40)), "en", ("b", "a", "c", None)[(i * i) % 7 % 4] if i % 3 else "hot", 0, "x") for i in range(n)]
    return [*out, (9001, None, "en", "a", 0, "x"), (9002, "", "en", "only empty", 0, "x"), (9003, "long " * 5000, "en", "c", 0, "x"), (9004, " \t\n", "en", None, 0, "x")]


def plain_targets(sizes, weights, repeats):
    """Water filling by rounds: what capped sources can't take goes to the others."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = {s: repeats * sizes[s] for s in free if share[s] > repeats * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.account(docs).collect()
    assert len(got) == len(rows())
    source, size = {r[0]: r[3] for r in rows()}, {r[0]: len((r[1] or "").split()) for r in rows()}
    sizes = Counter()
    for i, s in source.items():
        sizes[s] += size[i]
    targets = plain_targets(sizes, (5, 2, 1), 3.0)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s])
        assert r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 64 + 0.03 * t
    again = mixing.account(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pieces_are_what_account_takes(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    pieces = mixing.mix(docs).withColumn("n", F.regexp_count("text", F.lit(r"\S+"))).collect()
    taken = Counter()
    text = {r[0]: r[1] for r in rows()}
    for r in pieces:
        assert r.text in text[r.doc_id] and r.n == r.mix_words
        taken[r.doc_id] += r.n
    assert taken == Counter({r.doc_id: r.taken for r in mixing.account(docs).collect() if r.taken})
    assert set(docs.columns) <= set(mixing.mix(docs).columns)


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 64, 101):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit("s"))).collect()
        assert sorted(r[0] for r in out) == list(range(n))
    moved = spark.range(1000).select("id", mixing.permuted(F.col("id"), F.lit(1000), F.lit(1)).alias("p")).collect()
    assert sum(r.id == r.p for r in moved) < 20


def test_repeated_rows_and_empty_tables(spark):
    twice = spark.createDataFrame([(1, "a b c", "en", "s", 0, "x")] * 2 + [(None, "d e", "en", "s", 0, "x")], SCHEMA)
    got = mixing.account(twice).collect()
    assert len(got) == 3 and all(r.source_size == 8 for r in got) and sum(r.taken for r in got) == 8
    assert sorted(r.text for r in mixing.mix(twice.where("doc_id = 1")).collect()) == ["a b c", "a b c"]
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.account(none).count() == 0 and mixing.mix(none).count() == 0
    assert [r.taken for r in mixing.account(spark.createDataFrame([(1, "", "en", None, 0, "x")], SCHEMA)).collect()] == [0]
