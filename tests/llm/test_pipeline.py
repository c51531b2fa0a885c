"""The corpus pipeline, stage by stage, against plain versions on a small set."""

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.brute import linked, shingle_set, smallest
from tidemark.llm.scratch import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, function in corpus_pipeline.STAGES:
        docs = materialize(function(spark, docs, SF), name)
        out.append(docs.toPandas())
    return [spark.read.parquet(f"{SF}/documents.parquet").toPandas(), *out]


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_all_but_the_last_keep_the_columns(stages):
    assert all(list(s.columns) == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])


def test_quality_keeps_good_labels(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    kept = set(stages[1].doc_id)
    held = {i: q for i, q in labels.items()}
    assert sum((i in kept) == (q == 1) for i, q in held.items()) / len(held) > 0.95


def test_exact_copies_leave_the_largest_id(stages):
    want = stages[1].groupby("text").doc_id.max()
    assert sorted(stages[2].doc_id) == sorted(want)


def test_near_copies_leave_the_smallest_id(stages):
    before = stages[2].sort_values("doc_id")
    ids = before.doc_id.tolist()
    component = smallest(ids, linked([shingle_set(t) for t in before.text], 80))
    assert sorted(stages[3].doc_id) == [i for i, c in zip(ids, component, strict=True) if i == c]


def test_mix_takes_pieces_of_its_documents(stages):
    text = stages[3].set_index("doc_id").text
    mixed = stages[4]
    assert all(t in text[i] for i, t in zip(mixed.doc_id, mixed.text, strict=True))
    assert (mixed.n_chars == mixed.text.str.len()).all()
    taken, size = Counter(), {i: len(t.split()) for i, t in text.items()}
    for i, t in zip(mixed.doc_id, mixed.text, strict=True):
        taken[i] += len(t.split())
    assert all(n <= 3 * size[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(size.values())) < 0.1 * sum(size.values())


def test_tokens_decode_to_the_pieces(stages):
    assert sorted(stages[5].decoded) == sorted(stages[4].text)
    assert (stages[5].ids.map(len) == 4 * stages[5].n_tokens).all()


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == len(stages[-1])
    assert corpus_pipeline.ORACLE_SQL is None


EDGES = [(1, "good words in a row " * 9, "en", "a", 0), (1, "good words in a row " * 9, "en", "a", 0), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "some text of a null id", "en", None, 1), (None, "some text of a null id", "en", None, 1), (4, "Good words in a row " * 9, "en", "b", 2), (5, "x", "en", "b", 1)]


@pytest.mark.parametrize("rows", [EDGES, []])
def test_stages_take_nulls_repeats_clashes_and_empty_tables(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name in ("key", "id", "digest", "score", "label", "component", "mix_piece", "start", "block", "bands", "__mark"):
        docs = docs.withColumn(name, docs["n_chars"])
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = materialize(stage(spark, docs, SF), name)
        assert name == "bpe" or docs.columns == before
        counts.append(docs.count())
    if not rows:
        assert counts == [0] * 5
        return
    assert len(counts) == 5 and counts[0] <= len(rows) and counts[3] == counts[4] > 0


def test_exact_and_near_stages_on_nulls(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.distinct_texts(spark, docs, SF)
    assert sorted(((r.doc_id, (r.text or "")[:9]) for r in exact.collect()), key=str) == sorted([(1, "good word"), (3, ""), (4, "Good word"), (5, "x"), (None, "some text")], key=str)
    near = corpus_pipeline.no_near_copies(spark, exact, SF)
    assert sorted((str(r.doc_id) for r in near.collect())) == ["1", "3", "5", "None"]
