"""A training corpus from ``documents``: quality, exact and near copies, source mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, minhash, mixing, quality
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.scratch import materialize

#: Words of a block that the mix draws.
BLOCK_TOKENS = 256


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null texts are scored as empty; null ids and repeated rows are scored like
    others. Without labels all stay. An empty table gives an empty one.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null texts equal the empty one; null ids lose to others; of rows that
    repeat id and text one stays. An empty table gives an empty one.
    """
    return exact_dedup.deduplicate(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingle similarities of 0.8 or more the smallest id stays.

    Documents without words, null texts included, and rows with null ids all
    stay. Rows that share a kept id stay. An empty table gives an empty one.
    """
    return minhash.deduplicate(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents as the mix draws them, with the document's id, language and source; n_chars is the piece's.

    Null sources are a source of their own; null ids are kept; documents
    without words give no piece. Repeated rows each give theirs. Other columns
    go along. An empty table gives an empty one.
    """
    pieces = mixing.mix(docs, block_tokens=BLOCK_TOKENS).drop("mix_shard", "mix_words")
    return pieces.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece's packed ids and the text that they decode to; a null text counts as empty, repeated rows each get a row, columns other than doc_id, lang and source don't matter. An empty table gives an empty one."""
    coded = bpe.Tokenizer(spark, tokenizer_path()).round_trip(docs)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", no_near_copies),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
