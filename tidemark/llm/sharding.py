"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows fall into partitions by hash. How many rows of each partition go to each
shard is drawn exactly (each partition's counts are multivariate
hypergeometric), so shard sizes are fixed beforehand and every assignment of
rows is equally likely. Each partition is permuted and cut by its row of the
matrix; after the exchange each shard is permuted again, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text import utf8

#: Rows that a partition or block is meant to have, and the most partitions: the matrix stays below MOST * n_shards numbers.
ROWS, MOST = 512, 8192


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones among ``sample`` drawn without replacement; any population size."""
    if min(good, bad, sample, good + bad - sample) == 0:
        return max(0, sample - bad) if bad == 0 or sample == good + bad else min(good, sample)
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    # Ratio of uniforms (Stadlober, 1989) for populations beyond numpy's limit.
    few, many, population = min(good, bad), max(good, bad), good + bad
    m = min(sample, population - sample)
    p = few / population
    centre = m * p + 0.5
    deviation = math.sqrt((population - m) * sample * p * (1 - p) / (population - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * deviation + 3 - 2 * math.sqrt(3 / math.e)
    mode = (m + 1) * (few + 1) // (population + 2)

    def log_weight(k: int) -> float:
        return -sum(map(math.lgamma, (k + 1, few - k + 1, m - k + 1, many - m + k + 1)))

    top, most = log_weight(mode), min(min(m, few) + 1, math.floor(centre + 16 * deviation))
    while True:
        x, y = rng.random(), rng.random()
        w = centre + width * (y - 0.5) / max(x, 1e-300)
        if 0 <= w < most and 2 * math.log(max(x, 1e-300)) <= log_weight(int(w)) - top:
            k = int(w) if good <= bad else m - int(w)
            return k if m == sample else good - k


def communication_matrix(rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Counts [partition][shard] with the given row sums; shard totals differ by one at most."""
    total = sum(rows)
    left = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng = np.random.Generator(np.random.PCG64(seed))
    matrix = []
    for n in rows:
        rest, drawn = sum(left), []
        for s in range(n_shards):
            rest -= left[s]
            k = hypergeometric(rng, left[s], rest, n)
            n -= k
            left[s] -= k
            drawn.append(k)
        matrix.append(drawn)
    return matrix


def uniform_shards(rows: DataFrame, n_shards: int = 16, seed: int = 11, key: list[str] | None = None) -> DataFrame:
    """``rows`` with (shard int, slot long): a uniform shuffle; shard sizes differ by one at most, slots of a shard are 0 to its size - 1.

    ``key`` names the columns that tell rows apart (all, if None; map columns
    must be left out). Equal rows are interchangeable; nulls are ordinary
    values; reruns agree. An empty table gives an empty result. Columns named
    shard or slot are replaced; internal names start with "__tidemark".
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    key = key or rows.columns
    total = rows.count()
    parts = min(MOST, max(1, math.ceil(total / ROWS)))
    at, local, starts, block, base = (f"__tidemark_{x}" for x in ("part", "local", "starts", "block", "base"))

    def hashed(purpose: str) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(purpose), *(F.col(c) for c in key))

    dealt = rows.withColumn(at, F.pmod(hashed("partition"), F.lit(parts)))
    counts = dict(dealt.groupBy(at).count().collect())  # MOST rows at most
    present = sorted(counts)
    matrix = communication_matrix([counts[p] for p in present], n_shards, seed)
    firsts = [[sum(drawn[:s]) for s in range(n_shards)] for drawn in matrix]
    schema = T.StructType([T.StructField(at, T.LongType()), T.StructField(starts, T.ArrayType(T.LongType()))])
    cuts = F.broadcast(spark.createDataFrame(list(zip(present, firsts, strict=True)), schema))
    mixed = dealt.withColumn(local, F.row_number().over(Window.partitionBy(at).orderBy(hashed("local"), *key)) - 1)
    sent = mixed.join(cuts, at).withColumn("shard", (F.size(F.filter(starts, lambda x: x <= F.col(local))) - 1).cast("int")).drop(at, local, starts)
    blocks = max(1, math.ceil(total / n_shards / ROWS))
    sent = sent.withColumn(block, F.pmod(hashed("block"), F.lit(blocks)))
    sizes = sent.groupBy("shard", block).agg(F.count(F.lit(1)).alias(base))
    before = Window.partitionBy("shard").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", block, F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    again = Window.partitionBy("shard", block).orderBy(hashed("slot"), *key)
    return sent.withColumn("slot", F.row_number().over(again) - 1).join(bases, ["shard", block]).withColumn("slot", (F.col("slot") + F.col(base)).cast("long")).select(*rows.columns, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within and across its files."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def account(docs: DataFrame, n_shards: int = 16, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``; the law is rows, so grown_shard is null.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1. Null ids and texts
    and repeated rows are dealt like others. Other columns are not read.
    """
    narrow = docs.select(F.col(id_col).alias(id_col), (F.octet_length(utf8(F.col(text_col))) + 1).cast("long").alias("size"), F.crc32(utf8(F.col(text_col))).alias("text_crc32"))
    dealt = uniform_shards(narrow, n_shards, seed)
    return dealt.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
