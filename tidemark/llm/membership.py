"""Rows whose id is, or is not, among given ids, by a Bloom filter of bounded size, so that the rows themselves are hardly shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 16 an id, within these bounds, so at most 16 MB are broadcast. Of more ids a fuller filter lets more other rows pass.
FILTER_BITS = (1 << 18, 1 << 27)
_BLOCK, _BIT, _MARKS = "__tidemark_block", "__tidemark_bit", "__tidemark_marks"


def _marked(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` with the filter's columns, and whether the filter of ``ids`` (id) has ``key``: never false for one that it was given."""
    bits, wanted = FILTER_BITS[0], ids.count() * 16
    while bits < min(wanted, FILTER_BITS[1]):
        bits *= 2

    def place(of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(bits))

    own = place(F.col("id"))
    marks = ids.select((own / 32768).cast("int").alias(_BLOCK), (own % 32768).cast("long").alias("bit")).groupBy(_BLOCK).agg(F.expr("bitmap_construct_agg(bit)").alias(_MARKS))
    placed = rows.withColumns({_BLOCK: (place(key) / 32768).cast("int"), _BIT: (place(key) % 32768).cast("int")}).join(F.broadcast(marks), _BLOCK, "left")
    byte = F.conv(F.hex(F.substring(F.col(_MARKS), F.lit(1) + (F.col(_BIT) / 8).cast("int"), F.lit(1))), 16, 10).cast("int")
    return placed, F.coalesce(key.isNotNull() & (F.getbit(byte, F.col(_BIT) % 8) == 1), F.lit(False))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` (id), and a few others."""
    placed, marked = _marked(rows, F.col("id"), ids)
    return placed.where(marked).select(rows.columns)


def without(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not in the table ``ids`` (id), exactly; a null key never is. Only rows that the filter marks are shuffled."""
    placed, marked = _marked(rows, key, ids)
    away = placed.where(~marked).select(rows.columns)
    unsure = placed.where(marked).withColumn(_BIT, key).join(ids.select(F.col("id").alias(_BIT)), _BIT, "left_anti").select(rows.columns)
    return away.unionByName(unsure)


def split(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` is surely not in ``ids`` (id), and all others."""
    placed, marked = _marked(rows, key, ids)
    return placed.where(~marked).select(rows.columns), placed.where(marked).select(rows.columns)
