"""Joins of many rows with a table of one row for each key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than so small a part of all rows is hot; hence no more keys than that are, and their table can be broadcast.
PARTS = 4096


def hot(table: DataFrame, total: int, n: str = "n") -> DataFrame:
    """The rows of ``table`` whose count ``n`` is above a PARTS-th of ``total``, the sum of all counts: fewer than PARTS rows."""
    return table.where(F.col(n) > max(total, 1) / PARTS)


def attach(rows: DataFrame, table: DataFrame, key: str, total: int, n: str = "n") -> DataFrame:
    """The inner join of ``rows`` and ``table`` on ``key``, without a task that gets all rows of a hot key.

    ``table`` has one row for each key that many rows have, ``n`` being at least
    the number of ``rows`` that have it and ``total`` the sum of ``n``. The hot keys' rows of
    the table, fewer than PARTS, are broadcast; all others are shuffled.
    """
    few = F.broadcast(hot(table, total, n))
    left = rows.join(few.select(key), key, "left_anti").join(table.where(F.col(n) <= max(total, 1) / PARTS), key)
    return rows.join(few, key).select(left.columns).unionByName(left)
