"""Joins that stay even when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def join_even(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row a key, ``count`` of its rows) on a key without nulls.

    Keys with more than ``share`` of ``total`` rows are at most ``1 / share``, so
    their part of the table has a proven bound and is broadcast; any other key
    holds a small part of the rows and goes through a shuffle join.  ``rows`` is
    read twice and should be a written table.
    """
    hot = table.where(F.col(count) > total * share).drop(count)
    cold = table.where(F.col(count) <= total * share).drop(count)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
