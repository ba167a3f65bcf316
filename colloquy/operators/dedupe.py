"""Deduplication by message hash.

Rows with one hash may be a third of a table, so nothing is sorted per hash: an
aggregate with a map-side part keeps one row per hash and task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__row"))
    return best.select(key, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def keep_first_position_last_value(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key with the values of the last occurrence and the ``order`` of the first."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("__row"), F.min(order).alias(order)
    )
    return best.select(key, order, *[F.col("__row")[c].alias(c) for c in rest]).select(*df.columns)


def distinct_by(df: DataFrame, key: str, order: str, count: str = "copies") -> DataFrame:
    """``keep_last`` plus the number of rows that shared the key."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("__row"), F.count(F.lit(1)).alias(count)
    )
    return best.select(key, *[F.col("__row")[c].alias(c) for c in rest], count)


def union_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows with columns aligned by name; a column one side lacks is NULL there."""
    return old.unionByName(new, allowMissingColumns=True)


def only_new(rows: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key is not stored yet, one per key.

    Reduced to one row per key first, so the anti-join has no hot key; only the
    key column of the stored table is read.
    """
    return keep_last(rows, key, order).join(stored.select(key), key, "left_anti").select(*rows.columns)
