"""Keyed stores with a time to live: upsert, lookup, expiry. Every time-dependent step takes the time as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(entries: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of each key (null is a key of its own): an upsert of everything in ``entries``.

    ``order``: columns that rank the writes. Rows are combined in the map step, so a key that is written very often
    arrives as one row a task.
    """
    rest = [c for c in entries.columns if c not in keys]
    best = entries.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *(F.col("_b")[c].alias(c) for c in rest))


def upsert(store: DataFrame, writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``store`` after ``writes``."""
    return latest(store.unionByName(writes), keys, order)


def valid(store: DataFrame, as_of: int) -> DataFrame:
    """Entries that haven't expired."""
    return store.filter(F.col("expires_at") > as_of)


def without(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``store`` without the entries of ``keys``; null keys delete nothing."""
    return store.join(keys.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def stats(store: DataFrame, as_of: int) -> list[Column]:
    """Aggregates: entries in all, still valid, expired."""
    live = F.col("expires_at") > as_of
    return [F.count(F.lit(1)).alias("total"), F.count_if(live).alias("valid"), F.count_if(~live).alias("expired")]
