"""Join helpers (JN1-9): equi-joins on a key with defined handling of clashing columns; strategies are left to the optimiser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_first_wins(frames: list[DataFrame], key: str, how: str = "inner") -> DataFrame:
    """JN4: joins in order; a column that an earlier frame has is dropped from the later one."""
    return reduce(lambda a, b: a.join(b.select(key, *[c for c in b.columns if c not in a.columns]), key, how), frames)


def join_suffixed(left: DataFrame, right: DataFrame, key: str, suffix: str, how: str = "inner") -> DataFrame:
    """JN1-3: clashing columns of the right side get the suffix."""
    return left.join(right.select(key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key]), key, how)


def keep_known(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN6: rows whose key the other table has; repeated ids change nothing."""
    return df.join(ids.select(key), key, "left_semi")


def unknown(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """JN9: rows whose key the other table lacks; a null key is unknown."""
    return df.join(ids.select(key), key, "left_anti")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """JN7: the value of each key, the default where there is none; of repeated keys the smallest value."""
    one = table.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))
