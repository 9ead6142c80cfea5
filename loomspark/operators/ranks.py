"""Places and quantiles of whole tables without a window over all rows (WN1-2, AG4): exact and distributed.

Rows are sorted by range partitions and written once; a row's place is its number within its partition plus the rows of
the partitions before. Only the partitions' counts meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import materialise

_ROWS = (1 << 33) - 1
"""A row's number within its partition is the low 33 bits of its increasing id."""


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with places from 1 in the given order, which should be total: else ties have places in any order."""
    rows = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # as many rows as there are partitions
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_part", part).join(before, "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROWS)) + 1).drop("_at", "_part", "_before")


def quantiles(df: DataFrame, group: str, score: str, shares: list[float], name: str = "q") -> DataFrame:
    """Exact quantiles (group, array) by linear interpolation between the two nearest places; nulls are left out."""
    rows = numbered(df.where(F.col(score).isNotNull()).select(group, score), "_r", F.asc(group), F.asc(score))
    size = rows.groupBy(group).agg(F.min("_r").alias("_first"), F.count("*").alias("_n"))
    want = size.select(group, "_first", F.posexplode(F.lit([float(s) for s in shares])).alias("_i", "_share"), "_n").withColumn("_p", F.col("_share") * (F.col("_n") - 1))
    ends = want.select("_i", "_p", F.explode(F.array(F.floor("_p"), F.ceil("_p"))).alias("_k"), (F.col("_first")).alias("_first")).distinct()
    ends = ends.withColumn("_r", F.col("_first") + F.col("_k"))
    weight = F.when(F.col("_k") == F.col("_p"), 1.0).otherwise(1.0 - F.abs(F.col("_k") - F.col("_p")))
    each = rows.join(ends, "_r").groupBy(group, "_i").agg(F.sum(weight * F.col(score)).alias("_v"))
    # a row a group: written, so that plans that join it stay short
    return materialise(each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias(name)))
