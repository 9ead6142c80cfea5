"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Method: exact days are discretised into compressed run bitmaps per entity and time shard. A shard holds 64 words of 64
days. An interval contributes a mask to at most two partly covered words and, for the words it covers fully, one mask a
shard in which a bit stands for a whole word. Masks are united with ``bit_or``, which combines before the shuffle, so
that an entity with a third of all rows costs no more than its calendar; set runs are then read off the masks, joined
across words and shards, and the clear runs between them are the gaps.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AS_OF = dt.date(2026, 6, 21)


def _mask(lo: Column, hi: Column) -> Column:
    """Bits lo..hi of a 64-bit word."""
    ones = F.lit(-1).cast("bigint")
    return F.call_function("shiftrightunsigned", ones, (F.lit(63) - hi).cast("int")).bitwiseAND(F.call_function("shiftleft", ones, lo.cast("int")))


def _high(c: Column) -> Column:
    return F.shiftright(c, 6)


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(63).cast("bigint"))


def run_bitmaps(df: DataFrame, entity: str, first: str, last: str) -> DataFrame:
    """Bitmaps (entity, shard, slot, mask) of closed day intervals.

    Slot 0..63 is a word whose bits are days; slot -1 holds the words that are covered fully. Rows without entity, first
    or last day, or that end before they start, contribute nothing. An empty table gives no rows.
    """
    s, e = F.unix_date(F.col(first)).cast("bigint"), F.unix_date(F.col(last)).cast("bigint")
    base = df.where(F.col(entity).isNotNull() & (F.col(last) >= F.col(first))).select(F.col(entity).alias("_entity"), s.alias("_s"), e.alias("_e"))
    w0, w1 = _high(F.col("_s")), _high(F.col("_e"))
    a, b = w0 + 1, w1 - 1
    part = lambda w, lo, hi: F.struct(_high(w).alias("shard"), _low(w).cast("int").alias("slot"), _mask(lo, hi).alias("mask"))
    zero, top = F.lit(0).cast("bigint"), F.lit(63).cast("bigint")
    full = F.transform(
        F.sequence(_high(a), _high(b)),
        lambda k: F.struct(k.alias("shard"), F.lit(-1).alias("slot"), _mask(F.when(k == _high(a), _low(a)).otherwise(zero), F.when(k == _high(b), _low(b)).otherwise(top)).alias("mask")),
    )
    ends = F.array(part(w0, _low(F.col("_s")), top), part(w1, zero, _low(F.col("_e"))))
    pieces = F.when(w0 == w1, F.array(part(w0, _low(F.col("_s")), _low(F.col("_e"))))).when(b >= a, F.concat(ends, full)).otherwise(ends)
    return base.select("_entity", F.explode(pieces).alias("p")).groupBy("_entity", "p.shard", "p.slot").agg(F.bit_or("p.mask").alias("mask"))


def _runs(bitmaps: DataFrame) -> DataFrame:
    """Set runs (entity, first, last as day numbers) of each mask."""
    bit = lambda i: F.call_function("shiftrightunsigned", F.col("mask"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1
    places = F.sequence(F.lit(0), F.lit(63))
    starts = F.filter(places, lambda i: bit(i) & ((i == 0) | ~bit(F.greatest(i - 1, F.lit(0)))))
    ends = F.filter(places, lambda i: bit(i) & ((i == 63) | ~bit(F.least(i + 1, F.lit(63)))))
    x = bitmaps.select("_entity", "shard", "slot", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("r"))
    word = F.col("shard") * 64
    whole = F.col("slot") == -1
    day0 = (word + F.col("slot")) * 64
    return x.select(
        "_entity",
        F.when(whole, (word + F.col("r.a")) * 64).otherwise(day0 + F.col("r.a")).alias("a"),
        F.when(whole, (word + F.col("r.b")) * 64 + 63).otherwise(day0 + F.col("r.b")).alias("b"),
    )


def periods_and_gaps(df: DataFrame, entity: str, first: str, last: str) -> DataFrame:
    """Rows (entity, stretch, first_day, last_day): ``period`` for each longest covered run, ``gap`` between successive ones.

    Intervals are closed; nested, equal and touching ones merge. Repeated rows change nothing; rows that
    :func:`run_bitmaps` leaves out give neither period nor gap. The window over an entity holds its runs after the union,
    whose number is bounded by the calendar and not by the entity's rows.
    """
    runs = _runs(run_bitmaps(df, entity, first, last))
    w = Window.partitionBy("_entity").orderBy("a")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("_new", F.when(before.isNull() | (F.col("a") > before + 1), 1).otherwise(0)).withColumn("_k", F.sum("_new").over(w))
    periods = islands.groupBy("_entity", "_k").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    nxt = F.lead("a").over(Window.partitionBy("_entity").orderBy("a"))
    day = lambda c: F.date_from_unix_date(c.cast("int"))
    rows = F.filter(
        F.array(
            F.struct(F.lit("period").alias("stretch"), F.col("a").alias("a"), F.col("b").alias("b")),
            F.struct(F.lit("gap").alias("stretch"), (F.col("b") + 1).alias("a"), (F.col("_next") - 1).alias("b")),
        ),
        lambda x: x["b"].isNotNull(),
    )
    return periods.withColumn("_next", nxt).select(F.col("_entity").alias(entity), F.explode(rows).alias("x")).select(entity, "x.stretch", day(F.col("x.a")).alias("first_day"), day(F.col("x.b")).alias("last_day"))


def employment_periods(career: DataFrame, as_of: dt.date = AS_OF) -> DataFrame:
    """Periods and gaps of each candidate's entries; a current entry lasts until ``as_of`` whatever its end date."""
    end = F.when(F.col("is_current"), F.lit(as_of)).otherwise(F.col("end_date"))
    return periods_and_gaps(career.select("candidate_id", F.col("start_date").alias("_first"), end.alias("_last")), "candidate_id", "_first", "_last")
