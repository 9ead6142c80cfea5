"""Problem 1: the surviving record of each group of twin candidates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import collapse
from loomspark.llm.fusion import fuse

KEY = ("anonymized_name", "headline", "summary", "skill_names_json")


def twin_groups(candidates: DataFrame) -> DataFrame:
    """Members (g, member) of groups of two or more ids whose four key fields are equal once normalised.

    A null field counts as empty; rows without id are left out; repeated rows of one id are one member.
    """
    norm = [F.coalesce(collapse(F.lower(F.col(c))), F.lit("")) for c in KEY]
    rows = candidates.where("candidate_id is not null").select("candidate_id", F.sha2(F.concat_ws("\u0001", *norm), 256).alias("k")).distinct()
    groups = rows.groupBy("k").agg(F.min("candidate_id").alias("g"), F.count("*").alias("n")).where("n > 1").select("k", "g")
    return rows.join(groups, "k").select("g", F.col("candidate_id").alias("member")).distinct()


def twin_claims(candidates: DataFrame, twin_features: DataFrame, signals: DataFrame, as_of: dt.date = dt.date(2026, 6, 21)) -> DataFrame:
    """Claims of all members for the three fields, by where they come from: a table, of ``signals`` the month of the snapshot.

    Usable are a strength of 0 to 1, a completeness of 0 to 100 and a date up to ``as_of``; of the last two a member's
    value is the usable one with the latest ``snapshot_at`` (of equal times the larger), of the first its largest. The
    other snapshots and the completeness in ``candidates`` vote for their values but aren't the member's own.
    """
    members = twin_groups(candidates)
    scores = lambda c: F.when(F.col(c).between(0, 100), F.col(c) + 0.0)
    strength = twin_features.where("behavioral_strength between 0 and 1").groupBy(F.col("candidate_id").alias("member")).agg((F.max("behavioral_strength") + 0.0).alias("x"))
    day = F.when(F.col("last_active_date") <= F.lit(as_of), F.col("last_active_date"))
    shots = signals.select(F.col("candidate_id").alias("member"), "snapshot_at", F.concat(F.lit("signals "), F.coalesce(F.date_format("snapshot_at", "yyyy-MM"), F.lit("undated"))).alias("source"), scores("profile_completeness_score").alias("completeness"), day.alias("active"))
    mine = shots.join(members, "member")
    late = lambda v: F.max(F.when(F.col(v).isNotNull(), F.struct("snapshot_at", v)))
    latest = mine.groupBy("g", "member").agg(late("completeness").alias("c"), late("active").alias("a"))
    claim = lambda f, v, p: F.struct(F.lit(f).alias("field"), v.cast("string").alias("value"), p.cast("double").alias("pref"))
    own = lambda v, t: F.when(F.col(f"{t}.{v}").eqNullSafe(F.col(v)) & F.col(f"{t}.snapshot_at").eqNullSafe(F.col("snapshot_at")), F.unix_date(v) if v == "active" else F.col(v))
    both = F.array(claim("completeness", F.col("completeness"), own("completeness", "c")), claim("active", F.col("active"), own("active", "a")))
    rows = mine.join(latest, ["g", "member"]).select("g", "member", "source", F.explode(both).alias("x"))
    rows = rows.unionByName(strength.join(members, "member").select("g", "member", F.lit("twin_features").alias("source"), claim("strength", F.col("x"), F.col("x")).alias("x")))
    stated = candidates.select(F.col("candidate_id").alias("member"), scores("profile_completeness_score").alias("v")).distinct().join(members, "member")
    rows = rows.unionByName(stated.select("g", "member", F.lit("candidates").alias("source"), claim("completeness", F.col("v"), F.lit(None)).alias("x")))
    return rows.select("g", "x.field", "member", "source", "x.value", "x.pref")


def best_members(candidates: DataFrame, twin_features: DataFrame, signals: DataFrame) -> DataFrame:
    """Rows (group_id, strength_from, completeness_from, active_from) of every group; no usable value: empty string."""
    won = fuse(twin_claims(candidates, twin_features, signals), prior="strict")
    take = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("member"))), F.lit("")).alias(f"{f}_from")
    groups = twin_groups(candidates).select("g").distinct()
    return groups.join(won, "g", "left").groupBy(F.col("g").alias("group_id")).agg(take("strength"), take("completeness"), take("active"))


def fused_values(candidates: DataFrame, twin_features: DataFrame, signals: DataFrame) -> DataFrame:
    """Rows (group_id, field, value, member, posterior, margin) by votes alone (flat prior)."""
    return fuse(twin_claims(candidates, twin_features, signals), prior="flat").select(F.col("g").alias("group_id"), "field", "value", "member", F.round("posterior", 6).alias("posterior"), F.round("margin", 6).alias("margin"))
