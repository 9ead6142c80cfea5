"""Exact copies of profiles and their relative strength (TW1-5).

Groups are keyed by a digest of the normalised fields. Group sizes and maxima are aggregated before the shuffle and joined
back, so that a group with a third of all rows is neither sorted nor held in one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.coerce import col_or, iso_date
from loomspark.functions.text import strip
from loomspark.operators.joins import join_first_wins
from loomspark.operators.traps import REFERENCE_DAY

# Weights of the strength's parts.
PARTS = {"open": 0.20, "response": 0.20, "recency": 0.15, "interview": 0.15, "offer": 0.10, "views": 0.10, "saves": 0.10}
DAYS, VIEWS, SAVES = 180.0, 50.0, 10.0


def strength(df: DataFrame, reference_day: dt.date = REFERENCE_DAY, null_signal: str = "keep") -> Column:
    """TW1: weighted blend of the signals. A null signal makes the blend null, or counts as 0 with ``null_signal='zero'``."""
    s = lambda n: col_or(df, f"signal_{n}", 0.0).cast("double")
    v = (lambda n: F.coalesce(s(n), F.lit(0.0))) if null_signal == "zero" else s
    days = F.coalesce(F.datediff(F.lit(reference_day), iso_date(col_or(df, "signal_last_active_date", None))).cast("double"), F.lit(DAYS))
    capped = lambda n, top: F.when(v(n).isNotNull(), F.least(v(n) / top, F.lit(1.0)))
    offer = v("offer_acceptance_rate")
    parts = {
        "open": F.coalesce(col_or(df, "open_to_work_flag", False), F.lit(False)).cast("double"), "response": v("recruiter_response_rate"),
        "recency": F.greatest(F.lit(0.0), 1.0 - days / DAYS), "interview": v("interview_completion_rate"),
        "offer": F.when(offer < 0, 0.0).otherwise(offer), "views": capped("profile_views_received_30d", VIEWS), "saves": capped("saved_by_recruiters_30d", SAVES),
    }
    return sum((F.lit(PARTS[k]) * parts[k] for k in PARTS), F.lit(0.0))


def copy_key(*cols: Column) -> Column:
    """TW2: digest of trimmed lower-cased fields joined by a bar; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.lower(strip(F.coalesce(c.cast("string"), F.lit("")))) for c in cols]), 256)


def relative_scores(df: DataFrame, key: str, value: str) -> DataFrame:
    """TW3-4: adds is_twin and twin_score: 1 for single rows and for those with the group's largest value, else half of the ratio to it.

    A largest value of 0 or less counts as 1e-9. A null value of a copy gives a null score.
    """
    g = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.max(value).alias("_m"))
    top = F.when(F.col("_m") <= 0, 1e-9).otherwise(F.col("_m"))
    j = df.join(g, F.col(key) == F.col("_k"))
    score = F.when(F.col("_n") == 1, 1.0).when(F.col(value) == top, 1.0).otherwise(0.5 * F.col(value) / top)
    return j.select(*df.columns, (F.col("_n") > 1).alias("is_twin"), score.alias("twin_score"))


def resolve(candidates: DataFrame, features: DataFrame, reference_day: dt.date = REFERENCE_DAY, null_signal: str = "keep") -> DataFrame:
    """TW1-5: (candidate_id, twin_score, is_twin, behavioral_strength); no order is promised."""
    df = join_first_wins([candidates, features], "candidate_id")
    x = df.select("candidate_id", copy_key(*(F.col(c) for c in ("anonymized_name", "headline", "summary", "skill_names_json"))).alias("key"), strength(df, reference_day, null_signal).alias("behavioral_strength"))
    return relative_scores(x, "key", "behavioral_strength").select("candidate_id", "twin_score", "is_twin", "behavioral_strength")
