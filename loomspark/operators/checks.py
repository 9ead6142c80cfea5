"""Deterministic inconsistency checks of nested records and their fusion to a score (HP1-13).

A check is a function from options to a struct Column (triggered, penalty, reason, details). Checks are listed in order in
``REGISTRY``; the list is the extension point. Everything is a narrow projection inside whole-stage code generation.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Penalties, caps and limits of the seven checks.
WEIGHTS = {"salary_inversion": (0.30, 0.30), "job_date_inversion": (0.25, 0.50), "education_date_inversion": (0.15, 0.30), "duration_mismatch": (0.10, 0.40), "expert_zero_duration": (0.20, 0.20), "skill_exceeds_experience": (0.20, 0.40), "startup_founding_year": (0.35, 0.70)}
TOLERANCE_MONTHS = 3
LEAST_ZERO_SKILLS = 3
THRESHOLD = 0.6
AS_OF = dt.date(2026, 6, 21)
# Founding years, in the order in which they are looked up.
FOUNDED = {"openai": 2015, "huggingface": 2016, "pinecone": 2019, "cohere": 2019, "anthropic": 2021, "qdrant": 2021, "perplexity": 2022, "langchain": 2022, "llamaindex": 2022, "mistral": 2023}


def month_difference(a: Column, b: Column) -> Column:
    """HP5: months by the calendar, days ignored."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def first_key(c: Column, keys: dict[str, int]) -> Column:
    """HP8: the value of the first key, in order, that the lower-cased text contains."""
    out = None
    for k, v in keys.items():
        out = F.when(F.contains(F.lower(c), F.lit(k)), v) if out is None else out.when(F.contains(F.lower(c), F.lit(k)), v)
    return out


def _result(name: str, bad: Column, count: Column | None, reason: Column, clean: Column, details: Column) -> Column:
    each, cap = WEIGHTS[name]
    penalty = F.lit(each) if count is None else F.least(count * F.lit(each), F.lit(cap))
    hit = F.coalesce(bad, F.lit(False))
    return F.struct(
        F.lit(name).alias("check"), hit.alias("triggered"), F.when(hit, penalty).otherwise(0.0).alias("penalty"), F.when(hit, reason).otherwise(clean).alias("reason"),
        F.when(hit, details).otherwise(F.array().cast("array<string>")).alias("details"),
    )


def _many(name: str, rows: Column, reason: str, clean: Column, detail: Callable[[Column], Column], least: int = 1) -> Column:
    n = F.size(rows)
    return _result(name, n >= least, None if WEIGHTS[name][0] == WEIGHTS[name][1] else n, F.concat(n.cast("string"), F.lit(reason)), clean, F.transform(rows, detail))


def _job(j: Column) -> Column:
    return F.concat_ws(" / ", j["company"], j["title"])


def salary_inversion(**_) -> Column:
    s = F.col("signals.expected_salary_range_inr_lpa")
    lo, hi = s["min"], s["max"]
    clean = F.when(s.isNull(), "no salary").when(lo.isNull() | hi.isNull(), "incomplete or no number").otherwise("valid range")
    return _result("salary_inversion", lo > hi, None, F.concat(F.lit("min "), lo.cast("string"), F.lit(" > max "), hi.cast("string")), clean, F.array(F.concat_ws(" > ", lo.cast("string"), hi.cast("string"))))


def job_date_inversion(**_) -> Column:
    rows = F.filter(F.col("career_history"), lambda j: ~F.coalesce(j["is_current"], F.lit(False)) & (j["start_date"] > j["end_date"]))
    return _many("job_date_inversion", rows, " entries end before they start", F.lit("valid dates"), lambda j: F.concat(_job(j), F.lit(": "), j["start_date"].cast("string"), F.lit(" > "), j["end_date"].cast("string")))


def education_date_inversion(**_) -> Column:
    rows = F.filter(F.col("education"), lambda e: (e["start_year"] != 0) & (e["end_year"] != 0) & (e["start_year"] > e["end_year"]))
    return _many("education_date_inversion", rows, " studies end before they start", F.lit("valid years"), lambda e: F.concat(e["institution"], F.lit(": "), e["start_year"].cast("string"), F.lit(" > "), e["end_year"].cast("string")))


def duration_mismatch(as_of: dt.date = AS_OF, **_) -> Column:
    end = lambda j: F.when(F.coalesce(j["is_current"], F.lit(False)), F.lit(as_of)).otherwise(j["end_date"])
    off = lambda j: F.abs(month_difference(j["start_date"], end(j)) - j["duration_months"])
    rows = F.filter(F.col("career_history"), lambda j: F.coalesce((j["start_date"] <= end(j)) & (off(j) > TOLERANCE_MONTHS), F.lit(False)))
    return _many("duration_mismatch", rows, f" durations are off by more than {TOLERANCE_MONTHS} months", F.lit("durations agree"), lambda j: F.concat(_job(j), F.lit(": "), j["duration_months"].cast("string"), F.lit(" declared, off by "), off(j).cast("string")))


def expert_zero_duration(**_) -> Column:
    rows = F.filter(F.col("skills"), lambda s: F.lower(F.coalesce(s["proficiency"], F.lit(""))).isin("expert", "advanced") & (s["duration_months"] == 0))
    clean = F.concat(F.size(rows).cast("string"), F.lit(" expert skills without duration"))
    return _many("expert_zero_duration", rows, " expert skills without duration", clean, lambda s: s["name"], LEAST_ZERO_SKILLS)


def skill_exceeds_experience(**_) -> Column:
    top = (F.col("profile.years_of_experience") * 12).cast("int") + 12
    rows = F.filter(F.col("skills"), lambda s: F.coalesce(s["duration_months"] > top, F.lit(False)))
    clean = F.when(top.isNull(), "no experience given").otherwise("within experience")
    return _many("skill_exceeds_experience", rows, " skills are longer than the experience allows", clean, lambda s: F.concat(s["name"], F.lit(": "), s["duration_months"].cast("string"), F.lit(" > "), top.cast("string")))


def startup_founding_year(**_) -> Column:
    rows = F.filter(F.col("career_history"), lambda j: F.coalesce(F.year(j["start_date"]) < first_key(j["company"], FOUNDED), F.lit(False)))
    return _many("startup_founding_year", rows, " employers were founded later", F.lit("no such employer"), lambda j: F.concat(j["company"], F.lit(" from "), j["start_date"].cast("string"), F.lit(", founded "), first_key(j["company"], FOUNDED).cast("string")))


REGISTRY: list[Callable[..., Column]] = [salary_inversion, job_date_inversion, education_date_inversion, duration_mismatch, expert_zero_duration, skill_exceeds_experience, startup_founding_year]


def fuse_penalties(penalties: Column, threshold: float = THRESHOLD) -> dict[str, Column]:
    """HP10: raw sum in order, score clipped to 0..1, trust, and whether the score is above the threshold."""
    raw = F.aggregate(penalties, F.lit(0.0), lambda a, x: a + x)
    score = F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 6)
    return {"honeypot_score": score, "trust_score": F.round(F.lit(1.0) - score, 6), "is_honeypot": score > F.lit(threshold), "total_penalty": F.round(raw, 6)}


def detect(df: DataFrame, threshold: float = THRESHOLD, as_of: dt.date = AS_OF, registry: list[Callable[..., Column]] | None = None) -> DataFrame:
    """HP10-12: one row per record with score, trust, flag, triggered checks, all reasons, penalties of triggered ones.

    Null and empty blocks trigger nothing. The lists and maps are given as JSON text beside the score.
    """
    checks = registry if registry is not None else REGISTRY
    x = df.select("candidate_id", F.array(*[c(as_of=as_of) for c in checks]).alias("r"))
    hit = F.filter("r", lambda c: c["triggered"])
    fused = fuse_penalties(F.transform("r", lambda c: c["penalty"]), threshold)
    name = lambda a: F.transform(a, lambda c: c["check"])
    return x.select(
        "candidate_id", *(fused[k].alias(k) for k in ("honeypot_score", "trust_score", "is_honeypot", "total_penalty")),
        F.size("r").alias("num_checks_run"), F.size(hit).alias("num_checks_triggered"), F.to_json(name(hit)).alias("checks_triggered_json"),
        F.to_json(F.map_from_arrays(name(F.col("r")), F.transform("r", lambda c: c["reason"]))).alias("check_reasons_json"),
        F.to_json(F.map_from_arrays(name(hit), F.transform(hit, lambda c: c["penalty"]))).alias("check_penalties_json"),
    )


def rate(df: DataFrame, flag: str = "is_honeypot") -> DataFrame:
    """HP13: how many records are flagged and their share."""
    return df.agg(F.count_if(F.col(flag)).alias("flagged"), F.count("*").alias("records"), F.try_divide(F.count_if(F.col(flag)), F.count("*")).alias("share"))
