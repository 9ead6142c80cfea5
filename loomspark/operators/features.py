"""Feature expressions of nested records (FEX1-11): one projection of 39 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import contains_any

# What marks an employer's kind.
PRODUCT, CONSULTING, STARTUP = ["product", "saas"], ["consult", "services", "agency"], ["startup", "founder"]
SMALL_SIZE = "1-10"


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def extract(df: DataFrame) -> DataFrame:
    """One row per record; missing experience, jobs and places count as 0 or empty, missing signals stay null."""
    jobs = F.coalesce(F.col("career_history"), F.array().cast(df.schema["career_history"].dataType))
    n = F.size(jobs)
    months = F.transform(jobs, lambda j: F.coalesce(j["duration_months"], F.lit(0)))
    title = F.lower(F.coalesce(F.col("profile.current_title"), F.lit("")))
    same = F.transform(F.filter(jobs, lambda j: F.contains(F.lower(j["title"]), title)), lambda j: j["duration_months"])
    named = F.filter(F.transform(jobs, lambda j: j["company"]), lambda c: c != "")
    about = lambda j: F.lower(F.concat_ws(" ", F.coalesce(j["description"], F.lit("")), F.coalesce(j["company"], F.lit("")), F.coalesce(j["industry"], F.lit(""))))
    share = lambda test: _ratio(F.size(F.filter(jobs, test)), n)
    s = lambda c: F.col(f"signals.{c}")
    scores = s("skill_assessment_scores")
    values = F.filter(F.map_values(scores), lambda x: x.isNotNull())
    day = lambda c: F.date_format(s(c), "yyyy-MM-dd")
    sig = {
        "profile_completeness_score": s("profile_completeness_score"), "signup_date": day("signup_date"), "last_active_date": day("last_active_date"),
        **{c: s(c) for c in ("open_to_work_flag", "profile_views_received_30d", "applications_submitted_30d", "recruiter_response_rate", "avg_response_time_hours")},
        "skill_assessment_scores_json": F.coalesce(F.to_json(scores), F.lit("{}")), "num_skill_assessments": F.coalesce(F.when(scores.isNotNull(), F.size(scores)), F.lit(0)),
        "avg_skill_assessment_score": F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)),
        "max_skill_assessment_score": F.array_max(values), "min_skill_assessment_score": F.array_min(values),
        **{c: s(c) for c in ("connection_count", "endorsements_received", "notice_period_days")},
        "expected_salary_min": s("expected_salary_range_inr_lpa")["min"], "expected_salary_max": s("expected_salary_range_inr_lpa")["max"],
        **{c: s(c) for c in ("preferred_work_mode", "willing_to_relocate", "github_activity_score", "search_appearance_30d", "saved_by_recruiters_30d", "interview_completion_rate", "offer_acceptance_rate", "verified_email", "verified_phone", "linkedin_connected")},
    }
    return df.select(
        "candidate_id",
        F.coalesce(F.col("profile.years_of_experience"), F.lit(0.0)).alias("total_experience"),
        F.when(title != "", _sum(same) / 12.0).otherwise(0.0).alias("relevant_experience"),
        F.when(n > 0, _sum(months) / n / 12.0).otherwise(0.0).alias("avg_tenure"),
        (F.size(named) - F.size(F.array_distinct(named))).alias("promotion_count"),
        share(lambda j: contains_any(about(j), PRODUCT)).alias("product_company_ratio"),
        share(lambda j: contains_any(about(j), CONSULTING)).alias("consulting_ratio"),
        share(lambda j: contains_any(about(j), STARTUP) | F.coalesce(F.contains(j["company_size"], F.lit(SMALL_SIZE)), F.lit(False))).alias("startup_ratio"),
        *(c.alias(f"signal_{k}") for k, c in sig.items()),
        F.coalesce(F.col("profile.location"), F.lit("")).alias("location"),
        F.coalesce(F.col("profile.country"), F.lit("")).alias("country"),
        F.coalesce(s("notice_period_days"), F.lit(0)).alias("notice_period_days"),
    )
