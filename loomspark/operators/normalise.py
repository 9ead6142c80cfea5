"""Flat records of nested profiles (NRM1-10): one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import collapse, is_blank, strip

SECTIONS = ("HEADLINE", "SUMMARY", "EXPERIENCE", "SKILLS", "CERTS")


def _kept(arr: Column, field: str) -> Column:
    return F.filter(F.transform(arr, lambda x: F.coalesce(strip(x[field]), F.lit(""))), lambda s: s != "")


def experience_text(career: Column) -> Column:
    """NRM4: descriptions that aren't blank, joined by a bar."""
    return F.array_join(_kept(career, "description"), " | ")


def skills_text(skills: Column) -> Column:
    return F.array_join(_kept(skills, "name"), ", ")


def certifications_text(certs: Column) -> Column:
    """NRM6: ``name (issuer, year)`` joined by semicolons; nameless ones and empty parts are left out, so is the year 0."""

    def one(c: Column) -> Column:
        extra = F.array_join(F.filter(F.array(F.when(~is_blank(c["issuer"]), c["issuer"]), F.when(c["year"] != 0, c["year"].cast("string"))), lambda x: x.isNotNull()), ", ")
        return F.when(extra != "", F.concat(c["name"], F.lit(" ("), extra, F.lit(")"))).otherwise(c["name"])

    return F.array_join(F.transform(F.filter(certs, lambda c: ~is_blank(c["name"])), one), "; ")


def section_document(parts: dict[str, Column]) -> Column:
    """NRM7: ``[NAME] text`` for each part that isn't empty, in order, separated by an empty line."""
    rows = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"[{n}] "), c)) for n, c in parts.items()]
    return F.array_join(F.filter(F.array(*rows), lambda x: x.isNotNull()), "\n\n")


def _json(arr: Column) -> Column:
    return F.to_json(arr)


def flatten(df: DataFrame) -> DataFrame:
    """NRM1: the 29 columns of a flat candidate from a nested record; empty blocks give empty texts and ``[]``."""
    p, s = (lambda n: F.col(f"profile.{n}")), (lambda n: F.col(f"signals.{n}"))
    clean = lambda n: F.coalesce(collapse(p(n)), F.lit(""))
    doc = section_document(dict(zip(SECTIONS, (clean("headline"), clean("summary"), experience_text(F.col("career_history")), skills_text(F.col("skills")), certifications_text(F.col("certifications"))), strict=True)))
    every = lambda b, f: F.transform(F.col(b), lambda x: x[f])
    named = lambda b: F.filter(every(b, "name"), lambda x: x != "")
    n = lambda b: F.size(F.coalesce(F.col(b), F.array()))
    return df.select(
        "candidate_id", clean("anonymized_name").alias("anonymized_name"), doc.alias("normalized_text"), clean("headline").alias("headline"), clean("summary").alias("summary"),
        *(p(c).alias(c) for c in ("location", "country", "years_of_experience", "current_title", "current_company", "current_company_size", "current_industry")),
        _json(named("skills")).alias("skill_names_json"), _json(named("certifications")).alias("certification_names_json"),
        _json(every("career_history", "title")).alias("career_titles_json"), _json(every("career_history", "company")).alias("career_companies_json"), _json(every("career_history", "description")).alias("career_descriptions_json"),
        n("skills").alias("num_skills"), n("certifications").alias("num_certifications"), n("career_history").alias("num_career_entries"), n("languages").alias("num_languages"),
        *(s(c).alias(c) for c in ("profile_completeness_score", "notice_period_days", "open_to_work_flag", "github_activity_score", "willing_to_relocate", "preferred_work_mode", "verified_email", "verified_phone")),
    )
