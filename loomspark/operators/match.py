"""How well flat candidates match a requirement (JF1-13): literals of the requirement, one projection over one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.coerce import col_or
from loomspark.functions.text import contains_any
from loomspark.operators.joins import join_first_wins
from loomspark.operators.requirement import Requirement

# Substrings that mark technical roles, that rule them out, and that mark work on learning systems.
TECHNICAL = ["software", "machine learning", "ai", "ml", "nlp", "deep learning", "computer vision", "data scientist", "data science", "data engineer", "developer", "programmer", "tech lead", "technical lead", "architect", "systems engineer", "engineering", "coder", "backend", "front-end", "frontend", "fullstack", "full-stack", "back-end"]
OTHER_ROLES = ["civil", "hr", "human resources", "mechanical", "graphic designer", "accountant", "accounting", "operations", "customer support", "content writer", "marketing", "sales", "brand manager", "seo", "copywriter", "social media", "public relations", "ad operations", "finance", "legal", "teacher", "professor", "doctor", "nurse", "recruiter", "talent acquisition", "project manager", "devops", "qa", "quality assurance", "testing", "test engineer", "frontend", "front-end", "front end", "ui/ux", "mobile developer", "android", "ios", "scrum master", "analyst"]
LEARNING_PHRASES = ["machine learning", "deep learning", "natural language", "data scientist", "data science", "recommendation", "retrieval", "vector search"]
LEARNING_WORDS = ["ai", "ml", "nlp", "ranking", "search"]
NOT_RETRIEVED_RANK = 999999


def json_array(c: Column) -> Column:
    """JF13: the strings of a JSON array; anything else is empty."""
    return F.filter(F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull())


def _low(df: DataFrame, name: str) -> Column:
    return F.lower(F.coalesce(col_or(df, name, "").cast("string"), F.lit("")))


def member_ratio(have: Column, wanted: list[str]) -> Column:
    """JF1: share of the wanted names among the lower-cased ones; 1 if nothing is wanted."""
    if not wanted:
        return F.lit(1.0)
    low = [w.lower() for w in wanted]
    hits = sum((F.array_contains(have, w).cast("int") for w in low), F.lit(0))
    return hits / F.lit(float(len(low)))


def range_score(y: Column, lo: float | None, hi: float | None, slope: float = 0.5) -> Column:
    """JF3: mean of how far both bounds are kept; a bound that is null or not positive is kept."""
    below = F.greatest(F.lit(0.0), 1.0 - (lo - y) * slope) if lo and lo > 0 else None
    above = F.greatest(F.lit(0.0), 1.0 - (y - hi) * slope) if hi and hi > 0 else None
    a = F.when(y >= lo, 1.0).otherwise(below) if below is not None else F.lit(1.0)
    b = F.when(y <= hi, 1.0).otherwise(above) if above is not None else F.lit(1.0)
    return (a + b) / 2.0


def technical_role(*texts: Column) -> Column:
    """JF4: some text holds a technical term and none a disqualifying one, as substrings."""
    some = lambda keys: F.greatest(*[contains_any(t, keys) for t in (*texts, F.lit(""))])
    return (some(TECHNICAL) & ~some(OTHER_ROLES)).cast("double")


def learning_role(*texts: Column) -> Column:
    """JF5: a phrase as substring or a word of its own."""
    one = lambda t: contains_any(t, LEARNING_PHRASES) | F.arrays_overlap(F.split(t, r"(?U)\W+"), F.lit(LEARNING_WORDS))
    return F.greatest(*[one(t) for t in (*texts, F.lit(""))]).cast("double")


def location_score(place: Column, country: Column, mode: Column, moves: Column, wanted: list[str], home: str = "india") -> Column:
    """JF6: ordered rules; the texts are lower-cased, ``moves`` is never null."""
    if not wanted:
        return F.lit(1.0)
    low = [w.lower() for w in wanted]
    at_home = F.contains(country, F.lit(home)) | F.contains(place, F.lit(home))
    any_wanted = lambda k: any(k in w for w in low)
    return (
        F.when(contains_any(place, low), 1.0)
        .when(moves & (at_home | F.lit(not any_wanted(home))), 0.8)
        .when(F.contains(mode, F.lit("remote")) & F.lit(any_wanted("remote")), 0.8)
        .when(F.contains(mode, F.lit("hybrid")) & F.lit(any_wanted("hybrid")), 0.6)
        .when(moves, 0.5)
        .otherwise(0.0)
    )


def domain_score(industry: Column, history: Column, wanted: list[str]) -> Column:
    """JF7."""
    if not wanted:
        return F.lit(1.0)
    low = [w.lower() for w in wanted]
    return F.when(contains_any(industry, low), 1.0).when(contains_any(history, low), 0.7).otherwise(0.0)


def term_share(texts: list[Column], terms: list[str]) -> Column:
    """JF8: share of the terms that some text holds as a substring; 1 without terms."""
    if not terms:
        return F.lit(1.0)
    hit = lambda t: F.greatest(*[F.contains(x, F.lit(t.lower())) for x in (*texts, F.lit(""))]).cast("int")
    return sum((hit(t) for t in terms), F.lit(0)) / F.lit(float(len(terms)))


def certification_score(certs: Column, wanted: list[str]) -> Column:
    """JF9."""
    text = F.lower(F.array_join(certs, " "))
    return F.when(F.size(certs) == 0, 0.0).when(contains_any(text, [w.lower() for w in wanted]), 1.0).otherwise(0.2)


def match_features(candidates: DataFrame, features: DataFrame, anomalies: DataFrame, retrieved: DataFrame, need: Requirement, filter_flagged: bool = False) -> DataFrame:
    """JF1-12, JN1-3: 20 columns per candidate that has features and an anomaly score.

    Clashing columns: the candidates' win. Candidates that weren't retrieved get score 0 and rank 999999. ``filter_flagged``
    drops flagged ones below the joins. Unparsable lists count as empty.
    """
    flagged = anomalies.where(~F.col("is_honeypot")) if filter_flagged else anomalies
    df = join_first_wins([candidates, features, flagged.select("candidate_id", "honeypot_score", "trust_score", "is_honeypot")], "candidate_id")
    r = retrieved.select("candidate_id", "bm25_score", "dense_score", "rrf_score", "combined_rank")
    df = df.drop(*[c for c in r.columns if c != "candidate_id"]).join(r, "candidate_id", "left")
    skills = F.transform(json_array(col_or(df, "skill_names_json", "[]")), F.lower)
    req, pref = member_ratio(skills, need.required_skills), member_ratio(skills, need.preferred_skills)
    history = F.lower(F.array_join(json_array(col_or(df, "career_descriptions_json", "[]")), " "))
    titles = F.lower(F.array_join(json_array(col_or(df, "career_titles_json", "[]")), " "))
    head, title = _low(df, "headline"), _low(df, "current_title")
    moves = F.coalesce(col_or(df, "willing_to_relocate", False).cast("boolean"), F.lit(False))
    hit = F.col("rrf_score").isNotNull()
    score = lambda c: F.when(hit, F.col(c)).otherwise(0.0)
    return df.select(
        "candidate_id", req.alias("feat_required_skills_match_ratio"), pref.alias("feat_preferred_skills_match_ratio"), (0.7 * req + 0.3 * pref).alias("feat_skills_match_score"),
        range_score(F.coalesce(col_or(df, "years_of_experience", 0.0), F.lit(0.0)), need.min_years, need.max_years).alias("feat_experience_match_score"),
        technical_role(head, title).alias("feat_is_technical_role"), learning_role(head, title).alias("feat_is_ai_ml_role"),
        location_score(_low(df, "location"), _low(df, "country"), _low(df, "preferred_work_mode"), moves, need.locations).alias("feat_location_match_score"),
        domain_score(_low(df, "current_industry"), history, need.industries).alias("feat_domain_match_score"),
        term_share([history, titles], need.required_skills + need.soft_skills).alias("feat_responsibility_match_score"),
        certification_score(json_array(col_or(df, "certification_names_json", "[]")), need.required_skills).alias("feat_certification_match_score"),
        score("dense_score").alias("feat_semantic_match"), hit.cast("double").alias("feat_retrieved"), score("bm25_score").alias("feat_bm25_score"), score("dense_score").alias("feat_dense_score"), score("rrf_score").alias("feat_rrf_score"),
        F.when(hit, F.col("combined_rank")).otherwise(NOT_RETRIEVED_RANK).alias("feat_combined_rank"), "honeypot_score", "trust_score", "is_honeypot",
    )
