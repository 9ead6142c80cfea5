"""Eleven low-value patterns of flat candidates (TR1-11), each a double from 0 to 1."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.coerce import col_or, iso_date
from loomspark.functions.text import contains_any
from loomspark.operators.joins import join_first_wins
from loomspark.operators.match import json_array

# Substrings that mark employers, titles, skills and summaries.
CONSULTANCIES = ["tcs", "infosys", "wipro", "accenture", "cognizant", "capgemini", "tata consultancy", "hcl", "tech mahindra", "l&t", "deloitte", "pwc", "ey", "kpmg"]
RESEARCH = ["researcher", "research associate", "phd scholar", "postdoc", "postdoctoral", "fellow", "academic", "professor", "lecturer", "academic lab"]
WRAPPERS = ["langchain", "openai", "chatgpt"]
GROUNDWORK = ["pytorch", "tensorflow", "scikit-learn", "keras", "machine learning", "nlp", "computer vision", "pandas", "numpy", "feature engineering", "deep learning"]
ARCHITECTS = ["architect", "director", "manager", "tech lead", "principal engineer", "technical architect"]
BUZZWORDS = ["ai tools", "chatgpt", "generative ai", "prompt engineering", "artificial intelligence"]
MARKETING = ["marketing", "sales", "brand manager", "seo", "copywriter", "social media", "public relations", "ad operations"]
ROBOTICS = ["robotics", "ros", "lidar", "uav", "robot", "control theory", "kinematics", "slam", "path planning", "motion planning"]
SPEECH = ["speech", "tts", "asr", "whisper", "audio", "voice", "speech recognition", "text-to-speech", "speech-to-text"]
LANGUAGE = ["nlp", "natural language", "bert", "embeddings", "elasticsearch", "vector search", "pinecone", "milvus", "weaviate", "qdrant", "rag", "retrieval", "text"]
REFERENCE_DAY = dt.date(2026, 6, 21)


def share_with(arr: Column, keys: list[str]) -> Column:
    """TR1, TR2: share of the elements that hold a keyword; 0 without elements."""
    return F.when(F.size(arr) > 0, F.size(F.filter(arr, lambda x: contains_any(x, keys))) / F.size(arr)).otherwise(0.0)


def focus(arr: Column, keys: list[str], other: Column, alone: float, beside: float) -> Column:
    """TR3, TR10, TR11: some element holds a keyword; the value depends on whether the other side is there too."""
    has = F.exists(arr, lambda x: contains_any(x, keys))
    return F.when(has & ~other, alone).when(has, beside).otherwise(0.0)


def ladder(c: Column, steps: list[tuple[float, float]], above: bool = True) -> Column:
    """TR4-6: the value of the first step that holds; null and the rest give 0."""
    out = None
    for limit, value in steps:
        test = c > limit if above else c <= limit
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(0.0)


def detect_traps(candidates: DataFrame, features: DataFrame, reference_day: dt.date = REFERENCE_DAY) -> DataFrame:
    """One row per candidate with features. Absent columns take defaults; null values compare as false, as the blueprint says."""
    df = join_first_wins([candidates, features], "candidate_id")
    lower = lambda n: F.transform(json_array(col_or(df, n, "[]")), F.lower)
    low = lambda n: F.lower(F.coalesce(col_or(df, n, "").cast("string"), F.lit("")))
    skills, titles, firms, title = lower("skill_names_json"), lower("career_titles_json"), lower("career_companies_json"), low("current_title")
    all_titles = F.when(title != "", F.concat(titles, F.array(title))).otherwise(titles)
    code = col_or(df, "signal_github_activity_score", -1.0)
    arch = contains_any(title, ARCHITECTS)
    market = contains_any(title, MARKETING) | contains_any(F.array_join(titles, " "), MARKETING)
    days = F.coalesce(F.datediff(F.lit(reference_day), iso_date(col_or(df, "signal_last_active_date", None))), F.lit(0))
    rate = col_or(df, "signal_recruiter_response_rate", 1.0)
    rate = F.coalesce(rate, F.lit(1.0)) if "signal_recruiter_response_rate" not in df.columns else rate
    full, ties = col_or(df, "profile_completeness_score", 100.0), col_or(df, "signal_connection_count", 0)
    apps, views = col_or(df, "signal_applications_submitted_30d", 0), col_or(df, "signal_profile_views_received_30d", 0)
    language = F.exists(skills, lambda x: contains_any(x, LANGUAGE))
    tenure = ladder(col_or(df, "avg_tenure", 0.0), [(1.0, 1.0), (1.5, 0.7), (1.8, 0.3)], above=False)
    return df.select(
        "candidate_id", share_with(firms, CONSULTANCIES).alias("trap_consulting_only"), share_with(all_titles, RESEARCH).alias("trap_research_only"),
        focus(skills, WRAPPERS, F.arrays_overlap(skills, F.lit(GROUNDWORK)), 1.0, 0.3).alias("trap_langchain_only"),
        F.when(~arch, 0.0).when(code <= 0, 1.0).when(code < 20, 0.7).otherwise(0.2).alias("trap_architect_no_code"),
        F.when(col_or(df, "num_career_entries", 0) >= 3, tenure).otherwise(0.0).alias("trap_job_hopper"),
        ladder(col_or(df, "num_skills", 0), [(35, 1.0), (25, 0.7), (15, 0.3)]).alias("trap_keyword_stuffer"),
        F.when(market & contains_any(low("summary"), BUZZWORDS), 1.0).when(market, 0.3).otherwise(0.0).alias("trap_marketing_summary"),
        F.when((days > 180) | (rate < 0.1), 1.0).when((days > 90) | (rate < 0.3), 0.7).when(days > 30, 0.3).otherwise(0.0).alias("trap_inactive_candidate"),
        F.when((full < 40) & (ties == 0) & (apps == 0) & (views == 0), 1.0).when((full < 60) & (ties <= 1) & (apps == 0), 0.6).otherwise(0.0).alias("trap_cv_only"),
        focus(skills, ROBOTICS, language, 1.0, 0.4).alias("trap_robotics_only"), focus(skills, SPEECH, language, 1.0, 0.4).alias("trap_speech_only"),
    )
