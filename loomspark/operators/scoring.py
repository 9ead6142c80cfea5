"""Final scores, explanations and the result table (FS1-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.coerce import col_or
from loomspark.functions.text import strip
from loomspark.operators.match import json_array

# Points off for traps and anomalies.
TRAP_POINTS = {"trap_consulting_only": 10.0, "trap_research_only": 10.0, "trap_langchain_only": 5.0, "trap_job_hopper": 8.0, "trap_keyword_stuffer": 6.0, "trap_marketing_summary": 20.0, "trap_inactive_candidate": 10.0, "trap_cv_only": 10.0, "trap_robotics_only": 10.0, "trap_speech_only": 10.0, "trap_architect_no_code": 8.0, "honeypot_score": 40.0}


def years_points(y: Column, low: float = 5.0, high: float = 9.0) -> Column:
    """FS2."""
    y = F.coalesce(y, F.lit(0.0))
    return F.when(y < low, (low - y) * 10.0).when(y > high, (y - high) * 8.0).otherwise(0.0)


def notice_points(days: Column) -> Column:
    """FS5."""
    return F.when(days > 30, (days - 30) * 0.1).otherwise(0.0)


def adjusted_score(df: DataFrame, score: str = "score") -> Column:
    """FS1-6; absent columns and nulls take the neutral value."""
    z = lambda n, d=0.0: F.coalesce(col_or(df, n, d).cast("double"), F.lit(d))
    role = F.when(z("feat_is_technical_role", 1.0) == 0.0, 50.0).otherwise(0.0)
    boost = F.when(z("feat_is_ai_ml_role") == 1.0, 15.0).otherwise(0.0)
    traps = sum((z(n) * w for n, w in TRAP_POINTS.items()), F.lit(0.0))
    return F.col(score) - years_points(z("years_of_experience")) - role + boost - traps - notice_points(z("notice_period_days")) + z("behavioral_strength") * 2.0


def min_max(df: DataFrame, score: str, to: str = "score", digits: int = 4) -> DataFrame:
    """FS7, AG5: scaled to 0..100 over all rows by a one-row aggregate; a range of 0 counts as 1."""
    m = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    span = F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    out = df.crossJoin(F.broadcast(m))  # one row
    return out.withColumn(to, F.round((F.col(score) - F.col("_lo")) / span * 100.0, digits)).drop("_lo", "_hi")


def one_decimal(x: Column) -> Column:
    """A number that isn't negative with one digit, rounded by its exact binary value (0.35 is below its name and gives 0.3), ties to even."""
    k = F.floor(x * 10)
    # two parts of few bits: twenty times each is exact, so that the sign of the difference to the middle is
    high = x.cast("float").cast("double")
    above = (high * 20 - (k * 2 + 1)) + (x - high) * 20
    tenths = F.when(above > 0, k + 1).when(above < 0, k).otherwise(k + k % 2)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def reasoning(df: DataFrame) -> Column:
    """FS8-10: two sentences from the row's own facts; absent and null facts are left out or named as such."""
    # The phrases that the sentences are made of.
    text = lambda n: F.when(F.length(F.coalesce(strip(col_or(df, n, "").cast("string")), F.lit(""))) > 0, strip(col_or(df, n, "").cast("string")))
    z = lambda n: F.coalesce(col_or(df, n, 0.0).cast("double"), F.lit(0.0))
    years = F.coalesce(col_or(df, "years_of_experience", None).cast("double"), z("total_experience"))
    skills = F.slice(F.filter(json_array(col_or(df, "skill_names_json", None).cast("string")), lambda s: s != ""), 1, 3)
    shown = F.when(F.size(skills) > 0, F.array_join(skills, ", ")).otherwise("required technical skills")
    first = F.concat(F.coalesce(text("headline"), text("current_title"), F.lit("Software Engineer")), F.lit(" with "), one_decimal(years), F.lit(" years of experience, demonstrating expertise in "), shown, F.lit("."))
    rate = (z("signal_recruiter_response_rate") * 100).cast("int")
    mood = F.when(F.coalesce(col_or(df, "open_to_work_flag", False), F.lit(False)), "Candidate is actively open to new work").otherwise("Profile shows stable engagement")
    said = F.when(rate > 50, F.concat(F.lit("a high recruiter response rate of "), rate.cast("string"), F.lit("%"))).when(rate > 0, F.concat(F.lit("a response rate of "), rate.cast("string"), F.lit("%")))
    days = z("notice_period_days").cast("int")
    gaps = F.filter(
        F.array(
            F.when(days > 60, F.concat(F.lit("a long notice period of "), days.cast("string"), F.lit(" days"))), F.when(z("trap_job_hopper") > 0.6, "potential job-hopping history"),
            F.when(z("trap_consulting_only") > 0.7, "exclusively service-firm consulting experience"), F.when(z("trap_inactive_candidate") > 0.6, "low platform login recency"),
            F.when(z("trap_keyword_stuffer") > 0.6, "potential keyword stuffing in profile skills"),
        ),
        lambda g: g.isNotNull(),
    )
    tail = F.when(F.size(gaps) > 0, F.concat(F.lit(", though notes show "), F.array_join(gaps, ", with "), F.lit("."))).otherwise(".")
    return F.concat(first, F.lit(" "), F.concat_ws(" and ", mood, said), tail)


def final_table(compiled: DataFrame, scored: DataFrame, top: int = 100) -> DataFrame:
    """FS11, JN5, ST4, WN6: (candidate_id, rank, score, reasoning) of the best rows, ties by id."""
    df = compiled.drop("score").join(scored.select("candidate_id", "score"), "candidate_id")
    best = df.withColumn("adjusted", adjusted_score(df)).orderBy(F.desc("adjusted"), F.asc("candidate_id")).limit(top)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("adjusted"), F.asc("candidate_id"))))
    return min_max(ranked.withColumn("reasoning", reasoning(ranked)), "adjusted").select("candidate_id", "rank", "score", "reasoning")
