"""Nested profiles from the flat tables, so that the record operators run on either shape.

Repeats are removed per key (the latest arrival wins) before anything is collected; a collected list is one candidate's own
entries. The aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import is_blank
from loomspark.session import table


def latest(df: DataFrame, *keys: str, by: tuple[str, ...] = ("ingested_at",)) -> DataFrame:
    """One row per key: the one that arrived last; of equal times the larger row."""
    rest = [c for c in df.columns if c not in keys and "map" not in dict(df.dtypes)[c]]
    maps = [c for c in df.columns if "map" in dict(df.dtypes)[c]]
    order = F.struct(*[c for c in by if c in df.columns], *[c for c in rest if c not in by])
    row = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order)
    del maps
    return df.groupBy(*keys).agg(row.alias("r")).select(*keys, "r.*")


def candidates(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "candidates").where("candidate_id is not null"), "candidate_id").drop("ingested_at")


def signals(spark: SparkSession, root: str) -> DataFrame:
    """The latest snapshot of each candidate."""
    return latest(table(spark, root, "signals").where("candidate_id is not null"), "candidate_id", by=("snapshot_at", "ingested_at"))


def _lists(df: DataFrame, key: str, name: str, place: str) -> DataFrame:
    fields = [c for c in df.columns if c not in (key, "ingested_at")]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place, *[c for c in fields if c != place]))).alias(name))


def profiles(spark: SparkSession, root: str) -> DataFrame:
    """Nested profiles of all candidates; those without entries have empty lists and null signals."""
    c = candidates(spark, root)
    career = _lists(latest(table(spark, root, "career_entries"), "candidate_id", "entry_no"), "candidate_id", "career_history", "entry_no")
    education = _lists(latest(table(spark, root, "education_entries"), "candidate_id", "entry_no"), "candidate_id", "education", "entry_no")
    skills = _lists(latest(table(spark, root, "skills").where(~is_blank(F.col("name"))), "candidate_id", "skill_no"), "candidate_id", "skills", "skill_no")
    s = signals(spark, root)
    s = s.select("candidate_id", F.struct(*[x for x in s.columns if x not in ("candidate_id", "ingested_at", "snapshot_at")]).alias("signals"))
    fields = ("anonymized_name", "headline", "summary", "location", "country", "years_of_experience", "current_title", "current_company", "current_company_size", "current_industry")
    out = c.select("candidate_id", F.struct(*fields).alias("profile"))
    for x in (career, education, skills):
        name = x.columns[1]
        out = out.join(x, "candidate_id", "left").withColumn(name, F.coalesce(name, F.array().cast(x.schema[name].dataType)))
    return out.join(s, "candidate_id", "left")
