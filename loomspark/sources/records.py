"""Error-tolerant reading of JSON-lines profiles: every line gets a status, valid ones a typed nested record.

A line is parsed once, into a VARIANT; fields are read from it by path with the coercions the schema names, and rules
that a field breaks are listed. ``status`` is one of ok, blank, bad_json, invalid. Lines are never dropped silently:
counts and samples come from the same frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import coerce
from loomspark.functions.text import is_blank, strip, strip_or_empty

# Field kinds: text (null as empty, trimmed), label (optional text, another type breaks the record), name (text that may be
# missing but not null), yoe, date, months, flag (missing as false, null breaks), count, opt_months, year; and of the signal
# block lax_int, lax_float, lax_bool, map.
PROFILE = {"anonymized_name": "text", "headline": "text", "summary": "text", "location": "label", "country": "label", "years_of_experience": "yoe", "current_title": "label", "current_company": "label", "current_company_size": "label", "current_industry": "label"}
CAREER = {"company": "text", "title": "text", "start_date": "date", "end_date": "date", "duration_months": "months", "is_current": "flag", "industry": "label", "company_size": "label", "description": "text"}
EDUCATION = {"institution": "name", "degree": "label", "field_of_study": "label", "start_year": "year", "end_year": "year", "grade": "label", "tier": "label"}
SKILL = {"name": "text", "proficiency": "label", "endorsements": "count", "duration_months": "opt_months"}
CERTIFICATION = {"name": "name", "issuer": "label", "year": "year"}
LANGUAGE = {"language": "name", "proficiency": "label"}
SIGNALS = {
    "profile_completeness_score": "lax_float", "signup_date": "date", "last_active_date": "date", "open_to_work_flag": "lax_bool",
    "profile_views_received_30d": "lax_int", "applications_submitted_30d": "lax_int", "recruiter_response_rate": "lax_float",
    "avg_response_time_hours": "lax_float", "skill_assessment_scores": "map", "connection_count": "lax_int",
    "endorsements_received": "lax_int", "notice_period_days": "lax_int", "expected_salary_range_inr_lpa": "map",
    "preferred_work_mode": "label", "willing_to_relocate": "lax_bool", "github_activity_score": "lax_float",
    "search_appearance_30d": "lax_int", "saved_by_recruiters_30d": "lax_int", "interview_completion_rate": "lax_float",
    "offer_acceptance_rate": "lax_float", "verified_email": "lax_bool", "verified_phone": "lax_bool", "linkedin_connected": "lax_bool",
}
BLOCKS = {"career_history": CAREER, "education": EDUCATION, "skills": SKILL, "certifications": CERTIFICATION, "languages": LANGUAGE}
SIGNAL_BLOCKS = ("redrob_signals", "signals")

_TRUE, _FALSE = ["1", "on", "t", "true", "y", "yes"], ["0", "off", "f", "false", "n", "no"]


def _get(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _type(v: Column, name: str) -> Column:
    """JSON type of a field: VOID for null, null if the field is missing."""
    return F.schema_of_variant(_get(v, name, "variant"))


def _typed(v: Column, name: str, kind: str) -> tuple[Column, Column]:
    """(value, whether the field breaks its rule)."""
    s, t = _get(v, name), _type(v, name)
    absent = t.isNull() | (t == "VOID")
    never = F.lit(False)
    if kind == "text":
        falsy = absent | (t == "BOOLEAN") & (s == "false")
        return F.when(falsy, "").otherwise(strip_or_empty(s)), never
    if kind == "label":
        return F.when(t == "STRING", s), ~absent & (t != "STRING")
    if kind == "name":
        return F.when(t == "STRING", s).otherwise(""), t.isNotNull() & (t != "STRING")
    if kind == "yoe":
        return coerce.non_negative(s), never
    if kind == "date":
        return coerce.iso_date(s), never
    if kind == "months":
        return coerce.months(s), never
    if kind in ("count", "opt_months", "year"):
        cut = F.when(t == "STRING", s).otherwise(F.regexp_extract(s, r"^([+-]?\d+)(\.\d+)?$", 1))
        f = {"count": coerce.count_or_zero, "opt_months": coerce.clamped_or_null, "year": coerce.year}[kind]
        return f(cut), never
    if kind == "map":
        return _get(v, name, "variant"), ~absent & ~t.startswith("OBJECT")
    word = F.lower(strip(s))
    if kind in ("flag", "lax_bool"):
        value = F.when(word.isin(_TRUE) | (word.try_cast("double") == 1), True).when(word.isin(_FALSE) | (word.try_cast("double") == 0), False)
        if kind == "flag":
            return F.when(t.isNull(), False).otherwise(value), t.isNotNull() & value.isNull()
        return F.when(~absent, value), ~absent & value.isNull()
    plain = ~t.startswith("OBJECT") & ~t.startswith("ARRAY")
    value = F.when(t == "BOOLEAN", F.when(s == "true", 1.0).otherwise(0.0)).when(plain, strip(s).try_cast("double"))
    if kind == "lax_float":
        return F.when(~absent, coerce.no_nan(value)), ~absent & value.isNull()
    exact = F.when(value == F.floor(value), value.cast("bigint").try_cast("int"))
    return F.when(~absent, exact), ~absent & exact.isNull()


def _struct(v: Column, fields: dict[str, str]) -> Column:
    return F.struct(*[_typed(v, n, k)[0].alias(n) for n, k in fields.items()])


def _errors(v: Column, fields: dict[str, str], where: str) -> Column:
    return F.filter(F.array(*[F.when(_typed(v, n, k)[1], F.lit(f"{where}.{n}")) for n, k in fields.items()]), lambda e: e.isNotNull())


def _elements(v: Column, name: str) -> Column:
    return F.coalesce(_get(v, name, "array<variant>"), F.array().cast("array<variant>"))


def _is_object(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))


def _element_errors(block: str, fields: dict[str, str]):
    return lambda x: F.when(_is_object(x), _errors(x, fields, block)).otherwise(F.array(F.lit(block)))


def _element(fields: dict[str, str]):
    return lambda x: _struct(x, fields)


def parse_lines(df: DataFrame, text: str = "value") -> DataFrame:
    """Adds status, errors (array of broken rules) and the typed record's blocks to each line.

    Null and white-space lines are blank. JSON that is no object, a missing or empty id, a block of the wrong type or a field
    that breaks its rule makes the line invalid. Skills that are no objects or have no name are left out; missing or null
    blocks are empty ones. The record of a line that isn't ok is null.
    """
    lines = df.withColumn("_v", F.try_parse_json(F.col(text)))
    v = F.col("_v")
    kind = F.schema_of_variant(v)
    signal = F.coalesce(*[F.when(_is_object(_get(v, b, "variant")), _get(v, b, "variant")) for b in SIGNAL_BLOCKS], F.try_parse_json(F.lit("{}")))
    profile = F.coalesce(F.when(_is_object(_get(v, "profile", "variant")), _get(v, "profile", "variant")), F.try_parse_json(F.lit("{}")))
    lines = lines.withColumn("_signals", signal).withColumn("_profile", profile)
    named = lambda x: _is_object(x) & ~F.coalesce(is_blank(_get(x, "name")), F.lit(True))
    for b in BLOCKS:
        e = _elements(v, b)
        lines = lines.withColumn(f"_{b}", F.filter(e, named) if b == "skills" else e)
    id_type = _type(v, "candidate_id")
    rules = [F.when(id_type.isNull() | (id_type == "VOID") | F.coalesce(_get(v, "candidate_id"), F.lit("")).isin("", "0", "false"), F.array(F.lit("candidate_id"))).otherwise(F.array().cast("array<string>"))]
    wrong = lambda b, t: F.when(~F.coalesce(_type(v, b), F.lit("VOID")).startswith(t) & (F.coalesce(_type(v, b), F.lit("VOID")) != "VOID"), F.array(F.lit(b))).otherwise(F.array().cast("array<string>"))
    rules += [wrong("profile", "OBJECT"), *(wrong(b, "OBJECT") for b in SIGNAL_BLOCKS), *(wrong(b, "ARRAY") for b in BLOCKS if b != "skills")]
    rules += [_errors(F.col("_profile"), PROFILE, "profile"), _errors(F.col("_signals"), SIGNALS, "signals")]
    for b, fields in BLOCKS.items():
        rules.append(F.flatten(F.transform(F.col(f"_{b}"), _element_errors(b, fields))))
    errors = F.when(~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.array(F.lit("record"))).otherwise(F.array_distinct(F.concat(*rules)))
    blank = is_blank(F.col(text))
    out = lines.withColumn("errors", F.when(blank | v.isNull(), F.array().cast("array<string>")).otherwise(errors))
    status = F.when(blank, "blank").when(v.isNull(), "bad_json").when(F.size("errors") > 0, "invalid").otherwise("ok")
    out = out.withColumn("status", status)
    good = F.col("status") == "ok"
    only = lambda c: F.when(good, c)
    scores = F.transform_values(_get(F.col("_signals"), "skill_assessment_scores", "map<string,variant>"), lambda k, x: coerce.number(F.try_variant_get(x, "$", "string")))
    bound = lambda n: coerce.number(_get(F.col("_signals"), f"expected_salary_range_inr_lpa.{n}"))
    salary = F.when(_is_object(_get(F.col("_signals"), "expected_salary_range_inr_lpa", "variant")), F.struct(bound("min").alias("min"), bound("max").alias("max")))
    special = {"skill_assessment_scores": scores, "expected_salary_range_inr_lpa": salary}
    signals = F.struct(*[special.get(n, _typed(F.col("_signals"), n, k)[0]).alias(n) for n, k in SIGNALS.items()])
    return out.select(
        *df.columns,
        "status",
        "errors",
        only(strip(_get(v, "candidate_id"))).alias("candidate_id"),
        only(_struct(F.col("_profile"), PROFILE)).alias("profile"),
        *(only(F.transform(F.col(f"_{b}"), _element(f))).alias(b) for b, f in BLOCKS.items()),
        only(signals).alias("signals"),
        only(F.to_json(F.col("_signals"))).alias("signals_raw"),
    )


@dataclass(frozen=True)
class LoadReport:
    """Counts of one load."""

    total: int
    parsed: int
    blank: int
    bad_json: int
    invalid: int

    @property
    def success_rate(self) -> float:
        return self.parsed / self.total if self.total else 0.0

    def summary(self) -> str:
        return f"{self.parsed:,} of {self.total:,} lines parsed ({self.success_rate:.2%}); {self.blank:,} blank, {self.bad_json:,} not JSON, {self.invalid:,} invalid"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file or folder as ``value``; FileNotFoundError if the path doesn't exist."""
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid records, all lines with their status); one scan serves both if the second is persisted by the caller."""
    lines = parse_lines(read_lines(spark, path))
    return lines.where("status = 'ok'").drop("value", "status", "errors"), lines


def report(lines: DataFrame) -> LoadReport:
    """Counts by status; an empty table has a success rate of 0."""
    n = {r["status"]: r["n"] for r in lines.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return LoadReport(sum(n.values()), n.get("ok", 0), n.get("blank", 0), n.get("bad_json", 0), n.get("invalid", 0))


def error_samples(lines: DataFrame, most: int = 50) -> DataFrame:
    """At most so many invalid lines, whole, with their candidate id, if they have one, and the rules they break."""
    return lines.where("status = 'invalid'").select(F.try_variant_get(F.try_parse_json("value"), "$.candidate_id", "string").alias("candidate_id"), F.col("value").alias("line"), "errors").limit(most)


def require_rows(df: DataFrame, hint: str) -> DataFrame:
    """The frame, or ValueError with the hint if it is empty."""
    if df.isEmpty():
        raise ValueError(hint)
    return df
