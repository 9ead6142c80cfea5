import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import coerce
from loomspark.operators import normalise
from loomspark.sources import records


def lines(spark, *texts):
    return records.parse_lines(spark.createDataFrame([(t,) for t in texts], "value string"))


def one(spark, record):
    return lines(spark, json.dumps({"candidate_id": "C1", **record})).first()


@pytest.mark.parametrize(
    "text, status",
    [
        ('{"candidate_id":"CAND_0000001"}', "ok"), (None, "blank"), ("", "blank"), (" \t ", "blank"), ("{bad json}", "bad_json"), ("[1]", "invalid"), ("3", "invalid"), ('"x"', "invalid"),
        ('{"candidate_id":""}', "invalid"), ('{"candidate_id":null}', "invalid"), ("{}", "invalid"), ('{"candidate_id":"   "}', "ok"), ('{"candidate_id":"C","profile":null,"career_history":null}', "ok"),
        ('{"candidate_id":"C","career_history":{}}', "invalid"), ('{"candidate_id":"C","skills":{}}', "ok"), ('{"candidate_id":"C","education":[{"grade":3}]}', "invalid"), ('{"candidate_id":"C","education":[{"institution":null}]}', "invalid"),
        ('{"candidate_id":"C","profile":{"location":5}}', "invalid"), ('{"candidate_id":"C","career_history":[{"is_current":null}]}', "invalid"), ('{"candidate_id":"C","career_history":[3]}', "invalid"),
        ('{"candidate_id":"C","redrob_signals":{"notice_period_days":"30.5"}}', "invalid"), ('{"candidate_id":"C","redrob_signals":{"skill_assessment_scores":[1]}}', "invalid"), ('{"candidate_id":"C","signals":{"open_to_work_flag":"maybe"}}', "invalid"), ('{"candidate_id":"C","redrob_signals":{"unknown":1}}', "ok"),
    ],
)
def test_status(spark, text, status):
    assert lines(spark, text).first()["status"] == status


def test_report_counts_and_samples(spark):
    df = lines(spark, '{"candidate_id":"A"}', '{"candidate_id":"B"}', "{bad}", "", *['{"candidate_id":""}'] * 20)
    r = records.report(df)
    assert (r.total, r.parsed, r.blank, r.bad_json, r.invalid) == (24, 2, 1, 1, 20)
    assert r.success_rate == pytest.approx(2 / 24)
    assert records.error_samples(df, 5).count() == 5
    assert records.report(df.limit(0)).success_rate == 0.0


def test_profile_coercion(spark):
    p = one(spark, {"profile": {"headline": None, "anonymized_name": "  A  ", "years_of_experience": "6.5"}})["profile"]
    assert (p["headline"], p["anonymized_name"], p["years_of_experience"]) == ("", "A", 6.5)
    for bad in (-1, "many", "NaN"):
        assert one(spark, {"profile": {"years_of_experience": bad}})["profile"]["years_of_experience"] is None


def test_career_coercion(spark):
    r = one(spark, {"career_history": [{"company": None, "start_date": "2020-01-02T00:00", "end_date": "null", "duration_months": "12.7"}, {"start_date": "2020-13-01", "duration_months": -3, "is_current": "yes"}]})
    a, b = r["career_history"]
    assert (a["company"], str(a["start_date"]), a["end_date"], a["duration_months"], a["is_current"]) == ("", "2020-01-02", None, 12, False)
    assert (b["start_date"], b["duration_months"], b["is_current"]) == (None, None, True)


def test_skills_and_certifications(spark):
    r = one(spark, {"skills": [{"name": "A", "endorsements": -5, "duration_months": -2}, {"name": None}, {"name": "  "}, 7, {"name": "B", "endorsements": "x"}], "certifications": [{"name": "X", "year": "2020"}]})
    assert [(s["name"], s["endorsements"], s["duration_months"]) for s in r["skills"]] == [("A", 0, 0), ("B", 0, None)]
    assert r["certifications"][0]["year"] == 2020


def test_signals_lax_values(spark):
    s = one(spark, {"redrob_signals": {"notice_period_days": "30", "connection_count": True, "github_activity_score": "1.5", "open_to_work_flag": "on", "skill_assessment_scores": {"a": 5, "b": None, "c": "x"}, "expected_salary_range_inr_lpa": {"min": "3", "max": "odd"}}})["signals"]
    assert (s["notice_period_days"], s["connection_count"], s["github_activity_score"], s["open_to_work_flag"]) == (30, 1, 1.5, True)
    assert s["skill_assessment_scores"] == {"a": 5.0, "b": None, "c": None}
    assert (s["expected_salary_range_inr_lpa"]["min"], s["expected_salary_range_inr_lpa"]["max"]) == (3.0, None)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.read_lines(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(ValueError):
        records.require_rows(spark.range(0), "nothing")


def test_flatten(spark):
    rec = {"profile": {"headline": "Senior  Engineer", "summary": "Builds\nthings", "years_of_experience": 10}, "career_history": [{"title": "T1", "company": "X", "description": "did a"}, {"title": "T2", "company": "Y", "description": "  "}, {"description": "did b"}], "skills": [{"name": "Python"}, {"name": "SQL"}], "certifications": [{"name": "AWS", "issuer": "Amazon", "year": 2020}, {"name": "GCP", "year": 0}, {"name": "", "issuer": "z"}], "languages": [{"language": "en"}]}
    f = normalise.flatten(lines(spark, json.dumps({"candidate_id": "C", **rec})))
    r = f.first()
    assert len(f.columns) == 29
    assert r["normalized_text"] == "[HEADLINE] Senior Engineer\n\n[SUMMARY] Builds things\n\n[EXPERIENCE] did a | did b\n\n[SKILLS] Python, SQL\n\n[CERTS] AWS (Amazon, 2020); GCP"
    assert json.loads(r["career_titles_json"]) == ["T1", "T2", ""] and json.loads(r["certification_names_json"]) == ["AWS", "GCP"]
    assert (r["num_skills"], r["num_certifications"], r["num_career_entries"], r["num_languages"]) == (2, 3, 3, 1)
    empty = normalise.flatten(lines(spark, '{"candidate_id":"C"}')).first()
    assert empty["normalized_text"] == "" and empty["skill_names_json"] == "[]" and empty["num_skills"] == 0


def test_scalar_coercions(spark):
    df = spark.createDataFrame([("5",), ("-1",), ("x",), (None,), ("NaN",), (" 7.9 ",)], "s string")
    got = df.select(coerce.non_negative(F.col("s")), coerce.months(F.col("s")), coerce.count_or_zero(F.col("s")), coerce.clamped_or_null(F.col("s")), coerce.year(F.col("s")), coerce.as_feature(coerce.number(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [(5.0, 5, 5, 5, 5, 5.0), (None, None, 0, 0, -1, -1.0), (None, None, 0, None, None, 0.0), (None, None, 0, None, None, 0.0), (None, None, 0, None, None, 0.0), (7.9, 7, 0, None, None, 7.9)]
