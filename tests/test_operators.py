import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import checks, copies, features, match, ranker, requirement, retrieval, scoring, traps, validate
from loomspark.sources import artifacts
from loomspark.sources.records import parse_lines

DAY = dt.date(2026, 6, 21)


def nested(spark, **rec):
    return parse_lines(spark.createDataFrame([(json.dumps({"candidate_id": "C1", **rec}),)], "value string"))


def job(company="X", title="T", start=None, end=None, months=None, current=False, **more):
    return {"company": company, "title": title, "start_date": start, "end_date": end, "duration_months": months, "is_current": current, **more}


def penalty(spark, check, **rec):
    return nested(spark, **rec).select(check(as_of=DAY).alias("r")).first()["r"]["penalty"]


@pytest.mark.parametrize("lo, hi, want", [(10, 20, 0), (20, 10, 0.3), (10, 10, 0), (None, 5, 0), ("x", 5, 0)])
def test_salary(spark, lo, hi, want):
    assert penalty(spark, checks.salary_inversion, redrob_signals={"expected_salary_range_inr_lpa": {"min": lo, "max": hi}}) == want


@pytest.mark.parametrize("n, current, want", [(0, False, 0), (1, False, 0.25), (2, False, 0.5), (4, False, 0.5), (2, True, 0)])
def test_job_dates(spark, n, current, want):
    assert penalty(spark, checks.job_date_inversion, career_history=[job(start="2022-01-01", end="2020-01-01", current=current)] * n) == want


def test_other_checks(spark):
    edu = lambda n: [{"institution": "U", "start_year": 2019, "end_year": 2015}] * n
    assert [penalty(spark, checks.education_date_inversion, education=edu(n)) for n in (0, 1, 5)] == [0, 0.15, 0.3]
    dur = lambda m, n=1: [job(start="2020-01-01", end="2022-01-01", months=m)] * n
    assert [penalty(spark, checks.duration_mismatch, career_history=dur(m)) for m in (24, 26, 36, None)] == [0, 0, 0.1, 0]
    assert penalty(spark, checks.duration_mismatch, career_history=dur(60, 6)) == 0.4
    skill = lambda n, p="Expert", d=0: [{"name": f"s{i}", "proficiency": p, "duration_months": d} for i in range(n)]
    assert [penalty(spark, checks.expert_zero_duration, skills=s) for s in (skill(2), skill(3), skill(3, "beginner"), skill(3, d=5), skill(3, d=None))] == [0, 0.2, 0, 0, 0]
    over = lambda y, n: penalty(spark, checks.skill_exceeds_experience, profile={"years_of_experience": y}, skills=skill(n, "x", 73))
    assert [over(5.0, 1), over(5.1, 1), over(None, 3), over(1, 1), over(1, 5)] == [0.2, 0, 0, 0.2, 0.4]
    firm = lambda c, s, n=1: penalty(spark, checks.startup_founding_year, career_history=[job(company=c, start=s)] * n)
    assert [firm("OpenAI Inc", "2014-05-01"), firm("OpenAI", "2015-01-01"), firm("Bakery", "1990-01-01"), firm("openai", None), firm("Mistral", "2000-01-01", 5)] == [0.35, 0, 0, 0, 0.7]


def test_detect_clips_and_reports(spark):
    bad = nested(spark, profile={"years_of_experience": 5}, redrob_signals={"expected_salary_range_inr_lpa": {"min": 30, "max": 10}}, skills=[{"name": f"s{i}", "proficiency": "expert", "duration_months": 0} for i in range(3)], career_history=[job(start="2022-01-01", end="2020-01-01"), job("OpenAI", start="2010-01-01", end="2011-01-01")])
    r = checks.detect(bad).first()
    assert (r["honeypot_score"], r["trust_score"], r["is_honeypot"], r["num_checks_run"], r["num_checks_triggered"]) == (1.0, 0.0, True, 7, 4)
    assert set(json.loads(r["check_penalties_json"])) == set(json.loads(r["checks_triggered_json"])) and len(json.loads(r["check_reasons_json"])) == 7
    assert checks.detect(nested(spark)).first()["honeypot_score"] == 0.0
    edge = spark.createDataFrame([([0.25, 0.35],), ([],)], "p array<double>")
    assert [x[0] for x in edge.select(checks.fuse_penalties(F.col("p"))["is_honeypot"]).collect()] == [False, False]


def test_features(spark):
    r = features.extract(nested(spark, profile={"current_title": "Engineer"}, career_history=[job("TechCorp", "Senior Engineer", months=24, industry="Product"), job("TechCorp", "Engineer", months=12, industry="Product"), job("ConsultingInc", "Analyst", months=24, company_size="51-100")], redrob_signals={"skill_assessment_scores": {"a": 90, "b": 80}, "expected_salary_range_inr_lpa": {"min": 15, "max": 25}})).first()
    assert r["avg_tenure"] == pytest.approx(20 / 12) and r["relevant_experience"] == 3.0 and r["promotion_count"] == 1
    assert (r["product_company_ratio"], r["consulting_ratio"], r["startup_ratio"]) == pytest.approx((2 / 3, 1 / 3, 1 / 3))  # "1-10" is a substring of "51-100"
    assert (r["signal_num_skill_assessments"], r["signal_avg_skill_assessment_score"], r["signal_max_skill_assessment_score"], r["signal_expected_salary_max"]) == (2, 85.0, 90.0, 25.0)
    e = features.extract(nested(spark))
    assert len(e.columns) == 39 and (e.first()["avg_tenure"], e.first()["notice_period_days"], e.first()["location"]) == (0.0, 0, "")


JD = """Required Qualifications:
Strong Python and C++ skills, also go
Preferred:
Docker, python, machine learning.
Location: Remote, India
5 to 8 years of experience in fintech. Leadership"""


def test_requirement(spark):
    n = requirement.parse(spark, JD)
    assert n.required_skills == ["C++", "Go", "Python"] and n.preferred_skills == ["Docker", "Machine Learning"]
    assert (n.min_years, n.max_years, n.locations, n.industries, n.soft_skills) == (5.0, 8.0, ["India", "Remote"], ["FinTech"], ["Leadership"])
    assert requirement.Requirement.from_json(n.to_json()) == n
    assert requirement.parse(spark, "") == requirement.Requirement()
    with pytest.raises(ValueError):
        requirement.Requirement.from_json('{"required_skills": 3}')


@pytest.mark.parametrize("text, want", [("3-5 years", (3, 5)), ("2 to 4 years", (2, 4)), ("5+ years", (5, None)), ("at least 8 years", (8, None)), ("4 years of experience", (4, None)), ("years", (None, None)), ("5–9 years", (None, None)), ("7+ years, or 2-3 years", (2, 3))])
def test_years(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(requirement.years_range(F.col("t")).alias("y")).first()["y"]
    assert ((r["lo"], r["hi"]) if r else (None, None)) == want


def flat(spark, rows):
    cols = "candidate_id string, headline string, summary string, current_title string, years_of_experience double, location string, country string, preferred_work_mode string, willing_to_relocate boolean, current_industry string, skill_names_json string, career_titles_json string, career_companies_json string, career_descriptions_json string, certification_names_json string, num_skills int, num_career_entries int, profile_completeness_score double"
    names = [c.split()[0] for c in cols.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], cols)


def test_match(spark):
    c = flat(spark, [{"candidate_id": "A", "headline": "ML Engineer", "current_title": "Software Engineer", "years_of_experience": 6.0, "country": "India", "willing_to_relocate": True, "current_industry": "FinTech", "skill_names_json": '["Python", "Docker"]', "career_descriptions_json": '["python services"]', "certification_names_json": '["Python cert"]'}, {"candidate_id": "B", "headline": "HR", "years_of_experience": None, "skill_names_json": "{broken", "certification_names_json": '["x"]'}])
    f = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "candidate_id string, location double")
    h = spark.createDataFrame([("A", 0.1, 0.9, False), ("B", 0.9, 0.1, True)], "candidate_id string, honeypot_score double, trust_score double, is_honeypot boolean")
    r = spark.createDataFrame([("A", 2.0, 0.5, 0.03, 1)], "candidate_id string, bm25_score double, dense_score double, rrf_score double, combined_rank int")
    need = requirement.Requirement(["Python", "Rust"], ["Docker"], 5.0, 9.0, ["India"], ["FinTech"], [])
    m = match.match_features(c, f, h, r, need)
    a, b = m.orderBy("candidate_id").collect()
    assert len(m.columns) == 20
    assert (a["feat_required_skills_match_ratio"], a["feat_preferred_skills_match_ratio"], a["feat_experience_match_score"], a["feat_is_technical_role"], a["feat_is_ai_ml_role"], a["feat_location_match_score"], a["feat_domain_match_score"], a["feat_responsibility_match_score"], a["feat_certification_match_score"], a["feat_combined_rank"]) == (0.5, 1.0, 1.0, 1.0, 1.0, 0.8, 1.0, 0.5, 1.0, 1)
    assert (b["feat_experience_match_score"], b["feat_is_technical_role"], b["feat_certification_match_score"], b["feat_retrieved"], b["feat_combined_rank"]) == (0.5, 0.0, 0.2, 0.0, 999999)
    assert [x["candidate_id"] for x in match.match_features(c, f, h, r, need, filter_flagged=True).collect()] == ["A"]
    assert match.match_features(c, f, h, r, requirement.Requirement()).where("feat_required_skills_match_ratio = 1 and feat_location_match_score = 1 and feat_domain_match_score = 1").count() == 2


def test_traps_with_absent_columns(spark):
    c = flat(spark, [
        {"candidate_id": "CONSULTING", "career_companies_json": '["TCS", "Infosys", "Other"]', "num_skills": 40, "num_career_entries": 3},
        {"candidate_id": "RESEARCH", "current_title": "Professor", "career_titles_json": '["Postdoc"]', "num_skills": 5},
        {"candidate_id": "WRAPPER", "skill_names_json": '["LangChain"]', "current_title": "Solutions Architect"},
        {"candidate_id": "ROBOTICS", "skill_names_json": '["ROS", "Speech"]', "current_title": "Marketing lead", "summary": "uses ChatGPT"},
        {"candidate_id": "STORAGE", "skill_names_json": '["microservices", "storage"]'},
    ])
    f = spark.createDataFrame([(i, 0.9) for i in ("CONSULTING", "RESEARCH", "WRAPPER", "ROBOTICS", "STORAGE")], "candidate_id string, avg_tenure double")
    t = {r["candidate_id"]: r.asDict() for r in traps.detect_traps(c, f).collect()}
    assert t["CONSULTING"]["trap_consulting_only"] == pytest.approx(2 / 3) and t["CONSULTING"]["trap_keyword_stuffer"] == 1.0 and t["CONSULTING"]["trap_job_hopper"] == 1.0
    assert t["RESEARCH"]["trap_research_only"] == 1.0
    assert (t["WRAPPER"]["trap_langchain_only"], t["WRAPPER"]["trap_architect_no_code"]) == (1.0, 1.0)
    assert (t["ROBOTICS"]["trap_robotics_only"], t["ROBOTICS"]["trap_speech_only"], t["ROBOTICS"]["trap_marketing_summary"]) == (1.0, 1.0, 1.0)
    assert t["STORAGE"]["trap_robotics_only"] == 0.4  # substrings count: "ros" in microservices, "rag" in storage
    g = f.withColumn("signal_github_activity_score", F.lit(None).cast("double"))
    assert traps.detect_traps(c, g).where("candidate_id = 'WRAPPER'").first()["trap_architect_no_code"] == 0.2


def test_copies(spark):
    c = spark.createDataFrame([("A", " X ", "h", "s", "[]", True), ("B", "x", "H", "s", "[]", False), ("C", None, "h", "s", "[]", True), ("D", "y", "h", None, None, None)], "candidate_id string, anonymized_name string, headline string, summary string, skill_names_json string, open_to_work_flag boolean")
    f = spark.createDataFrame([(i, 0.5, "2026-06-21", 0.5, -1.0, 100, 5) for i in "ABCD"], "candidate_id string, signal_recruiter_response_rate double, signal_last_active_date string, signal_interview_completion_rate double, signal_offer_acceptance_rate double, signal_profile_views_received_30d int, signal_saved_by_recruiters_30d int")
    r = {x["candidate_id"]: x for x in copies.resolve(c, f).collect()}
    a, b = 0.2 + 0.1 + 0.15 + 0.075 + 0.1 + 0.05, 0.1 + 0.15 + 0.075 + 0.1 + 0.05
    assert r["A"]["behavioral_strength"] == pytest.approx(a) and r["A"]["twin_score"] == 1.0 and r["A"]["is_twin"]
    assert r["B"]["twin_score"] == pytest.approx(0.5 * b / a) and not r["C"]["is_twin"] and r["D"]["twin_score"] == 1.0
    tied = spark.createDataFrame([("k", 0.0), ("k", 0.0), ("m", 2.0), ("m", 2.0)], "key string, v double")
    assert sorted(x["twin_score"] for x in copies.relative_scores(tied, "key", "v").collect()) == [0.0, 0.0, 1.0, 1.0]


def test_bm25_against_formula(spark):
    docs = ["python python go", "java go", "", None, "rust c"]
    got = {r["id"]: r["bm25_score"] for r in retrieval.bm25(spark.createDataFrame(list(enumerate(docs)), "id int, t string"), "id", "t", "python go missing python").collect()}
    toks = [(d or "").split() for d in docs]
    n, avg = len(docs), np.mean([len(t) for t in toks])
    vocab = {w for t in toks for w in t}
    idf = {w: np.log(n - sum(w in t for t in toks) + 0.5) - np.log(sum(w in t for t in toks) + 0.5) for w in vocab}
    floor = 0.25 * np.mean(list(idf.values()))
    for i, t in enumerate(toks):
        want = sum((idf[w] if idf[w] >= 0 else floor) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in "python go missing python".split() if w in idf and t)
        assert got[i] == pytest.approx(want)


def test_hybrid(spark):
    d = spark.createDataFrame([("a", "python", [1.0, 0.0]), ("b", "go", [0.0, 1.0]), ("c", "frontend", None)], "id string, t string, v array<double>")
    h = retrieval.hybrid(d, "id", "t", "v", "python", [1.0, 0.0], top_n=2).orderBy("combined_rank").collect()
    assert [x["id"] for x in h] == ["a", "b"] and h[0]["rrf_score"] == pytest.approx(2 / 61)
    limited = retrieval.hybrid(d, "id", "t", "v", "python", [1.0, 0.0], top_n=2, depth=2).orderBy("combined_rank").first()
    assert limited["id"] == "a"
    e = retrieval.hybrid(d.limit(0), "id", "t", "v", "python", [1.0, 0.0])
    assert e.count() == 0 and len(e.columns) == 7
    assert retrieval.query_text(requirement.Requirement()) == "Software Engineer"


def test_vector_cache(spark):
    d = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", None)], "id string, t string")
    empty = spark.createDataFrame([], artifacts.VECTOR_CACHE)
    out, fresh = retrieval.encode_missing(d, "t", empty, "m")
    assert out.count() == 3 and fresh.count() == 2
    again, none = retrieval.encode_missing(d, "t", fresh, "m")
    assert none.count() == 0 and again.count() == 3
    assert retrieval.encode_missing(d, "t", fresh, "other")[1].count() == 2


def test_labels_and_ranker(spark):
    rng = np.random.default_rng(7)
    rows = [(f"C{i:03d}", *map(float, rng.random(8)), float(rng.integers(0, 15)), 0.9 if i < 5 else 0.0) for i in range(100)]
    df = spark.createDataFrame(rows, "candidate_id string, " + ", ".join(f"{w} double" for w in ranker.WEIGHED) + ", years_of_experience double, honeypot_score double")
    lab = ranker.relevance(ranker.persona_utilities(df))
    assert lab.count() == 500 and lab.where("honeypot_score > 0.6").agg(F.max("relevance")).first()[0] == 0
    assert {r[0] for r in lab.select("relevance").distinct().collect()} == {0, 1, 2, 3, 4}
    model = ranker.train(df, rounds=15)
    out = ranker.rank(df, model).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 101)) and all(a["score"] >= b["score"] for a, b in zip(out, out[1:], strict=False))
    y = {r["candidate_id"]: r["relevance"] for r in lab.where("persona = 0").collect()}
    s = np.array([r["score"] for r in out])
    rel = np.array([y[r["candidate_id"]] for r in out], float)
    assert ranker.ndcg(rel, s, 10) > 0.8
    assert ranker.TreeRanker.from_json(model.to_json()).to_json() == model.to_json()


def test_labels_of_a_bounded_table_are_those_of_all_rows(spark, monkeypatch):
    """Utility rises with the id, so that a prefix of ids would hold the worst only."""
    rows = [(f"C{i:03d}", *[float(i)] * 8, 6.0) for i in range(200)]
    df = spark.createDataFrame(rows, "candidate_id string, " + ", ".join(f"{w} double" for w in ranker.WEIGHED) + ", years_of_experience double")
    every = {(r["candidate_id"], r["persona"]): r["relevance"] for r in ranker.relevance(ranker.persona_utilities(df)).collect()}
    seen = []
    monkeypatch.setattr(ranker.TreeRanker, "fit", lambda self, x, y, group, rounds: seen.append((y, group)) or self)
    monkeypatch.setattr(ranker.labels, "__defaults__", (250,))
    got = {(r["candidate_id"], r["persona"]): r["relevance"] for r in ranker.labels(df).collect()}
    ids = {i for i, _ in got}
    assert got.items() <= every.items() and len(got) == 250 and len(ids) == 50 and ids != {f"C{i:03d}" for i in range(50)}
    ranker.train(df)
    y, group = seen[0]
    assert len(y) == 250 and set(y) == {0, 1, 2, 3, 4}


def test_rerank_uses_the_cache(spark):
    c = spark.createDataFrame([("A", "good match"), ("B", "none"), ("C", None)], "candidate_id string, normalized_text string")
    empty = spark.createDataFrame([], artifacts.SCORE_CACHE)
    out, fresh = ranker.rerank(c, c, "good match", empty, top_k=2)
    fresh = spark.createDataFrame(fresh.collect(), artifacts.SCORE_CACHE)
    assert [r["candidate_id"] for r in out.orderBy("rank").collect()][0] == "A" and fresh.count() == 3

    def never(need, texts):
        raise AssertionError("scored again")

    assert ranker.rerank(c, c, "good match", fresh, scorer=never, top_k=3)[0].count() == 3


def test_scores_and_reasoning(spark):
    d = spark.createDataFrame([("A", 3.0, 90, 10.0, 1.0, "Head ", '["a","","b","c","d"]', True, 0.75), ("B", None, None, 10.0, 0.0, " ", None, None, None)], "candidate_id string, years_of_experience double, notice_period_days int, score double, feat_is_technical_role double, headline string, skill_names_json string, open_to_work_flag boolean, signal_recruiter_response_rate double")
    a, b = d.select(scoring.adjusted_score(d).alias("s"), scoring.reasoning(d).alias("r")).collect()
    assert a["s"] == pytest.approx(10 - 20 - 6) and b["s"] == pytest.approx(10 - 50 - 50)
    assert a["r"] == "Head with 3.0 years of experience, demonstrating expertise in a, b, c. Candidate is actively open to new work and a high recruiter response rate of 75%, though notes show a long notice period of 90 days."
    assert b["r"] == "Software Engineer with 0.0 years of experience, demonstrating expertise in required technical skills. Profile shows stable engagement."
    same = scoring.min_max(spark.createDataFrame([(5.0,), (5.0,)], "x double"), "x").collect()
    assert [r["score"] for r in same] == [0.0, 0.0]


def result(spark, n=100, **change):
    rows = [(change.get("id", f"CAND_{i:07d}"), str(change.get("rank", i + 1)), str(100.0 - i if not change.get("rising") else i), f"reason number {i} that is long enough to be read by people") for i in range(n)]
    return spark.createDataFrame(rows, "candidate_id string, rank string, score string, reasoning string")


def failed(report):
    return {r["check"] for r in report.where("status = 'FAIL'").collect()}


def test_validators(spark):
    known = result(spark).select("candidate_id")
    good = validate.table_report(result(spark), known)
    assert validate.passed(good) and good.count() == 18 and "PASS" in artifacts.print_report(good)
    assert failed(validate.table_report(result(spark).drop("score"))) == {"exact columns"}
    assert "row count" in failed(validate.table_report(result(spark, 10)))
    assert "ranks complete" in failed(validate.table_report(result(spark, rank=5)))
    assert "not rising" in failed(validate.table_report(result(spark, rising=True)))
    assert {"unique ids", "id pattern"} <= failed(validate.table_report(result(spark, id="bad")))
    assert "rank is an integer" in failed(validate.table_report(result(spark, rank="01")))
    assert failed(validate.table_report(result(spark), known.limit(50))) == {"ids exist"}
    assert "row count" in failed(validate.table_report(result(spark, 0)))


def test_csv_round_trip(spark, tmp_path):
    p = str(tmp_path / "a" / "out.csv")
    artifacts.write_result_csv(spark.createDataFrame([("C", 1, 2.5, 'says "x", and\nmore')], "candidate_id string, rank int, score double, reasoning string"), p)
    assert artifacts.read_csv(spark, p).first()["reasoning"] == 'says "x", and\nmore'
    f = tmp_path / "raw.csv"
    f.write_text("candidate_id , rank,score,reasoning\nA,1,2,ok\n , , ,\nB,2,3\nC,3,4,x,y\n")
    good, bad = artifacts.read_csv_raw(spark, str(f))
    assert good.columns == ["candidate_id", "rank", "score", "reasoning"] and [r["candidate_id"] for r in good.collect()] == ["A"] and bad.count() == 2


def test_small_sources(spark, tmp_path):
    assert artifacts.read_cache(spark, str(tmp_path / "none"), artifacts.SCORE_CACHE).count() == 0
    p = str(tmp_path / "t" / "x.parquet")
    assert artifacts.write_parquet(spark.range(25), p, rows_per_file=10) == 25 and artifacts.read_parquet(spark, p, "id").count() == 25
    (tmp_path / "s.json").write_text('{"A": -1.5, "B": 2}')
    assert {tuple(r) for r in artifacts.read_legacy_scores(spark, str(tmp_path / "s.json")).collect()} == {("A", -1.5), ("B", 2.0)}
    (tmp_path / "l.jsonl").write_text('{"candidate_id":"A"}\n{bad\n{"x":1}\n')
    assert [r[0] for r in artifacts.read_ids(spark, str(tmp_path / "l.jsonl")).collect()] == ["A"]
    with pytest.raises(FileNotFoundError):
        artifacts.read_model(spark, str(tmp_path / "model.json"))
    with pytest.raises(FileNotFoundError):
        artifacts.require(spark, str(tmp_path / "gone"))
