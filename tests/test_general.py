"""Nested records and intervals, each against a brute-force version; stream; queries against their SQL."""

import datetime as dt
import json
import random

import pytest
from compare import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.operators.intervals import employment_periods, periods_and_gaps
from loomspark.operators.nested import CAREER_FIELDS, Layout, Scanner, ancestors_found, children, flat_tables, parse_record, pivot_group, triples
from loomspark.streaming import ingest

DAY = dt.date(2026, 6, 21)


def brute_periods(rows):
    out = set()
    for e in {r[0] for r in rows if r[0]}:
        days = {a.toordinal() + i for x, a, b in rows if x == e and a and b for i in range((b - a).days + 1)}
        run = []
        for d in sorted(days):
            if run and d == run[-1][1] + 1:
                run[-1][1] = d
            else:
                run.append([d, d])
        f = dt.date.fromordinal
        out |= {(e, "period", f(a), f(b)) for a, b in run} | {(e, "gap", f(p[1] + 1), f(q[0] - 1)) for p, q in zip(run, run[1:], strict=False)}
    return out


def test_periods_against_brute_force(spark):
    rng = random.Random(3)
    base = dt.date(1969, 1, 1)
    rows = []
    for e in ("A", "B", "C", None):
        for _ in range(40):
            a = base + dt.timedelta(days=rng.randint(0, 9000))
            b = a + dt.timedelta(days=rng.choice([-1, 0, 1, 5, 63, 64, 65, 700, 4096, 5000]) if e != "C" else rng.randint(0, 6))
            rows.append((e, rng.choice([a, a, a, None]), rng.choice([b, b, b, None])))
    rows += rows[:30]
    got = {tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, "e string, a date, b date"), "e", "a", "b").collect()}
    assert got == brute_periods(rows)


def test_extreme_intervals(spark):
    d = dt.date
    rows = [("A", d(1, 1, 1), d(9999, 12, 31)), ("B", d(2020, 1, 31), d(2020, 1, 31)), ("B", d(2020, 2, 1), d(2020, 2, 1)), ("B", d(2020, 2, 3), d(2020, 2, 3))]
    got = {tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, "e string, a date, b date"), "e", "a", "b").collect()}
    assert got == {("A", "period", d(1, 1, 1), d(9999, 12, 31)), ("B", "period", d(2020, 1, 31), d(2020, 2, 1)), ("B", "gap", d(2020, 2, 2), d(2020, 2, 2)), ("B", "period", d(2020, 2, 3), d(2020, 2, 3))}
    assert periods_and_gaps(spark.createDataFrame([], "e string, a date, b date"), "e", "a", "b").count() == 0


def test_current_entries(spark):
    rows = [("A", dt.date(2026, 6, 1), dt.date(2020, 1, 1), True), ("B", dt.date(2027, 1, 1), None, True), ("C", dt.date(2020, 1, 1), None, None), ("D", dt.date(2020, 1, 5), dt.date(2020, 1, 1), False)]
    df = spark.createDataFrame(rows, "candidate_id string, start_date date, end_date date, is_current boolean").selectExpr("*", "1 as shard", "'x' as mask", "2 as a", "3 as stretch")
    assert [tuple(r) for r in employment_periods(df).collect()] == [("A", "period", dt.date(2026, 6, 1), DAY)]


def line(**rec):
    return json.dumps({"candidate_id": "C", **rec})


CASES = {
    None: [], "": [], "{bad": [], "[1]": [], '"C"': [], '{"candidate_id": " "}': [], '{"candidate_id": null, "skills": [{"name": "x"}]}': [], "{\"candidate_id\": \"C\", \"x\": NaN}": [],
    line(career_history=[{}, 3, None, {"company": "X"}, "text", []]): [("career", "0"), ("career", "3")], line(career_history={"title": "T"}): [("career", "0")], line(career_history=json.dumps([{"title": "T"}, None])): [("career", "0")],
    line(career_history="oops"): [], line(skills=[{"name": " "}, {"name": None}, {"x": 1}, {"name": "A"}]): [("skill", "3")], line(skills={"name": "A"}): [("skill", "0")],
    line(redrob_signals={"skill_assessment_scores": {"A": 1, "B": None, "C": "pending"}}): [("assessment", "A"), ("assessment", "C")], line(signals=json.dumps({"skill_assessment_scores": {"A": 0}})): [("assessment", "A")],
    line(signals={"expected_salary_range_inr_lpa": {"min": None, "max": 3}}): [("salary", "0")], line(signals={"expected_salary_range_inr_lpa": {"min": None, "max": None}}): [], line(signals={"expected_salary_range_inr_lpa": [1, 2]}): [],
    line(redrob_signals=None, signals={"skill_assessment_scores": {"A": 2}}): [("assessment", "A")], line(skills=[{"name": "long", "note": "y" * 200_000}]): [("skill", "0")],
}


def test_children(spark):
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(CASES)], "raw_id bigint, payload string, record string")
    got = {tuple(r) for r in children(df).collect()}
    assert got == {(i, *c) for i, want in enumerate(CASES.values()) for c in want}
    assert children(df.limit(0)).count() == 0


def test_flat_tables_keep_links_and_values(spark):
    df = spark.createDataFrame([(7, line(career_history=[None, {"company": "X", "description": "d", "duration_months": 3}], skills=[{"name": "A", "endorsements": 4}], redrob_signals={"expected_salary_range_inr_lpa": {"min": 2.5}}))], "raw_id bigint, payload string")
    t = {k: [r.asDict() for r in v.collect()] for k, v in flat_tables(df).items()}
    assert t["career"] == [{"raw_id": 7, "ordinal": "1", **dict.fromkeys(CAREER_FIELDS), "company": "X", "description": "d", "duration_months": "3"}]
    assert t["skill"][0]["endorsements"] == "4" and t["salary"] == [{"raw_id": 7, "ordinal": "0", "min": "2.5", "max": None}] and t["assessment"] == []


def test_parse_record_edges():
    lay = Layout()
    assert parse_record('{"candidate_id":"C","skills":[{"name":"a\\ud800"}]}', lay)[-1][3] == "a?"
    assert parse_record("[" * 100_000, lay) is None
    assert parse_record('{"candidate_id":"C","candidate_id":"D"}', lay)[0][3] == "D"


def test_third_level_has_tables_and_parents(spark):
    jobs = [{"company": "X", "projects": [{"name": "p", "tags": ["a", None, "b"]}, 5, {"name": "q", "lead": {"first": "L"}}]}, {"company": "Y", "projects": []}]
    df = spark.createDataFrame([(7, line(career_history=jobs, redrob_signals={"log": [[1, 2], [3]]}))], "raw_id bigint, payload string")
    t = triples(df)
    got = {(r["ancestor"], r["ordinal"], r["path"]): r["value"] for r in t.collect()}
    assert got["career_history.projects", "0/0", "name"] == "p" and got["career_history.projects", "0/2", "lead.first"] == "L" and got["career_history.projects", "0/1", "="] == "5"
    assert got["career_history.projects.tags", "0/0/2", "="] == "b" and got["career_history.projects.tags", "0/0/1", "="] is None
    assert got["redrob_signals.log[]", "0/1", "="] == "2" and got["redrob_signals.log[]", "1/0", "="] == "3" and got["career_history", "1", "projects"] == "[]"
    projects = sorted((r["ordinal"], r["name"]) for r in pivot_group(t, "career_history.projects", ["name"]).collect())
    assert projects == [("0/0", "p"), ("0/2", "q")]
    found = {r["ancestor"]: (r["parent"], r["depth"]) for r in ancestors_found(t).collect()}
    assert found["career_history.projects"] == ("career_history", 2) and found["career_history.projects.tags"] == ("career_history.projects", 3) and found["career_history"] == ("", 1)


def test_depth_and_length_cost_nothing(spark):
    deep = '{"candidate_id": "C", "x": ' + "[" * 50_000 + "]" * 50_000 + ', "n": ' + "9" * 6000 + ', "skills": [{"name": "A", "y": ' + '{"z":' * 30_000 + "1" + "}" * 30_000 + ', "endorsements": ' + "8" * 5000 + "}]}"
    df = spark.createDataFrame([(1, deep), (2, deep[:-1])], "raw_id bigint, payload string")
    assert [tuple(r) for r in children(df).collect()] == [(1, "skill", "0")]
    assert [len(r["endorsements"]) for r in flat_tables(df)["skill"].collect()] == [5000]


@pytest.mark.parametrize("text", ["[1,]", "{,}", '{"a" 1}', '{"a":01}', "[1 2]", '["\n"]', "[+1]", "[.5]", "tru", "[1]]", "", '{"a":1,}', "[\u00a01]", '"\\x"'])
def test_broken_json_is_refused(text):
    with pytest.raises(ValueError):
        json.loads(text)
    assert parse_record('{"candidate_id":"C","x":' + text + "}", Layout()) is None and parse_record('{"candidate_id":"C","skills":' + text + "}", Layout(), frozenset({"skills"})) is None


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20))
@settings(max_examples=150, deadline=None)
def test_events_read_all_json(value):
    text = json.dumps(value, indent=1)
    x, seen = Scanner(text), []
    while (e := x.next())[0] != ".":
        seen.append(e)
    leaves = lambda v: sum(map(leaves, v.values())) if isinstance(v, dict) else sum(map(leaves, v)) if isinstance(v, list) else 1
    assert sum(e[0] in "sa" for e in seen) == leaves(value)
    y = Scanner(text)
    y.skip()
    assert y.next()[0] == "."


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"candidate_id":"A"}\n{bad}\n\n{"candidate_id":"B"}\n')
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    ingest.run(spark, *args)
    (tmp_path / "in" / "b.jsonl").write_text('{"candidate_id":"C"}\n')
    ingest.run(spark, *args)
    got = {(r["table"], r["batch"]): r["rows"] for r in ingest.counts(spark, args[1]).collect()}
    assert got[("candidates", 0)] == 2 and got[("candidates", 1)] == 1 and got[("rejected", 0)] == 2


def test_pipeline(spark, root, tmp_path):
    from pyspark.sql import functions as F

    from loomspark.plans.pipeline import STAGES, Pipeline

    rows = spark.read.parquet(f"{root}/raw_candidates.parquet").select(F.regexp_replace("payload", r"[\r\n]", " "))
    (tmp_path / "lines.jsonl").write_text("\n".join(r[0] for r in rows.collect()))
    (tmp_path / "need.txt").write_text("Required: python\n5-9 years")
    p = Pipeline(spark, str(tmp_path / "out"), str(tmp_path / "lines.jsonl"), str(tmp_path / "need.txt"), top_result=3, rounds=2, filter_flagged=False)
    with pytest.raises(FileNotFoundError):
        p.run("match")
    p.run("all")
    assert p.read("lines.parquet").count() >= p.read("candidates.parquet").count() >= p.read("reranked.parquet").count() > 3
    assert len(STAGES) == 11
    (tmp_path / "bad.jsonl").write_text("{bad}\n")
    with pytest.raises(ValueError):
        Pipeline(spark, str(tmp_path / "out2"), str(tmp_path / "bad.jsonl")).ingest()


def _core():
    from loomspark.plans import interval_queries, stage_queries, table_queries

    return {**table_queries.QUERIES, **stage_queries.QUERIES, **interval_queries.QUERIES}, {**table_queries.SQL, **stage_queries.SQL, **interval_queries.SQL}


@pytest.fixture(scope="module")
def con(root):
    return connect(root)


@pytest.mark.parametrize("name", sorted(_core()[1]))
def test_query_equals_its_sql(spark, root, con, name):
    qs, sqls = _core()
    said = compare(spark, con, root, name, qs[name], sqls[name])
    assert said[0] == "ok", said
