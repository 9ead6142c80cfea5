"""Queries that run whole stages and the artefacts' readers and writers, with their SQL.

Columns that earlier stages would compute are derived from a candidate's own counts, so that every term of a rule takes
many values; :data:`X` gives them in SQL, :func:`_facts` the same expressions in Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import SPACE
from loomspark.operators import normalise, ranker, requirement, retrieval, scoring, validate
from loomspark.plans import assemble
from loomspark.plans.table_queries import _LINES, CAND, CAREER, QUERY, SIG, SKILL, _has
from loomspark.session import shared_dir, table
from loomspark.sources import artifacts, records

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


# ---- derived facts

_N, _J, _L, _C = (f"coalesce({c}, 0)" for c in ("num_skills", "num_career_entries", "num_languages", "num_certifications"))
DERIVED = {
    **{t: f"((({_N} * {i + 2}) + {_J}) % 5) / 4e0" for i, t in enumerate(ranker.TRAPS)},
    **{f: f"((({_N} * {i + 3}) + {_C}) % 7) / 6e0" for i, f in enumerate(ranker.WEIGHED[:-1])},
    "honeypot_score": f"(({_N} * 7) % 11) / 1e1", "behavioral_strength": f"({_L} % 4) / 3e0", "twin_score": f"(({_N} % 3) + 1) / 3e0",
    "feat_is_technical_role": f"({_N} % 2) * 1e0", "feat_is_ai_ml_role": f"case when {_J} % 3 = 0 then 1e0 else 0e0 end",
    "score": "cast(substr(candidate_id, 6) as integer) * 137e-5",
}
X = f"(select c.*, s.recruiter_response_rate as signal_recruiter_response_rate, {', '.join(f'{e} as {n}' for n, e in DERIVED.items())} from {CAND} c left join (select candidate_id as sid, recruiter_response_rate from {SIG}) s on s.sid = c.candidate_id)"


def _facts(spark, root) -> DataFrame:
    s = assemble.signals(spark, root).select("candidate_id", F.col("recruiter_response_rate").alias("signal_recruiter_response_rate"))
    c = assemble.candidates(spark, root).join(s, "candidate_id", "left")
    return c.select("*", *[F.expr(e).alias(n) for n, e in DERIVED.items()])


_Y = "coalesce(years_of_experience, 0e0)"
_TRAP_POINTS = " + ".join(f"{t} * {w:.1f}e0" for t, w in scoring.TRAP_POINTS.items())
_ADJUSTED = f"""(score - case when {_Y} < 5 then (5 - {_Y}) * 10 when {_Y} > 9 then ({_Y} - 9) * 8 else 0e0 end - case when feat_is_technical_role = 0 then 50e0 else 0e0 end
  + case when feat_is_ai_ml_role = 1 then 15e0 else 0e0 end - ({_TRAP_POINTS}) - case when notice_period_days > 30 then (notice_period_days - 30) * 1e-1 else 0e0 end + behavioral_strength * 2)"""


@query("fs_adjusted_full", f"select candidate_id, round({_ADJUSTED}, 6) as score from {X}")
def fs_adjusted_full(spark, root):
    d = _facts(spark, root)
    return d.select("candidate_id", F.round(scoring.adjusted_score(d), 6).alias("score"))


def _utility_sql(weights, trap: float, special: dict[str, float]) -> str:
    good = " + ".join(f"{w}e0 * {f}" for w, f in zip(weights, ranker.WEIGHED, strict=True))
    bad = " + ".join(f"{special.get(t, trap)}e0 * {t}" for t in ranker.TRAPS)
    return f"""(({good}) + case when feat_is_ai_ml_role = 1 then 15e0 else 0e0 end - ({bad}) - case when {_Y} < 5 then (5 - {_Y}) * 4 when {_Y} > 9 then ({_Y} - 9) * 3 else 0e0 end
  - case when feat_is_technical_role = 0 then 30e0 else 0e0 end) * twin_score"""


_UTILITIES = " union all ".join(f"select candidate_id, cast({i} as bigint) as persona, {_utility_sql(*p)} as u, honeypot_score from {X}" for i, p in enumerate(ranker.PERSONAS))


@query("ml_utility_full", f"select candidate_id, persona, round(u, 6) as utility from ({_UTILITIES})")
def ml_utility_full(spark, root):
    return ranker.persona_utilities(_facts(spark, root)).select("candidate_id", F.col("persona").cast("bigint").alias("persona"), F.round("utility", 6).alias("utility"))


@query("ml_labels", f"""
with u as (select candidate_id, persona, round(u, 9) as u, honeypot_score from ({_UTILITIES})),
q as (select persona, quantile_cont(u, 0.2) as a, quantile_cont(u, 0.4) as b, quantile_cont(u, 0.6) as c, quantile_cont(u, 0.85) as d from u group by 1)
select candidate_id, persona, cast(case when honeypot_score > 0.6 then 0 when u <= a + 1e-9 then 0 when u <= b + 1e-9 then 1 when u <= c + 1e-9 then 2 when u <= d + 1e-9 then 3 else 4 end as bigint) as relevance from u join q using (persona)""")  # fmt: skip
def ml_labels(spark, root):
    u = ranker.persona_utilities(_facts(spark, root)).withColumn("utility", F.round("utility", 9))
    return ranker.relevance(u).select("candidate_id", F.col("persona").cast("bigint").alias("persona"), F.col("relevance").cast("bigint").alias("relevance"))


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


_SHOWN = "list_slice(list_filter(coalesce(try_cast(skill_names_json as json)::varchar[], []), lambda x: x is not null and x <> ''), 1, 3)"
_RATE = "cast(trunc(coalesce(signal_recruiter_response_rate, 0e0) * 100) as integer)"
_GAPS = f"""list_filter([case when notice_period_days > 60 then 'a long notice period of ' || notice_period_days || ' days' end, case when trap_job_hopper > 0.6 then 'potential job-hopping history' end,
  case when trap_consulting_only > 0.7 then 'exclusively service-firm consulting experience' end, case when trap_inactive_candidate > 0.6 then 'low platform login recency' end,
  case when trap_keyword_stuffer > 0.6 then 'potential keyword stuffing in profile skills' end], lambda g: g is not null)"""
_REASON = f"""coalesce(nullif({_strip_sql('headline')}, ''), nullif({_strip_sql('current_title')}, ''), 'Software Engineer') || ' with ' || printf('%.1f', {_Y}) || ' years of experience, demonstrating expertise in '
  || case when len({_SHOWN}) > 0 then array_to_string({_SHOWN}, ', ') else 'required technical skills' end || '. '
  || case when open_to_work_flag then 'Candidate is actively open to new work' else 'Profile shows stable engagement' end
  || case when {_RATE} > 50 then ' and a high recruiter response rate of ' || {_RATE} || '%' when {_RATE} > 0 then ' and a response rate of ' || {_RATE} || '%' else '' end
  || case when len({_GAPS}) > 0 then ', though notes show ' || array_to_string({_GAPS}, ', with ') || '.' else '.' end"""


@query("fs_reasoning", f"select candidate_id, {_REASON} as reasoning from {X}")
def fs_reasoning(spark, root):
    d = _facts(spark, root)
    return d.select("candidate_id", scoring.reasoning(d).alias("reasoning"))


_FINAL = f"""(with b as (select candidate_id, {_ADJUSTED} as adj, {_REASON} as reasoning from {X} order by adj desc, candidate_id limit 100)
select candidate_id, cast(row_number() over (order by adj desc, candidate_id) as integer) as rank, round((adj - min(adj) over ()) / case when max(adj) over () = min(adj) over () then 1 else max(adj) over () - min(adj) over () end * 100, 4) as score, reasoning from b)"""


def _final(spark, root) -> DataFrame:
    d = _facts(spark, root)
    return scoring.final_table(d, d.select("candidate_id", "score"), 100)


@query("fs_final_table", f"select candidate_id, cast(rank as bigint) as rank, score, reasoning from {_FINAL}")
def fs_final_table(spark, root):
    return _final(spark, root).select("candidate_id", F.col("rank").cast("bigint").alias("rank"), "score", "reasoning")


def _report_sql(final: str) -> str:
    full = "reasoning <> ''"
    checks = [
        ("columns", "exact columns", "true", "'candidate_id, rank, score, reasoning'", "FAIL"), ("rows", "row count", "n = 100", "n", "FAIL"), ("format", "id pattern", "bad_ids = 0", "bad_ids", "FAIL"),
        ("format", "rank is an integer", "bad_ranks = 0", "bad_ranks", "FAIL"), ("format", "score is finite", "bad_scores = 0", "bad_scores", "FAIL"), ("ids", "unique ids", "ids = n", "ids", "FAIL"),
        ("ranks", "ranks complete", "ranks = 100 and n = 100", "ranks", "FAIL"), ("scores", "not rising", "rises = 0", "rises", "FAIL"), ("scores", "not all equal", "scores > 1", "scores", "FAIL"),
        ("scores", "more than three scores", "scores > 3", "scores", "WARN"), ("scores", "ties by id", "swaps = 0", "swaps", "WARN"), ("ids", "ids exist", "strange = 0", "strange", "FAIL"),
        ("reasoning", "given", "no_reason = 0", "no_reason", "FAIL"), ("reasoning", "all rows", "reasons = n", "reasons", "WARN"), ("reasoning", "varied", "kinds >= least(10, n)", "kinds", "WARN"),
        ("reasoning", "long enough", "coalesce(mean_length >= 50, false)", "round(mean_length, 1)", "WARN"), ("reasoning", "none short", "short = 0", "short", "WARN"), ("reasoning", "top and bottom differ", "top <> last", "len(top)", "WARN"),
    ]
    rows = " union all ".join(f"select cast({i} as bigint) as seq, '{c}' as category, '{n}' as \"check\", case when {ok} then 'PASS' else '{bad}' end as status, cast({m} as varchar) as message from a" for i, (c, n, ok, m, bad) in enumerate(checks, 1))
    return f"""
with f as {final}, t as (select candidate_id as id, case when regexp_full_match(rank, '[1-9][0-9]*') then try_cast(rank as integer) end as rank, try_cast(score as double) as score, trim(coalesce(reasoning, '')) as reasoning from f),
o as (select *, lag(score) over w as pb, lag(id) over w as ib from t where rank between 1 and 100 window w as (order by rank, id)),
a as (select count(*) as n, count(*) filter (not coalesce(regexp_full_match(id, 'CAND_[0-9]{{7}}'), false)) as bad_ids, count(distinct id) as ids, count(*) filter (rank is null) as bad_ranks,
  count(distinct rank) filter (rank between 1 and 100) as ranks, count(*) filter (score is null or not isfinite(score)) as bad_scores, count(distinct score) as scores, count(*) filter ({full}) as reasons,
  count(distinct reasoning) filter ({full}) as kinds, avg(length(reasoning)) filter ({full}) as mean_length, count(*) filter (length(reasoning) < 5 or lower(reasoning) = 'nan') as no_reason, count(*) filter ({full} and length(reasoning) < 15) as short,
  coalesce(list_sort(list(distinct reasoning) filter ({full} and rank <= 10)), []) as top, coalesce(list_sort(list(distinct reasoning) filter ({full} and rank > 90)), []) as last,
  (select count(*) from o where score > pb) as rises, (select count(*) from o where score = pb and id < ib) as swaps, (select count(*) from t where id is null or id not in (select candidate_id from candidates where candidate_id is not null)) as strange from t)
{rows}"""


def _reported(df: DataFrame, spark, root) -> DataFrame:
    return validate.table_report(df, assemble.candidates(spark, root)).withColumn("seq", F.col("seq").cast("bigint"))


@query("va_report", _report_sql(f"(select candidate_id, cast(rank as varchar) as rank, cast(score as varchar) as score, reasoning from {_FINAL})"))
def va_report(spark, root):
    return _reported(_final(spark, root), spark, root)


_BROKEN = {
    "candidate_id": "case when rank = 5 then 'BAD' when rank = 30 then 'CAND_9999999' else candidate_id end", "rank": "case when rank = 3 then '03' when rank = 40 then '39' when rank = 41 then '1e1' else cast(rank as {}) end",
    "score": "case when rank = 20 then '1000' when rank = 60 then 'x' when rank = 61 then null when rank between 70 and 80 then '1' else cast(score as {}) end", "reasoning": "case when rank = 9 then 'nan' when rank = 12 then '' when rank = 13 then 'too short' when rank between 50 and 60 then 'the same sentence for all of them' else reasoning end",
}


@query("va_report_broken", _report_sql(f"(select {', '.join(e.format('varchar') + ' as ' + n for n, e in _BROKEN.items())} from {_FINAL})"))
def va_report_broken(spark, root):
    return _reported(_final(spark, root).select(*[F.expr(e.format("string")).alias(n) for n, e in _BROKEN.items()]), spark, root)


# ---- requirements


def _found_sql(line: str, names: dict[str, str]) -> str:
    edge = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"

    def pattern(k: str) -> str:
        q = k.replace("+", r"\+")
        return rf"(^|[\s,;]){q}($|[\s,;])" if k in ("c++", "c#") else rf"(^|{edge}){q}($|{edge})"

    return "list_filter([" + ", ".join(f"case when contains({line}, '{k}') and regexp_matches({line}, '{pattern(k)}') then '{v}' end" for k, v in names.items()) + "], lambda x: x is not null)"


_JOINED = lambda c: f"array_to_string(list_sort(list_distinct(coalesce({c}, []))), '|')"
_YEARS = ", ".join(f"cast(nullif(regexp_extract(t, '{p}', 1), '') as double)" for p in requirement.YEARS)


@query("jd_parse", f"""
with x as (select * from ({_LINES}) where line <> ''),
m as (select *, case when length(line) < 50 then case when {_has("lower(line)", requirement.PREFERRED_MARKS)} then 2 when {_has("lower(line)", requirement.REQUIRED_MARKS)} then 1 end end as mark from x),
s as (select doc_id, line_no, line, lower(line) as low, coalesce(last_value(mark ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row), 0) as section from m),
g as (select doc_id, flatten(list({_found_sql('low', requirement.SKILLS)}) filter (section <> 2)) as req, flatten(list({_found_sql('low', requirement.SKILLS)}) filter (section = 2)) as pref,
  flatten(list({_found_sql('low', requirement.SOFT_SKILLS)})) as soft, flatten(list({_found_sql('low', requirement.INDUSTRIES)})) as ind, flatten(list({_found_sql('low', requirement.LOCATIONS)})) as loc, string_agg(line, ' ' order by line_no) as t from s group by 1)
select d.doc_id, {_JOINED('req')} as required, {_JOINED('list_filter(pref, lambda x: not list_contains(coalesce(req, []), x))')} as preferred, coalesce({_YEARS}) as min_years,
  case when nullif(regexp_extract(t, '{requirement.YEARS[0]}', 1), '') is not null then cast(nullif(regexp_extract(t, '{requirement.YEARS[0]}', 2), '') as double) end as max_years,
  {_JOINED('loc')} as locations, {_JOINED('ind')} as industries, {_JOINED('soft')} as soft_skills from (select distinct doc_id from documents) d left join g using (doc_id)""")  # fmt: skip
def jd_parse(spark, root):
    p = requirement.parse_requirements(table(spark, root, "documents"), "doc_id", "text")
    joined = lambda c, n: F.array_join(c, "|").alias(n)
    return p.select("doc_id", joined("required_skills", "required"), joined("preferred_skills", "preferred"), "min_years", "max_years", joined("locations", "locations"), joined("industries", "industries"), joined("soft_skills", "soft_skills"))


@query("rt_query_text", "select 'Schema Design SQL Load Testing Leadership mining' as query union all select 'Software Engineer'")
def rt_query_text(spark, root):
    need = requirement.Requirement(required_skills=["Schema Design", "SQL"], preferred_skills=["Load Testing"], soft_skills=["Leadership"], industries=["mining"])
    return spark.createDataFrame([(retrieval.query_text(n),) for n in (need, requirement.Requirement())], "query string")


# ---- pair scores, with a cache that has a third of the texts

_NEED = sorted(set(QUERY.lower().split()))
_OVERLAP = f"ln((len(list_intersect({_NEED}, list_filter(regexp_split_to_array(lower(coalesce(normalized_text, '')), '{SPACE}+'), lambda x: x <> ''))) + 0.5) / {len(_NEED) + 1})"


@query("rr_rerank", f"""
with s as (select candidate_id, case when length(coalesce(normalized_text, '')) % 3 = 0 then length(coalesce(normalized_text, '')) / 1e4 else {_OVERLAP} end as v from {CAND})
select candidate_id, round(v, 9) as score, row_number() over (order by v desc, candidate_id) as place from s order by v desc, candidate_id limit 100""")  # fmt: skip
def rr_rerank(spark, root):
    c = assemble.candidates(spark, root).select("candidate_id", "normalized_text")
    text = F.coalesce("normalized_text", F.lit(""))
    cache = c.where(F.length(text) % 3 == 0).select(F.lit("overlap").alias("model"), F.sha2(F.lit(QUERY), 256).alias("need_digest"), F.sha2(text, 256).alias("text_digest"), (F.length(text) / 1e4).alias("score"))
    best = ranker.rerank(c.select("candidate_id"), c, QUERY, cache, top_k=100)[0]
    return best.select("candidate_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("place"))


# ---- flat records of nested ones


@query("nrm_flat_profile", f"""
with j as (select candidate_id, count(*) as n, array_to_string(list_filter(list({_strip_sql("coalesce(description, '')")} order by entry_no), lambda x: x <> ''), ' | ') as t, list(coalesce(title, '<null>') order by entry_no) as titles from {CAREER} group by 1),
s as (select candidate_id, count(*) as n, array_to_string(list_filter(list({_strip_sql("coalesce(name, '')")} order by skill_no), lambda x: x <> ''), ', ') as t from {SKILL} group by 1),
c as (select *, trim(regexp_replace(coalesce(headline, ''), '{SPACE}+', ' ', 'g')) as hl, trim(regexp_replace(coalesce(summary, ''), '{SPACE}+', ' ', 'g')) as su, trim(regexp_replace(coalesce(anonymized_name, ''), '{SPACE}+', ' ', 'g')) as an from {CAND})
select c.candidate_id, an as anonymized_name, hl as headline, su as summary, md5(array_to_string(list_filter([case when hl <> '' then '[HEADLINE] ' || hl end, case when su <> '' then '[SUMMARY] ' || su end, case when coalesce(j.t, '') <> '' then '[EXPERIENCE] ' || j.t end,
  case when coalesce(s.t, '') <> '' then '[SKILLS] ' || s.t end, '[CERTS] Paper (Board, 2020); Note'], lambda x: x is not null), chr(10) || chr(10))) as document, coalesce(s.n, 0) as skills, coalesce(j.n, 0) as jobs, cast(3 as bigint) as certificates,
  array_to_string(coalesce(j.titles, []), '|') as titles, c.years_of_experience, c.current_title, g.notice_period_days, g.open_to_work_flag from c left join j using (candidate_id) left join s using (candidate_id) left join {SIG} g on g.candidate_id = c.candidate_id""")  # fmt: skip
def nrm_flat_profile(spark, root):
    p = assemble.profiles(spark, root)
    cert = lambda n, i, y: F.struct(F.lit(n).alias("name"), F.lit(i).cast("string").alias("issuer"), F.lit(y).cast("int").alias("year"))
    p = p.withColumn("certifications", F.array(cert("Paper", "Board", 2020), cert(" ", "x", 1), cert("Note", None, 0))).withColumn("languages", F.array().cast("array<struct<language:string>>"))
    f = normalise.flatten(p)
    titles = F.array_join(F.transform(F.from_json("career_titles_json", "array<string>"), lambda x: F.coalesce(x, F.lit("<null>"))), "|")
    n = lambda c, name: F.col(c).cast("bigint").alias(name)
    return f.select("candidate_id", "anonymized_name", "headline", "summary", F.md5("normalized_text").alias("document"), n("num_skills", "skills"), n("num_career_entries", "jobs"), n("num_certifications", "certificates"), titles.alias("titles"), "years_of_experience", "current_title", "notice_period_days", "open_to_work_flag")


# ---- readers and writers, each over what it wrote


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/trip-{uuid.uuid4().hex}"


@query("src_parquet_round_trip", "select c_custkey, c_name, c_acctbal from customer")
def src_parquet_round_trip(spark, root):
    p = f"{_folder(spark)}/deep/x.parquet"
    artifacts.write_parquet(table(spark, root, "customer"), p, rows_per_file=1000)
    return artifacts.read_parquet(spark, p, "c_custkey", "c_name", "c_acctbal")


@query("snk_rows_written", "select (select count(*) from customer) as customers, (select count(*) from orders) as orders")
def snk_rows_written(spark, root):
    p = _folder(spark)
    n = [artifacts.write_parquet(table(spark, root, t), f"{p}/{t}") for t in ("customer", "orders")]
    return spark.createDataFrame([tuple(n)], "customers bigint, orders bigint")


@query("src_csv_round_trip", "select 'CAND_' || lpad(cast(c_custkey as varchar), 7, '0') as candidate_id, cast(c_custkey as integer) as rank, cast(c_acctbal as double) as score, 'says \"' || c_mktsegment || '\", and' || chr(10) || c_name as reasoning from customer")
def src_csv_round_trip(spark, root):
    p = f"{_folder(spark)}/result.csv"
    c = table(spark, root, "customer")
    text = F.concat(F.lit('says "'), "c_mktsegment", F.lit('", and\n'), "c_name")
    artifacts.write_result_csv(c.select(F.concat(F.lit("CAND_"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("candidate_id"), F.col("c_custkey").cast("int").alias("rank"), F.col("c_acctbal").cast("double").alias("score"), text.alias("reasoning")), p)
    return artifacts.read_csv(spark, p)


@query("src_csv_raw", "select cast(n_nationkey as varchar) as candidate_id, '0' || n_regionkey as rank, n_name as score, 'ok' as reasoning from nation where n_nationkey % 5 <> 0")
def src_csv_raw(spark, root):
    p = f"{_folder(spark)}/raw.csv"
    k = F.col("n_nationkey")
    line = F.when(k % 5 == 0, F.when(k == 0, " , , ,").otherwise(F.concat(k.cast("string"), F.lit(",2,3")))).otherwise(F.concat_ws(",", k.cast("string"), F.concat(F.lit("0"), F.col("n_regionkey").cast("string")), "n_name", F.lit("ok")))
    lines = "\n".join(["candidate_id , rank,score,reasoning", *(r[0] for r in table(spark, root, "nation").select(line.alias("l")).collect())])
    artifacts.write_text(spark, lines + "\n", p)
    return artifacts.read_csv_raw(spark, p)[0]


@query("src_ids", "select json_extract_string(payload, '$.candidate_id') as candidate_id from raw_candidates where json_valid(payload) and not contains(payload, chr(10)) and not contains(payload, chr(13)) and json_type(payload) = 'OBJECT' and json_extract_string(payload, '$.candidate_id') is not null")
def src_ids(spark, root):
    p = f"{_folder(spark)}/lines"
    table(spark, root, "raw_candidates").where(r"not payload rlike '[\r\n]'").select(F.col("payload").alias("value")).write.text(p)
    return artifacts.read_ids(spark, p)


@query("src_cache_round_trip", "select 'm' as model, sha256(text) as digest, cast(length(text) as double) as size from documents where text is not null group by all")
def src_cache_round_trip(spark, root):
    p = f"{_folder(spark)}/vectors.parquet"
    d = table(spark, root, "documents").where("text is not null").select("text").distinct()
    rows = d.select(F.lit("m").alias("model"), F.sha2("text", 256).alias("digest"), F.array(F.length("text").cast("double")).alias("vector"))
    artifacts.append_cache(rows, p)
    return artifacts.read_cache(spark, p, artifacts.VECTOR_CACHE).select("model", "digest", F.col("vector")[0].alias("size"))


@query("src_legacy_scores", "select 'N' || n_nationkey as candidate_id, n_nationkey / 4e0 as score from nation")
def src_legacy_scores(spark, root):
    p = f"{_folder(spark)}/scores.json"
    artifacts.write_text(spark, "{" + ", ".join(f'"N{r[0]}": {r[0] / 4}' for r in table(spark, root, "nation").select("n_nationkey").collect()) + "}", p)
    return artifacts.read_legacy_scores(spark, p)


@query("src_requirement_round_trip", "select 'Schema Design|SQL' as required, 'Go' as preferred, 5e0 as lo, 9e0 as hi union all select '', '', null, null")
def src_requirement_round_trip(spark, root):
    p, out = _folder(spark), []
    for i, need in enumerate((requirement.Requirement(["Schema Design", "SQL"], ["Go"], 5.0, 9.0), requirement.Requirement())):
        artifacts.write_requirement(spark, need, f"{p}/{i}.json")
        got = artifacts.read_requirement(spark, f"{p}/{i}.json")
        out.append(("|".join(got.required_skills), "|".join(got.preferred_skills), got.min_years, got.max_years))
    return spark.createDataFrame(out, "required string, preferred string, lo double, hi double")


@query("adm_line_counts", f"""
select case when payload is null or not regexp_matches(payload, '[^\\s]') then 'blank' when not json_valid(payload) then 'bad_json' when json_type(payload) <> 'OBJECT' then 'no_object' when coalesce(json_extract_string(payload, '$.candidate_id'), '') in ('', '0', 'false') then 'no_id' else 'record' end as kind, count(*) as lines
from raw_candidates group by 1""")  # fmt: skip
def adm_line_counts(spark, root):
    lines = records.parse_lines(table(spark, root, "raw_candidates").select(F.col("payload").alias("value")))
    kind = F.when(F.col("status").isin("blank", "bad_json"), F.col("status")).when(F.array_contains("errors", "record"), "no_object").when(F.array_contains("errors", "candidate_id"), "no_id").otherwise("record")
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("lines"))


@query("adm_load_report", "select count(*) as total, count(*) filter (payload is null or not regexp_matches(payload, '[^\\s]')) as blank, count(*) filter (regexp_matches(payload, '[^\\s]') and not json_valid(payload)) as bad_json from raw_candidates")
def adm_load_report(spark, root):
    r = records.report(records.parse_lines(table(spark, root, "raw_candidates").select(F.col("payload").alias("value"))))
    return spark.createDataFrame([(r.total, r.blank, r.bad_json)], "total bigint, blank bigint, bad_json bigint")
