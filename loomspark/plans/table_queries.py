"""Queries over the driver's tables, one or more for each operator of the blueprint, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import coerce
from loomspark.functions.text import SPACE, collapse, contains_any, tokens
from loomspark.operators import checks, copies, features, joins, match, normalise, ranker, ranks, requirement, retrieval, scoring, traps
from loomspark.plans import assemble
from loomspark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

QUERY = "ranking features for retail banking with the support line"
NEED = requirement.Requirement(required_skills=["Schema Design", "Nortelflow", "Data Modelling"], preferred_skills=["Prompt Writing", "Load Testing"], min_years=5.0, max_years=9.0, locations=["Hybrid", "Fanralham"], industries=["insurance", "mining"], soft_skills=["Leadership"])
DAY = "date '2026-06-21'"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _has(c: str, keys: list[str]) -> str:
    """SQL: some keyword is a substring; false for null."""
    return "coalesce(" + " or ".join(f"contains({c}, {_quoted(k)})" for k in keys) + ", false)"


def _list(c: str) -> str:
    return f"list_transform(list_filter(coalesce(try_cast({c} as json)::varchar[], []), lambda x: x is not null), lambda x: lower(x))"


_WS = SPACE + "+"
CAND = "(select * from candidates where candidate_id is not null qualify row_number() over (partition by candidate_id order by ingested_at desc) = 1)"
SIG = "(select * from signals where candidate_id is not null qualify row_number() over (partition by candidate_id order by snapshot_at desc, ingested_at desc) = 1)"
CAREER = "(select * from career_entries qualify row_number() over (partition by candidate_id, entry_no order by ingested_at desc) = 1)"
EDU = "(select distinct * from education_entries)"
SKILL = "(select distinct * from skills where regexp_matches(name, '[^\\t-\\r\\x1c-\\x20\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]'))"


# ---- admission and coercion


@query("adm_status_counts", """
select status, cast(count(*) as bigint) as lines from (
  select case when payload is null or trim(payload) = '' then 'blank' when not json_valid(payload) then 'bad_json' when json_type(payload) <> 'OBJECT' then 'no_object' else 'object' end as status from raw_candidates
) group by 1""")  # fmt: skip
def adm_status_counts(spark, root):
    v = F.try_parse_json("payload")
    status = F.when(F.coalesce(F.trim("payload"), F.lit("")) == "", "blank").when(v.isNull(), "bad_json").when(~F.schema_of_variant(v).startswith("OBJECT"), "no_object").otherwise("object")
    return table(spark, root, "raw_candidates").groupBy(status.alias("status")).agg(F.count("*").alias("lines"))


@query("adm_ingest_report")
def adm_ingest_report(spark, root):
    from loomspark.sources.records import parse_lines

    lines = parse_lines(table(spark, root, "raw_candidates").select(F.col("payload").alias("value")))
    return lines.groupBy("status").agg(F.count("*").alias("lines"), F.sum(F.size("errors")).alias("broken_rules"))


@query("nrm_flatten")
def nrm_flatten(spark, root):
    from loomspark.sources.records import parse_lines

    return normalise.flatten(parse_lines(table(spark, root, "raw_candidates").select(F.col("payload").alias("value"))).where("status = 'ok'"))


@query("adm_json_extract", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def adm_json_extract(spark, root):
    return table(spark, root, "events").select("event_id", coerce.year(F.get_json_object("props", "$.k")).alias("k"))


@query("coe_numeric_lenient", """
select p_partkey, case when regexp_matches(s, '^[0-9]+$') then cast(s as integer) end as brand_no, greatest(coalesce(try_cast(s as integer), 0) - 10, 0) as clamped,
  case when try_cast(n as double) >= 0 then try_cast(n as double) end as years from (select p_partkey, replace(p_brand, 'Brand#', '') as s, case when p_size % 3 = 0 then '-' || p_size else p_size || '.5' end as n from part)""")  # fmt: skip
def coe_numeric_lenient(spark, root):
    s = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))
    n = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("-"), F.col("p_size").cast("string"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    return table(spark, root, "part").select("p_partkey", coerce.year(s).alias("brand_no"), F.greatest(F.coalesce(coerce.year(s), F.lit(0)) - 10, F.lit(0)).alias("clamped"), coerce.non_negative(n).alias("years"))


@query("coe_date_lenient", """
select l_orderkey, l_linenumber, strftime(try_cast(s as date), '%Y-%m-%d') as day from (
  select l_orderkey, l_linenumber, case when l_linenumber = 3 then '' when l_linenumber = 4 then 'null' when l_linenumber = 5 then strftime(l_shipdate, '%Y-19-%d') else strftime(l_shipdate, '%Y-%m-%d') end as s from lineitem)""")  # fmt: skip
def coe_date_lenient(spark, root):
    n = F.col("l_linenumber")
    s = F.when(n == 3, "").when(n == 4, "null").when(n == 5, F.date_format("l_shipdate", "yyyy-'19'-dd")).otherwise(F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00")))
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.date_format(coerce.iso_date(s), "yyyy-MM-dd").alias("day"))


# ---- normalisation


@query("nrm_collapse_ws", f"select doc_id, cast(length(t) as bigint) as chars, md5(t) as digest from (select doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) as t from documents)")
def nrm_collapse_ws(spark, root):
    t = collapse(F.col("text"))
    return table(spark, root, "documents").select("doc_id", F.length(t).cast("bigint").alias("chars"), F.md5(t).alias("digest"))


@query("nrm_section_doc", "select p_partkey, '[HEADLINE] ' || p_name || chr(10) || chr(10) || '[SUMMARY] ' || p_type || case when p_size > 20 then chr(10) || chr(10) || '[SKILLS] ' || p_brand else '' end as doc from part")
def nrm_section_doc(spark, root):
    parts = {"HEADLINE": F.col("p_name"), "SUMMARY": F.col("p_type"), "EXPERIENCE": F.lit(None).cast("string"), "SKILLS": F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise("")}
    return table(spark, root, "part").select("p_partkey", normalise.section_document(parts).alias("doc"))


@query("nrm_nested_counts", f"""
select c.candidate_id, coalesce(j.n, 0) as jobs, coalesce(e.n, 0) as schools, coalesce(s.n, 0) as skills from {CAND} c
left join (select candidate_id, count(*) as n from {CAREER} group by 1) j using (candidate_id) left join (select candidate_id, count(*) as n from {EDU} group by 1) e using (candidate_id)
left join (select candidate_id, count(*) as n from {SKILL} group by 1) s using (candidate_id)""")  # fmt: skip
def nrm_nested_counts(spark, root):
    n = lambda c: F.size(c).cast("bigint")
    return assemble.profiles(spark, root).select("candidate_id", n("career_history").alias("jobs"), n("education").alias("schools"), n("skills").alias("skills"))


# ---- anomaly checks

_HP = f"""
with c as {CAND}, s as {SIG}, j as {CAREER}, e as {EDU}, k as {SKILL},
hp1 as (select candidate_id, 0.30 as p from s where expected_salary_range_inr_lpa.min > expected_salary_range_inr_lpa.max),
hp2 as (select candidate_id, least(count(*) * 0.25, 0.50) as p from j where not coalesce(is_current, false) and start_date > end_date group by 1),
hp3 as (select candidate_id, least(count(*) * 0.15, 0.30) as p from e where start_year <> 0 and end_year <> 0 and start_year > end_year group by 1),
hp4 as (select candidate_id, least(count(*) * 0.10, 0.40) as p from (select *, case when is_current then {DAY} else end_date end as d from j)
  where start_date <= d and abs((year(d) - year(start_date)) * 12 + month(d) - month(start_date) - duration_months) > 3 group by 1),
hp6 as (select candidate_id, 0.20 as p from k where lower(proficiency) in ('expert', 'advanced') and duration_months = 0 group by 1 having count(*) >= 3),
hp7 as (select k.candidate_id, least(count(*) * 0.20, 0.40) as p from k join c using (candidate_id) where k.duration_months > cast(trunc(c.years_of_experience * 12) as integer) + 12 group by 1),
hp8 as (select candidate_id, least(count(*) * 0.35, 0.70) as p from j where year(start_date) < case {" ".join(f"when contains(lower(company), '{k}') then {v}" for k, v in checks.FOUNDED.items())} end group by 1)
"""
_HP_CHECKS = {"hp1": "salary_inversion", "hp2": "job_date_inversion", "hp3": "education_date_inversion", "hp4": "duration_mismatch", "hp6": "expert_zero_duration", "hp7": "skill_exceeds_experience", "hp8": "startup_founding_year"}


def _penalty(name: str):
    def run(spark, root):
        x = assemble.profiles(spark, root).select("candidate_id", getattr(checks, name)(as_of=checks.AS_OF).alias("r"))
        return x.select("candidate_id", F.round("r.penalty", 6).alias("penalty"))

    return run


for _k, _n in _HP_CHECKS.items():
    query(f"hp_{_n}", _HP + f"select c.candidate_id, round(coalesce(cast(p as double), 0.0), 6) as penalty from c left join {_k} using (candidate_id) where c.candidate_id in (select candidate_id from c)")(_penalty(_n))


@query("hp_score_fusion", _HP + """
, t as (select c.candidate_id, list_sum([%s]) as raw, cast(%s as bigint) as n from c %s)
select candidate_id, round(least(cast(raw as double), 1.0), 6) as score, round(1.0 - round(least(cast(raw as double), 1.0), 6), 6) as trust, round(least(cast(raw as double), 1.0), 6) > 0.6 as flagged, n as triggered from t
""" % (", ".join(f"coalesce({k}.p, 0.0)" for k in _HP_CHECKS), " + ".join(f"(case when {k}.p is null then 0 else 1 end)" for k in _HP_CHECKS), " ".join(f"left join {k} on {k}.candidate_id = c.candidate_id" for k in _HP_CHECKS)))  # fmt: skip
def hp_score_fusion(spark, root):
    d = checks.detect(assemble.profiles(spark, root))
    return d.select("candidate_id", F.col("honeypot_score").alias("score"), F.col("trust_score").alias("trust"), F.col("is_honeypot").alias("flagged"), F.col("num_checks_triggered").cast("bigint").alias("triggered"))


@query("hp_rate", _HP + ", t as (select round(least(cast(%s as double), 1.0), 6) > 0.6 as f from c %s) select count(*) filter (f) as flagged, count(*) as records, round(count(*) filter (f) / count(*), 6) as share from t" % (" + ".join(f"coalesce({k}.p, 0.0)" for k in _HP_CHECKS), " ".join(f"left join {k} on {k}.candidate_id = c.candidate_id" for k in _HP_CHECKS)))
def hp_rate(spark, root):
    r = checks.rate(checks.detect(assemble.profiles(spark, root)))
    return r.select("flagged", "records", F.round("share", 6).alias("share"))


# ---- features

_ABOUT = "lower(coalesce(description, '') || ' ' || coalesce(company, '') || ' ' || coalesce(industry, ''))"


@query("fex_ratios", f"""
with j as (select *, {_ABOUT} as a from {CAREER}), c as {CAND},
g as (select j.candidate_id, count(*) as n, sum(coalesce(duration_months, 0)) as m,
  sum(case when contains(lower(title), lower(c.current_title)) and c.current_title <> '' then coalesce(duration_months, 0) else 0 end) as rel,
  count(company) filter (company <> '') - count(distinct company) filter (company <> '') as promo,
  count(*) filter ({_has("a", features.PRODUCT)}) as prod, count(*) filter ({_has("a", features.CONSULTING)}) as cons,
  count(*) filter ({_has("a", features.STARTUP)} or coalesce(contains(company_size, '1-10'), false)) as start from j join c using (candidate_id) group by 1)
select c.candidate_id, coalesce(c.years_of_experience, 0.0) as total_experience, round(coalesce(rel, 0) / 12.0, 6) as relevant_experience, round(coalesce(m / n / 12.0, 0.0), 6) as avg_tenure, cast(coalesce(promo, 0) as bigint) as promotion_count,
  round(coalesce(prod / n, 0.0), 6) as product_ratio, round(coalesce(cons / n, 0.0), 6) as consulting_ratio, round(coalesce(start / n, 0.0), 6) as startup_ratio from c left join g using (candidate_id)""")  # fmt: skip
def fex_ratios(spark, root):
    r = lambda c, a: F.round(c, 6).alias(a)
    return features.extract(assemble.profiles(spark, root)).select("candidate_id", "total_experience", r("relevant_experience", "relevant_experience"), r("avg_tenure", "avg_tenure"), F.col("promotion_count").cast("bigint").alias("promotion_count"), r("product_company_ratio", "product_ratio"), r("consulting_ratio", "consulting_ratio"), r("startup_ratio", "startup_ratio"))


@query("fex_map_stats", f"""
select c.candidate_id, cast(coalesce(cardinality(s.skill_assessment_scores), 0) as bigint) as n, round(list_avg(map_values(s.skill_assessment_scores)), 6) as mean, list_max(map_values(s.skill_assessment_scores)) as top, list_min(map_values(s.skill_assessment_scores)) as low,
  s.expected_salary_range_inr_lpa.min as salary_min, s.expected_salary_range_inr_lpa.max as salary_max, strftime(s.last_active_date, '%Y-%m-%d') as last_active from {CAND} c left join {SIG} s using (candidate_id)""")  # fmt: skip
def fex_map_stats(spark, root):
    s = lambda n: F.col(f"signal_{n}")
    return features.extract(assemble.profiles(spark, root)).select("candidate_id", s("num_skill_assessments").cast("bigint").alias("n"), F.round(s("avg_skill_assessment_score"), 6).alias("mean"), s("max_skill_assessment_score").alias("top"), s("min_skill_assessment_score").alias("low"), s("expected_salary_min").alias("salary_min"), s("expected_salary_max").alias("salary_max"), s("last_active_date").alias("last_active"))


# ---- requirements

_LINES = f"select doc_id, i - 1 as line_no, trim(regexp_replace(l[i], '^{SPACE}+|{SPACE}+$', '', 'g')) as line from (select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]') as l from documents where text is not null), unnest(range(1, len(l) + 1)) as t(i)"


@query("jd_section_state", f"""
with x as (select * from ({_LINES}) where line <> ''),
m as (select *, case when length(line) < 50 then case when {_has("lower(line)", requirement.PREFERRED_MARKS)} then 2 when {_has("lower(line)", requirement.REQUIRED_MARKS)} then 1 end end as mark from x)
select doc_id, cast(line_no as bigint) as line_no, cast(coalesce(last_value(mark ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row), 0) as bigint) as section from m""")  # fmt: skip
def jd_section_state(spark, root):
    x = requirement.section_lines(table(spark, root, "documents"), "doc_id", "text")
    return x.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("section").cast("bigint").alias("section"))


_TAGS = {"retail": "Retail", "banking": "Banking", "gaming": "Gaming", "insurance": "Insurance", "energy tariffs": "Energy", "retail banking": "Banking"}


def _tag_sql(names: dict[str, str]) -> str:
    hits = ", ".join(f"case when regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])') then '{v}' end" for k, v in names.items())
    return f"array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x is not null))), ',')"


@query("jd_dictionary_tags", f"select doc_id, coalesce({_tag_sql(_TAGS)}, '') as tags from documents")
def jd_dictionary_tags(spark, root):
    return table(spark, root, "documents").select("doc_id", F.array_join(F.coalesce(requirement.tags(F.lower("text"), _TAGS), F.array().cast("array<string>")), ",").alias("tags"))


@query("jd_set_difference", f"select doc_id, array_to_string(list_filter(string_split(tags, ','), lambda x: x <> 'Banking' and x <> ''), ',') as tags from (select doc_id, coalesce({_tag_sql(_TAGS)}, '') as tags from documents)")
def jd_set_difference(spark, root):
    x = jd_dictionary_tags(spark, root)
    return x.select("doc_id", F.array_join(F.array_except(F.filter(F.split("tags", ","), lambda t: t != ""), F.array(F.lit("Banking"))), ",").alias("tags"))


@query("jd_regex_cascade", "select doc_id, coalesce(%s) as lo, case when nullif(regexp_extract(text, '%s', 1), '') is not null then cast(nullif(regexp_extract(text, '%s', 2), '') as double) end as hi from documents" % (", ".join(f"cast(nullif(regexp_extract(text, '{p}', 1), '') as double)" for p in requirement.YEARS), requirement.YEARS[0], requirement.YEARS[0]))
def jd_regex_cascade(spark, root):
    y = requirement.years_range(F.col("text"))
    return table(spark, root, "documents").select("doc_id", y["lo"].alias("lo"), y["hi"].alias("hi"))


# ---- match features

_REQ, _PREF = [s.lower() for s in NEED.required_skills], [s.lower() for s in NEED.preferred_skills]
_TERMS = [s.lower() for s in NEED.required_skills + NEED.soft_skills]
_IND = [s.lower() for s in NEED.industries]


def _ratio_sql(wanted: list[str]) -> str:
    return "(" + " + ".join(f"cast(list_contains(sk, '{w}') as integer)" for w in wanted) + f") / {len(wanted)}.0"


_FLAT = f"select *, {_list('skill_names_json')} as sk, array_to_string({_list('career_titles_json')}, ' ') as ti, array_to_string({_list('career_descriptions_json')}, ' ') as de, {_list('certification_names_json')} as ce, lower(coalesce(headline, '')) as hl, lower(coalesce(current_title, '')) as ct, lower(coalesce(location, '')) as lo, lower(coalesce(country, '')) as co, lower(coalesce(preferred_work_mode, '')) as wm, coalesce(willing_to_relocate, false) as mv from {CAND}"


def _matched(spark, root) -> DataFrame:
    c = assemble.candidates(spark, root)
    f = features.extract(assemble.profiles(spark, root))
    a = c.select("candidate_id", F.lit(0.0).alias("honeypot_score"), F.lit(1.0).alias("trust_score"), F.lit(False).alias("is_honeypot"))
    r = c.where("num_skills > 8").select("candidate_id", F.lit(1.5).alias("bm25_score"), F.lit(0.5).alias("dense_score"), F.lit(0.03).alias("rrf_score"), F.lit(7).alias("combined_rank"))
    return match.match_features(c, f, a, r, NEED)


@query("jf_skill_ratios", f"select candidate_id, round({_ratio_sql(_REQ)}, 6) as required, round({_ratio_sql(_PREF)}, 6) as preferred, round(0.7 * ({_ratio_sql(_REQ)}) + 0.3 * ({_ratio_sql(_PREF)}), 6) as skills from ({_FLAT})")
def jf_skill_ratios(spark, root):
    m = _matched(spark, root)
    return m.select("candidate_id", F.round("feat_required_skills_match_ratio", 6).alias("required"), F.round("feat_preferred_skills_match_ratio", 6).alias("preferred"), F.round("feat_skills_match_score", 6).alias("skills"))


@query("jf_range_score", f"select candidate_id, round(((case when y >= 5 then 1.0 else greatest(0.0, 1.0 - (5 - y) * 0.5) end) + (case when y <= 9 then 1.0 else greatest(0.0, 1.0 - (y - 9) * 0.5) end)) / 2.0, 6) as score from (select candidate_id, coalesce(years_of_experience, 0.0) as y from {CAND})")
def jf_range_score(spark, root):
    return _matched(spark, root).select("candidate_id", F.round("feat_experience_match_score", 6).alias("score"))


def _word_sql(c: str) -> str:
    return f"len(list_intersect(regexp_split_to_array({c}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), {match.LEARNING_WORDS})) > 0"


@query("jf_role_flags", f"select candidate_id, cast(({_has('hl', match.TECHNICAL)} or {_has('ct', match.TECHNICAL)}) and not ({_has('hl', match.OTHER_ROLES)} or {_has('ct', match.OTHER_ROLES)}) as double) as technical, cast({_has('hl', match.LEARNING_PHRASES)} or {_has('ct', match.LEARNING_PHRASES)} or {_word_sql('hl')} or {_word_sql('ct')} as double) as learning from ({_FLAT})")
def jf_role_flags(spark, root):
    return _matched(spark, root).select("candidate_id", F.col("feat_is_technical_role").alias("technical"), F.col("feat_is_ai_ml_role").alias("learning"))


@query("jf_when_chain", f"""
select candidate_id, case when contains(lo, 'hybrid') or contains(lo, 'fanralham') then 1.0 when mv then 0.8 when contains(wm, 'hybrid') then 0.6 else 0.0 end as place,
  case when {_has("lower(coalesce(current_industry, ''))", _IND)} then 1.0 when {_has('de', _IND)} then 0.7 else 0.0 end as domain,
  round(({' + '.join(f"cast(contains(de, '{t}') or contains(ti, '{t}') as integer)" for t in _TERMS)}) / {len(_TERMS)}.0, 6) as duties,
  case when len(ce) = 0 then 0.0 when {_has("array_to_string(ce, ' ')", _REQ)} then 1.0 else 0.2 end as certificates from ({_FLAT})""")  # fmt: skip
def jf_when_chain(spark, root):
    m = _matched(spark, root)
    return m.select("candidate_id", F.col("feat_location_match_score").alias("place"), F.col("feat_domain_match_score").alias("domain"), F.round("feat_responsibility_match_score", 6).alias("duties"), F.col("feat_certification_match_score").alias("certificates"))


@query("jf_left_defaults", f"select candidate_id, case when num_skills > 8 then 1.0 else 0.0 end as retrieved, case when num_skills > 8 then 0.5 else 0.0 end as dense, cast(case when num_skills > 8 then 7 else 999999 end as bigint) as place from {CAND}")
def jf_left_defaults(spark, root):
    return _matched(spark, root).select("candidate_id", F.col("feat_retrieved").alias("retrieved"), F.col("feat_dense_score").alias("dense"), F.col("feat_combined_rank").cast("bigint").alias("place"))


@query("jf_filter_flagged", f"select count(*) as n from {CAND} where coalesce(num_skills, 0) % 2 = 0")
def jf_filter_flagged(spark, root):
    c = assemble.candidates(spark, root)
    a = c.select("candidate_id", F.lit(0.0).alias("honeypot_score"), F.lit(1.0).alias("trust_score"), (F.coalesce("num_skills", F.lit(0)) % 2 == 1).alias("is_honeypot"))
    r = c.limit(0).select("candidate_id", F.lit(1.5).alias("bm25_score"), F.lit(0.5).alias("dense_score"), F.lit(0.03).alias("rrf_score"), F.lit(7).alias("combined_rank"))
    return match.match_features(c, c.select("candidate_id"), a, r, NEED, filter_flagged=True).agg(F.count("*").alias("n"))


# ---- traps


def _share_sql(arr: str, keys: list[str]) -> str:
    return f"case when len({arr}) = 0 then 0.0 else len(list_filter({arr}, lambda x: {_has('x', keys)})) / len({arr}) end"


def _any_sql(arr: str, keys: list[str]) -> str:
    return f"len(list_filter({arr}, lambda x: {_has('x', keys)})) > 0"


def _trapped(spark, root) -> DataFrame:
    return traps.detect_traps(assemble.candidates(spark, root), features.extract(assemble.profiles(spark, root)))


_TRAPS = f"""
with s as {SIG}, f as (select candidate_id, coalesce(sum(coalesce(duration_months, 0)) / count(*) / 12.0, 0.0) as avg_tenure from {CAREER} group by 1),
x as (select c.*, {_list('c.skill_names_json')} as sk, {_list('c.career_titles_json')} as ti, {_list('c.career_companies_json')} as fi, lower(coalesce(c.current_title, '')) as ct, lower(coalesce(c.summary, '')) as su,
  s.github_activity_score as gh, s.last_active_date as la, s.recruiter_response_rate as rr, s.connection_count as cc, s.applications_submitted_30d as ap, s.profile_views_received_30d as vw, coalesce(f.avg_tenure, 0.0) as avg_tenure
  from {CAND} c left join s using (candidate_id) left join f using (candidate_id)),
t as (select *, case when ct <> '' then list_append(ti, ct) else ti end as all_ti from x)
"""


@query("tr_share_keywords", _TRAPS + f"select candidate_id, round({_share_sql('fi', traps.CONSULTANCIES)}, 6) as consulting, round({_share_sql('all_ti', traps.RESEARCH)}, 6) as research from t")
def tr_share_keywords(spark, root):
    return _trapped(spark, root).select("candidate_id", F.round("trap_consulting_only", 6).alias("consulting"), F.round("trap_research_only", 6).alias("research"))


@query("tr_tiers", _TRAPS + f"""
select candidate_id, case when not {_has('ct', traps.ARCHITECTS)} then 0.0 when gh <= 0 then 1.0 when gh < 20 then 0.7 else 0.2 end as architect,
  case when num_career_entries >= 3 then case when avg_tenure <= 1.0 then 1.0 when avg_tenure <= 1.5 then 0.7 when avg_tenure <= 1.8 then 0.3 else 0.0 end else 0.0 end as hopper,
  case when num_skills > 35 then 1.0 when num_skills > 25 then 0.7 when num_skills > 15 then 0.3 else 0.0 end as stuffer,
  case when not ({_has('ct', traps.MARKETING)} or {_has("array_to_string(ti, ' ')", traps.MARKETING)}) then 0.0 when {_has('su', traps.BUZZWORDS)} then 1.0 else 0.3 end as marketing from t""")  # fmt: skip
def tr_tiers(spark, root):
    t = _trapped(spark, root)
    return t.select("candidate_id", F.col("trap_architect_no_code").alias("architect"), F.col("trap_job_hopper").alias("hopper"), F.col("trap_keyword_stuffer").alias("stuffer"), F.col("trap_marketing_summary").alias("marketing"))


@query("tr_inactivity", _TRAPS + f"""
select candidate_id, case when d > 180 or rr < 0.1 then 1.0 when d > 90 or rr < 0.3 then 0.7 when d > 30 then 0.3 else 0.0 end as inactive,
  case when profile_completeness_score < 40 and cc = 0 and ap = 0 and vw = 0 then 1.0 when profile_completeness_score < 60 and cc <= 1 and ap = 0 then 0.6 else 0.0 end as cv_only from (select *, coalesce(date_diff('day', la, {DAY}), 0) as d from t)""")  # fmt: skip
def tr_inactivity(spark, root):
    return _trapped(spark, root).select("candidate_id", F.col("trap_inactive_candidate").alias("inactive"), F.col("trap_cv_only").alias("cv_only"))


@query("tr_exclusive_focus", _TRAPS + f"""
select candidate_id, case when not {_any_sql('sk', traps.WRAPPERS)} then 0.0 when len(list_intersect(sk, {traps.GROUNDWORK})) > 0 then 0.3 else 1.0 end as wrappers,
  case when not {_any_sql('sk', traps.ROBOTICS)} then 0.0 when {_any_sql('sk', traps.LANGUAGE)} then 0.4 else 1.0 end as robotics,
  case when not {_any_sql('sk', traps.SPEECH)} then 0.0 when {_any_sql('sk', traps.LANGUAGE)} then 0.4 else 1.0 end as speech from t""")  # fmt: skip
def tr_exclusive_focus(spark, root):
    t = _trapped(spark, root)
    return t.select("candidate_id", F.col("trap_langchain_only").alias("wrappers"), F.col("trap_robotics_only").alias("robotics"), F.col("trap_speech_only").alias("speech"))


# ---- copies

_STRENGTH = f"""
select c.candidate_id, 0.20 * cast(coalesce(c.open_to_work_flag, false) as double) + 0.20 * s.recruiter_response_rate + 0.15 * greatest(0.0, 1.0 - coalesce(date_diff('day', s.last_active_date, {DAY}), 180) / 180.0) + 0.15 * s.interview_completion_rate
  + 0.10 * case when s.offer_acceptance_rate < 0 then 0.0 else s.offer_acceptance_rate end + 0.10 * case when s.profile_views_received_30d is not null then least(s.profile_views_received_30d / 50.0, 1.0) end + 0.10 * case when s.saved_by_recruiters_30d is not null then least(s.saved_by_recruiters_30d / 10.0, 1.0) end as v,
  {" || '|' || ".join(f"lower(regexp_replace(coalesce(c.{x}, ''), '^{SPACE}+|{SPACE}+$', '', 'g'))" for x in ("anonymized_name", "headline", "summary", "skill_names_json"))} as k
from {CAND} c left join {SIG} s using (candidate_id)"""


@query("tw_strength", f"select candidate_id, round(v, 6) as strength from ({_STRENGTH})")
def tw_strength(spark, root):
    return copies.resolve(assemble.candidates(spark, root), features.extract(assemble.profiles(spark, root))).select("candidate_id", F.round("behavioral_strength", 6).alias("strength"))


@query("tw_resolution", f"""
with x as ({_STRENGTH}), g as (select *, count(*) over (partition by k) as n, max(v) over (partition by k) as m from x)
select candidate_id, n > 1 as is_twin, round(case when n = 1 then 1.0 when v = case when m <= 0 then 1e-9 else m end then 1.0 else 0.5 * v / case when m <= 0 then 1e-9 else m end end, 6) as twin_score from g""")  # fmt: skip
def tw_resolution(spark, root):
    return copies.resolve(assemble.candidates(spark, root), features.extract(assemble.profiles(spark, root))).select("candidate_id", "is_twin", F.round("twin_score", 6).alias("twin_score"))


# ---- joins, aggregates, windows, order, sets


@query("jn_inner", "select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey")
def jn_inner(spark, root):
    o, c = table(spark, root, "orders"), table(spark, root, "customer")
    return joins.join_suffixed(o.select(F.col("o_custkey").alias("key"), "o_orderkey"), c.select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment"), "key", "_c").select("o_orderkey", "c_name", "c_mktsegment")


@query("jn_left", "select c_custkey, coalesce(n, 0) as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def jn_left(spark, root):
    n = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return joins.lookup(table(spark, root, "customer").select("c_custkey"), n, "c_custkey", "orders", 0)


@query("jn_star_first_wins", "select c_custkey as k, c_name as name, n_name as nation, r_name as region from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def jn_star_first_wins(spark, root):
    c = table(spark, root, "customer").select(F.col("c_nationkey").alias("nk"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    n = table(spark, root, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("name"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("rk"))
    r = table(spark, root, "region").select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("region"), F.col("r_name").alias("name"))
    return joins.join_first_wins([joins.join_first_wins([c, n], "nk"), r], "rk").select("k", "name", "nation", "region")


@query("jn_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def jn_semi(spark, root):
    return joins.keep_known(table(spark, root, "customer").select("c_custkey"), table(spark, root, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("jn_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
def jn_anti(spark, root):
    return joins.unknown(table(spark, root, "customer").select("c_custkey"), table(spark, root, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("ag_quantiles", "select o_orderstatus, round(quantile_cont(o_totalprice, 0.2), 6) as q20, round(quantile_cont(o_totalprice, 0.4), 6) as q40, round(quantile_cont(o_totalprice, 0.6), 6) as q60, round(quantile_cont(o_totalprice, 0.85), 6) as q85 from orders group by 1")
def ag_quantiles(spark, root):
    q = ranks.quantiles(table(spark, root, "orders"), "o_orderstatus", "o_totalprice", ranker.QUANTILES)
    return q.select("o_orderstatus", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q20", "q40", "q60", "q85"))])


@query("ag_counts", "select l_returnflag, count(*) as n, count(distinct l_suppkey) as suppliers, round(avg(l_quantity), 6) as mean, count(*) filter (l_discount > 0.05) as cheap from lineitem group by 1")
def ag_counts(spark, root):
    return table(spark, root, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"))


@query("wn_rank_first", "select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders")
def wn_rank_first(spark, root):
    return retrieval.rank_by(table(spark, root, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "place").select("o_orderkey", F.col("place").cast("bigint").alias("place"))


@query("wn_lag_monotone", "select o_custkey, count(*) filter (o_totalprice > p) as rises from (select *, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as p from orders) group by 1")
def wn_lag_monotone(spark, root):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, root, "orders").withColumn("p", F.lag("o_totalprice").over(w)).groupBy("o_custkey").agg(F.count_if(F.col("o_totalprice") > F.col("p")).alias("rises"))


@query("st_topk_multikey", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_discount desc, l_orderkey, l_linenumber limit 500")
def st_topk_multikey(spark, root):
    return table(spark, root, "lineitem").orderBy(F.desc("l_extendedprice"), F.desc("l_discount"), "l_orderkey", "l_linenumber").limit(500).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("st_slice_first", f"select candidate_id, array_to_string(list_slice(list_filter({_list('skill_names_json')}, lambda x: x <> ''), 1, 3), ', ') as shown from {CAND}")
def st_slice_first(spark, root):
    a = F.slice(F.filter(F.transform(match.json_array(F.col("skill_names_json")), F.lower), lambda x: x != ""), 1, 3)
    return assemble.candidates(spark, root).select("candidate_id", F.array_join(a, ", ").alias("shown"))


@query("so_union_all", "select 'c' as side, c_nationkey as k from customer union all select 's', s_nationkey from supplier")
def so_union_all(spark, root):
    return table(spark, root, "customer").select(F.lit("c").alias("side"), F.col("c_nationkey").alias("k")).unionAll(table(spark, root, "supplier").select(F.lit("s"), "s_nationkey"))


@query("so_except", "select c_nationkey as k from customer except select s_nationkey from supplier where s_acctbal > 7000")
def so_except(spark, root):
    return table(spark, root, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, root, "supplier").where("s_acctbal > 7000").select("s_nationkey"))


@query("so_intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
def so_intersect(spark, root):
    return table(spark, root, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, root, "supplier").select("s_nationkey"))


# ---- retrieval

_WORDS = QUERY.lower().split()
_BM25 = f"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(lower(text), ''), '{_WS}'), lambda x: x <> '') as t from documents),
n as (select count(*) as n, avg(len(t)) as al from d), p as (select doc_id, len(t) as l, u.x as term from d, unnest(t) as u(x)),
df as (select term, count(distinct doc_id) as df from p group by 1), raw as (select term, ln(n.n - df + 0.5) - ln(df + 0.5) as idf from df, n), mi as (select avg(idf) as m from raw),
w as (select term, case when idf < 0 then 0.25 * m else idf end as idf from raw, mi where term in ({", ".join(map(_quoted, sorted(set(_WORDS))))})),
f as (select doc_id, l, term, count(*) as f from p where term in (select term from w) group by 1, 2, 3),
q as (select unnest({_WORDS}) as term), m as (select term, count(*) as m from q group by 1),
s as (select doc_id, sum(m.m * w.idf * f.f * 2.5 / (f.f + 1.5 * (0.25 + 0.75 * f.l / n.al))) as s from f join w using (term) join m using (term), n group by 1),
bm as (select d.doc_id, coalesce(s.s, 0.0) as bm25_score from d left join s using (doc_id))
"""


@query("rt_bm25", _BM25 + "select doc_id, round(bm25_score, 6) as score from bm")
def rt_bm25(spark, root):
    return retrieval.bm25(table(spark, root, "documents"), "doc_id", "text", QUERY).select("doc_id", F.round("bm25_score", 6).alias("score"))


@query("rt_bm25_topk", _BM25 + "select doc_id, round(bm25_score, 6) as score from bm order by round(bm25_score, 6) desc, doc_id limit 20")
def rt_bm25_topk(spark, root):
    return rt_bm25(spark, root).orderBy(F.desc("score"), "doc_id").limit(20)


@query("rt_tokens", f"select doc_id, cast(len(t) as bigint) as tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, list_filter(regexp_split_to_array(coalesce(lower(text), ''), '{_WS}'), lambda x: x <> '') as t from documents)")
def rt_tokens(spark, root):
    t = tokens(F.col("text"))
    return table(spark, root, "documents").select("doc_id", F.size(t).cast("bigint").alias("tokens"), F.md5(F.array_join(t, " ")).alias("digest"))


_PROBE = [round(((i * 37) % 19 - 9) / 10.0, 1) for i in range(64)]
_COS = f"select vec_id, list_dot_product(embedding::double[], {_PROBE}::double[]) / ((sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-9) * (sqrt(list_dot_product({_PROBE}::double[], {_PROBE}::double[])) + 1e-9)) as c from embeddings"


@query("rt_cosine", f"select vec_id, round(c, 6) as score from ({_COS})")
def rt_cosine(spark, root):
    return table(spark, root, "embeddings").select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.lit(_PROBE)), 6).alias("score"))


_HYBRID = _BM25 + f""", e as (select bm.doc_id, round(bm25_score, 9) as bs, round(coalesce(c, 0.0), 9) as ds from bm left join ({_COS}) v on v.vec_id = bm.doc_id),
r as (select *, row_number() over (order by bs desc, doc_id) as br, row_number() over (order by ds desc, doc_id) as dr from e), x as (select *, 1.0 / (60 + br) + 1.0 / (60 + dr) as rrf from r)
"""


def _hybrid_docs(spark, root) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "text").join(table(spark, root, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


def _rounded(spark, root) -> DataFrame:
    d = _hybrid_docs(spark, root)
    b = retrieval.bm25(d, "doc_id", "text", QUERY).select("doc_id", F.round("bm25_score", 9).alias("bs"))
    return b.join(d.select("doc_id", F.round(F.coalesce(retrieval.cosine(F.col("embedding"), F.lit(_PROBE)), F.lit(0.0)), 9).alias("ds")), "doc_id")


@query("rt_rrf", _HYBRID + "select doc_id, br as bm25_place, dr as dense_place, round(rrf, 9) as rrf from x")
def rt_rrf(spark, root):
    x = retrieval.rank_by(retrieval.rank_by(_rounded(spark, root), "bs", "doc_id", "br"), "ds", "doc_id", "dr")
    return x.select("doc_id", F.col("br").cast("bigint").alias("bm25_place"), F.col("dr").cast("bigint").alias("dense_place"), F.round(retrieval.fuse_ranks(F.col("br"), F.col("dr")), 9).alias("rrf"))


@query("rt_hybrid_topk", _HYBRID + "select doc_id, row_number() over (order by rrf desc, ds desc, doc_id) as place, round(rrf, 9) as rrf from x order by rrf desc, ds desc, doc_id limit 50")
def rt_hybrid_topk(spark, root):
    h = retrieval.hybrid(_hybrid_docs(spark, root), "doc_id", "text", "embedding", QUERY, _PROBE, top_n=50)
    return h.select("doc_id", F.col("combined_rank").cast("bigint").alias("place"), F.round("rrf_score", 9).alias("rrf"))


# ---- ranking, scores, validation


def _judged(spark, root) -> DataFrame:
    m = _matched(spark, root)
    c = assemble.candidates(spark, root).select("candidate_id", "years_of_experience", "notice_period_days", "headline", "current_title", "skill_names_json", "open_to_work_flag")
    return joins.join_first_wins([m, c, _trapped(spark, root)], "candidate_id").withColumn("behavioral_strength", F.lit(0.5)).withColumn("twin_score", F.lit(1.0))


@query("ml_persona_utility", f"""
with m as (select candidate_id, 0.7 * ({_ratio_sql(_REQ)}) + 0.3 * ({_ratio_sql(_PREF)}) as sk, coalesce(years_of_experience, 0.0) as y from ({_FLAT})),
p as (select * from (values (0, 3.0, 2.0), (1, 5.0, 1.0), (2, 1.5, 4.5), (3, 2.0, 1.5), (4, 3.0, 2.0)) as t(persona, ws, we))
select candidate_id, cast(persona as bigint) as persona, round(ws * sk + we * ((case when y >= 5 then 1.0 else greatest(0.0, 1.0 - (5 - y) * 0.5) end) + (case when y <= 9 then 1.0 else greatest(0.0, 1.0 - (y - 9) * 0.5) end)) / 2.0
  - case when y < 5 then (5 - y) * 4 when y > 9 then (y - 9) * 3 else 0 end, 6) + 0.0 as utility from m, p""")  # fmt: skip
def ml_persona_utility(spark, root):
    d = _judged(spark, root).select("candidate_id", "years_of_experience", "feat_skills_match_score", "feat_experience_match_score")
    return ranker.persona_utilities(d).select("candidate_id", F.col("persona").cast("bigint").alias("persona"), (F.round("utility", 6) + 0.0).alias("utility"))


@query("ml_relevance_bins", """
with q as (select o_orderstatus as g, quantile_cont(o_totalprice, 0.2) as a, quantile_cont(o_totalprice, 0.4) as b, quantile_cont(o_totalprice, 0.6) as c, quantile_cont(o_totalprice, 0.85) as d from orders group by 1)
select o_orderkey, cast(case when o_totalprice <= a then 0 when o_totalprice <= b then 1 when o_totalprice <= c then 2 when o_totalprice <= d then 3 else 4 end as bigint) as relevance from orders join q on g = o_orderstatus""")  # fmt: skip
def ml_relevance_bins(spark, root):
    o = table(spark, root, "orders").select("o_orderkey", F.col("o_orderstatus").alias("persona"), F.col("o_totalprice").alias("utility"))
    return ranker.relevance(o).select("o_orderkey", F.col("relevance").cast("bigint").alias("relevance"))


@query("ml_lambdamart")
def ml_lambdamart(spark, root):
    d = _judged(spark, root)
    return ranker.rank(d, ranker.train(d))


@query("rt_encode")
def rt_encode(spark, root):
    from loomspark.sources.artifacts import VECTOR_CACHE

    d, _ = retrieval.encode_missing(table(spark, root, "documents").select("doc_id", "text"), "text", spark.createDataFrame([], VECTOR_CACHE), "hashed-64")
    return d.select("doc_id", "digest", "vector")


_SCORED = f"select candidate_id, years_of_experience as y, notice_period_days as nd from {CAND}"


@query("fs_adjusted_score", f"select candidate_id, round(10.0 - (case when coalesce(y, 0.0) < 5 then (5 - coalesce(y, 0.0)) * 10 when y > 9 then (y - 9) * 8 else 0.0 end) - (case when nd > 30 then (nd - 30) * 0.1 else 0.0 end), 6) + 0.0 as score from ({_SCORED})")
def fs_adjusted_score(spark, root):
    d = assemble.candidates(spark, root).select("candidate_id", "years_of_experience", "notice_period_days", F.lit(10.0).alias("score"))
    return d.select("candidate_id", (F.round(scoring.adjusted_score(d), 6) + 0.0).alias("score"))


@query("fs_minmax", "select o_orderkey, round((o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()) * 100.0, 4) as score from orders")
def fs_minmax(spark, root):
    return scoring.min_max(table(spark, root, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "score")


@query("st_stream_ingest")
def st_stream_ingest(spark, root):
    import uuid

    from loomspark.session import shared_dir
    from loomspark.streaming import ingest

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    table(spark, root, "raw_candidates").select(F.regexp_replace("payload", r"[\r\n]+", " ").alias("value")).write.text(f"{base}/in")
    ingest.run(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    return ingest.counts(spark, f"{base}/out")


@query("src_contains_any", "select p_partkey, contains(p_name, 'ring') or contains(p_name, 'bolt') as hit from part")
def src_contains_any(spark, root):
    return table(spark, root, "part").select("p_partkey", contains_any(F.col("p_name"), ["ring", "bolt"]).alias("hit"))
