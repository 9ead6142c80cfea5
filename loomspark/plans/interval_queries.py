"""Queries and SQL of the general data-preparation operators: nested records and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.intervals import employment_periods
from loomspark.operators.nested import CAREER_FIELDS, SKILL_FIELDS, children, flat_tables
from loomspark.session import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return children(table(spark, root, "raw_candidates"))


def _flat(name: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        return flat_tables(table(spark, root, "raw_candidates"))[name]

    return query


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    x = employment_periods(table(spark, root, "career_entries"))
    return x.select("candidate_id", "stretch", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


QUERIES = {"p4_found": p4_found, "p4_career": _flat("career"), "p4_skill": _flat("skill"), "p4_assessment": _flat("assessment"), "p4_salary": _flat("salary"), "p5_found": p5_found}



def _unwrapped(x: str) -> str:
    """SQL: an array or object written as JSON text inside a string counts as itself."""
    return f"case when json_type({x}) = 'VARCHAR' and json_valid({x} ->> '$') then cast({x} ->> '$' as json) else {x} end"


def _array(x: str) -> str:
    return f"case json_type({x}) when 'ARRAY' then cast({x} as json[]) when 'OBJECT' then [{x}] else cast([] as json[]) end"


_CHILDREN = f"""
with r as (select raw_id, cast(payload as json) as j from raw_candidates where json_valid(payload)),
o as (select * from r where json_type(j) = 'OBJECT' and regexp_matches(coalesce(j ->> '$.candidate_id', ''), '[^\\s]')),
b as (select raw_id, {_unwrapped("(j -> '$.career_history')")} as career, {_unwrapped("(j -> '$.skills')")} as skills, {_unwrapped("(j -> '$.redrob_signals')")} as s1, {_unwrapped("(j -> '$.signals')")} as s2 from o),
s as (select *, case when json_type(s1) = 'OBJECT' then s1 else s2 end as sig from b),
c as (select raw_id, 'career' as child, {_array("career")} as a from s union all select raw_id, 'skill', {_array("skills")} from s),
e as (select raw_id, child, i, a[i + 1] as x from c, unnest(range(len(a))) as t(i)),
u as (select raw_id, child, i, {_unwrapped("x")} as x from e),
m as (select raw_id, {_unwrapped("(sig -> '$.skill_assessment_scores')")} as scores, {_unwrapped("(sig -> '$.expected_salary_range_inr_lpa')")} as pay from s where json_type(sig) = 'OBJECT')
"""


def _fields(x: str, names) -> str:
    return ", ".join(f"{x} ->> '$.{n}' as {n}" for n in names)


SQL = {
    "p4_found": _CHILDREN + """
select raw_id, child, cast(i as varchar) as child_key from u where json_type(x) = 'OBJECT' and (child = 'career' or regexp_matches(coalesce(x ->> '$.name', ''), '[^\\s]'))
union all
select raw_id, 'assessment', k from (select raw_id, scores, unnest(json_keys(scores)) as k from m where json_type(scores) = 'OBJECT') where json_type(json_extract(scores, '$."' || k || '"')) <> 'NULL'
union all
select raw_id, 'salary', '0' from m where json_type(pay) = 'OBJECT' and (coalesce(json_type(pay -> '$.min'), 'NULL') <> 'NULL' or coalesce(json_type(pay -> '$.max'), 'NULL') <> 'NULL')
""",
    "p4_career": _CHILDREN + f"select raw_id, cast(i as varchar) as ordinal, {_fields('x', CAREER_FIELDS)} from u where json_type(x) = 'OBJECT' and child = 'career'",
    "p4_skill": _CHILDREN + f"select raw_id, cast(i as varchar) as ordinal, {_fields('x', SKILL_FIELDS)} from u where json_type(x) = 'OBJECT' and child = 'skill' and regexp_matches(coalesce(x ->> '$.name', ''), '[^\\s]')",
    "p4_assessment": _CHILDREN + """
select raw_id, k as ordinal, json_extract_string(scores, '$."' || k || '"') as value from (select raw_id, scores, unnest(json_keys(scores)) as k from m where json_type(scores) = 'OBJECT') where json_type(json_extract(scores, '$."' || k || '"')) <> 'NULL'""",
    "p4_salary": _CHILDREN + f"select * from (select raw_id, '0' as ordinal, {_fields('pay', ('min', 'max'))} from m where json_type(pay) = 'OBJECT') where min is not null or max is not null",
    "p5_found": """
with e as (
  select candidate_id, start_date as a, case when is_current then date '2026-06-21' else end_date end as b from career_entries
), v as (select * from e where candidate_id is not null and b >= a),
w as (select *, max(b) over (partition by candidate_id order by a, b rows between unbounded preceding and 1 preceding) as m from v),
i as (select *, sum(case when m is null or a > m + 1 then 1 else 0 end) over (partition by candidate_id order by a, b) as k from w),
p as (select candidate_id, k, min(a) as a, max(b) as b from i group by 1, 2),
n as (select *, lead(a) over (partition by candidate_id order by a) as nxt from p)
select candidate_id, 'period' as stretch, strftime(a, '%Y-%m-%d') as first_day, strftime(b, '%Y-%m-%d') as last_day from n
union all
select candidate_id, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') from n where nxt is not null
""",
}
