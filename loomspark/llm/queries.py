"""Queries and SQL of the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import canonical, leakage, names, near, spans, tokenize, twins
from loomspark.session import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return twins.best_members(*(table(spark, root, t) for t in ("candidates", "twin_features", "signals")))


def p1_fused(spark: SparkSession, root: str) -> DataFrame:
    return twins.fused_values(*(table(spark, root, t) for t in ("candidates", "twin_features", "signals")))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return near.candidate_pairs(table(spark, root, "candidates"))


def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    return near.candidate_classes(table(spark, root, "candidates")).select(F.col("id").alias("candidate_id"), "class_id", "links")


def _names(spark: SparkSession, root: str) -> DataFrame:
    return names.pool(table(spark, root, "career_entries"), table(spark, root, "candidates"), table(spark, root, "education_entries"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return names.name_pairs(_names(spark, root))


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    return names.organisation_classes(_names(spark, root))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return canonical.mapped(*(table(spark, root, t) for t in ("candidates", "skills", "ref_titles", "ref_skills")))


def p6_misses(spark: SparkSession, root: str) -> DataFrame:
    return p6_found(spark, root).where("ref_id = 0").groupBy("field_name").agg(F.count("*").alias("values"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, root, "documents"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_near(spark: SparkSession, root: str) -> DataFrame:
    m = leakage.near_passages(table(spark, root, "documents"), table(spark, root, "eval_items"))
    return m.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.round("share", 6).alias("share"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_spans(table(spark, root, "documents"))


def p9_share(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_share(table(spark, root, "documents"))


def p9_passages(spark: SparkSession, root: str) -> DataFrame:
    return spans.passages(table(spark, root, "documents"))


def p9_fuzzy(spark: SparkSession, root: str) -> DataFrame:
    return spans.fuzzy_passages(table(spark, root, "documents"))


QUERIES = {"p1_found": p1_found, "p1_fused": p1_fused, "p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_classes": p3_classes, "p6_found": p6_found, "p6_misses": p6_misses, "p7_ids": p7_ids, "p8_found": p8_found, "p8_items": p8_items, "p8_near": p8_near, "p9_found": p9_found, "p9_share": p9_share, "p9_passages": p9_passages, "p9_fuzzy": p9_fuzzy}

_SPACE = r"[\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NORM = " || chr(1) || ".join(f"coalesce(trim(regexp_replace(lower({c}), '{_SPACE}', ' ', 'g')), '')" for c in ("anonymized_name", "headline", "summary", "skill_names_json"))
_RUNS = """
with tok as (
  select doc_id, i, w[i] as term from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from documents where text is not null), unnest(range(1, len(w) + 1)) as t(i)
), it as (
  select item_id, i, w[i] as term from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from eval_items where text is not null), unnest(range(1, len(w) + 1)) as t(i)
), hit as (select distinct doc_id, item_id, tok.i - it.i as shift, it.i as q from tok join it using (term)),
isl as (select *, q - row_number() over (partition by doc_id, item_id, shift order by q) as k from hit),
run as (select doc_id, item_id, shift, k, count(*) as n from isl group by 1, 2, 3, 4 having count(*) >= 13)
"""

_SPANS = """
with d as (select distinct doc_id, text from documents where doc_id is not null and length(text) >= 300),
w as (select doc_id, i, substr(text, i + 1, 300) as s from d, unnest(range(0, length(text) - 299)) as t(i)),
g as (select s from w group by s having min(doc_id) <> max(doc_id)),
h as (select doc_id, i from w join g using (s)),
n as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 300 then 0 else 1 end as nw from h),
k as (select *, sum(nw) over (partition by doc_id order by i) as k from n),
sp as (select doc_id, min(i) as span_start, max(i) + 300 as span_end from k group by doc_id, k)
"""

SQL = {
    "p9_found": _SPANS + "select * from sp",
    "p9_share": _SPANS + """
, x as (select doc_id, cast(sum(span_end - span_start) as bigint) as n from sp group by 1)
select d.doc_id, coalesce(x.n, 0) as shared_chars, d.chars, case when d.chars > 0 then round(coalesce(x.n, 0) / d.chars, 6) else 0.0 end as share
from (select doc_id, max(coalesce(length(text), 0)) as chars from documents where doc_id is not null group by 1) d left join x on x.doc_id = d.doc_id
""",
    "p2_found": """
with recursive f as (
  select distinct candidate_id as id, list_filter(regexp_split_to_array(lower(concat_ws(' ', coalesce(anonymized_name, ''), coalesce(headline, ''), coalesce(summary, ''),
    array_to_string(list_filter(coalesce(try_cast(skill_names_json as json)::varchar[], []), lambda x: x is not null), ' '))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w
  from candidates where candidate_id is not null
), n as (select id, len(w) as n from f),
t as (select id, x as word, count(*) as k from f, unnest(w) as u(x) group by 1, 2),
p as (select a.id as a, b.id as b, sum(least(a.k, b.k)) as c from t a join t b on a.word = b.word and a.id <> b.id group by 1, 2),
e as (select a, b from p join n na on na.id = a join n nb on nb.id = b where c >= 0.7 * (na.n + nb.n - c) - 1e-9),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b)
select distinct a as candidate_a, b as candidate_b from r where a < b
""",
    "p1_found": f"""
with m as (select distinct candidate_id as id, {_NORM} as k from candidates where candidate_id is not null),
g as (select k, min(id) as g from m group by k having count(*) > 1),
mem as (select g, id from m join g using (k)),
s as (select candidate_id as id, max(behavioral_strength) as v from twin_features where behavioral_strength between 0 and 1 group by 1),
c as (select candidate_id as id, arg_max(profile_completeness_score, (snapshot_at, profile_completeness_score)) as v from signals where profile_completeness_score between 0 and 100 group by 1),
d as (select candidate_id as id, arg_max(last_active_date, (snapshot_at, last_active_date)) as v from signals where last_active_date <= date '2026-06-21' group by 1),
rs as (select g, id, row_number() over (partition by g order by v desc, id) as r from mem join s using (id)),
rc as (select g, id, row_number() over (partition by g order by v desc, id) as r from mem join c using (id)),
rd as (select g, id, row_number() over (partition by g order by v desc, id) as r from mem join d using (id))
select g.g as group_id, coalesce(rs.id, '') as strength_from, coalesce(rc.id, '') as completeness_from, coalesce(rd.id, '') as active_from
from g left join rs on rs.g = g.g and rs.r = 1 left join rc on rc.g = g.g and rc.r = 1 left join rd on rd.g = g.g and rd.r = 1
""",
    "p8_found": _RUNS + "select distinct doc_id, item_id from run",
    "p8_items": _RUNS + "select item_id, count(distinct doc_id) as documents, max(n) as longest_run from run group by 1",
}
