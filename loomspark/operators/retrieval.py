"""Hybrid retrieval (RT1-8): BM25 over postings, cosine over stored vectors, reciprocal rank fusion.

BM25 counts lengths and document frequencies over all documents; postings of terms the query lacks never leave the
aggregation. The two rank lists are numbered by a total order over range partitions, exactly for every document; ``depth``
limits each list by a distributed top-k instead.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from loomspark.functions.text import tokens
from loomspark.operators.ranks import numbered
from loomspark.operators.requirement import Requirement
from loomspark.session import materialise

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
VECTOR_SIZE = 64
FALLBACK_QUERY = "Software Engineer"


def query_text(need: Requirement) -> str:
    """RT1."""
    return " ".join([*need.required_skills, *need.preferred_skills, *need.soft_skills, *need.industries]).strip() or FALLBACK_QUERY


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """RT3: (key, bm25_score) of every document; documents without query terms, and empty ones, score 0.

    A term's idf below 0 becomes ``epsilon`` times the mean idf of all terms. Query terms count with multiplicity. The
    corpus statistics are one row; document frequencies of query terms are joined by size, not by hint.
    """
    wanted = Counter(t for t in query.lower().split() if t)
    d = docs.select(F.col(key), tokens(F.col(text)).alias("_t"))
    # the texts are read twice: for lengths and hits of each document, which are kept, and for the document frequencies
    hit = F.filter("_t", lambda x: x.isin(list(wanted)) if wanted else F.lit(False))
    sizes = materialise(d.select(key, F.size("_t").alias("_len"), hit.alias("_hits")))
    total = sizes.agg(F.count("*").alias("n"), F.avg("_len").alias("avg_len"))
    terms = d.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = terms.crossJoin(F.broadcast(total)).select("term", "avg_len", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))  # one row
    named = F.col("term").isin(list(wanted)) if wanted else F.lit(False)
    # one pass over all terms gives the mean and the few weights of the query's own
    few = raw.agg(F.avg("idf").alias("mean_idf"), F.collect_list(F.when(named, F.struct("term", "avg_len", "idf"))).alias("w"))
    weights = few.select("mean_idf", F.explode("w").alias("w")).select("w.term", "w.avg_len", F.when(F.col("w.idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("w.idf")).alias("idf"))
    times = F.create_map(*[x for t, n in sorted(wanted.items()) for x in (F.lit(t), F.lit(float(n)))]) if wanted else F.create_map(F.lit(""), F.lit(0.0))
    hits = sizes.where(F.size("_hits") > 0).select(key, "_len", F.explode("_hits").alias("term")).groupBy(key, "_len", "term").agg(F.count("*").alias("f"))
    scored = hits.join(weights, "term")
    part = F.element_at(times, F.col("term")) * F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("_len") / F.col("avg_len")))
    sums = scored.groupBy(key).agg(F.sum(part).alias("s"))
    return sizes.select(key).join(sums, key, "left").select(key, F.coalesce("s", F.lit(0.0)).alias("bm25_score"))


def cosine(v: Column, w: Column, eps: float = 1e-9) -> Column:
    """RT5: cosine of two arrays in double precision, eps added to both norms."""
    dot = F.aggregate(F.zip_with(v, w, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + eps
    return dot / (norm(v) * norm(w))


def rank_by(df: DataFrame, score: str, key: str, name: str, depth: int | None = None) -> DataFrame:
    """WN1: places from 1 by score, best first; equal scores by key. ``depth`` keeps the best so many."""
    order = (F.desc(score), F.asc(key))
    if depth is None:
        return numbered(df, name, *order)
    return df.orderBy(*order).limit(depth).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse_ranks(*ranks: Column, k: int = RRF_K) -> Column:
    """RT6: sum of 1 / (k + rank); a missing rank adds nothing."""
    return sum((F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def hybrid(docs: DataFrame, key: str, text: str, vector: str, query: str, query_vector: list[float], top_n: int = 5000, k: int = RRF_K, depth: int | None = None) -> DataFrame:
    """RT7-8: the best ``top_n`` by fused rank, then dense score, then key, with both ranks and scores.

    An empty table gives an empty result of seven columns; a null vector scores 0.
    """
    dense = docs.select(F.col(key), F.coalesce(cosine(F.col(vector), F.lit(query_vector)), F.lit(0.0)).alias("dense_score"))
    a = rank_by(bm25(docs, key, text, query), "bm25_score", key, "bm25_rank", depth)
    b = rank_by(dense, "dense_score", key, "dense_rank", depth)
    j = a.join(b, key, "full" if depth else "inner").withColumn("rrf_score", fuse_ranks(F.col("bm25_rank"), F.col("dense_rank"), k=k))
    order = (F.desc("rrf_score"), F.desc("dense_score"), F.asc(key))
    top = j.orderBy(*order).limit(top_n)
    return top.withColumn("combined_rank", F.row_number().over(Window.orderBy(*order))).select(key, "bm25_rank", "bm25_score", "dense_rank", "dense_score", "rrf_score", "combined_rank")


def _signed_counts(hashes: pd.Series) -> pd.Series:
    def one(h):
        h = np.asarray(h, dtype=np.int64)
        return np.bincount(h % VECTOR_SIZE, np.where((h >> 40) & 1 == 1, 1.0, -1.0), VECTOR_SIZE)

    return hashes.map(one)


def hashed_vector(text: Column) -> Column:
    """A deterministic stand-in for a sentence encoder: signed counts of hashed tokens, an array of ``VECTOR_SIZE`` doubles."""
    counts = F.pandas_udf(_signed_counts, ArrayType(DoubleType()))
    return counts(F.transform(tokens(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t)))


def encode_missing(docs: DataFrame, text: str, cache: DataFrame, model: str, encoder: Callable[[Column], Column] = hashed_vector) -> tuple[DataFrame, DataFrame]:
    """SRC8, RT4: (all texts with vectors, new cache rows). The cache is keyed by model and digest of the text, never by place.

    ``cache``: model, digest, vector. Texts that the cache has aren't encoded again; equal texts are encoded once.
    """
    d = docs.withColumn("digest", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    known = cache.where(F.col("model") == model).select("digest", "vector").dropDuplicates(["digest"])
    fresh = d.select("digest", F.col(text).alias("_t")).dropDuplicates(["digest"]).join(known, "digest", "left_anti").select(F.lit(model).alias("model"), "digest", encoder(F.coalesce("_t", F.lit(""))).alias("vector"))
    return d.join(known.unionByName(fresh.select("digest", "vector")), "digest"), fresh
