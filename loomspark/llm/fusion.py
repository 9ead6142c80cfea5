"""Best representative of each duplicate group: Bayesian fusion with copy detection.

A claim says that, for one field of one group, a member's record holds a value; members belong to sources. Rounds of
expectation and maximisation estimate each source's accuracy from the posterior of its values and, for each pair of
sources, the probability that one copies the other, from the false values they share. A copied vote is discounted before
the posterior of the values is taken; the value with the largest posterior survives.

The prior is a parameter. ``flat`` lets the votes decide. ``strict`` prefers the best usable value of a group and field
(most complete, most recent, strongest) to each other one by log-odds of ``PREFERENCE``, which is more than all votes can
sum up to; the survivor is the value of the largest posterior in either case.

Everything is aggregated before it is shuffled; per group and field only sources, values and sums move. The sources'
statistics come to the driver: all but the ``MAX_SOURCES - 1`` that claim most are one source, so at most its square of
numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import materialise

MAX_SOURCES = 64
FALSE_VALUES = 20.0
"""Number of false values a field is taken to have."""
COPY_RATE = 0.8
"""Probability that a copier takes a value over rather than finding it itself."""
COPY_PRIOR = 0.2
START_ACCURACY = 0.8
PREFERENCE = 450.0
"""Log-odds of the strict prior: above the votes of ``MAX_SOURCES`` sources of the largest accuracy, which sum up to 441."""
OTHERS = "(others)"


def _clip(x: float, lo: float = 0.02, hi: float = 0.98) -> float:
    return min(hi, max(lo, x))


def copy_probability(same_true: float, same_false: float, different: float, a1: float, a2: float) -> float:
    """Posterior that two sources are dependent, given how often they agree on true values, on false ones, and differ."""
    both = a1 * a2
    wrong = (1 - a1) * (1 - a2) / FALSE_VALUES
    differ = max(1e-9, 1 - both - wrong)
    a = (a1 + a2) / 2
    dep_true, dep_false, dep_diff = a * COPY_RATE + both * (1 - COPY_RATE), (1 - a) * COPY_RATE + wrong * (1 - COPY_RATE), differ * (1 - COPY_RATE)
    odds = math.log(COPY_PRIOR / (1 - COPY_PRIOR))
    odds += same_true * math.log(dep_true / both) + same_false * math.log(dep_false / wrong) + different * math.log(dep_diff / differ)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _score(sources: Column, weight: list[float], depend: list[list[float]]) -> Column:
    """Sum of the sources' votes, each discounted by its dependence on the more accurate ones before it."""
    k = len(weight)
    w = F.lit(weight)
    keep = F.lit([1 - COPY_RATE * depend[i][j] for i in range(k) for j in range(k)])
    alone = lambda i: F.aggregate(F.filter(sources, lambda j: j < i), F.lit(1.0), lambda p, j: p * F.element_at(keep, (i * k + j + 1).cast("int")))
    return F.aggregate(sources, F.lit(0.0), lambda acc, i: acc + F.element_at(w, (i + 1).cast("int")) * alone(i))


def _posterior(values: DataFrame, weight: list[float], depend: list[list[float]], strict: bool) -> DataFrame:
    """Score (votes and prior, in logarithms), posterior, number of values and whether it is the largest, of each value."""
    scored = values.withColumn("score", _score(F.col("sources"), weight, depend))
    keys = ["g", "field"]
    if strict:
        best = scored.groupBy(*keys).agg(F.max("pref").alias("best"))
        scored = scored.join(best, keys).withColumn("score", F.when(F.col("pref") == F.col("best"), F.col("score")).otherwise(F.col("score") - PREFERENCE)).drop("best")
    top = scored.groupBy(*keys).agg(F.max("score").alias("top"))
    scaled = scored.join(top, keys)
    total = scaled.groupBy(*keys).agg(F.sum(F.exp(F.col("score") - F.col("top"))).alias("z"), F.count("*").alias("n"))
    # values that nobody claims have no votes
    rest = F.greatest(F.lit(FALSE_VALUES + 1) - F.col("n"), F.lit(0.0)) * F.exp(-F.col("top") - (PREFERENCE if strict else 0.0))
    return scaled.join(total, keys).withColumn("posterior", F.exp(F.col("score") - F.col("top")) / (F.col("z") + rest)).withColumn("is_map", F.col("score") >= F.col("top"))


def _pairs(sources: str) -> Column:
    """All (i, j), i <= j, of a row's sources."""
    return F.explode(F.flatten(F.transform(sources, lambda i: F.transform(F.filter(sources, lambda j: j >= i), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def fuse(claims: DataFrame, prior: str = "strict", rounds: int = 2) -> DataFrame:
    """One row per (g, field): the surviving ``value``, the ``member`` it is taken from, its ``posterior``, and its ``margin``: the log-odds to the next value, null if there is none.

    ``claims``: g, field, member, source (string), value (string), pref (double; larger is better). A claim whose pref is
    null or NaN votes for its value but can't be taken: if no other claim of the group and field has the value, it can't
    survive. A group and field without a value that can be taken give no row; null values are no claims. A null source is a
    source of its own. Of members with the same value the smallest id is named, of equal posteriors the better and then
    the smaller value. Repeated claims count once a source. Clashing extra columns are ignored.
    """
    if prior not in ("strict", "flat"):
        raise ValueError(prior)
    strict = prior == "strict"
    pref = F.col("pref").cast("double")
    c = claims.select("g", "field", "member", F.coalesce("source", F.lit("")).alias("source"), "value", F.when(~F.isnan(pref), pref).alias("pref")).where("value is not null")
    # one row per (group, field, value, source): copies of a third of all rows shrink to one row before the shuffle
    taken = F.when(F.col("pref").isNotNull(), F.col("member"))
    kept = materialise(c.groupBy("g", "field", "value", "source").agg(F.min(taken).alias("member"), F.max("pref").alias("pref")))
    names = [r[0] for r in kept.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        named = F.when(F.col("source").isin(names[: MAX_SOURCES - 1]), F.col("source")).otherwise(OTHERS)
        kept = kept.groupBy("g", "field", "value", named.alias("source")).agg(F.min("member").alias("member"), F.max("pref").alias("pref"))
        names = [*names[: MAX_SOURCES - 1], OTHERS]
    names = sorted(set(names))
    accuracy = {s: START_ACCURACY for s in names}
    depend = {(s, t): 0.0 for s in names for t in names}

    def placed(order: list[str]) -> Column:
        return F.element_at(F.create_map(*[x for i, s in enumerate(order or [""]) for x in (F.lit(s), F.lit(i))]), F.col("source"))

    for turn in range(rounds + 1):
        order = sorted(names, key=lambda s: (-accuracy[s], s))
        weight = [math.log(FALSE_VALUES * accuracy[s] / (1 - accuracy[s])) for s in order] or [0.0]
        matrix = [[depend[s, t] for t in order] for s in order] or [[0.0]]
        valued = kept.groupBy("g", "field", "value").agg(F.sort_array(F.collect_set(placed(order))).alias("sources"), F.min("member").alias("member"), F.max("pref").alias("pref"))
        scored = _posterior(valued, weight, matrix, strict)
        if turn == rounds or len(names) <= 1:
            break
        # accuracies from pairs of a source with itself over all values; agreements from the groups whose values conflict
        agree = scored.select("is_map", "posterior", "n", _pairs("sources").alias("p")).groupBy("p.i", "p.j").agg(F.sum(F.when((F.col("n") > 1) & F.col("is_map"), 1).otherwise(0)).alias("t"), F.sum(F.when((F.col("n") > 1) & ~F.col("is_map"), 1).otherwise(0)).alias("f"), F.avg("posterior").alias("a")).collect()
        spoke = kept.groupBy("g", "field").agg(F.sort_array(F.collect_set(placed(order))).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi")
        both = spoke.select(_pairs("s").alias("p")).where("p.i < p.j").groupBy("p.i", "p.j").agg(F.count("*").alias("n")).collect()
        accuracy = {**accuracy, **{order[r["i"]]: _clip(r["a"]) for r in agree if r["i"] == r["j"]}}
        same = {(r["i"], r["j"]): (r["t"], r["f"]) for r in agree}
        for r in both:
            i, j = r["i"], r["j"]
            t, f = same.get((i, j), (0, 0))
            depend[order[i], order[j]] = depend[order[j], order[i]] = copy_probability(t, f, max(0, r["n"] - t - f), accuracy[order[i]], accuracy[order[j]])
    best = F.struct("score", "pref", "value")
    won = scored.where("pref is not null").groupBy("g", "field").agg(F.max_by(F.struct("value", "member", "posterior", "score"), best).alias("w"))
    beaten = scored.join(won, ["g", "field"]).where("value <> w.value").groupBy("g", "field").agg(F.max("score").alias("next"))
    out = won.join(beaten, ["g", "field"], "left")
    return out.select("g", "field", "w.value", "w.member", "w.posterior", (F.col("w.score") - F.col("next")).alias("margin"))
