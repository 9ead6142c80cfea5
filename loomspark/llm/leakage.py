"""Evaluation passages inside a training corpus: a distributed positional inverted index.

The terms of the passages are counted over the whole corpus first. Postings (term, document, place) are stored for the
terms that searches begin with: for every run of ``n`` words of a passage its two rarest terms, for proximity the rarest
terms of the passage of which a match must hold some. The rarest term's postings, shifted by its offset, give candidates
(document, passage, shift), which are intersected with the shifted postings of the next rarest one. All other words are
read of the candidate documents only, beside the passage, and the runs of consecutive matches are read off. No document is cut, no term is
left out for being frequent, and what no search begins with is neither stored nor shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import words
from loomspark.session import materialise

RUN = 13
EXTRA = 3
"""Places of a passage's prefix that must be held beside one: more are read, fewer candidates are checked."""


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Terms (item, q, term) of the passages; null and blank passages have none; equal rows count once."""
    return items.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.posexplode(words(F.col(text))).alias("q", "term")).distinct()


def _tokens(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Tokens (doc, p, term) of whole texts."""
    return docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(words(F.col(text))).alias("p", "term"))


def term_counts(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored counts (term, df) of the passages' terms over the whole corpus; terms it lacks have no row."""
    tokens = docs.where(F.col(doc).isNotNull()).select(F.explode(words(F.col(text))).alias("term"))
    return materialise(tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")))


def postings(docs: DataFrame, wanted: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Stored index (term, doc, p): the places of the ``wanted`` terms in all documents."""
    return materialise(_tokens(docs, doc, text).join(wanted.select("term").distinct(), "term", "left_semi"))


def _beside(docs: DataFrame, candidates: DataFrame, terms: DataFrame, doc: str, text: str, before: Callable[[Column], Column], after: Callable[[Column], Column]) -> DataFrame:
    """Each candidate (doc, item, place) with the passage's words ``t`` and the document's words ``w`` from ``lo`` on.

    ``before`` and ``after`` give, from the place, where the part begins and how far it ends behind the passage's length.
    Whole texts move once, and per candidate only that part. A document's list of candidates is as long as its matches of
    rare terms.
    """
    passages = terms.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "term"))), lambda x: x["term"]).alias("t"))
    place = F.col("place")
    sized = candidates.join(terms.groupBy("item").agg(F.count("*").cast("int").alias("m")), "item")
    part = F.struct("item", "place", F.greatest(before(place), F.lit(0)).alias("lo"), F.greatest(F.col("m") + after(place), F.lit(0)).alias("hi"))
    lists = sized.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(part).alias("_c"))
    # parts are cut before they become rows, which would each hold the whole text; its words are split once, as the lambda's variable
    cut = lambda w: lambda c: F.struct(c["item"].alias("item"), c["place"].alias("place"), c["lo"].alias("lo"), F.slice(w, c["lo"] + 1, F.greatest(c["hi"] - c["lo"], F.lit(0))).alias("w"))
    parts = F.transform(F.array(words(F.col(text))), lambda w: F.transform("_c", cut(w)))[0]
    rows = docs.select(doc, text).join(lists, doc).select(F.col(doc).alias("doc"), F.explode(parts).alias("c"))
    return rows.select("doc", "c.*").join(passages, "item")


def _anchors(df: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """Rows (item, q, term, q2, term2): the rarest and second rarest term of each run of n words that the corpus could hold."""
    # a term that the corpus lacks rules the run out
    spread = terms.join(df, "term", "left").select("item", "q", "term", F.coalesce("df", F.lit(0)).alias("df"), F.explode(F.sequence(F.greatest(F.col("q") - (n - 1), F.lit(0)), F.col("q"))).alias("s"))
    runs = spread.groupBy("item", "s").agg(F.sort_array(F.collect_set(F.struct("df", "q", "term"))).alias("t")).where(F.size("t") == n)
    return runs.where(F.col("t")[0]["df"] > 0).select("item", F.col("t")[0]["q"].alias("q"), F.col("t")[0]["term"].alias("term"), F.col("t")[min(1, n - 1)]["q"].alias("q2"), F.col("t")[min(1, n - 1)]["term"].alias("term2")).distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, n: int = RUN, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Matches (doc, item, shift, first_q, last_q): longest runs of at least ``n`` consecutive words of a passage.

    Null, empty and blank texts match nothing, nor do passages of fewer than ``n`` words; empty tables give no rows.
    """
    terms = item_terms(items, item, item_text)
    anchors = materialise(_anchors(term_counts(docs, terms, doc, text), terms, n))
    index = postings(docs, anchors.select(F.explode(F.array("term", "term2")).alias("term")), doc, text)
    first = index.join(anchors, "term").select("doc", "item", (F.col("p") - F.col("q")).alias("shift"), "q2", "term2")
    second = materialise(first.withColumn("p", F.col("shift") + F.col("q2")).join(index.withColumnRenamed("term", "term2"), ["doc", "p", "term2"], "left_semi").select("doc", "item", F.col("shift").alias("place")).distinct())
    m = F.size("t")
    here = lambda place: place
    places = F.sequence(F.lit(0), m - 1)
    misses = F.filter(places, lambda i: ~F.get("w", i + F.col("place") - F.col("lo")).eqNullSafe(F.get("t", i)))
    seen = _beside(docs, second, terms, doc, text, here, here).withColumn("x", F.concat(F.array(F.lit(-1)), misses, F.array(m)))
    # between two misses lies a run of matches
    between = F.filter(F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.struct((F.get("x", i - 1) + 1).alias("first_q"), (F.get("x", i) - 1).alias("last_q"))), lambda r: r["last_q"] - r["first_q"] >= n - 1)
    return seen.select("doc", "item", F.col("place").alias("shift"), F.explode(between).alias("r")).select("doc", "item", "shift", "r.first_q", "r.last_q").distinct()


def _prefix(df: DataFrame, terms: DataFrame, share: float, extra: int) -> DataFrame:
    """Rows (item, q, term, least): the rarest places of each passage, of which a match must hold at least ``least``.

    A match holds ``need`` of a passage's ``m`` places, so that it lacks ``m - need`` at most: of any ``m - need + least``
    places it holds at least ``least``. Terms that the corpus lacks use up places.
    """
    size = terms.groupBy("item").agg(F.count("*").alias("m"))
    need = F.greatest(F.ceil(F.col("m") * share - 1e-9), F.lit(1))
    ranked = terms.join(df, "term", "left").withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("df", F.lit(0)), "q", "term")))
    sized = ranked.join(size, "item").withColumn("need", need).withColumn("least", F.least(F.col("need"), F.lit(1 + extra)))
    return sized.where(F.col("df").isNotNull() & (F.col("r") <= F.col("m") - F.col("need") + F.col("least"))).select("item", "q", "term", "least")


def near_passages(docs: DataFrame, items: DataFrame, n: int = RUN, slack: int = 5, share: float = 0.6, extra: int = EXTRA, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc, item, share): all passages of which at least ``share`` of the words stand within one band of ``2 * slack`` shifts.

    The best band counts; bands overlap by half. Candidates come from :func:`_prefix`, which loses none, whichever words
    were lost, added or moved; ``extra`` only says how many are checked. Passages of fewer than ``n`` words match nothing.
    """
    terms = item_terms(items, item, item_text)
    terms = terms.join(terms.groupBy("item").agg(F.max("q").alias("z")).where(F.col("z") >= n - 1).select("item"), "item", "left_semi")
    prefix = materialise(_prefix(term_counts(docs, terms, doc, text), terms, share, extra))
    shift = F.col("p") - F.col("q")
    band = F.floor(shift / slack)
    first = postings(docs, prefix, doc, text).join(prefix, "term").select("doc", "item", "least", F.explode(F.array(band, band + 1)).alias("band"))
    bands = materialise(first.groupBy("doc", "item", "band", "least").agg(F.count("*").alias("hits")).where("hits >= least").select("doc", "item", F.col("band").cast("int").alias("place")))
    begin, end = (lambda place: (place - 1) * slack), (lambda place: (place + 1) * slack)
    low, high = (lambda q: F.greatest(q + begin(F.col("place")) - F.col("lo"), F.lit(0))), (lambda q: q + end(F.col("place")) - F.col("lo"))
    held = lambda q: F.array_contains(F.slice("w", low(q) + 1, F.greatest(high(q) - low(q), F.lit(0))), F.get("t", q))
    k = F.size(F.filter(F.sequence(F.lit(0), F.size("t") - 1), held))
    return _beside(docs, bands, terms, doc, text, begin, end).groupBy("doc", "item").agg(F.max(k / F.size("t")).alias("share")).where(F.col("share") >= share)


def leaked(docs: DataFrame, items: DataFrame, n: int = RUN) -> DataFrame:
    """Rows (doc_id, item_id), each once: documents with at least ``n`` consecutive words of a passage."""
    return phrase_matches(docs, items, n).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def leaked_items(docs: DataFrame, items: DataFrame, n: int = RUN) -> DataFrame:
    """Rows (item_id, documents, longest_run): which passages leaked, into how many documents, and how much at most."""
    m = phrase_matches(docs, items, n)
    return m.groupBy(F.col("item").alias("item_id")).agg(F.countDistinct("doc").alias("documents"), F.max(F.col("last_q") - F.col("first_q") + 1).cast("bigint").alias("longest_run"))
