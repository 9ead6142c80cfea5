"""Checks of a result table (VA1-14): each gives rows (seq, category, check, status, message); nothing fails before all ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.joins import unknown

COLUMNS = ["candidate_id", "rank", "score", "reasoning"]
ID_PATTERN = r"^CAND_[0-9]{7}$"


def _row(seq: int, category: str, check: str, ok: Column, message: Column, bad: str = "FAIL") -> Column:
    return F.struct(F.lit(seq).alias("seq"), F.lit(category).alias("category"), F.lit(check).alias("check"), F.when(ok, "PASS").otherwise(bad).alias("status"), message.cast("string").alias("message"))


def column_report(df: DataFrame) -> DataFrame:
    """VA2."""
    ok = df.columns == COLUMNS
    return df.sparkSession.range(1).select(F.lit(1).alias("seq"), F.lit("columns").alias("category"), F.lit("exact columns").alias("check"), F.lit("PASS" if ok else "FAIL").alias("status"), F.lit(", ".join(df.columns)).alias("message"))


def table_report(raw: DataFrame, candidates: DataFrame | None = None, rows: int = 100) -> DataFrame:
    """VA2-14 over a table of text columns; wrong columns give that row alone. An empty table fails the row count.

    One aggregate counts all that counting decides; order is checked by one window over the lines of
    places up to ``rows``; others fail the ranks or the row count.
    """
    if raw.columns != COLUMNS:
        return column_report(raw)
    t = raw.select(F.col("candidate_id").alias("id"), F.col("rank").cast("string").alias("rank_text"), F.col("score").cast("string").alias("score_text"), F.trim(F.coalesce(F.col("reasoning").cast("string"), F.lit(""))).alias("reasoning"))
    t = t.withColumn("rank", F.when(F.col("rank_text").rlike(r"^[1-9][0-9]*$"), F.col("rank_text").try_cast("int"))).withColumn("score", F.col("score_text").try_cast("double"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    w = Window.orderBy("rank", "id")
    o = t.where(F.col("rank").between(1, rows)).select("rank", "id", "score", F.lag("score").over(w).alias("before"), F.lag("id").over(w).alias("id_before"))
    order = o.agg(F.count_if(F.col("score") > F.col("before")).alias("rises"), F.count_if((F.col("score") == F.col("before")) & (F.col("id") < F.col("id_before"))).alias("tie_swaps"))
    full = F.col("reasoning") != ""
    text = lambda c: F.array_sort(F.collect_set(F.when(c & full, F.col("reasoning"))))
    a = t.agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("id").rlike(ID_PATTERN), F.lit(False))).alias("bad_ids"), F.countDistinct("id").alias("ids"), F.count_if(F.col("rank").isNull()).alias("bad_ranks"),
        F.countDistinct(F.when(F.col("rank").between(1, rows), F.col("rank"))).alias("ranks"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("bad_scores"), F.countDistinct("score").alias("scores"),
        F.count_if(full).alias("reasons"), F.countDistinct(F.when(full, F.col("reasoning"))).alias("kinds"), F.avg(F.when(full, F.length("reasoning"))).alias("mean_length"),
        F.count_if((F.length("reasoning") < 5) | (F.lower("reasoning") == "nan")).alias("no_reason"), F.count_if(full & (F.length("reasoning") < 15)).alias("short"),
        text(F.col("rank") <= 10).alias("top"), text(F.col("rank") > rows - 10).alias("last"),
    ).crossJoin(order)
    strange = F.lit(0).alias("strange")
    a = a.crossJoin(unknown(t.select(F.col("id").alias("candidate_id")), candidates, "candidate_id").agg(F.count("*").alias("strange"))) if candidates is not None else a.withColumn("strange", strange)
    c = F.col
    out = [
        _row(1, "columns", "exact columns", F.lit(True), F.lit(", ".join(COLUMNS))), _row(2, "rows", "row count", c("n") == rows, c("n")), _row(3, "format", "id pattern", c("bad_ids") == 0, c("bad_ids")),
        _row(4, "format", "rank is an integer", c("bad_ranks") == 0, c("bad_ranks")), _row(5, "format", "score is finite", c("bad_scores") == 0, c("bad_scores")), _row(6, "ids", "unique ids", c("ids") == c("n"), c("ids")),
        _row(7, "ranks", "ranks complete", (c("ranks") == rows) & (c("n") == rows), c("ranks")), _row(8, "scores", "not rising", c("rises") == 0, c("rises")), _row(9, "scores", "not all equal", c("scores") > 1, c("scores")),
        _row(10, "scores", "more than three scores", c("scores") > 3, c("scores"), "WARN"), _row(11, "scores", "ties by id", c("tie_swaps") == 0, c("tie_swaps"), "WARN"), _row(12, "ids", "ids exist", c("strange") == 0, c("strange")),
        _row(13, "reasoning", "given", c("no_reason") == 0, c("no_reason")), _row(14, "reasoning", "all rows", c("reasons") == c("n"), c("reasons"), "WARN"), _row(15, "reasoning", "varied", c("kinds") >= F.least(F.lit(10), c("n")), c("kinds"), "WARN"),
        _row(16, "reasoning", "long enough", F.coalesce(c("mean_length") >= 50, F.lit(False)), F.round("mean_length", 1), "WARN"), _row(17, "reasoning", "none short", c("short") == 0, c("short"), "WARN"), _row(18, "reasoning", "top and bottom differ", c("top") != c("last"), F.size("top"), "WARN"),
    ]
    return a.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def passed(report: DataFrame) -> bool:
    """VA14: no check failed; warnings don't count."""
    return report.where("status = 'FAIL'").isEmpty()
