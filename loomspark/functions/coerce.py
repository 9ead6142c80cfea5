"""Lenient scalar coercions (COE1-8): built-in expressions that give null or a default instead of failing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import strip


def number(c: Column) -> Column:
    """A finite double, else null; text is trimmed first."""
    d = strip(c.cast("string")).try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def non_negative(c: Column) -> Column:
    """COE1: a double of at least 0, else null."""
    d = number(c)
    return F.when(d >= 0, d)


def iso_date(c: Column) -> Column:
    """COE3: the first ten characters as yyyy-MM-dd; null, empty, ``null`` and anything else give null."""
    s = F.substring(strip(c.cast("string")), 1, 10)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def whole(c: Column) -> Column:
    """Truncated to an int; null if it is no number or out of range."""
    d = number(c)
    return F.when(F.abs(d) < 2147483648.0, d.cast("bigint").cast("int"))


def months(c: Column) -> Column:
    """COE4: a duration of at least 0, truncated; else null."""
    w = whole(c)
    return F.when(number(c) >= 0, w)


def count_or_zero(c: Column) -> Column:
    """COE5: an int clamped to 0; null and unparsable give 0."""
    return F.greatest(F.lit(0), F.coalesce(year(c), F.lit(0)))


def clamped_or_null(c: Column) -> Column:
    """COE5: an int clamped to 0; null and unparsable stay null."""
    y = year(c)
    return F.when(y.isNotNull(), F.greatest(F.lit(0), y))


def year(c: Column) -> Column:
    """COE6: an int; a fraction is truncated only where it was a number and not text: here text with a fraction gives null."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))


def as_feature(c: Column) -> Column:
    """COE7: flags and numbers as double, null and NaN as 0."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def no_nan(c: Column) -> Column:
    """NaN as null: NaN would compare as larger than everything."""
    return F.when(~F.isnan(c), c)


def col_or(df: DataFrame, name: str, default, prefix: str = "") -> Column:
    """COE8: the column if the frame has it, else the default; a null in the column stays null."""
    return F.col(prefix + name) if name in df.columns else F.lit(default)
