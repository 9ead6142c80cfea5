"""Text kernels shared by the operators; all are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Python's str.isspace() holds for white space.
SPACE = r"[\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)


def strip(c: Column) -> Column:
    """White space of any kind removed from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def strip_or_empty(c: Column) -> Column:
    """COE2: :func:`strip`, null as the empty string."""
    return F.coalesce(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """NRM3: runs of white space become one blank, both ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return c.isNull() | ~c.rlike(NOT_SPACE)


def tokens(c: Column) -> Column:
    """RT2: lower-cased tokens split on white space, punctuation kept; null gives an empty array."""
    return F.filter(F.split(F.coalesce(F.lower(c), F.lit("")), f"{SPACE}+"), lambda t: t != "")


def words(c: Column) -> Column:
    """Lower-cased maximal runs of letters and digits, in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(F.lower(c), F.lit("")), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def contains_any(c: Column, keywords: list[str]) -> Column:
    """True if any keyword is a substring; no word boundaries. False for null text and for an empty list."""
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(c, F.lit(k))
    return F.coalesce(out, F.lit(False))


def word_match(c: Column, keyword: str) -> Column:
    """True if the keyword stands between two characters that are no letter, digit or underscore."""
    quoted = "\\Q" + keyword + "\\E"
    return c.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){quoted}($|[^\p{{L}}\p{{N}}_])")

