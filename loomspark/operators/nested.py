"""Deeply nested, semi-structured records to related flat tables.

Method: each record is read once as a stream of events (no tree is built, no depth or length is too large) into
path-value-ordinal triples; paths are grouped by their nearest repeated ancestor (an array, found where one occurs, or a
map, which the layout names); each group is pivoted into one table keyed by the record and the ordinals of all repeated
ancestors. Parsing runs in Arrow batches inside the scan's tasks; the pivot is an aggregate that combines before the
shuffle, so that what is shuffled is one row a child.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLES = "record bigint, ancestor string, ordinal string, path string, value string"


@dataclass(frozen=True)
class Layout:
    """Names that say more than the paths do. Arrays are unrolled wherever they occur.

    ``arrays``: where a lone object counts as place 0; ``maps``: objects whose names are ordinals; ``objects``: single blocks
    with a table of their own. At these places, and as an element of ``arrays``, JSON text in a string counts as itself.
    ``aliases`` maps another name of a top-level block to its usual one.
    """

    arrays: tuple[str, ...] = ("career_history", "education", "skills", "certifications", "languages")
    maps: tuple[str, ...] = ("redrob_signals.skill_assessment_scores",)
    objects: tuple[str, ...] = ("profile", "redrob_signals", "redrob_signals.expected_salary_range_inr_lpa")
    aliases: dict[str, str] = field(default_factory=lambda: {"signals": "redrob_signals"})
    key: str = "candidate_id"


_SPACE = re.compile(r"[ \t\n\r]*").match
_ATOM = re.compile(r"true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?").match


def _no_constant(name: str):
    raise ValueError(name)


_FAST = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_no_constant)


class Scanner:
    """Events of a JSON text, one by one: (kind, value, begin, end). Kinds: ``{ } [ ]``, ``k`` a name, ``s`` a string, ``a`` another value as it stands, ``.`` the end.

    ValueError where the text is no JSON.
    """

    def __init__(self, text: str):
        self.text, self.at, self.open, self.need = text, 0, [], "value"

    def _closed(self, c: str, i: int):
        self.open.pop()
        self.at, self.need = i + 1, "after"
        return c, None, i, i + 1

    def next(self) -> tuple[str, str | None, int, int]:
        s = self.text
        while True:
            i = _SPACE(s, self.at).end()
            c = s[i : i + 1]
            need = self.need
            if need == "after":
                if not self.open:
                    if c:
                        raise ValueError("more than one value")
                    return ".", None, i, i
                if c == ",":
                    self.at, self.need = i + 1, "name" if self.open[-1] == "{" else "value"
                    continue
                if c and c == ("}" if self.open[-1] == "{" else "]"):
                    return self._closed(c, i)
                raise ValueError(f"a comma is expected at {i}")
            if need in ("name", "name or end"):
                if c == "}" and need != "name":
                    return self._closed(c, i)
                if c != '"':
                    raise ValueError(f"a name is expected at {i}")
                k, end = scanstring(s, i + 1, True)
                j = _SPACE(s, end).end()
                if s[j : j + 1] != ":":
                    raise ValueError(f"a colon is expected at {j}")
                self.at, self.need = j + 1, "value"
                return "k", k, i, end
            if c == "{" or c == "[":
                self.open.append(c)
                self.at, self.need = i + 1, "name or end" if c == "{" else "value or end"
                return c, None, i, i + 1
            if c == "]" and need == "value or end":
                return self._closed(c, i)
            if c == '"':
                v, end = scanstring(s, i + 1, True)
                self.at, self.need = end, "after"
                return "s", v, i, end
            m = _ATOM(s, i)
            if not m:
                raise ValueError(f"a value is expected at {i}")
            self.at, self.need = m.end(), "after"
            return "a", m.group(), i, m.end()

    def skip(self) -> None:
        """Passes the next value over."""
        i = _SPACE(self.text, self.at).end()
        try:
            self.at, self.need = _FAST.raw_decode(self.text, i)[1], "after"
        except RecursionError:
            depth = len(self.open)
            while True:
                kind = self.next()[0]
                if len(self.open) == depth and kind in "}]sa":
                    return


def _valid(text: str) -> bool:
    x = Scanner(text)
    try:
        while x.next()[0] != ".":
            pass
    except ValueError:
        return False
    return True


def _inside(text: str) -> str | None:
    """The JSON text of an array or object that a string holds, through any number of strings; None if it holds none."""
    while True:
        t = text.strip()
        if not t or t[0] not in '[{"' or not _valid(t):
            return None
        if t[0] != '"':
            return t
        text = scanstring(t, 1, True)[0]


def _text(s: str | None) -> str | None:
    return None if s is None else s.encode("utf-8", "replace").decode("utf-8")


def _atom(v: str) -> str | None:
    return None if v == "null" else v


class _Frame:
    __slots__ = ("anc", "at", "begin", "end", "full", "index", "key", "kind", "places", "raw", "rel", "rep", "source", "whole")

    def __init__(self, kind: str, full: str, anc: str, rep: tuple[str, ...], rel: str, source: Scanner, begin: int, raw=None, whole: bool = False):
        self.kind, self.full, self.anc, self.rep, self.rel, self.source, self.begin = kind, full, anc, rep, rel, source, begin
        self.index, self.key, self.places, self.raw, self.whole = 0, None, {}, raw, whole


class Reader:
    """Triples (ancestor, ordinal, path, value) of one record; see :func:`parse_record`."""

    def __init__(self, layout: Layout, wanted: frozenset[str] | None = None, fields: frozenset[str] | None = None):
        self.layout, self.wanted, self.fields = layout, wanted, fields
        self.arrays, self.maps, self.objects = map(frozenset, (layout.arrays, layout.maps, layout.objects))
        self.out: list[tuple | None] = []
        self.known: dict[tuple, bool] = {}

    def _emit(self, anc: str, rep: tuple[str, ...], path: str, value: str | None) -> None:
        if self.wanted is not None and anc not in self.wanted or self.fields is not None and path not in self.fields:
            return
        self.out.append((_text(anc), _text("/".join(rep)) if rep else "0" if anc else "", _text(path), _text(value)))

    def _needed(self, full: str) -> bool:
        """Whether something below the path may be wanted."""
        return self.wanted is None or any(w == full or w.startswith(full + ".") or full.startswith(w + ".") or full.startswith(w + "[") for w in self.wanted)

    def _read(self, f: _Frame) -> bool:
        """Whether the innermost frame's value may give wanted triples; known once per path, but for a map's names."""
        at = (f.anc, f.rel, f.full, "" if f.kind == "m" else f.key)
        if at not in self.known:
            own = f.anc in self.wanted and (f.kind == "m" or self.fields is None or f"{f.rel}{f.key}" in self.fields)
            below = f"{f.full}.{f.key}"
            self.known[at] = own or any(w == below or w.startswith((f"{below}.", f"{below}[")) or self.fields is None and below.startswith((f"{w}.", f"{w}[")) for w in self.wanted)
        return self.known[at]

    def read(self, text: str) -> list[tuple] | None:
        source = Scanner(text)
        if source.next()[0] != "{":
            return None
        key: str | None = None
        tops: dict[str, tuple[int, int, bool]] = {}
        while True:
            kind, name, _, _ = source.next()
            if kind == "}":
                break
            usual = self.layout.aliases.get(name, name)
            begin = len(self.out)
            if name == self.layout.key:
                i = _SPACE(text, source.at).end()
                source.skip()
                key = self._key(text[i : source.at])
                is_object = False
            elif not self._needed(usual) and self.wanted is not None:
                i = _SPACE(text, source.at).end()
                is_object = text[i : i + 1] == "{"
                source.skip()
            else:
                is_object = self._block(source, usual)
            if name in tops:
                self._drop(*tops[name][:2])
            tops[name] = (begin, len(self.out), is_object)
        if source.next()[0] != "." or key is None:
            return None
        for other, usual in self.layout.aliases.items():
            if other in tops and usual in tops:
                self._drop(*tops[other if tops[usual][2] else usual][:2])
        found, self.out = [x for x in self.out if x is not None], []
        self._emit("", (), self.layout.key, key)
        return self.out + found

    def _key(self, raw: str) -> str | None:
        if raw[0] in "[{":
            return None
        v = scanstring(raw, 1, True)[0] if raw[0] == '"' else raw
        return None if raw in ("null", "false") or not v.strip() else v

    def _drop(self, begin: int, end: int) -> None:
        self.out[begin:end] = [None] * (end - begin)

    def _block(self, source: Scanner, usual: str) -> bool:
        """Reads one top-level value; whether it is an object."""
        root = _Frame("{", "", "", (), "", source, 0)
        root.key = usual
        stack = [root]
        first = self._value(stack, source.next())
        while len(stack) > 1:
            f = stack[-1]
            e = f.source.next()
            kind = e[0]
            if kind == "k":
                if e[1] in f.places:
                    self._drop(*f.places[e[1]])
                f.key = e[1]
                f.places[f.key] = (len(self.out), len(self.out))
                if self.wanted is not None and not self._read(f):
                    f.source.skip()
            elif kind in "}]":
                stack.pop()
                if f.raw is not None:
                    self._emit(*f.raw, f.source.text[f.begin : e[3]])
                self._after(stack[-1])
                if f.whole:
                    # the end of a text inside a string
                    f.source.next()
            else:
                self._value(stack, e)
        return first == "{"

    def _after(self, f: _Frame) -> None:
        if f.kind == "[":
            f.index += 1
        elif f.key in f.places:
            f.places[f.key] = (f.places[f.key][0], len(self.out))

    def _value(self, stack: list[_Frame], e: tuple[str, str | None, int, int], source: Scanner | None = None, whole: bool = False) -> str:
        """Takes the next value of the innermost frame; gives its kind, of a text inside a string that of the text."""
        f = stack[-1]
        kind, v, begin, _ = e
        source = source or f.source
        element = f.kind == "["
        full = f.full if element else f"{f.full}.{f.key}" if f.full else f.key
        named = full in self.arrays or full in self.maps or full in self.objects
        if kind == "s" and named and (inner := _inside(v)) is not None:
            source = Scanner(inner)
            return self._value(stack, source.next(), source, True)
        if element:
            rep, anc = (*f.rep, str(f.index)), f.anc
            if kind == "{":
                self._emit(anc, rep, ".", None)
                stack.append(_Frame("{", full, anc, rep, "", source, begin, whole=whole))
            elif kind == "[":
                stack.append(_Frame("[", f"{full}[]", f"{anc}[]", rep, "", source, begin, whole=whole))
            else:
                self._emit(anc, rep, "=", v if kind == "s" else _atom(v))
                self._after(f)
            return kind
        if f.kind == "m":
            rep = (*f.rep, f.key)
            if kind in "{[":
                stack.append(_Frame(kind if kind == "{" else "[", f"{full}.*", f"{f.anc}.*", rep, "", source, begin, raw=(f.anc, rep, "value"), whole=whole))
            else:
                self._emit(f.anc, rep, "value", v if kind == "s" else _atom(v))
                self._after(f)
            return kind
        if full in self.maps and kind == "{":
            stack.append(_Frame("m", full, full, f.rep, "", source, begin, whole=whole))
        elif full in self.objects and kind == "{":
            self._emit(full, f.rep, ".", None)
            stack.append(_Frame("{", full, full, f.rep, "", source, begin, whole=whole))
        elif full in self.arrays and kind == "{":
            self._emit(full, (*f.rep, "0"), ".", None)
            stack.append(_Frame("{", full, full, (*f.rep, "0"), "", source, begin, whole=whole))
        elif kind in "{[" and (full in self.arrays or not named):
            raw = None if full in self.arrays or f.rel or not f.full else (f.anc, f.rep, f.key)
            if kind == "[":
                stack.append(_Frame("[", full, full, f.rep, "", source, begin, raw=raw, whole=whole))
            else:
                stack.append(_Frame("{", full, f.anc, f.rep, f"{f.rel}{f.key}.", source, begin, raw=raw, whole=whole))
        elif kind in "{[":
            # of another type than the layout says
            stack.append(_Frame(kind, full, "\0", (), "", source, begin, whole=whole))
        else:
            if not named:
                self._emit(f.anc, f.rep, f"{f.rel}{f.key}", v if kind == "s" else _atom(v))
            self._after(f)
        return kind


def parse_record(text: str | None, layout: Layout, wanted: frozenset[str] | None = None, fields: frozenset[str] | None = None, reader: Reader | None = None) -> list[tuple[str, str, str, str | None]] | None:
    """Triples (ancestor, ordinal, path, value) of one line; None if it is no JSON object with a non-blank key.

    The ordinal has the places in all repeated ancestors, joined by ``/``; a map's entry has its name as the last of them.
    Every object in an array gives a triple with the path ``.``, so that an empty object is a row; other elements give one
    with the path ``=``. A field that is an array or object has a table or longer paths of its own and, in an element, also
    its text as value. What the layout names but is of another type gives nothing. Values are as they stand, whatever
    their length. Of equal names in one object the last one holds. ``wanted`` and ``fields`` keep only those ancestors and
    paths; the rest is passed over.
    """
    if text is None:
        return None
    reader = reader or Reader(layout, wanted, fields)
    reader.out = []
    if len(reader.known) > 10_000:
        reader.known.clear()
    try:
        out = reader.read(text)
    except ValueError:
        return None
    return None if out is None else [x for x in out if x[0] != "\0"]


def triples(df: DataFrame, record: str = "raw_id", text: str = "payload", layout: Layout | None = None, ancestors: Iterable[str] | None = None, fields: Iterable[str] | None = None) -> DataFrame:
    """Path-value-ordinal triples of all lines; ``ancestors`` and ``fields`` keep only those groups and paths.

    Null, blank and broken lines, JSON that is no object and records without key give nothing; extra keys are kept as
    triples; an empty table gives an empty one.
    """
    layout = layout or Layout()
    wanted = None if ancestors is None else frozenset(ancestors)
    paths = None if fields is None else frozenset(fields)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(layout, wanted, paths)
        for batch in batches:
            rows = []
            for rid, line in zip(batch["record"], batch["text"], strict=True):
                rows.extend((rid, *t) for t in parse_record(line, layout, wanted, paths, reader) or ())
                if len(rows) >= 20_000:
                    yield pd.DataFrame(rows, columns=["record", "ancestor", "ordinal", "path", "value"])
                    rows = []
            yield pd.DataFrame(rows, columns=["record", "ancestor", "ordinal", "path", "value"]).astype({"record": "int64"})

    return df.select(F.col(record).cast("bigint").alias("record"), F.col(text).alias("text")).where("record is not null").mapInPandas(parse, TRIPLES)


def ancestors_found(t: DataFrame) -> DataFrame:
    """Rows (ancestor, parent, depth, paths): the tables that the paths call for, with the table each is a child of.

    ``depth`` is the number of ordinals; a child's ordinal begins with its parent's.
    """
    depth = F.when(F.col("ancestor") == "", 0).otherwise(F.size(F.split("ordinal", "/")))
    found = t.groupBy("ancestor").agg(F.max(depth).alias("depth"), F.array_sort(F.collect_set("path")).alias("paths"))
    up = found.select(F.col("ancestor").alias("up"), F.col("depth").alias("up_depth"))
    child = (F.length("ancestor") > F.length("up")) & ((F.col("up") == "") | F.col("ancestor").startswith(F.col("up"))) & (F.col("up_depth") <= F.col("depth"))
    return found.join(up, child, "left").groupBy("ancestor", "depth", "paths").agg(F.max_by("up", F.length("up")).alias("parent"))


def pivot_group(t: DataFrame, ancestor: str, fields: Iterable[str], record: str = "raw_id") -> DataFrame:
    """The flat table of one group: (record, ordinal, fields...), all as text; a field that is absent is null."""
    fields = list(fields)
    cols = [F.max(F.when(F.col("path") == f, F.col("value"))).alias(f) for f in fields]
    # elements that are no objects, and have no entry of the fields, are no rows
    mine = F.col("path").isin(".", *fields) if fields else F.lit(True)
    return t.where((F.col("ancestor") == ancestor) & mine).groupBy(F.col("record").alias(record), "ordinal").agg(*(cols or [F.count("*").alias("n")]))


CAREER_FIELDS = ("company", "title", "start_date", "end_date", "duration_months", "is_current", "industry", "company_size", "description")
SKILL_FIELDS = ("name", "proficiency", "endorsements", "duration_months")


def flat_tables(df: DataFrame, record: str = "raw_id", text: str = "payload") -> dict[str, DataFrame]:
    """Career entries, skills with a name, assessment scores and salary ranges of raw lines, each row with its line's id.

    ``ordinal`` is the place in the array as it stands, or the name of a score. Values are text as received: typing them
    is the task of the coercion functions, so that one odd value loses no row.
    """
    from loomspark.functions.text import is_blank

    score, salary = "redrob_signals.skill_assessment_scores", "redrob_signals.expected_salary_range_inr_lpa"
    t = triples(df, record, text, ancestors=("career_history", "skills", score, salary))
    return {
        "career": pivot_group(t, "career_history", CAREER_FIELDS, record),
        "skill": pivot_group(t, "skills", SKILL_FIELDS, record).where(~is_blank(F.col("name"))),
        "assessment": pivot_group(t, score, ("value",), record).where("value is not null"),
        "salary": pivot_group(t, salary, ("min", "max"), record).where("min is not null or max is not null"),
    }


def children(df: DataFrame, record: str = "raw_id", text: str = "payload") -> DataFrame:
    """Keys of all children (record, child, child_key), pivoted from one parse of the lines."""
    from loomspark.functions.text import is_blank

    score, salary = "redrob_signals.skill_assessment_scores", "redrob_signals.expected_salary_range_inr_lpa"
    t = triples(df, record, text, ancestors=("career_history", "skills", score, salary), fields=(".", "name", "value", "min", "max"))
    at = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    wide = t.groupBy("record", "ancestor", "ordinal").agg(at("name").alias("name"), at("value").alias("value"), at("min").alias("lo"), at("max").alias("hi"))
    child = F.when(F.col("ancestor") == "career_history", "career").when((F.col("ancestor") == "skills") & ~is_blank(F.col("name")), "skill").when((F.col("ancestor") == score) & F.col("value").isNotNull(), "assessment").when((F.col("ancestor") == salary) & (F.col("lo").isNotNull() | F.col("hi").isNotNull()), "salary")
    return wide.select(F.col("record").alias(record), child.alias("child"), F.col("ordinal").alias("child_key")).where("child is not null")
