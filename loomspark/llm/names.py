"""Variant spellings of organisations: noisy-channel attribution.

Distinct spellings are counted; spellings that differ in case, accents, punctuation, legal form or word order only are one
form. Forms that share a block are paired: the more frequent one is a candidate for what the other one was meant to be.
The posterior of a candidate is its frequency prior times the likelihood that typing, abbreviating, joining or reordering
turned its words into the variant's; a variant is attached to the candidate of the largest posterior if the likelihood is
above that of an unrelated name. Attachments are followed to their roots.

Blocks are drawn from a name's words together with the first or last letter of its other word. Rows are counted before
anything is paired, so that an employer with a tenth of all rows is one form; of a block that a common word makes large
the pairs are ruled out by their letters in the join, which adaptive skew joins split.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.components import components
from loomspark.session import materialise

# Words that say what kind of organisation a name stands for; they tell organisations apart but name none.
KINDS = (
    "analytics automotive bank business capital chemicals college commerce consulting consultants design energy engineering enterprises "
    "finance foods foundation group healthcare holdings hospital industries infrastructure institute insurance international labs "
    "laboratories law logistics management media medical motors networks partners pharma pharmaceuticals polytechnic power retail "
    "school sciences science services software solutions steel studies studios systems technologies technology telecom textiles trading "
    "university ventures arts academy"
).split()
# Legal forms and their usual short forms.
LEGAL = {"inc": "inc", "incorporated": "inc", "llp": "llp", "ltd": "ltd", "limited": "ltd", "pvt": "pvt", "private": "pvt", "p": "pvt", "corp": "inc", "corporation": "inc", "plc": "ltd", "llc": "llc", "gmbh": "gmbh", "co": "ltd", "company": "ltd"}
# Words that carry no meaning in a name.
FILLERS = {"the", "of", "and", "for", "at", "m", "s", "ms", "messrs"}
SAME_KIND = {"technology": "technologies", "science": "sciences", "consultants": "consulting", "laboratories": "labs", "pharmaceuticals": "pharma"}

# Usual short forms of kinds; others are recognised by rule.
SHORT_KINDS = {"ind": "industries", "inds": "industries", "solns": "solutions", "soln": "solutions", "svcs": "services", "sys": "systems", "tech": "technologies", "engg": "engineering", "coll": "college", "inst": "institute", "sch": "school", "uni": "university", "univ": "university"}

LEAST = -9.5
"""Log-likelihood below which a variant is taken to be a name of its own."""


def fold(s: str) -> str:
    """Accents removed; letters keep their case."""
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def distance(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance of adjacent transpositions; ``most + 1`` if larger than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row[j] = v
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def shortens(short: str, full: str) -> bool:
    """Whether ``short`` may abbreviate ``full``: same first letter, its letters in order, at least a quarter shorter."""
    if not short or short[0] != full[0] or len(short) > 0.85 * len(full):
        return False
    it = iter(full)
    return all(c in it for c in short)


@lru_cache(100_000)
def kind_of(word: str) -> str | None:
    """The kind that a word names, spelled in full, abbreviated or with one slip; None if it names none."""
    if word in KINDS:
        return SAME_KIND.get(word, word)
    if word in SHORT_KINDS:
        return SHORT_KINDS[word]
    if len(word) >= 3:
        # of several kinds that the word may abbreviate the one that keeps most of it: the longest common beginning, then the shortest
        fits = [k for k in KINDS if shortens(word, k) and (len(word) < 6 or word[:3] == k[:3] or len(word) >= 0.6 * len(k))]
        if fits:
            best = min(fits, key=lambda k: (-_common(word, k), len(k), k))
            return SAME_KIND.get(best, best)
        if word.endswith("g") and word[:-1] == "eng":
            return "engineering"
    if len(word) >= 5:
        near = [k for k in KINDS if distance(word, k, 1) <= 1]
        # a short form with a slip: one of its letters isn't the kind's
        near = near or sorted({k for t in _one_less(word) for k in KINDS if _keeps(t, k)}, key=lambda k: (-_common(word, k), len(k), k))
        if near:
            return SAME_KIND.get(near[0], near[0])
    return None


def _one_less(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(1, len(word))}


def _consonants(word: str) -> int:
    return sum(x not in "aeiou" for x in word)


def _keeps(short: str, full: str) -> bool:
    """Whether a short form keeps so much of the word that it hardly stands for another: half of its letters and most of its consonants."""
    return shortens(short, full) and 2 * len(short) >= len(full) and _consonants(short) >= 0.7 * _consonants(full)


@lru_cache(100_000)
def legal_slip(word: str) -> str | None:
    """The long legal form that the word is with one slip."""
    return next((x for x in LEGAL if len(x) >= 7 and distance(word, x, 1) <= 1), None)


@lru_cache(100_000)
def near_kind(word: str) -> bool:
    """Whether the word is a kind with one slip, or keeps most of one, a slip in it allowed."""
    return len(word) >= 5 and any(distance(word, k, 1) <= 1 or any(_keeps(t, k) for t in (word, *_one_less(word))) for k in KINDS)


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def parse(name: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """(core words, kinds, legal forms) of a name.

    Camel case is split, dotted letters are joined, an acronym in brackets at the end is left out. A dotted acronym that
    spells the initials of kinds stands for them. If nothing else is left, kinds are the core.
    """
    s = fold(name)
    s = re.sub(r"\(\s*[pP]\s*\)", " pvt ", s)
    s = re.sub(r"\([^()]*\)\s*\W*$", " ", s)
    s = re.sub(r"(?i)\bm/s\b\.?", " ", s)
    s = re.sub(r"\b(?:[A-Za-z]\.\s?){2,}", lambda m: re.sub(r"[.\s]", "", m.group()) + " ", s)
    s = re.sub(r"(?<=[A-Za-z][a-z]{3})(?=[A-Z][a-z]{3})", " ", s)
    words = [w for w in re.findall(r"[^\W_]+", s.lower())]
    core, kinds, legal, guessed = [], [], [], []
    for i, w in enumerate(words):
        if w == "p" and not (i + 1 < len(words) and words[i + 1] in ("ltd", "limited")):
            core.append(w)
        elif w in LEGAL or legal_slip(w):
            legal.append(LEGAL[w if w in LEGAL else legal_slip(w)])
        elif w in FILLERS and not (len(w) == 1 and i == 0):
            continue
        else:
            k = _ACRONYMS.get(w) or kind_of(w)
            if k:
                kinds += k.split()
                if len(w) >= 4 and w not in KINDS and w not in SHORT_KINDS and w not in _ACRONYMS and not near_kind(w):
                    guessed.append((w, k, len(core)))
            else:
                core.append(w)
    if guessed and len(core) == 1:
        # what was only guessed to shorten a kind is the name's other word
        w, k, at = guessed[0]
        core.insert(at, w)
        kinds.remove(k)
    if not core:
        core, kinds = [w for w in words if w not in LEGAL and w not in FILLERS] or words, []
    return tuple(core), tuple(sorted(set(kinds))), tuple(sorted(set(legal)))


# Initials of kinds that stand for more than one word.
_ACRONYMS = {"coe": "college engineering", "it": "institute technologies", "iot": "institute technologies", "soc": "school commerce", "coc": "college commerce", "som": "school management", "coll": "college"}


def form_of(core: tuple[str, ...], kinds: tuple[str, ...]) -> str:
    return " ".join(sorted(core)) + "|" + " ".join(kinds)


def _word(v: str, c: str) -> float:
    """Log-likelihood that a core word ``c`` came out as ``v``."""
    if v == c:
        return 0.0
    if len(v) == 1:
        return -3.5 if v == c[0] else -99.0
    if min(len(v), len(c)) >= 4:
        d = distance(v, c, 2)
        if d == 1:
            return -3.5
        if d == 2 and min(len(v), len(c)) >= 7:
            return -7.5
    if 2 <= len(v) <= 4 and c.startswith(v):
        return -3.6
    if len(v) >= 3 and len(v) >= 0.5 * len(c) and shortens(v, c):
        return -5.0
    return -99.0


def likelihood(v: tuple, c: tuple) -> float:
    """Log-likelihood of the parsed variant ``v`` if the parsed name ``c`` was meant."""
    (vc, vk, vl), (cc, ck, cl) = v, c
    best = -99.0
    if len(vc) == len(cc):
        if len(vc) == 2:
            best = max(_word(vc[0], cc[0]) + _word(vc[1], cc[1]), _word(vc[0], cc[1]) + _word(vc[1], cc[0]) - 1.5)
        else:
            best = sum(_word(a, b) for a, b in zip(vc, cc, strict=True))
    a, b = "".join(vc), "".join(cc)
    if a == b:
        best = max(best, -0.5)
    elif min(len(a), len(b)) >= 8:
        best = max(best, {1: -4.0, 2: -8.5}.get(distance(a, b, 2), -99.0))
    if len(vc) == 1 and len(cc) == 2:
        w = vc[0]
        if 4 <= len(w) <= 8 and any(cc[0].startswith(w[:i]) and cc[1].startswith(w[i:]) for i in range(2, len(w) - 1)):
            best = max(best, -7.3)
    if best <= LEAST:
        return -99.0
    sv, sc = set(vk), set(ck)
    if sv != sc:
        if sv and sc and not (sv < sc or sc < sv):
            best -= 12.0
        else:
            best -= 3.0
    lv, lc = set(vl), set(cl)
    if lv and lc and lv != lc:
        best -= 1.0 if lv | lc == {"ltd", "pvt"} else 4.0
    elif lv != lc:
        best -= 0.3
    return best


def blocks(core: tuple[str, ...], meant: bool) -> set[str]:
    """Blocks of a form as a variant or as the name that was meant: the two sides of a possible attachment share one.

    One slip, one initial or one lost letter leaves one of two words whole and the first or last letter of the other; the
    beginnings of both words may stand for the name, so that only names offer pairs of beginnings.
    """
    out = set()
    squeezed = "".join(core)
    if len(core) == 2:
        a, b = core
        for w, o in ((a, b), (b, a)):
            if len(w) >= 4:
                out |= {f"{w}>{o[0]}", f"{w}<{o[-1]}"}
        if meant:
            out |= {f"{a[:i]}+{b[:j]}" for i in (2, 3, 4) for j in (2, 3, 4) if len(a) >= 4 and len(b) >= 4}
        elif 2 <= len(a) <= 4 and 2 <= len(b) <= 4:
            out |= {f"{a}+{b}", f"{b}+{a}"}
    if len(core) == 1 and 4 <= len(squeezed) <= 8 and not meant:
        out |= {f"{squeezed[:i]}+{squeezed[i:]}" for i in range(2, len(squeezed) - 1)}
    if len(squeezed) >= 8:
        out |= {f"^{squeezed[:6]}{squeezed[-1]}", f"${squeezed[-6:]}{squeezed[0]}", f"^{squeezed[:8]}", f"${squeezed[-8:]}"}
    else:
        out.add(f"={squeezed}")
    return out


def letters(core: Iterable[str]) -> int:
    """The letters of a name as a set of 64 bits.

    Whatever the likelihood allows (slips of two letters, initials, short forms, joining, another order), at most two
    letters of a variant aren't the meant name's: pairs of other forms needn't be scored.
    """
    out = 0
    for word in core:
        for x in word:
            out |= 1 << (ord(x) % 64)
    return out - (1 << 64) if out >> 63 else out


_PARSED = "name string, n bigint, form string, core array<string>, kinds array<string>, legal array<string>"


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        p = [parse(x) for x in b["name"]]
        yield pd.DataFrame({"name": b["name"], "n": b["n"], "form": [form_of(c, k) for c, k, _ in p], "core": [list(x[0]) for x in p], "kinds": [list(x[1]) for x in p], "legal": [list(x[2]) for x in p]})


def _block_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, meant, f, letters(c)) for f, c in zip(b["form"], b["core"], strict=True) for meant in (False, True) for k in sorted(blocks(tuple(c), meant))]
        yield pd.DataFrame(rows, columns=["block", "meant", "form", "letters"])


def _score_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        t = lambda *xs: tuple(tuple(x) for x in xs)
        score = [likelihood(t(*v), t(*c)) for v, c in zip(zip(b["core"], b["kinds"], b["legal"], strict=True), zip(b["core2"], b["kinds2"], b["legal2"], strict=True), strict=True)]
        out = pd.DataFrame({"form": b["form"], "canonical": b["form2"], "n": b["n2"], "likelihood": score})
        yield out[out["likelihood"] > LEAST]


def attributions(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(best, parsed): rows (form, canonical, posterior), the best earlier form of each form that has one, and the parsed names.

    ``names``: name, n. The prior of a candidate is its share of all rows, as a logarithm; ties go to the smaller form.
    """
    parsed = materialise(names.mapInPandas(_parse_all, _PARSED))
    rep = F.max_by(F.struct("core", "kinds", "legal"), F.struct("n", "name"))
    forms = materialise(parsed.groupBy("form").agg(F.sum("n").alias("n"), rep.alias("r")).select("form", "n", "r.*"))
    blocked = materialise(forms.mapInPandas(_block_all, "block string, meant boolean, form string, letters bigint"))
    said, meant = blocked.where("not meant").select("block", "form", "letters"), blocked.where("meant").select("block", F.col("form").alias("form2"), F.col("letters").alias("letters2"))
    # a block of a common word pairs many forms: most are ruled out by their letters, before anything is shuffled or scored
    strange = F.bit_count(F.col("letters").bitwiseAND(F.bitwise_not("letters2")))
    both = said.join(meant, "block").where((F.col("form") != F.col("form2")) & (strange <= 2)).select("form", "form2").distinct()
    other = forms.select(*(F.col(c).alias(f"{c}2") for c in forms.columns))
    full = lambda c: F.aggregate(c, F.lit(0), lambda s, w: s + F.length(w))
    rank = lambda n, c, f: F.struct(F.col(n).alias("n"), full(c).alias("l"), F.col(f).alias("f"))
    # initials and beginnings stand for whole words, however frequent they are; else the more frequent form is the one meant
    shorter = full("core") + 4 < full("core2")
    longer = full("core") > full("core2") + 4
    whole = F.forall("core2", lambda w: F.length(w) > 1)
    pairs = both.join(forms, "form").join(other, "form2").where(whole & (shorter | ~longer & (rank("n2", "core2", "form2") > rank("n", "core", "form"))))
    scored = pairs.mapInPandas(_score_all, "form string, canonical string, n bigint, likelihood double")
    best = scored.groupBy("form").agg(F.max_by(F.struct("canonical", (F.col("likelihood") + F.log("n")).alias("posterior")), F.struct(F.col("likelihood") + F.log("n"), "n", "canonical")).alias("b"))
    return best.select("form", "b.canonical", "b.posterior"), parsed


def organisation_classes(names: DataFrame) -> DataFrame:
    """Rows (name, class_id, canonical, links) of all distinct spellings.

    ``names``: one column ``name``, rows as stored, repeated as often as they occur. Null and blank names are left out;
    strings count exactly as stored; a name that nothing explains is a class of its own. ``canonical`` is the most
    frequent spelling of the class (of equal ones the smallest); ``links`` counts the other spellings of the name's form and
    the forms that it is attached to or that are attached to it.
    """
    from loomspark.functions.text import is_blank

    counts = names.where(~is_blank(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))
    best, parsed = attributions(counts)
    edges = materialise(best.select(F.col("form").alias("a"), F.col("canonical").alias("b")))
    comp = components(edges)
    ends = edges.select(F.explode(F.array("a", "b")).alias("form")).groupBy("form").agg(F.count("*").alias("attached"))
    spelled = parsed.groupBy("form").agg((F.count("*") - 1).alias("spelled"))
    placed = parsed.join(comp, parsed["form"] == comp["node"], "left").join(spelled, "form").join(ends, "form", "left").select("name", "n", F.coalesce("component", "form").alias("class_id"), (F.col("spelled") + F.coalesce("attached", F.lit(0))).alias("links"))
    named = placed.groupBy("class_id").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("canonical"))
    return placed.join(named, "class_id").select("name", "class_id", "canonical", "links")


def pool(career: DataFrame, candidates: DataFrame, education: DataFrame) -> DataFrame:
    """All stored employer and school names as one pool, column ``name``."""
    return career.select(F.col("company").alias("name")).unionAll(candidates.select("current_company")).unionAll(education.select("institution"))


def name_pairs(names: DataFrame) -> DataFrame:
    """All pairs (name_a, name_b) of different spellings of one organisation, smaller first by code point."""
    c = materialise(organisation_classes(names).select("name", "class_id"))
    return c.alias("x").join(c.alias("y"), (F.col("x.class_id") == F.col("y.class_id")) & (F.col("x.name") < F.col("y.name"))).select(F.col("x.name").alias("name_a"), F.col("y.name").alias("name_b"))
