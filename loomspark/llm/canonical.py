"""Mapping of freely typed values to a reference list: symmetric-delete dictionary with weighted Damerau-Levenshtein ranking.

The reference list becomes a dictionary of its entries' squeezed spellings under all deletions of up to two letters; a
typed value's own deletions are looked up in it, so that all entries within the bounded distance are found without
comparing the value to the list. Before the lookup words are expanded: abbreviations, initials and joined words to
reference words. Hits are ranked by weighted distance, then by how often the entry itself was typed, and what has no hit
within the bound is reported with 0. The list is broadcast after a check of its size (``MAX_ENTRIES``); distinct values
are counted before anything is matched, so that a value with a tenth of all rows is matched once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import product
from math import prod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import is_blank
from loomspark.llm.names import fold, shortens

MAX_ENTRIES = 20_000
MAX_LETTERS = 200
MOST_WEIGHT = 2.6
"""What an entry's words and slips may weigh."""
MANY = 500
"""Windows of more combinations of meanings are followed through the entries' prefixes; smaller ones are all looked up."""

# Usual short forms in job titles and skills.
SHORT = {
    "sr": "senior", "snr": "senior", "sen": "senior", "jr": "junior", "jnr": "junior", "ld": "lead",
    "eng": "engineer engineering", "engr": "engineer", "engg": "engineering engineer", "dev": "developer",
    "mgr": "manager", "mngr": "manager", "mgmt": "management", "admin": "administrator administration", "adm": "administrator",
    "db": "database", "ux": "userexperience", "sw": "software", "softw": "software", "sys": "systems", "ops": "operations",
    "prod": "product", "tech": "technical", "fin": "financial", "mktg": "marketing", "sci": "scientist",
    "anlst": "analyst", "coord": "coordinator", "spec": "specialist", "archt": "architect", "arch": "architect",
    "sre": "sitereliabilityengineer", "ir": "informationretrieval", "ci": "continuousintegration", "nlp": "naturallanguageprocessing",
}
# Words that say how a post or skill is held, not which one it is.
NOISE = set("contract full part time hands on ii iii iv i certified basic advanced beginner intermediate expert freelance remote permanent level years of".split())
LINKING = {"at", "in", "for", "with", "by"}
_NUMBER = re.compile(r"v?\d+")


def weighted_distance(a: str, b: str) -> tuple[int, float]:
    """(edits, weight) of the lightest Damerau-Levenshtein edits: a swap weighs 0.8, a vowel for a vowel 0.9, another letter 1.1, an inserted or lost one 1."""
    vowels = "aeiou"
    before: list[tuple[float, int]] | None = None
    last = [(float(j), j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [(float(i), i)]
        for j, y in enumerate(b, 1):
            if x == y:
                v = last[j - 1]
            else:
                w, e = last[j - 1]
                v = (w + (0.9 if x in vowels and y in vowels else 1.1), e + 1)
                v = min(v, (last[j][0] + 1, last[j][1] + 1), (row[j - 1][0] + 1, row[j - 1][1] + 1))
                if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    v = min(v, (before[j - 2][0] + 0.8, before[j - 2][1] + 1))
            row.append(v)
        before, last = last, row
    return last[-1][1], last[-1][0]


def allowed(n: int) -> int:
    """Edits allowed in a spelling of n letters."""
    return 0 if n < 4 else 1 if n < 14 else 2


def deletions(s: str, k: int) -> set[str]:
    out, edge = {s}, {s}
    for _ in range(k):
        edge = {x[:i] + x[i + 1 :] for x in edge for i in range(len(x))}
        out |= edge
    return out


class DeleteIndex:
    """Spellings found by the deletions they share with a query."""

    def __init__(self, spellings: dict[str, object]):
        self.values = spellings
        self.longest = max(map(len, spellings), default=0)
        self.by_deletion: dict[str, set[str]] = defaultdict(set)
        for s in spellings:
            for d in deletions(s, allowed(len(s))):
                self.by_deletion[d].add(s)

    def near(self, q: str) -> list[tuple[float, str]]:
        """(weight, spelling) of all within the allowed distance."""
        if q in self.values:
            return [(0.0, q)]
        if len(q) > self.longest + 2:
            return []
        found = {s for d in deletions(q, allowed(len(q))) for s in self.by_deletion.get(d, ())}
        out = []
        for s in found:
            edits, weight = weighted_distance(q, s)
            if edits <= min(allowed(len(q)), allowed(len(s))):
                out.append((weight, s))
        return out


class Prefixes:
    """The trie of all spellings, followed with up to two edits: what leaves it can't begin a spelling within the allowed distance."""

    EDITS = 2

    def __init__(self, spellings: Iterable[str]):
        self.nodes: list[dict[str, int]] = [{}]
        for s in spellings:
            at = 0
            for x in s:
                if x not in self.nodes[at]:
                    self.nodes[at][x] = len(self.nodes)
                    self.nodes.append({})
                at = self.nodes[at][x]
        self.start = self._lost({(0, ""): 0})

    def _lost(self, states: dict[tuple[int, str], int]) -> dict[tuple[int, str], int]:
        """``states`` and what they reach by letters that were not typed."""
        for e in range(self.EDITS):
            for (at, wait), had in list(states.items()):
                if had == e and not wait:
                    for v in self.nodes[at].values():
                        if states.get((v, ""), 9) > e + 1:
                            states[v, ""] = e + 1
        return states

    def feed(self, states: dict[tuple[int, str], int], typed: str) -> dict[tuple[int, str], int]:
        """Edits of each (node, second letter of a swap that is open) after more letters."""
        for x in typed:
            out: dict[tuple[int, str], int] = {}

            def put(at: int, wait: str, e: int) -> None:
                if e <= self.EDITS and e < out.get((at, wait), 9):  # noqa: B023
                    out[at, wait] = e  # noqa: B023

            for (at, wait), e in states.items():
                if wait:
                    if wait == x:
                        put(at, "", e)
                    continue
                put(at, "", e + 1)
                for y, v in self.nodes[at].items():
                    put(v, "", e + (x != y))
                    if x != y and x in self.nodes[v]:
                        put(self.nodes[v][x], y, e + 1)
            states = self._lost(out)
            if not states:
                break
        return states


class Canonicaliser:
    """Maps values to entries; built once a task from the broadcast list of (id, text, frequency)."""

    def __init__(self, entries: list[tuple[int, str, int]]):
        split = {i: tuple(re.findall(r"[^\W_]+", fold(t).lower())) for i, t, _ in entries}
        split = {i: ws for i, ws in split.items() if ws}
        self.frequency = {i: n for i, _, n in entries}
        first, inner = defaultdict(set), set()
        for ws in split.values():
            first[ws[0]].add(ws[1:])
            inner |= set(ws[1:])
        # a first word with several remainders, some of which stand alone, that begins names only, is a level
        alone = set(split.values())
        self.levels = {w for w, rest in first.items() if len(rest) >= 2 and w not in inner and any(r in alone for r in rest)}
        self.entry: dict[tuple[str, str], int] = {}
        roles: dict[str, tuple[str, ...]] = {}
        for i, ws in sorted(split.items()):
            level = ws[0] if ws[0] in self.levels and len(ws) > 1 else ""
            role = ws[1:] if level else ws
            roles["".join(role)] = role
            self.entry.setdefault((level, "".join(role)), i)
        spell: dict[str, tuple[str, str]] = {r: ("", r) for r in roles}
        for level, role in self.entry:
            if level:
                spell.setdefault(level + role, (level, role))
                spell.setdefault(role + level, (level, role))
        shorts: dict[str, list[str]] = defaultdict(list)
        for short, meant in SHORT.items():
            for w in meant.split():
                shorts[w].append(short)
        for key, r in sorted(roles.items()):
            # joined words whose last one is shortened
            for short in shorts[r[-1]] if len(r) > 1 else ():
                spell.setdefault("".join(r[:-1]) + short, ("", key))
        self.index = DeleteIndex(spell)
        self.prefixes = Prefixes(spell)
        self.words = {w for r in roles.values() for w in r} | self.levels
        self.word_index = DeleteIndex(dict.fromkeys(self.words))
        holding: dict[tuple[str, str], set[str]] = defaultdict(set)
        for w in self.words:
            for x in set(w[1:]):
                holding[w[0], x].add(w)
        self.holding = {k: frozenset(v) for k, v in holding.items()}
        self.most_words = max(map(len, roles.values()), default=0)
        self.initials: dict[str, set[str]] = defaultdict(set)
        self.whole_initials: dict[str, set[str]] = defaultdict(set)
        for key, r in roles.items():
            if len(r) > 1:
                self.whole_initials["".join(w[0] for w in r)].add(key)
            for a in range(len(r)):
                for b in range(a + 2, len(r) + 1):
                    self.initials["".join(w[0] for w in r[a:b])].add("".join(r[a:b]))
        self.short = DeleteIndex(dict.fromkeys(s for s in SHORT if len(s) >= 4))
        self._expanded: dict[str, list[tuple[float, str]]] = {}
        self._windows: dict[str, tuple | None] = {}

    def longer(self, word: str) -> Iterable[str]:
        """Words that begin with the same letter and hold the others: those that ``word`` may shorten are among them."""
        held = [self.holding.get((word[0], x), frozenset()) for x in set(word[1:])]
        held.sort(key=len)
        return frozenset.intersection(*held) if held else ()

    def level(self, word: str) -> str | None:
        if word in self.levels:
            return word
        for x in SHORT.get(word, "").split():
            if x in self.levels:
                return x
        if len(word) >= 5:
            near = [s for _, s in sorted(self.word_index.near(word)) if s in self.levels]
            if near:
                return near[0]
        return None

    def expand(self, word: str, deep: bool = True) -> list[tuple[float, str]]:
        """(weight, spelling) of what a word may stand for, itself with its own letters among them."""
        if len(word) > self.index.longest + 2:
            return [(0.0, word)]
        key = word if deep else "\0" + word
        known = self._expanded.get(key)
        if known is not None:
            return known
        if len(self._expanded) > 200_000:
            self._expanded.clear()
        out: dict[str, float] = {}

        def add(s: str, w: float) -> None:
            out[s] = min(w, out.get(s, 9.0))

        if word in self.words:
            add(word, 0.0)
        else:
            for x in SHORT.get(word, "").split():
                add(x, 0.1)
            if len(word) >= 4:
                for w, s in self.short.near(word):
                    for x in SHORT[s].split():
                        add(x, 0.6 + w)
            for x in self.initials.get(word, ()):
                add(x, 0.3)
            for w, s in self.word_index.near(word):
                add(s, w)
            if len(word) >= 3 and min(out.values(), default=9.0) > 0.8:
                for s in self.longer(word):
                    if shortens(word, s):
                        add(s, 0.8 + 0.2 * (1 - len(word) / len(s)))
            if len(word) >= 5 and not out:
                # a short form with a slip: one of its letters isn't the word's
                for t in {word[:i] + word[i + 1 :] for i in range(1, len(word))}:
                    for s in self.longer(t):
                        if shortens(t, s) and 2 * len(t) >= 0.8 * len(s):
                            add(s, 1.8 + 0.2 * (1 - len(t) / len(s)))
            if deep and not out and len(word) >= 5:
                for i in range(2, len(word) - 2):
                    left = self.expand(word[:i], False)
                    if left and left[0][0] <= 0.3:
                        for (wl, a), (wr, b) in product(left, self.expand(word[i:], len(word) - i >= 5)):
                            if wr < 2 and b != word[i:] or b in self.words:
                                add(a + b, wl + wr + 0.2)
            if deep:
                add(word, 0.0 if not out else 0.5)
        self._expanded[key] = sorted((w, s) for s, w in out.items())
        return self._expanded[key]

    def spellings(self, words: list[str]) -> list[tuple[float, str]]:
        """Weighted squeezed spellings of a window, as typed and with its words expanded."""
        out = {"".join(words): 0.0}

        def add(s: str, w: float) -> None:
            if w < out.get(s, 9.0):
                out[s] = w

        choices = [self.expand(w) for w in words]
        # what the words that follow weigh at least
        least = [sum(c[0][0] for c in choices[i:]) for i in range(len(words) + 1)]
        pruned = prod(map(len, choices)) > MANY

        def go(i: int, s: str, w: float, states: dict) -> None:
            if i == len(words):
                add(s, w)
                return
            for x, t in choices[i]:
                if w + x + least[i + 1] > MOST_WEIGHT + 5e-4:
                    break
                after = self.prefixes.feed(states, t) if pruned else states
                if after:
                    go(i + 1, s + t, w + x, after)

        go(0, "", 0.0, self.prefixes.start)
        return [(w, s) for s, w in out.items()]

    def _best(self, words: list[str]) -> tuple[float, int, str, str] | None:
        """(weight, -frequency, level, role) of the best entry that the window spells."""
        key = " ".join(words)
        if key in self._windows:
            return self._windows[key]
        if len(self._windows) > 300_000:
            self._windows.clear()
        found = []
        for w, s in self.spellings(words):
            if len(s) < 4 and s not in self.index.values:
                continue
            for d, hit in self.index.near(s):
                level, role = self.index.values[hit]
                # letters lost by expansion and slips are both paid for
                found.append((round(w + d, 3), -self.frequency.get(self.entry.get((level, role), 0), 0), level, role))
        self._windows[key] = min(found) if found else None
        return self._windows[key]

    @staticmethod
    def tokens(text: str) -> list[tuple[str, bool]]:
        """(word, begins a segment): camel case and hyphens split words, brackets, dashes and other signs segments."""
        s = fold(text)
        s = re.sub(r"(?i)\bs/w-?(?=[A-Za-z]|\b)", "sw ", s)
        s = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m.group().replace(".", "") + " ", s)
        s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])|(?<=[A-Z])(?=[A-Z][a-z]{2})", " ", s)
        s = re.sub(r"(?<=[a-z])(?=[A-Z]{2})", " ", s)
        s = re.sub(r"(?<=\w)-(?=\w)", " ", s)
        out: list[tuple[str, bool]] = []
        begins = True
        for m in re.finditer(r"[^\W_]+|[|•/,:;()\[\]–—*]|\s-\s?|-\s", s):
            if re.match(r"[^\W_]", m.group()):
                out.append((m.group().lower(), begins))
                begins = False
            else:
                begins = True
        return out

    def match(self, text: str, free: bool) -> int:
        """The entry's id, 0 if none. ``free``: the value may hold other text around the entry, as a headline does."""
        toks = self.tokens(text or "")
        words = [w for w, _ in toks]
        if not words:
            return 0
        if not free:
            kept = [(w, b) for w, b in toks if w not in NOISE and not _NUMBER.fullmatch(w)]
            roles = self.whole_initials.get("".join(w for w, _ in kept)) if len(kept) == 1 or all(len(w) == 1 for w, _ in kept) else None
            usual = [r for w, _ in kept[:1] for r in SHORT.get("".join(x for x, _ in kept), "").split() if ("", r) in self.entry]
            if usual:
                return self.entry[("", usual[0])]
            if roles:
                ids = [self.entry[("", r)] for r in roles if ("", r) in self.entry]
                if ids:
                    return min(ids, key=lambda i: (-self.frequency.get(i, 0), i))
        best = None
        n = len(words)
        most = self.most_words + 2
        for a in range(n):
            for b in range(a + 1, min(n, a + most) + 1):
                if free and any(toks[k][1] for k in range(a + 1, b)):
                    break
                hit = self._best(words[a:b])
                if hit is None or free and b - a == 1 and len(words[a]) < 5 and words[a] not in self.whole_initials and words[a] not in self.index.values:
                    continue
                weight, freq, level, role = hit
                if hit[0] > MOST_WEIGHT:
                    continue
                rank = (-len(role) + 3 * weight, weight, freq, a)
                if best is None or rank < best[0]:
                    best = (rank, a, b, level, role)
        if best is None and not free and 2 <= len(kept) <= 4:
            # words in another order, as in an inverted index entry
            for k in range(1, len(kept)):
                hit = self._best([w for w, _ in kept[k:] + kept[:k]])
                if hit and hit[0] <= 2:
                    return self.entry.get((hit[2], hit[3]), 0)
        if best is None:
            return 0
        _, a, b, level, role = best
        rest = list(range(a)) + list(range(b, n))
        if not level:
            if a > 0 and (lv := self.level(words[a - 1])) and (not toks[a][1] or a == 1 or toks[a - 1][1]):
                level = lv
                rest.remove(a - 1)
            elif b < n and (lv := self.level(words[b])) and (b + 1 == n or toks[b + 1][1] or not toks[b][1] or words[b + 1] in NOISE or words[b + 1] in LINKING):
                level = lv
                rest.remove(b)
        if not free and any(words[k] not in NOISE and not _NUMBER.fullmatch(words[k]) for k in rest):
            return 0
        return self.entry.get((level, role), 0)


_MATCHERS: dict[tuple, Canonicaliser] = {}


def map_values(values: DataFrame, references: dict[str, list[tuple[int, str, int]]], field_list: dict[str, tuple[str, bool]]) -> DataFrame:
    """Rows (field_name, typed_value, ref_id) of distinct values (field_name, typed_value), 0 where no entry is meant.

    ``references``: entries of each list; ``field_list``: for each field its list and whether other text may stand around
    the entry.
    """
    for entries in references.values():
        if len(entries) > MAX_ENTRIES or any(len(t) > MAX_LETTERS for _, t, _ in entries):
            raise ValueError("the reference list is too large to broadcast")
    sent = values.sparkSession.sparkContext.broadcast(references)
    stamp = hash(tuple((k, tuple(v)) for k, v in sorted(references.items())))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = []
            for f, v in zip(b["field_name"], b["typed_value"], strict=True):
                name, free = field_list[f]
                m = _MATCHERS.get((stamp, name))
                if m is None:
                    m = _MATCHERS[stamp, name] = Canonicaliser(sent.value[name])
                ids.append(m.match(v, free))
            yield pd.DataFrame({"field_name": b["field_name"], "typed_value": b["typed_value"], "ref_id": pd.Series(ids, dtype="int32")})

    return values.mapInPandas(work, "field_name string, typed_value string, ref_id int")


def _entries(ref: DataFrame, name: str, typed: DataFrame) -> list[tuple[int, str, int]]:
    """(id, text, how often it was typed as it stands) of a reference list; null and blank entries are left out."""
    r = ref.where(~is_blank(F.col(name)) & F.col("ref_id").isNotNull()).select("ref_id", F.col(name).alias("entry")).distinct()
    n = typed.groupBy(F.lower(F.trim("typed_value")).alias("k")).agg(F.sum("n").alias("n"))
    got = r.join(n, F.lower(F.trim("entry")) == F.col("k"), "left").select("ref_id", "entry", F.coalesce("n", F.lit(0)).alias("n")).orderBy("ref_id").limit(MAX_ENTRIES + 1).collect()
    return [(x[0], x[1], x[2]) for x in got]


def typed_values(candidates: DataFrame, skills: DataFrame) -> DataFrame:
    """Distinct non-blank values (field_name, typed_value, n) of the three fields."""
    pool = candidates.select(F.explode(F.array(F.struct(F.lit("current_title").alias("f"), F.col("current_title").alias("v")), F.struct(F.lit("headline").alias("f"), F.col("headline").alias("v")))).alias("x")).select("x.f", "x.v")
    pool = pool.unionAll(skills.select(F.lit("skill_name"), F.col("name")))
    return pool.where(~is_blank(F.col("v"))).groupBy(F.col("f").alias("field_name"), F.col("v").alias("typed_value")).agg(F.count("*").alias("n"))


def mapped(candidates: DataFrame, skills: DataFrame, ref_titles: DataFrame, ref_skills: DataFrame) -> DataFrame:
    """Rows (field_name, typed_value, ref_id) of every different non-blank title, headline and skill name."""
    typed = typed_values(candidates, skills)
    refs = {"titles": _entries(ref_titles, "title", typed.where("field_name = 'current_title'")), "skills": _entries(ref_skills, "name", typed.where("field_name = 'skill_name'"))}
    # matching costs far more than its few bytes suggest: distinct values are spread over all cores
    spread = typed.select("field_name", "typed_value").repartition(2 * candidates.sparkSession.sparkContext.defaultParallelism)
    return map_values(spread, refs, {"current_title": ("titles", False), "headline": ("titles", True), "skill_name": ("skills", False)})
