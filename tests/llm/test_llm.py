"""Operators of the llm subpackage against brute force, a published tokenizer, SQL and labelled spellings."""

import datetime as dt
import itertools
import json
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import compare, connect
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.llm import canonical, components, fusion, leakage, names, near, queries, spans, tokenize, twins


# ---- 1: fusion

CLAIM = "g string, field string, member string, source string, value string, pref double, posterior string"


def test_strict_prior_takes_the_best_usable_value(spark):
    rows = [("g", "f", "B", "s1", "5", 5.0, "x"), ("g", "f", "A", "s1", "5", 5.0, "x"), ("g", "f", "C", "s2", "4", 4.0, "x"), ("g", "f", "D", None, "9", None, "x"), ("g", "f", "E", "s2", "9", float("nan"), "x"), ("h", "f", "A", "s1", None, 1.0, "x"), ("i", "f", "A", "s1", "3", None, "x")]
    got = fusion.fuse(spark.createDataFrame(rows * 3, CLAIM)).collect()
    assert [(r["g"], r["value"], r["member"]) for r in got] == [("g", "5", "A")]
    assert fusion.fuse(spark.createDataFrame([], CLAIM)).count() == 0
    with pytest.raises(ValueError):
        fusion.fuse(spark.createDataFrame([], CLAIM), prior="none")


def test_votes_of_copiers_are_discounted(spark):
    """Five sources err on their own; three others copy one bad source and outvote them where three err."""
    rng = random.Random(4)
    rows = []
    for g in range(120):
        truth, lie = f"t{g}", f"l{g}"
        for s in ("a1", "a2", "a3", "a4", "a5"):
            rows.append((f"g{g}", "f", s, s, truth if rng.random() < 0.7 else f"{s}{g}", 1.0, ""))
        bad = lie if rng.random() < 0.5 else truth
        rows += [(f"g{g}", "f", s, s, bad, 1.0, "") for s in ("c0", "c1", "c2")]
    out = fusion.fuse(spark.createDataFrame(rows, CLAIM), prior="flat", rounds=4).collect()
    right = sum(r["value"] == "t" + r["g"][1:] for r in out)
    majority = sum(Counter(x[4] for x in rows if x[0] == r["g"]).most_common(1)[0][0] == "t" + r["g"][1:] for r in out)
    assert right > majority and right >= 110
    assert fusion.copy_probability(10, 30, 5, 0.7, 0.7) > 0.99 > 0.3 > fusion.copy_probability(30, 0, 30, 0.7, 0.7)


def test_many_sources_are_one(spark):
    rows = [("g", "f", f"m{i:03d}", f"s{i:03d}", "v" if i % 3 else "w", 1.0, "") for i in range(2 * fusion.MAX_SOURCES)]
    assert [tuple(r)[:4] for r in fusion.fuse(spark.createDataFrame(rows, CLAIM), prior="flat").collect()] == [("g", "f", "v", "m001")]


def test_votes_change_the_posterior_of_the_strict_prior(spark):
    claims = [("g", "f", "A", "s1", "5", 5.0, ""), ("g", "f", "B", "s2", "4", 4.0, "")]
    one = fusion.fuse(spark.createDataFrame(claims, CLAIM), rounds=0).first()
    more = fusion.fuse(spark.createDataFrame([*claims, ("g", "f", "C", "s3", "4", 4.0, ""), ("g", "f", "D", "s4", "4", None, "")], CLAIM), rounds=0).first()
    vote = math.log(fusion.FALSE_VALUES * 4)
    assert one["value"] == more["value"] == "5" and one["margin"] == pytest.approx(fusion.PREFERENCE) and more["margin"] == pytest.approx(fusion.PREFERENCE - 2 * vote)
    assert fusion.PREFERENCE > fusion.MAX_SOURCES * math.log(fusion.FALSE_VALUES * 0.98 / 0.02)
    flat = fusion.fuse(spark.createDataFrame(claims, CLAIM), prior="flat", rounds=0).first()
    assert flat["value"] == "5" and 0.4 < flat["posterior"] < 0.5 and flat["margin"] == 0.0


def test_copiers_that_mostly_agree_on_truth(spark):
    """Two sources share false values, though most of what they agree on is true; independent ones err alone."""
    rng = random.Random(6)
    rows = []
    for g in range(150):
        truth = f"t{g}"
        for s in ("a", "b", "c"):
            rows.append((f"g{g}", "f", s, s, truth if rng.random() < 0.75 else f"{s}{g}", 1.0, ""))
        said = truth if rng.random() < 0.7 else f"lie{g}"
        rows += [(f"g{g}", "f", s, s, said, 1.0, "") for s in ("x", "y", "z")]
    out = fusion.fuse(spark.createDataFrame(rows, CLAIM), prior="flat", rounds=4).collect()
    right = sum(r["value"] == "t" + r["g"][1:] for r in out)
    groups = defaultdict(Counter)
    for x in rows:
        groups[x[0]][x[4]] += 1
    majority = sum(c.most_common(1)[0][0] == "t" + g[1:] for g, c in groups.items())
    assert right > majority + 5 and right >= 125


def test_twins_edges(spark):
    c = spark.createDataFrame([("B", " X  y ", "h", None, "[]", 50.0, None), ("A", "x Y", "H", "", "[]", None, False), ("A", "x Y", "H", "", "[]", 700.0, False), ("C", "z", "h", None, "[]", None, None), (None, "x y", "h", "", "[]", None, None)], "candidate_id string, anonymized_name string, headline string, summary string, skill_names_json string, profile_completeness_score double, verified_phone boolean")
    t = spark.createDataFrame([("A", 0.4), ("B", 1.2), ("B", None)], "candidate_id string, behavioral_strength double")
    ts = lambda d: dt.datetime(2026, 1, d)
    s = spark.createDataFrame([("A", ts(1), 50.0, dt.date(2026, 1, 1)), ("A", ts(2), 300.0, dt.date(2027, 1, 1)), ("B", ts(3), 50.0, dt.date(2026, 2, 1))], "candidate_id string, snapshot_at timestamp, profile_completeness_score double, last_active_date date")
    assert [tuple(r) for r in twins.best_members(c, t, s).collect()] == [("A", "A", "A", "B")]
    assert [tuple(r) for r in twins.best_members(c, t.limit(0), s.limit(0)).collect()] == [("A", "", "", "")]
    assert twins.best_members(c.limit(0), t, s).count() == 0


# ---- 2: near duplicates


def bags(rows):
    return {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows if i is not None}


def brute_classes(rows, threshold):
    b = bags(rows)
    parent = {i: i for i in b}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in b:
        for j in b:
            if i < j and ((u := sum((b[i] | b[j]).values())) == 0 or sum((b[i] & b[j]).values()) >= threshold * u - 1e-9):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in b}


def edited(rng, words, share):
    w = list(words)
    for _ in range(int(len(w) * share)):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.pop(k), lambda: w.insert(k, rng.choice(words)), lambda: w.__setitem__(k, f"new{rng.randrange(999)}")])()
    return w


@pytest.mark.parametrize("small, most_rows", [(near.SMALL, near.MOST_ROWS), (4, near.MOST_ROWS), (4, 12), (2, 8)])
def test_near_classes_against_brute_force(spark, small, most_rows, monkeypatch):
    """Also with buckets that are large up to the last level, in memory and as tables."""
    monkeypatch.setattr(near.similar_pairs, "__defaults__", (near.RECALL, small, near.LEVELS if most_rows > 10 else 2, most_rows, near.MOST_TOKENS))
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for c in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))]
        rows += [(f"{c:03d}-{k}", " ".join(edited(rng, base, rng.choice([0, 0.02, 0.06])))) for k in range(rng.randint(1, 5))]
    crowd = [rng.choice(vocabulary) for _ in range(50)]
    rows += [(f"x{k:03d}", " ".join(edited(rng, crowd, 0.04))) for k in range(60)]
    rows += [("e1", ""), ("e2", None), ("e3", "..."), (None, "w1 w2"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("node", F.lit(1)).withColumn("path", F.lit("p"))
    from loomspark.functions.text import words

    got = {r["id"]: r["class_id"] for r in near.near_classes(df, "id", words(F.col("t")), 0.7).collect()}
    want = brute_classes(rows, 0.7)
    pairs = lambda m: {(a, b) for a in m for b in m if a < b and m[a] == m[b]}
    assert set(got) == set(want) and pairs(got) <= pairs(want)
    assert len(pairs(got)) >= 0.995 * len(pairs(want))
    assert near.near_classes(df.limit(0), "id", words(F.col("t")), 0.7).count() == 0


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 16, rng.integers(1, 300)))
        b = np.unique(np.r_[rng.choice(a, rng.integers(0, len(a) + 1), replace=False), rng.integers(0, 1 << 16, 20)])
        x, y = near.parity_sketches(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_recall_at_the_threshold(spark):
    """Pairs at the threshold among buckets that never get small, with the production number of roots."""
    rng = np.random.default_rng(7)
    kinds, pairs, union = np.arange(3000), 4000, 100
    rows = []
    for p in range(pairs):
        t = rng.choice(kinds, union, replace=False)
        for side in (0, 1):
            rows.append((f"{p:05d}-{side}", " ".join(f"k{x}" for x in np.r_[t[:70], t[70:85] if side else t[85:]])))
    from loomspark.functions.text import words

    got = near.near_classes(spark.createDataFrame(rows, "id string, t string"), "id", words(F.col("t")), 0.7).toPandas()
    found = got.groupby("class_id").size()
    assert (found == 2).sum() >= 0.9985 * pairs and near.roots(0.7) == 5 and 0.88 < near.path_recall(0.7) < 0.89


def test_path_recall_by_simulation():
    rng = np.random.default_rng(3)
    trials, hit = 600, 0
    for _ in range(trials):
        t = rng.choice(1 << 16, 100, replace=False)
        sets = [np.unique(np.r_[t[:70], t[70:85] if s else t[85:]]) for s in (0, 1)]
        flat, off = np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        paths = [np.array([rng.integers(1 << 60)], dtype=np.uint64)] * 2
        for _ in range(near.LEVELS):
            paths = [near.children(near.token_hashes(flat), off, np.full(len(p), s), p)[1] for s, p in enumerate(paths)]
            paths = [np.intersect1d(*paths)] * 2
        hit += len(paths[0]) > 0
    assert hit / trials == pytest.approx(near.path_recall(0.7), abs=0.045)


def test_numbered_sets_are_the_multisets():
    h = np.array([5, 5, 5, 9, 5, 5, 9, 9], dtype=np.int64)
    flat, off = near.numbered_sets(h, np.array([0, 4, 4, 8]))
    a, empty, b = (flat[x:y] for x, y in zip(off, off[1:], strict=False))
    assert len(a) == 4 and len(b) == 4 and len(np.intersect1d(a, b)) == 3 and not len(empty)
    assert near.numbered_sets(np.zeros(0, np.int64), np.zeros(1, np.int64))[1].tolist() == [0]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(900, x) for x in range(901, 960)] + [(1, 1), (None, 2)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


# ---- 3: names

SAME = [
    ["Vextaljor Calfanlen Systems Private Limited", "Systems Vextaljor Calfanlen", "Sys V. Calfanlen Pvt. Ltd.", "VextaljorCalfanlen Systems P Ltd", "Vextaljor Cálfánlén Systms (P) Ltd", "vextaljor  calfnalen systems (VCS)"],
    ["Penor Janlorkes Consulting Limited", "PenJan Conslt. Ltd. (PJC)", "M/s Penor-Janlorkes Consulting LTD,", "penor janlorrkes conslt."],
    ["Bortornes Bacendor College of Engineering", "C.O.E., Bortornes Bacendor", "bortornes-bacendor engg college"],
    ["University of Felzan Ollamcal", "Felzan Ollamcal University", "Univ. of F. Ollamcal", "UNI OF FELZNA OLLAMCAL"],
    ["Vextaljor Sevmarlen Foods"], ["Penor Tamdalven Energy LLP"], ["Felzan Tordalbri Institute of Technology", "Felzan Tordalbri I.T."],
]


def test_names(spark):
    rows = [(n,) for group in SAME for k, n in enumerate(group) for _ in range(9 if k == 0 else 1 + k % 2)] + [(None,), (" ",)]
    df = spark.createDataFrame(rows, "name string")
    got = {tuple(r) for r in names.name_pairs(df).collect()}
    assert got == {tuple(sorted((a, b))) for g in SAME for a in g for b in g if a < b}
    assert {r["canonical"] for r in names.organisation_classes(df).collect()} == {g[0] for g in SAME}
    assert names.name_pairs(df.limit(0)).count() == 0


def test_letters_rule_out_no_likely_pair():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwxyz") for _ in range(rng.randint(4, 10)))
    likely = 0
    for _ in range(20_000):
        core = [word() for _ in range(rng.choice([1, 2, 2, 2, 3]))]
        said = list(core)
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(said))
            w = said[k]
            i = rng.randrange(len(w)) if w else 0
            said[k] = rng.choice([w[:1], w[: rng.randint(1, 4)], w[:i] + w[i + 1 :], w[:i] + rng.choice("qxyz") + w[i:], w[:i] + "q" + w[i + 1 :], w[:1] + "".join(x for x in w[1:] if x not in "aeiou"), w])
        if rng.random() < 0.3:
            said = ["".join(said)] if rng.random() < 0.5 else said[::-1]
        v, c = (tuple(x for x in said if x), (), ()), (tuple(core), (), ())
        if v[0] and names.likelihood(v, c) > names.LEAST:
            likely += 1
            assert ((names.letters(v[0]) & ~names.letters(c[0])) & ((1 << 64) - 1)).bit_count() <= 2
    assert likely > 2000


def test_a_common_word_makes_no_large_work(spark):
    rng = random.Random(5)
    other = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(9)) for _ in range(3000)]
    rows = [(f"Global X{w}",) for w in other for _ in range(2)] + [(f"Global X{other[0][:4]}{other[0][5:]}",), (f"X{other[1]}, Global",)]
    got = {tuple(r) for r in names.name_pairs(spark.createDataFrame(rows, "name string")).collect()}
    want = {tuple(sorted((f"Global X{other[0]}", rows[-2][0]))), tuple(sorted((f"Global X{other[1]}", rows[-1][0])))}
    assert want <= got and len(got) < 60
    links = {r["name"]: r["links"] for r in names.organisation_classes(spark.createDataFrame(rows[:2] + rows[-2:-1], "name string")).collect()}
    assert links == {rows[0][0]: 1, rows[-2][0]: 1}


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
@settings(max_examples=200, deadline=None)
def test_distances_agree(a, b):
    assert names.distance(a, b, 9) == names.distance(b, a, 9) <= max(len(a), len(b))
    assert canonical.weighted_distance(a, b)[0] >= names.distance(a, b, 9) and (a != b or canonical.weighted_distance(a, b) == (0, 0.0))


# ---- 6: reference lists

TITLES = ["Senior Data Engineer", "Data Engineer", "Lead Data Engineer", "Junior User Experience Designer", "User Experience Designer", "Senior User Experience Designer", "Search Relevance Engineer", "Senior Search Relevance Engineer", "Lead Search Relevance Engineer", "Quality Assurance Analyst", "Site Reliability Engineer", "Lead Software Developer", "Software Developer", "Junior Software Developer"]
TYPED = {
    "Sr. Data Engg": "Senior Data Engineer", "DATA-ENGINEER (Lead)": "Lead Data Engineer", "Jnr UX Designre": "Junior User Experience Designer", "searchrelevanceengr": "Search Relevance Engineer", "Data Engineer, Snr / hands-on": "Senior Data Engineer",
    "qaanlst": "Quality Assurance Analyst", "SRE": "Site Reliability Engineer", "Ld. S/W-Developer": "Lead Software Developer", "Junior Data Engineer": None, "Beekeeper": None, "-": None, "Data Enginee (contract)": "Data Engineer",
}
HEADLINES = {"Ex-Foo | Sr Data Engineer at heart": "Senior Data Engineer", "Ask me about data": None, "10+ years • Software Developer - Jr. • Freight": "Junior Software Developer", "Former data hobbyist, engineer of bridges": None}
SKILLS = ["Time Series Forecasting", "Contract Negotiation", "Supply Chain Planning", "Balordeck", "Balordeck Cloud", "Data Modelling"]
SKILLED = {"time series forcasting v4": "Time Series Forecasting", "Contract Negotiation certified": "Contract Negotiation", "S.C.P.": "Supply Chain Planning", "scp": "Supply Chain Planning", "balor deck": "Balordeck", "BALORDECK CLUOD": "Balordeck Cloud", "Modelling, Data": "Data Modelling", "Calordack": None, "fast learner!!": None, "x" * 5000: None}


def test_canonical(spark):
    c = spark.createDataFrame([(t, h) for t, h in zip([*TYPED, None, " "], [*HEADLINES] + [None] * (len(TYPED) - 2), strict=True)], "current_title string, headline string")
    s = spark.createDataFrame([(n,) for n in [*SKILLED, None, "", *["scp"] * 5]], "name string")
    rt = spark.createDataFrame([(i + 1, t) for i, t in enumerate(TITLES)], "ref_id int, title string")
    rs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(SKILLS)], "ref_id int, name string")
    got = {(r["field_name"], r["typed_value"]): r["ref_id"] for r in canonical.mapped(c, s, rt, rs).collect()}
    at = lambda lst, x: 0 if x is None else lst.index(x) + 1
    want = {("current_title", k): at(TITLES, v) for k, v in TYPED.items()} | {("headline", k): at(TITLES, v) for k, v in HEADLINES.items()} | {("skill_name", k): at(SKILLS, v) for k, v in SKILLED.items()}
    assert got == want
    assert {r["ref_id"] for r in canonical.mapped(c, s, rt.limit(0), rs.limit(0)).collect()} == {0}


def test_all_meanings_of_short_forms_are_tried(spark, monkeypatch):
    skills = ["Container Orchestration", "Continuous Integration", "Contract Negotiation", "Control Systems", "Content Strategy", "Conflict Resolution", "Technical Interviewing", "Technical Writing", "Incident Response", "Information Retrieval", "Integration Testing", "Stream Processing", "Process Design", "Product Strategy", "Program Delivery", "Project Planning", "Workforce Scheduling", "Schema Design", "School Outreach", "Science Writing"]
    typed = {"Cont. Orchestration": "Container Orchestration", "Con Integration": "Continuous Integration", "Con Intgeratoin": "Continuous Integration", "Technical Int": "Technical Interviewing", "Stream Pro": "Stream Processing", "Workforce Sch": "Workforce Scheduling", "Con Negotiation": "Contract Negotiation", "Con Beekeeping": None}
    for many in (canonical.MANY, 0):
        monkeypatch.setattr(canonical, "MANY", many)
        m = canonical.Canonicaliser([(i + 1, t, 0) for i, t in enumerate(skills)])
        assert {k: m.match(k, False) for k in typed} == {k: skills.index(v) + 1 if v else 0 for k, v in typed.items()}


def test_short_entries_are_matched_exactly():
    m = canonical.Canonicaliser([(1, "SQL", 0), (2, "Git", 0), (3, "Data Modelling", 0)])
    assert [m.match(t, False) for t in ("SQL", "git", "sql v4", "sqk", "gi", "data modeling")] == [1, 2, 1, 0, 0, 3]
    assert [m.match(t, True) for t in ("Ex-Foo | SQL at heart", "sqk at heart")] == [1, 0]


@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=5), st.text("abc", max_size=6))
@settings(max_examples=200, deadline=None)
def test_prefixes_lose_nothing(spellings, typed):
    trie = canonical.Prefixes(spellings)
    near = any(canonical.weighted_distance(typed, s[:k])[0] <= 2 for s in spellings for k in range(len(s) + 1))
    assert bool(trie.feed(trie.start, typed)) or not near


# ---- 7: tokenizer


@pytest.fixture(scope="module")
def library():
    if not os.path.exists(tokenize.VOCABULARY):
        pytest.skip("no vocabulary here")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenize.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_encoder_against_the_library(library):
    enc = tokenize.TrieEncoder(*tokenize.load_vocabulary())
    rng = random.Random(1)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "é", "😀", "ß", "क", "्", "1", "22", "!", "...", "<|endoftext|>", "'s", " ", "A", "THE", "aaaaaaaa", "=====", "x" * 300, "\x00", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["a" * 20_000, "ab" * 5000, " " * 3000]
    flat, at = enc.encode_batch(texts)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_encode_texts(spark, library):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 5), (3, "", 5), (3, "", 5), (4, " \n", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokenize.encode_texts(df).collect())
    assert got == sorted([(1, library.encode("Hello world").ids), (2, []), (3, []), (3, []), (4, library.encode(" \n").ids)])
    assert tokenize.encode_texts(df.limit(0)).count() == 0


# ---- 8: leakage


def brute_runs(docs, items, n):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = defaultdict(set)
    for i, t in items:
        ws = w(t)
        for k in range(len(ws) - n + 1):
            grams[tuple(ws[k : k + n])].add(i)
    return {(d, i) for d, t in docs for ws in [w(t)] for k in range(len(ws) - n + 1) for i in grams.get(tuple(ws[k : k + n]), ())}


def test_leakage_against_brute_force(spark):
    rng = random.Random(8)
    v = ["the"] * 5 + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(3, 40)))) for i in range(25)] + [(90, None), (91, ""), (92, "the " * 30)]
    docs = []
    for d in range(120):
        t = [rng.choice(v) for _ in range(60)]
        if d % 2:
            ws = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(ws))
            t[10:10] = ws[a : a + rng.randint(10, 30)]
        docs.append((d, rng.choice([" ", ", ", "-"]).join(t).upper()))
    docs += [(500, None), (501, ""), (502, "THE! " * 20_000), (503, items[3][1]), (503, items[3][1])]
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("x")).withColumn("item", F.lit(1))
    ii = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc", F.lit(1))
    for n in (1, 5, 13):
        assert {tuple(r) for r in leakage.leaked(dd, ii, n).collect()} == brute_runs(docs, items, n)
    assert leakage.leaked(dd.limit(0), ii).count() == 0 and leakage.leaked(dd, ii.limit(0)).count() == 0


def brute_near(docs, items, n, slack, least):
    """All (doc, item): share, from every band of every document, without anchors."""
    out = {}
    for i, ws in items:
        for d, t in docs if len(ws) >= n else ():
            bands = defaultdict(set)
            for q, w in enumerate(ws):
                for p, x in enumerate(t):
                    if x == w:
                        for b in (math.floor((p - q) / slack), math.floor((p - q) / slack) + 1):
                            bands[b].add(q)
            k = max(map(len, bands.values()), default=0)
            if k / len(ws) >= least:
                out[d, i] = round(k / len(ws), 9)
    return out


@pytest.mark.parametrize("n, slack, least", [(4, 3, 0.6), (13, 5, 0.6), (1, 2, 0.9), (13, 5, 0.3)])
def test_near_passages_against_brute_force(spark, n, slack, least):
    rng = random.Random(13)
    v = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(v) for _ in range(rng.randint(3, 30))]) for i in range(12)]
    items += [(50, [f"u{i}" for i in range(13)]), (51, [f"x{i}" if i in (8, 17) else f"r{i}" for i in range(28)]), (52, [f"s{i}" for i in range(28)])]
    docs = []
    for d in range(60):
        t = [rng.choice(v) for _ in range(40)]
        t[9:9] = edited(rng, items[rng.randrange(12)][1], rng.choice([0, 0.2, 0.4]))
        docs.append((d, t))
    # one run only, copied; words that the corpus lacks; one rare word of few replaced
    docs += [(100, items[12][1]), (101, [w for w in items[13][1] if w[0] == "r"]), (102, [w if w != "s5" else "new" for w in items[14][1]]), (103, [])]
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(t)) for i, t in rows], f"{key} bigint, text string")
    want = brute_near(docs, items, n, slack, least)
    assert {(100, 50), (102, 52)} <= set(want) and (least > 0.9 or (101, 51) in want)
    for extra in (0, leakage.EXTRA):
        got = {(r["doc"], r["item"]): round(r["share"], 9) for r in leakage.near_passages(frame(docs, "doc_id"), frame(items, "item_id"), n, slack, least, extra).collect()}
        assert got == want
    assert leakage.near_passages(frame(docs, "doc_id").limit(0), frame(items, "item_id")).count() == 0


def test_near_query_returns_a_copy_of_one_run(spark, tmp_path):
    text = " ".join(f"u{i}" for i in range(13))
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, text)], "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    assert [tuple(r) for r in queries.p8_near(spark, str(tmp_path)).collect()] == [(1, 7, 1.0)]


# ---- 9: spans


def brute_spans(docs, span):
    where = defaultdict(set)
    for d, t in docs:
        for k in range(len(t or "") - span + 1):
            where[t[k : k + span]].add(d)
    out = set()
    for d, t in docs:
        run = None
        for k in range(len(t or "") - span + 1):
            if len(where[t[k : k + span]]) > 1:
                if run and k <= run[1]:
                    run[1] = k + span
                else:
                    if run:
                        out.add((d, *run))
                    run = [k, k + span]
        if run:
            out.add((d, *run))
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(9)
    alphabet = "abcdéü😀 \n"
    noise = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [noise(rng.randint(25, 120)) for _ in range(6)]
    docs = []
    for d in range(70):
        t = noise(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            t += p[a : a + rng.randint(20, 120)] + noise(rng.randint(0, 15))
        docs.append((d, t))
    docs += [(100, docs[5][1]), (101, None), (102, ""), (103, "ab" * 200), (104, "ab" * 300), (105, passages[0] * 3)]
    df = spark.createDataFrame([*docs, docs[7], docs[7]], "doc_id bigint, text string").withColumn("h", F.lit(1)).withColumn("pos", F.lit("p"))
    want = brute_spans(docs, 30)
    for few in (8, 2, 0):
        rows = [tuple(r) for r in spans.shared_spans(df, span=30, k=12, few=few).collect()]
        assert set(rows) == want and len(rows) == len(want)
    share = {r["doc_id"]: r for r in spans.shared_share(df, span=30, k=12).collect()}
    assert set(share) == {d for d, _ in docs} and share[101]["share"] == 0.0 and share[100]["share"] == 1.0
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_long_texts_are_cut_into_overlapping_pieces(spark, monkeypatch):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh") for _ in range(5000))
    monkeypatch.setattr(spans, "PIECE", 256)
    assert sum(len(cp) for _, cp in spans._pieces(a, 100)) > 5000
    seeds = set()
    for at, cp in spans._pieces(a, 100):
        h = spans._hashes(spans._sums(cp, 0), 40, 0)
        seeds |= {int(p) + at for p in spans.window_seeds(h, 61)}
    h = spans._hashes(spans._sums(spans.code_points(a), 0), 40, 0)
    assert seeds == {int(p) for p in spans.window_seeds(h, 61)}


def follows(p, q, k):
    """Whether match q may follow p in a chain: it begins after p on both sides, or overlaps it on one diagonal."""
    return p[0] + k <= q[0] and p[1] + k <= q[1] or 0 < q[0] - p[0] == q[1] - p[1] < k


def chain_score(matches, k, gap):
    steps = list(zip(matches, matches[1:], strict=False))
    covered = k + sum(min(k, q[0] - p[0]) for p, q in steps)
    return covered - gap * sum(max(0, q[0] - p[0] - k) + max(0, q[1] - p[1] - k) for p, q in steps)


@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90)), max_size=9, unique=True))
@settings(max_examples=200, deadline=None)
def test_chains(matches):
    k, gap = 20, 0.1
    got = spans.chain([m[0] for m in matches], [m[1] for m in matches], k, gap)
    assert sorted(i for _, p in got for i in p) == list(range(len(matches)))
    for score, path in got:
        row = [matches[i] for i in path]
        assert all(follows(p, q, k) for p, q in zip(row, row[1:], strict=False)) and score == pytest.approx(chain_score(row, k, gap))
    # every chain there is
    ordered = sorted(matches)
    chains = [c for n in range(1, len(ordered) + 1) for c in itertools.combinations(ordered, n) if all(follows(p, q, k) for p, q in zip(c, c[1:], strict=False))]
    assert (got[0][0] if got else 0) == pytest.approx(max((chain_score(c, k, gap) for c in chains), default=0))


def test_a_fresh_start_is_better_than_a_costly_gap():
    assert spans.chain([0, 2], [0, 153], 20, 0.1) == [(20.0, [0]), (20.0, [1])]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = next_row(row, i, x, b)
    assert spans.edits(a, b) == row[-1]


def next_row(row, i, x, b):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(row[j + 1] + 1, out[j] + 1, row[j] + (x != y)))
    return out


def test_fuzzy_passages_of_planted_pairs(spark):
    """A passage of two texts with letters changed, lost and added between exact parts is one alignment with so many edits."""
    rng = random.Random(23)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    parts = [noise(60) for _ in range(3)]
    changed = parts[0] + "XX" + parts[1][:-1] + "YZ" + parts[2]
    docs = [(1, noise(50) + "".join(parts) + noise(40)), (2, noise(30) + changed + noise(20)), (3, noise(200)), (4, None), (5, "")]
    docs += [(10 + i, noise(20) + parts[2] + noise(25)) for i in range(4)]
    df = spark.createDataFrame([*docs, docs[0]], "doc_id bigint, text string")
    for few in (8, 1):
        got = [r for r in spans.fuzzy_passages(df, span=30, k=12, few=few).collect() if (r["doc_a"], r["doc_b"]) == (1, 2)]
        assert [(r["a_start"], r["a_end"], r["b_start"], r["b_end"], r["edits"]) for r in got] == [(50, 230, 30, 213, 4)] and got[0]["identity"] == round(1 - 4 / 183, 6)
    # a gap longer than a seed's surroundings cuts the chain
    far = spark.createDataFrame([(1, parts[0] + "X" + noise(90) + "X" + parts[1]), (2, parts[0] + "Y" + noise(70) + "Y" + parts[1])], "doc_id bigint, text string")
    assert sorted((r["a_start"], r["a_end"], r["edits"]) for r in spans.fuzzy_passages(far, span=30, k=12).collect()) == [(0, 60, 0), (152, 212, 0)]
    assert spans.fuzzy_passages(df.limit(0)).count() == 0


def brute_stretches(x, y, k):
    """Longest equal stretches (place in x, place in y, size) of at least k characters."""
    out = []
    for d in range(-len(y) + 1, len(x)):
        i, end = max(0, d), min(len(x), len(y) + d)
        while i < end:
            j = i
            while j < end and x[j] == y[j - d]:
                j += 1
            if j - i >= k:
                out.append((i, i - d, j - i))
            i = j + 1
    return out


def brute_linked(x, y, span, k):
    """Whether stretches that follow each other, at most span - k characters apart, make a passage of span characters on both sides."""
    m = sorted(brute_stretches(x, y, k))
    starts = [{(a, b)} for a, b, _ in m]
    for i, (a, b, _) in enumerate(m):
        for j, (c, d, n) in enumerate(m[:i]):
            if all(0 <= g <= span - k for g in (a - c - n, b - d - n)):
                starts[i] |= starts[j]
    return any(a + n - c >= span and b + n - d >= span for (a, b, n), s in zip(m, starts, strict=True) for c, d in s)


def test_fuzzy_passages_of_all_partners(spark):
    """Every two documents with a passage are a pair: however many have it, with changes closer than a span, and copies too."""
    rng = random.Random(29)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot, parts = noise(45), [noise(rng.randint(13, 22)) for _ in range(9)]
    docs = [(d, noise(rng.randint(5, 20)) + hot + noise(rng.randint(0, 20))) for d in range(12)]
    docs += [(20 + d, noise(rng.randint(0, 9)) + "".join(rng.choice(parts) + noise(rng.choice((0, 1, 3, 30))) for _ in range(rng.randint(1, 4)))) for d in range(40)]
    docs += [(70, docs[3][1]), (71, docs[3][1]), (15, docs[20][1]), (72, noise(40)), (73, docs[-1][1] if (alone := noise(50)) else ""), (74, alone), (75, alone), (76, None), (77, "")]
    docs += [(80, "*" * 90), (81, noise(9) + "*" * 50 + hot), (82, "ab" * 40 + parts[0]), (83, noise(7) + "ab" * 25)]
    docs += [(90, parts[0] + "X" + parts[1] + "Y" + parts[2]), (91, parts[0] + "ZZ" + parts[1] + parts[2])]
    texts = {d: t or "" for d, t in docs}
    want = {(x, y) for x in texts for y in texts if x < y and min(len(texts[x]), len(texts[y])) >= 30 and (texts[x] == texts[y] or brute_linked(texts[x], texts[y], 30, 12))}
    assert {(x, y) for x in range(12) for y in range(x + 1, 12)} | {(3, 70), (3, 71), (70, 71), (74, 75), (80, 81), (82, 83), (90, 91)} <= want
    df = spark.createDataFrame([*docs, docs[3], docs[3]], "doc_id bigint, text string")
    results = [sorted(tuple(r) for r in spans.fuzzy_passages(df, span=30, k=12, few=few).collect()) for few in (512, 3)]
    assert results[0] == results[1] and len(results[0]) == len(set(results[0]))
    assert want <= {r[:2] for r in results[0]}
    for a, b, i, j, m, n, anchors, changes, identity in results[0]:
        x, y = texts[a][i:j], texts[b][m:n]
        assert a < b and len(x) == j - i >= 30 <= n - m == len(y) and anchors > 0
        assert spans.edits(x, y) <= changes and identity == round(1 - changes / max(len(x), len(y)), 6)
        assert (a, b) in want or anchors > 1
    assert (74, 75, 0, 50, 0, 50, 1, 0, 1.0) in results[0]


def test_places_of_runs():
    assert spans.run_pairs([5], [1, 2, 3]) == [(5, 1), (5, 2), (5, 3)]
    assert spans.run_pairs([0, 4], [9, 11]) == [(0, 9), (0, 11), (4, 9), (4, 11)]
    got = spans.run_pairs(list(range(100, 0, -1))[::-1], list(range(7)))
    assert {b for _, b in got} == set(range(7)) and {a for a, _ in got} == set(range(1, 101)) and {(1, 0), (100, 6)} <= set(got) and len(got) < 110


def places(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r["passage"]].add((r["doc"], r["span_start"], r["span_end"]))
    return out


def test_passages_have_all_partners(spark):
    rng = random.Random(19)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common = [noise(rng.randint(30, 90)) for _ in range(8)]
    docs = [(d, noise(rng.randint(0, 40)) + "".join(rng.choice(common) + noise(rng.randint(0, 20)) for _ in range(rng.randint(0, 4)))) for d in range(60)]
    hot, pair = noise(60), [noise(70), noise(70)]
    docs += [(100, hot), (101, pair[0] + hot + pair[1]), (102, noise(9) + pair[0] + hot + pair[1]), (103, noise(30) + hot + noise(5) + hot)]
    docs += [(201, alone := noise(80)), (202, alone), (203, alone), (204, docs[61][1]), (205, None), (206, ""), (207, "ab" * 60)]
    texts = {d: t or "" for d, t in docs}
    got = places(spans.passages(spark.createDataFrame([*docs, docs[3], docs[3]], "doc_id bigint, text string"), span=30, k=12))
    for name, at in got.items():
        assert len({texts[d] for d, _, _ in at}) > 1 or name.startswith("text-")
        assert len({texts[d][a : a + 12] for d, a, _ in at}) == len({texts[d][b - 12 : b] for d, _, b in at}) == 1
    pairs = {(x, y) for at in got.values() for x in {m[0] for m in at} for y in {m[0] for m in at} if x < y}
    windows = {d: {t[i : i + 30] for i in range(len(t) - 29)} for d, t in texts.items()}
    assert pairs >= {(x, y) for x in texts for y in texts if x < y and windows[x] & windows[y]}
    # a pair that no smaller document takes part in, around a passage that others have too
    assert any({m[0] for m in at} == {101, 102, 204} and all(b - a > 150 for _, a, b in at) for at in got.values())
    assert got["text-201"] == {(d, 0, 80) for d in (201, 202, 203)} and got["text-101"] == {(d, 0, 200) for d in (101, 204)}
    assert any(sum(m[0] == 103 for m in at) == 2 and {100, 101, 102, 103, 204} == {m[0] for m in at} for at in got.values())
    assert spans.passages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---- queries


@pytest.fixture(scope="module")
def con(root):
    return connect(root)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, root, con, name):
    said = compare(spark, con, root, name, queries.QUERIES[name], queries.SQL.get(name))
    assert said[0] in ("ok", "rows only"), said


def test_found_columns(spark, root):
    want = {"p1_found": ["group_id", "strength_from", "completeness_from", "active_from"], "p2_found": ["candidate_a", "candidate_b"], "p3_found": ["name_a", "name_b"], "p6_found": ["field_name", "typed_value", "ref_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "span_start", "span_end"]}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, root)
        assert df.columns == columns
        if name != "p7_ids":
            assert df.count() == df.distinct().count()
    assert json.loads("[]") == []
