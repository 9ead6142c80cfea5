"""Long exact spans shared between records: k-mer seeds, collinear chains, alignment of the chains.

Each text's seeds are the minimisers of its windows of ``span`` characters: a window's content alone decides its seed, so
that two texts that share a window share its seed at the same offset. Seeds are joined by their hash. A seed of up to
``FEW`` occurrences is matched between all of them; of a more frequent one every occurrence is matched with the first,
which keeps hot passages linear. A match carries how far the two texts agree around it. The matches of two texts are
chained in order with gap costs through a Fenwick tree; a chain is aligned from anchor to anchor into stretches that are
equal character by character, and for fuzzy passages by the edits of the gaps between them. Stretches move, not characters.

What the matches of a frequent seed leave open are windows that hold it but differ from its first occurrence: these
alone are hashed and compared among all texts (an exact check, by 128 bits).

Fuzzy passages have seeds of half the length, the minimisers of all windows of ``SEED`` characters, and all places of a
seed are compared: no exact stretch of that length between any two texts is missed. Gaps are read from the texts once the
chains are known.

Passages of any number of places have shorter seeds of their own and are classes of places.

Exact copies of a text are one text in all of this; they are shared as a whole.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.near import mix
from loomspark.session import discard, materialise

SPAN = 300
SEED = 120
GAP_COST = 0.05
FEW = 8
"""Occurrences up to which a seed is matched between all of them."""
PLACES = 512
"""Places of one seed that a task compares with each other or with as many others."""
PAIRS = 1 << 14
"""Pairs of places that are compared at once in memory."""
PASSAGE_SPAN, PASSAGE_SEED, PASSAGE_GAP = 120, 40, 1200
PIECE = 1 << 22
"""Longer texts are hashed in pieces of so many characters that overlap by a window."""

_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1B54A32D192ED03 | 1))


def _powers(n: int, _kept: dict = {}) -> list[tuple[np.ndarray, np.ndarray]]:  # noqa: B006
    """Powers of the bases and of their inverses modulo 2**64, kept and grown by doubling."""
    if len(_kept.get("p", [((),)])[0][0]) < n:
        size = 1 << max(12, int(n).bit_length())
        with np.errstate(over="ignore"):
            out = []
            for b in _BASES:
                inverse = np.uint64(pow(int(b), -1, 1 << 64))
                out.append(tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x, dtype=np.uint64)]) for x in (b, inverse)))
            _kept["p"] = out
    return _kept["p"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sums(cp: np.ndarray, base: int) -> np.ndarray:
    up = _powers(len(cp) + 1)[base][0]
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum(mix(cp.astype(np.uint64) + np.uint64(base * 0x110000 + 1)) * up[: len(cp)])]


def _hashes(sums: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hashes of all substrings of k characters."""
    down = _powers(len(sums))[base][1]
    with np.errstate(over="ignore"):
        return mix((sums[k:] - sums[:-k]) * down[: len(sums) - k])


def window_seeds(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the place of the smallest, of equal ones the first; in linear time."""
    n = len(h)
    bits = np.uint64((1 << 24) - 1)
    key = (h & ~bits) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[: n - w + 1], left[w - 1 : n]) & bits).astype(np.int64)


def _pieces(text: str, span: int) -> Iterator[tuple[int, np.ndarray]]:
    cp = code_points(text)
    for at in range(0, max(1, len(cp) - span + 1), PIECE):
        yield at, cp[at : at + PIECE + span - 1]


def _seed_rows(span: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
            for d, v, text in zip(docs, kinds, batch.column(2).to_pylist(), strict=True):
                for at, cp in _pieces(text, span):
                    h = _hashes(_sums(cp, 0), k, 0)
                    p, first, n = np.unique(window_seeds(h, span - k + 1), return_index=True, return_counts=True)
                    for to, x in zip(out, (h[p].view(np.int64), np.full(len(p), d), np.full(len(p), v), p + at, first + at, first + n - 1 + at), strict=True):
                        to.append(x)
            cols = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])], names=["h", "doc", "v", "pos", "w0", "w1"])

    return rows


def chain(pos: list[int], other: list[int], k: int = SEED, gap: float = GAP_COST, near: tuple[list[int], list[int], int] | None = None) -> list[tuple[float, list[int]]]:
    """Collinear chains of matches (pos, other), each match in one chain: (score, indices in order), best first.

    A chain's score is the characters its matches cover less ``gap`` for every character between them on either side.
    Matches of a chain that overlap are on one diagonal. A Fenwick tree over the ranks of ``other`` holds the best score
    of the matches that end before, corrected by the place they end at; of the overlapping ones the nearest is as good as
    any. With ``near``, the agreements left and right of the matches and a number of characters, what lies between the
    stretches of two matches in a row is at most so many on both sides.
    """
    left, right, room = near or ((), (), 0)
    beyond = room + max(left, default=0) + max(right, default=0)
    follows = lambda j, i: max(pos[i] - pos[j], other[i] - other[j]) - k - left[i] - right[j] <= room
    order = sorted(range(len(pos)), key=lambda i: (pos[i], other[i]))
    ranks = sorted(set(other))
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    score, prev, diagonal, ended = [0.0] * len(pos), [-1] * len(pos), {}, 0
    for i in order:
        while pos[order[ended]] + k <= pos[i]:
            j = order[ended]
            r, v = bisect_left(ranks, other[j]) + 1, (score[j] + gap * (pos[j] + other[j] + 2 * k), j)
            while r < len(tree):
                tree[r] = max(tree[r], v)
                r += r & -r
            ended += 1
        score[i] = float(k)
        r, best = bisect_right(ranks, other[i] - k), (float("-inf"), -1)
        while r:
            best = max(best, tree[r])
            r -= r & -r
        if near and best[1] >= 0 and not follows(best[1], i):
            best = (float("-inf"), -1)
            for e in range(ended - 1, -1, -1):
                j = order[e]
                if pos[i] - pos[j] - k > beyond:
                    break
                if other[j] + k <= other[i] and follows(j, i):
                    best = max(best, (score[j] + gap * (pos[j] + other[j] + 2 * k), j))
        if best[0] - gap * (pos[i] + other[i]) > 0:
            score[i], prev[i] = best[0] - gap * (pos[i] + other[i]) + k, best[1]
        j = diagonal.get(pos[i] - other[i], -1)
        if j >= 0 and pos[i] - pos[j] < k and score[j] + pos[i] - pos[j] > score[i]:
            score[i], prev[i] = score[j] + pos[i] - pos[j], j
        diagonal[pos[i] - other[i]] = i
    out, used = [], [False] * len(pos)
    for i in sorted(range(len(pos)), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        path, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = prev[j]
        cut = 0.0 if j < 0 else score[path[-1]] - k
        out.append((score[i] - cut, path[::-1]))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def common_prefix(x: str, y: str) -> int:
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def edits(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors: a column of the table is two integers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, n = full, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        across = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(across | up)) & full, up & across
        n += bool(more & last) - bool(less & last)
        more, eq = (more << 1 | 1) & full, eq | down
        up, down = (less << 1 | ~(eq | more)) & full, more & eq
    return n


def _agreement(a: str, a_at: int, b: str, b_at: int, k: int) -> tuple[int, int]:
    """Characters left and right of the seed that the surroundings of two occurrences have in common."""
    return common_prefix(a[:a_at][::-1], b[:b_at][::-1]), common_prefix(a[a_at + k :], b[b_at + k :])


def _matched(k: int):
    """Matches (a, b, pos, other, l, r) with the agreement around the seed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            xa, ya = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            lr = [_agreement(p, i, q, j, k) for p, i, q, j in zip(x, xa, y, ya, strict=True)]
            left, right = pa.array([t[0] for t in lr], pa.int32()), pa.array([t[1] for t in lr], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), left, right], names=["a", "b", "pos", "other", "l", "r"])

    return rows


def _open_windows(span: int, k: int):
    """Hashes of the windows around a frequent seed's occurrence that its first occurrence doesn't share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, pos, w0, w1, at = (np.asarray(batch.column(c)).astype(np.int64) for c in range(5))
            first, first_at = batch.column(6).to_pylist(), batch.column(7).to_pylist()
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for i, text in enumerate(batch.column(5).to_pylist()):
                start = np.arange(w0[i], w1[i] + 1)
                if first[i] is not None:
                    left, right = _agreement(text, at[i], first[i], first_at[i], k)
                    start = start[(start < pos[i] - left) | (start + span > pos[i] + k + right)]
                if not len(start):
                    continue
                cp = code_points(text)
                local = start - (pos[i] - at[i])
                g, h = (_hashes(_sums(cp, b), span, b)[local].view(np.int64) for b in (0, 1))
                for to, x in zip(out, (g, h, np.full(len(start), docs[i]), start), strict=True):
                    to.append(x)
            cols = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:3]), pa.array(cols[3].astype(np.int32))], names=["h", "g", "doc", "start"])

    return rows


_ALIGNED = "a bigint, b bigint, a_start int, a_end int, b_start int, b_end int, gaps array<struct<a0:int,a1:int,b0:int,b1:int>>, exact array<struct<at:int,other:int,size:int>>"


def align(pos: list[int], other: list[int], left: list[int], right: list[int], path: list[int], k: int, room: int) -> Iterator[tuple[int, int, int, int, list[dict], list[dict]]]:
    """Alignments (a_start, a_end, b_start, b_end, gaps, exact stretches) of a chain.

    An anchor stretches as far as the texts agree around it; anchors whose stretches touch on one diagonal are one
    stretch. What lies between two others is a gap, from the first anchor's end to the second's start, if the stretches
    are at most ``room`` characters apart on both sides; else the chain is cut there.
    """
    part: list[int] = []
    exact: list[dict] = []
    gaps: list[dict] = []
    for i in path:
        a, b, size = pos[i] - left[i], other[i] - left[i], left[i] + k + right[i]
        touch = False
        if part:
            j, x = part[-1], exact[-1]
            touch = pos[i] - other[i] == pos[j] - other[j] and a <= x["at"] + x["size"]
            if touch:
                x["size"] = max(x["size"], a + size - x["at"])
            elif max(a - x["at"], b - x["other"]) - x["size"] > room:
                yield _extent(pos, other, left, right, part, k, gaps, exact)
                part, exact, gaps = [], [], []
            else:
                gaps.append({"a0": pos[j] + k, "a1": pos[i], "b0": other[j] + k, "b1": other[i]})
        if not touch:
            exact.append({"at": a, "other": b, "size": size})
        part.append(i)
    if part:
        yield _extent(pos, other, left, right, part, k, gaps, exact)


def _extent(pos, other, left, right, part: list[int], k: int, gaps: list[dict], exact: list[dict]):
    i, j = part[0], part[-1]
    return pos[i] - left[i], pos[j] + k + right[j], other[i] - left[i], other[j] + k + right[j], gaps, exact


def _outer(found: list[tuple]) -> list[tuple]:
    ends = np.array([x[:4] for x in found], dtype=np.int64).reshape(-1, 4)
    inside = lambda n: (ends[:n, 0] <= ends[n, 0]) & (ends[:n, 1] >= ends[n, 1]) & (ends[:n, 2] <= ends[n, 2]) & (ends[:n, 3] >= ends[n, 3])
    return [x for n, x in enumerate(found) if not inside(n).any()]


def _chained(span: int, k: int, room: int, fuzzy: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pos, other, left, right = ([x[c] for x in m] for c in ("pos", "other", "l", "r"))
                chains = chain(pos, other, k, near=(left, right, room) if fuzzy else None)
                found = [x for _, path in chains for x in align(pos, other, left, right, path, k, room)]
                # a passage inside a better one of the same texts is part of it; for exact stretches every anchor counts
                out += [(a, b, *x) for x in (_outer([x for x in found if min(x[1] - x[0], x[3] - x[2]) >= span]) if fuzzy else found)]
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            structs = [pa.struct([(c, pa.int32()) for c in names]) for names in (("a0", "a1", "b0", "b1"), ("at", "other", "size"))]
            types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(t) for t in structs]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "a_start", "a_end", "b_start", "b_end", "gaps", "exact"])

    return rows


def _surroundings(span: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                docs, lists = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                out = [(x["h"], d, x["pos"], x["w0"], x["w1"], min(x["pos"], span - k), t[max(0, x["pos"] - span + k) : x["pos"] + span]) for d, t, m in zip(docs, batch.column(1).to_pylist(), lists, strict=True) for x in m]
                cols = list(zip(*out, strict=True)) if out else [()] * 7
                types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["h", "doc", "pos", "w0", "w1", "at", "text"])

    return rows


def distinct_texts(docs: DataFrame, doc: str, text: str, span: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, copies, spare): rows (doc, v, text) of at least ``span`` characters; copies (doc, first, n, size) of every document; spare (doc, v) of those whose text another row stands for.

    One document stands for all of equal text. Of several texts of one ``doc`` that with the smallest digest counts.
    """
    rows = docs.where(F.col(doc).isNotNull() & (F.length(text) >= span)).select(F.col(doc).cast("bigint").alias("doc"), F.xxhash64(text).alias("v"), F.col(text).alias("text"))
    keys = materialise(rows.select("doc", "v", F.unhex(F.sha2("text", 256)).alias("k"), F.length("text").alias("size")).distinct())
    chosen = keys.groupBy("doc").agg(F.min_by(F.struct("v", "k", "size"), "k").alias("t")).select("doc", "t.*")
    groups = chosen.groupBy("k").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
    copies = materialise(chosen.join(groups, "k").select("doc", "v", "first", "n", "size"))
    spare = keys.select("doc", "v").join(copies.where("doc = first").select("doc", "v"), ["doc", "v"], "left_anti")
    return rows, copies.drop("v"), spare


def text_seeds(rows: DataFrame, spare: DataFrame, span: int, k: int) -> DataFrame:
    """Stored seeds (h, doc, v, pos, w0, w1) of one document of each text; w0..w1 are the starts of the windows a seed is of."""
    seeds = rows.mapInArrow(_seed_rows(span, k), "h bigint, doc bigint, v bigint, pos int, w0 int, w1 int").join(spare, ["doc", "v"], "left_anti")
    # repeated rows of a document, and both sides of a cut through a long text, are one seed
    return materialise(seeds.groupBy("h", "doc", "v", "pos").agg(F.min("w0").alias("w0"), F.max("w1").alias("w1")))


def occurrences(rows: DataFrame, spare: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(stored occurrences (h, doc, pos, w0, w1, at, text) of the seeds that several texts hold, ``text`` being what surrounds one and ``at`` the seed's place in it; classes (h, n))."""
    seeds = text_seeds(rows, spare, span, k)
    classes = materialise(seeds.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("h", "n"))
    # a list is as long as its document's seeds
    lists = seeds.join(classes.select("h"), "h").groupBy("doc", "v").agg(F.collect_list(F.struct("h", "pos", "w0", "w1")).alias("m"))
    around = rows.join(lists, ["doc", "v"]).select("doc", "text", "m").mapInArrow(_surroundings(span, k), "h bigint, doc bigint, pos int, w0 int, w1 int, at int, text string")
    occ = materialise(around.dropDuplicates(["h", "doc", "pos"]))
    discard(seeds)
    return occ, classes


def seed_matches(occ: DataFrame, classes: DataFrame, k: int, few: int) -> tuple[DataFrame, DataFrame]:
    """(matches, open): matches (a, b, pos, other, l, r) of occurrences in different texts, a < b; open (doc, pos, w0, w1, at, text, first, first_at) of frequent seeds.

    A seed of at most ``few`` occurrences is matched between all; of another one every occurrence is matched with the
    first. ``first`` is null where nothing may be taken for settled: if the first's own text holds the seed again.
    """
    rare = occ.join(classes.where(F.col("n") <= few).select("h"), "h")
    x, y = rare.alias("x"), rare.alias("y")
    cols = [f"{t}.{c} as {n}" for c, names in (("doc", "ab"), ("pos", ("pos", "other")), ("text", "xy"), ("at", ("xa", "ya"))) for t, n in zip("xy", names, strict=True)]
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.doc") < F.col("y.doc"))).selectExpr(*cols)
    often = occ.join(classes.where(F.col("n") > few).select("h"), "h")
    per = often.groupBy("h", "doc").agg(F.count("*").alias("c"), F.min(F.struct("pos", "at", "text")).alias("t"))
    first = per.groupBy("h").agg(F.min(F.struct("doc", "t", "c")).alias("f")).select("h", F.struct("f.doc", "f.t.pos", "f.t.at", "f.t.text").alias("f"), (F.col("f.c") == 1).alias("once"))
    placed = often.join(first, "h")
    pairs = pairs.unionByName(placed.where("doc <> f.doc").select(F.col("f.doc").alias("a"), F.col("doc").alias("b"), F.col("f.pos").alias("pos"), F.col("pos").alias("other"), F.col("f.text").alias("x"), F.col("text").alias("y"), F.col("f.at").alias("xa"), F.col("at").alias("ya")))
    left = placed.where("doc <> f.doc or not once").select("doc", "pos", "w0", "w1", "at", "text", F.when(F.col("once"), F.col("f.text")).alias("first"), F.col("f.at").alias("first_at"))
    return pairs.mapInArrow(_matched(k), "a bigint, b bigint, pos int, other int, l int, r int"), left


def aligned_chains(matches: DataFrame, span: int, k: int, room: int, fuzzy: bool) -> DataFrame:
    """Aligned chains of the matches of each two texts, if ``fuzzy`` those of at least ``span`` characters; a list is as long as the seeds of the two."""
    lists = matches.groupBy("a", "b").agg(F.collect_list(F.struct("pos", "other", "l", "r")).alias("m"), *(F.max(F.col(c) + k + F.col("r")) - F.min(F.col(c) - F.col("l")) for c in ("pos", "other")))
    reached = lists.toDF("a", "b", "m", "ea", "eb").where((F.col("ea") >= span) & (F.col("eb") >= span))
    return reached.select("a", "b", "m").mapInArrow(_chained(span, k, room, fuzzy), _ALIGNED)


def shared_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", span: int = SPAN, k: int = SEED, few: int = FEW) -> DataFrame:
    """Rows (doc_id, span_start, span_end): the longest stretches that lie in strings of at least ``span`` characters that also stand in another document.

    Positions are code points from 0, the end is exclusive. Null, empty and shorter texts have none; repeated rows of one
    document are one document; texts are processed whole; an empty table gives no rows. ``few`` changes the cost, not the
    result.
    """
    if not 0 < k <= span:
        raise ValueError("seeds are at most as long as spans")
    rows, copies, spare = distinct_texts(docs, doc, text, span)
    occ, classes = occurrences(rows, spare, span, k)
    matches, left = seed_matches(occ, classes, k, few)
    both = aligned_chains(matches, span, k, span - k, False).select("a", "b", F.explode(F.filter("exact", lambda e: e["size"] >= span)).alias("e"))
    # each stretch is one of both texts
    found = both.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("e.at").alias("a")), F.struct(F.col("b").alias("doc"), F.col("e.other").alias("a")))).alias("s"), F.col("e.size").alias("size")).select("s.doc", "s.a", (F.col("s.a") + F.col("size")).alias("b"))
    windows = materialise(left.mapInArrow(_open_windows(span, k), "h bigint, g bigint, doc bigint, start int"))
    shared = windows.groupBy("h", "g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("h", "g")
    hits = windows.join(shared, ["h", "g"]).select("doc", F.col("start").alias("a"), (F.col("start") + span).alias("b"))
    w = Window.partitionBy("doc").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("a") <= F.max("b").over(w), 0).otherwise(1)
    runs = found.unionByName(hits).withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = runs.groupBy("doc", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    single = copies.where("n = 1").select("doc").join(islands, "doc").select("doc", "a", "b")
    whole = copies.where("n > 1").select("doc", F.lit(0).alias("a"), F.col("size").alias("b"))
    return single.unionByName(whole).select(F.col("doc").alias("doc_id"), F.col("a").cast("bigint").alias("span_start"), F.col("b").cast("bigint").alias("span_end"))


def _run_rows(k: int, s: int):
    """Runs (h, doc, v, first, last) of the seeds of all windows of k characters: equal seeds that overlap are one run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            for d, v, text in zip(docs, kinds, batch.column(2).to_pylist(), strict=True):
                h, p = (np.concatenate(x) for x in zip(*_seeds_of(text, k, s), strict=True))
                order = np.lexsort((p, h))
                h, p = h[order], p[order]
                begins = np.r_[True, (h[1:] != h[:-1]) | (p[1:] - p[:-1] >= s)]
                first = np.flatnonzero(begins)
                last = np.r_[first[1:], len(p)] - 1
                for to, x in zip(out, (h[first], np.full(len(first), d), np.full(len(first), v), p[first], p[last]), strict=True):
                    to.append(x)
            cols = [np.concatenate(x) for x in out]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols[:3]), *(pa.array(c.astype(np.int32)) for c in cols[3:])], names=["h", "doc", "v", "first", "last"])

    return rows


def _seeds_of(text: str, k: int, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at, cp in _pieces(text, k):
        h = _hashes(_sums(cp, 0), s, 0)
        p = np.unique(window_seeds(h, k - s + 1))
        yield h[p].view(np.int64), p + at


def _run_texts(k: int, s: int):
    """Runs (h, n, doc, first, last, at, text) with k - s characters on both sides of their seeds; ``at`` is the first seed's place in ``text``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                lists = batch.column(2)
                flat, of = lists.flatten(), np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
                first, last = (np.asarray(flat.field(c)) for c in (2, 3))
                texts = batch.column(1).to_pylist()
                cut = [texts[i][a:b] for i, a, b in zip(of.tolist(), np.maximum(first - (k - s), 0).tolist(), (last + k).tolist(), strict=True)]
                cols = [flat.field(0), flat.field(1), batch.column(0).take(pa.array(of)), flat.field(2), flat.field(3), pa.array(np.minimum(first, k - s).astype(np.int32)), pa.array(cut, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "n", "doc", "first", "last", "at", "text"])

    return rows


def _places(text: str, at: int, last: int, s: int) -> list[int]:
    """Places in ``text`` of the seed at ``at``, from there to ``last``."""
    out, seed = [], text[at : at + s]
    while 0 <= at <= last:
        out.append(at)
        at = text.find(seed, at + 1)
    return out


def run_pairs(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Pairs of the places of a seed in two runs: all, or in periodic text so many as there are places.

    Where both runs repeat with one period, the shorter is laid along the longer one from its start, and once at its end:
    a stretch that leaves the periodic text does so at an end that both runs have there, and every place of such text is
    in a pair.
    """
    if len({b - a for z in (x, y) for a, b in zip(z, z[1:], strict=False)}) != 1:
        return [(a, b) for a in x for b in y]
    if len(x) > len(y):
        return [(a, b) for b, a in run_pairs(y, x)]
    m, n = len(x), len(y)
    return sorted({(x[j % m], y[j]) for j in range(n)} | {(x[i], y[n - m + i]) for i in range(m)})


def _runs_matched(k: int, s: int):
    """Matches (a, b, pos, other, l, r) that lie in an exact stretch of at least k characters, of lists of runs of one seed each.

    Runs of side 0 and 1 are compared with each other, runs of side 2 among themselves. The texts of a batch are one array
    of code points, so that the pairs of all its lists are compared together.
    """
    ahead = np.arange(k - s)
    half = (k - s + 1) // 2
    weights = mix(np.arange(1, half + 1, dtype=np.uint64)) | np.uint64(1)

    def keys(cp: np.ndarray, at: np.ndarray, enough: np.ndarray) -> np.ndarray:
        """Hashes of the ``half`` characters from each place, different ones where there aren't enough."""
        with np.errstate(over="ignore"):
            found = (mix(cp[np.clip(at[:, None] + ahead[:half], 0, len(cp) - 1)].astype(np.uint64)) * weights).sum(axis=1, dtype=np.uint64)
        return np.where(enough, found, np.arange(len(at), dtype=np.uint64))

    def agreement(cp: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, most: np.ndarray) -> np.ndarray:
        same = cp[np.clip(x[:, None] + step * ahead, 0, len(cp) - 1)] == cp[np.clip(y[:, None] + step * ahead, 0, len(cp) - 1)]
        first = np.argmin(np.c_[same, np.zeros(len(x), bool)], axis=1)
        return np.minimum(first, most)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            flat = lists.flatten()
            side, doc, first, last, at = (np.asarray(flat.field(c)).astype(np.int64) for c in range(5))
            group = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
            order = np.lexsort((first, doc, side, group))
            # repeated rows of a document are one
            order = order[np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in (group, side, doc, first)], axis=0)]]
            group, side, doc, first, last, at = (c[order] for c in (group, side, doc, first, last, at))
            texts = flat.field(5).take(pa.array(order)).to_pylist()
            cp = code_points("".join(texts))
            ends = np.cumsum([len(t) for t in texts])
            starts = np.r_[0, ends[:-1]]
            more = np.flatnonzero(last > first)
            places = {i: _places(texts[i], int(at[i]), int(at[i] + last[i] - first[i]), s) for i in more.tolist()}
            many = last > first
            # k - s characters around a seed are half of them on one side at least
            u = starts + at
            before, behind = keys(cp, u - half, at >= half), keys(cp, u + s, ends - u - s >= half)
            # each run with the later ones of its list
            later = np.searchsorted(group, group, side="right") - np.arange(len(group)) - 1
            step = max(1, PAIRS // max(1, int(later.max())))
            for lo in range(0, len(group), step):
                n = later[lo : lo + step]
                x = np.repeat(np.arange(lo, lo + len(n)), n)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                ok = (doc[x] != doc[y]) & ((side[x] == 2) | (side[x] != side[y])) & (many[x] | many[y] | (before[x] == before[y]) | (behind[x] == behind[y]))
                x, y = x[ok], y[ok]
                px, py = at[x], at[y]
                long = many[x] | many[y]
                if long.any():
                    cols = [[c[~long]] for c in (x, y, px, py)]
                    for i, j in zip(x[long].tolist(), y[long].tolist(), strict=True):
                        p = np.array(run_pairs(places.get(i, [int(at[i])]), places.get(j, [int(at[j])])))
                        for to, c in zip(cols, (np.full(len(p), i), np.full(len(p), j), p[:, 0], p[:, 1]), strict=True):
                            to.append(c)
                    x, y, px, py = (np.concatenate(c) for c in cols)
                for z in range(0, len(x), PAIRS):
                    xs, ys, ps, qs = (c[z : z + PAIRS] for c in (x, y, px, py))
                    u, v = starts[xs] + ps, starts[ys] + qs
                    left = agreement(cp, u - 1, v - 1, -1, np.minimum(ps, qs))
                    right = agreement(cp, u + s, v + s, 1, np.minimum(ends[xs] - u, ends[ys] - v) - s)
                    hit = left + right + s >= k
                    xs, ys, ps, qs, left, right = (c[hit] for c in (xs, ys, ps, qs, left, right))
                    pos, other = first[xs] + ps - at[xs], first[ys] + qs - at[ys]
                    turned = doc[xs] > doc[ys]
                    cols = (np.where(turned, doc[ys], doc[xs]), np.where(turned, doc[xs], doc[ys]), *(c.astype(np.int32) for c in (np.where(turned, other, pos), np.where(turned, pos, other), left, right)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "pos", "other", "l", "r"])

    return rows


def all_matches(rows: DataFrame, spare: DataFrame, k: int, s: int, few: int) -> DataFrame:
    """Matches (a, b, pos, other, l, r), a < b, of seeds of s characters, between all places of each; every exact stretch of at least k characters has some.

    The places of a seed are compared in blocks of about ``few``, every two blocks in a task of their own.
    """
    seeds = rows.mapInArrow(_run_rows(k, s), "h bigint, doc bigint, v bigint, first int, last int").join(spare, ["doc", "v"], "left_anti")
    # one exchange by the seed serves repeated rows, classes and their join, as both sides have all its columns and conditions
    seeds = seeds.where("h is not null and doc is not null and v is not null").repartition("h").groupBy("h", "doc", "v", "first").agg(F.max("last").alias("last"))
    classes = seeds.groupBy("h").agg(F.count("last").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("h", "n")
    lists = seeds.join(classes, "h").groupBy("doc", "v").agg(F.collect_list(F.struct("h", "n", "first", "last")).alias("m"))
    runs = rows.join(lists, ["doc", "v"]).select("doc", "text", "m").mapInArrow(_run_texts(k, s), "h bigint, n bigint, doc bigint, first int, last int, at int, text string")
    blocks = F.ceil(F.col("n") / few)
    of = runs.withColumn("u", F.pmod(F.xxhash64("doc"), blocks)).withColumn("w", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    side = F.when(F.col("u") == F.col("w"), 2).when(F.col("u") < F.col("w"), 0).otherwise(1)
    lists = of.groupBy("h", F.least("u", "w").alias("i"), F.greatest("u", "w").alias("j")).agg(F.collect_list(F.struct(side.alias("side"), "doc", "first", "last", "at", "text")).alias("m"))
    return lists.where(F.size("m") > 1).select("m").mapInArrow(_runs_matched(k, s), "a bigint, b bigint, pos int, other int, l int, r int")


def _pieces_read():
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, kinds, lists = (batch.column(c).to_pylist() for c in (0, 1, 3))
            out = [(d, v, x["lo"], x["hi"], t[x["lo"] : x["hi"]]) for d, v, t, m in zip(docs, kinds, batch.column(2).to_pylist(), lists, strict=True) for x in m]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc", "v", "lo", "hi", "piece"])

    return rows


def _edits_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [edits(x, y) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(n, pa.int32())], names=["a", "b", "a_start", "a_end", "b_start", "b_end", "edits"])


def gap_edits(aligned: DataFrame, rows: DataFrame, spare: DataFrame) -> DataFrame:
    """Alignments (a, b, a_start, a_end, b_start, b_end, anchors, edits); the gaps' texts are read once for all alignments that have them."""
    key = ["a", "b", "a_start", "a_end", "b_start", "b_end"]
    gaps = aligned.select(*key, F.explode("gaps").alias("g"))
    sides = [gaps.select(F.col(c).alias("doc"), F.struct(F.col(f"g.{c}0").alias("lo"), F.col(f"g.{c}1").alias("hi")).alias("p")) for c in "ab"]
    # stored, so that its size is known before the texts are joined
    lists = materialise(sides[0].unionByName(sides[1]).groupBy("doc").agg(F.collect_set("p").alias("m")))
    read = rows.join(lists, "doc").select("doc", "v", "text", "m").mapInArrow(_pieces_read(), "doc bigint, v bigint, lo int, hi int, piece string")
    pieces = read.join(spare, ["doc", "v"], "left_anti").groupBy("doc", "lo", "hi").agg(F.min("piece").alias("piece"))
    of = lambda c: pieces.select(F.col("doc").alias(c), F.col("lo").alias(f"{c}0"), F.col("hi").alias(f"{c}1"), F.col("piece").alias(f"{c}_text"))
    both = gaps.select(*key, "g.*").join(of("a"), ["a", "a0", "a1"]).join(of("b"), ["b", "b0", "b1"]).select(*key, "a_text", "b_text")
    counted = both.mapInArrow(_edits_counted, "a bigint, b bigint, a_start int, a_end int, b_start int, b_end int, edits int").groupBy(key).agg(F.sum("edits").cast("int").alias("edits"))
    return aligned.join(counted, key, "left").select(*key, F.size("exact").alias("anchors"), F.coalesce("edits", F.lit(0)).alias("edits"))


def fuzzy_passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", span: int = SPAN, k: int = SEED, few: int = PLACES) -> DataFrame:
    """Rows (doc_a, doc_b, a_start, a_end, b_start, b_end, anchors, edits, identity): aligned chains of at least ``span`` characters on both sides, of every two documents.

    The ``anchors`` of a chain are exact stretches of at least k characters, at most span - k characters apart on both
    sides. All stretches count, however many documents have them; only shifts of periodic text within itself are left to
    :func:`run_pairs`. ``edits`` are the letters changed, lost or added between the anchors, ``identity`` is 1 less their
    share of the longer side. A passage inside a better one of the same two documents is part of it. Documents of equal
    text have each other's whole text as a passage, and each has all passages of the others. ``few`` changes the cost,
    not the result.
    """
    if not 0 < k <= span:
        raise ValueError("anchors are at most as long as spans")
    rows, copies, spare = distinct_texts(docs, doc, text, span)
    s = (k + 1) // 2
    aligned = materialise(aligned_chains(all_matches(rows, spare, k, s, few), span, s, span - k, True))
    found = gap_edits(aligned, rows, spare)
    of = lambda c: copies.select(F.col("first").alias(c), F.col("doc").alias(f"doc_{c}"))
    placed = found.join(of("a"), "a").join(of("b"), "b")
    turned = F.col("doc_a") > F.col("doc_b")
    ends = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for p, q in (("a", "b"), ("b", "a")) for x, y in ((f"{p}_start", f"{q}_start"), (f"{p}_end", f"{q}_end"))]
    pairs = placed.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"), *ends, "anchors", "edits")
    same = copies.where("n > 1")
    whole = same.select("first", F.col("doc").alias("doc_a")).join(same.select("first", F.col("doc").alias("doc_b"), "size"), "first").where("doc_a < doc_b")
    zero, size = F.lit(0), F.col("size").cast("int")
    pairs = pairs.unionByName(whole.select("doc_a", "doc_b", zero.alias("a_start"), size.alias("a_end"), zero.alias("b_start"), size.alias("b_end"), F.lit(1).alias("anchors"), zero.alias("edits")))
    longer = F.greatest(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    return pairs.withColumn("identity", F.round(1 - F.col("edits") / longer, 6))


def shared_share(docs: DataFrame, doc: str = "doc_id", text: str = "text", span: int = SPAN, k: int = SEED) -> DataFrame:
    """Rows (doc_id, shared_chars, chars, share) of every document; those that share nothing have 0, empty ones a share of 0."""
    s = shared_spans(docs, doc, text, span, k).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    d = docs.where(F.col(doc).isNotNull()).groupBy(F.col(doc).cast("bigint").alias("doc_id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("bigint").alias("chars"))
    j = d.join(s, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0).cast("bigint")))
    return j.select("doc_id", "shared_chars", "chars", F.when(F.col("chars") > 0, F.round(F.col("shared_chars") / F.col("chars"), 6)).otherwise(0.0).alias("share"))


def passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", span: int = PASSAGE_SPAN, k: int = PASSAGE_SEED, gap: int = PASSAGE_GAP) -> DataFrame:
    """Rows (passage, doc, span_start, span_end, seeds): every place of every passage that two different texts hold.

    A passage is a longest run of shared seeds that follow each other, at most ``gap`` characters apart, at every place of
    any of them; words may differ between two seeds. All places have one ``passage``, so that its members are all partners
    at a cost linear in the places: each shared seed is in one passage, and any two texts with a string of ``span``
    characters in common are members of one. A run whose seeds stand in other texts too is a passage of its own. Ends are
    those of the first and last seed. Copies of a text are members wherever it is one, and of ``text-N`` as a whole, N
    being the smallest of them.
    """
    if not 0 < k <= span:
        raise ValueError("seeds are at most as long as spans")
    rows, copies, spare = distinct_texts(docs, doc, text, span)
    seeds = text_seeds(rows, spare, span, k).select("h", "doc", "pos")
    # seeds of equal places have equal sums
    sums = [F.sum(F.pmod(F.xxhash64("doc", F.lit(i)), F.lit(1 << 31))).alias(f"s{i}") for i in (0, 1)]
    shared = seeds.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), *sums).where("lo <> hi").drop("lo", "hi")
    same = ["doc", "n", "s0", "s1"]
    w = Window.partitionBy(*same).orderBy("pos")
    before = F.when(F.col("pos") - F.lag("pos").over(w) <= gap, F.lag("h").over(w))
    places = materialise(seeds.join(shared, "h").withColumn("before", before))
    follows = places.groupBy("h", "n").agg(F.count("before").alias("c"), F.min("before").alias("lo"), F.max("before").alias("hi")).where("c = n and lo = hi").select("h", F.lit(0).alias("begins"))
    runs = places.join(follows, "h", "left").withColumn("run", F.sum(F.coalesce("begins", F.lit(1))).over(w))
    found = runs.groupBy(*same, "run").agg(F.min_by("h", "pos").alias("h"), F.min("pos").alias("a"), (F.max("pos") + k).alias("b"), F.count("*").alias("seeds"))
    members = found.withColumnRenamed("doc", "first").join(copies, "first").select(F.hex("h").alias("passage"), "doc", F.col("a").cast("bigint").alias("span_start"), F.col("b").cast("bigint").alias("span_end"), "seeds")
    whole = copies.where("n > 1").select(F.concat(F.lit("text-"), F.col("first")).alias("passage"), "doc", F.lit(0).cast("bigint").alias("span_start"), F.col("size").cast("bigint").alias("span_end"), F.lit(0).cast("bigint").alias("seeds"))
    return members.unionByName(whole)
