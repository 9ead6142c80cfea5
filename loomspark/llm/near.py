"""Near-duplicate records with small edits: a chosen-path similarity join over multisets of words.

A record is the set of its words numbered by occurrence, so that the Jaccard similarity of two sets is that of the
multisets. Records with equal sets are one node. From each of several roots a path grows by tokens: a node takes the
``BRANCH`` tokens of its set that a hash drawn from the path puts first, so that similar sets take the same ones. Nodes
that share a path form a bucket, and a path grows until its bucket is small: that is compared in full.

The first level is a shuffle by path; from there on a task recurses on the whole buckets it holds, in memory. Only a bucket
too large for that grows further as a table. In a large bucket a few nodes are compared with all first: what they link is
one class, whose members needn't be compared among themselves, and once all but ``SMALL`` nodes are settled so, the others
are compared with all and the bucket is finished. A class of copies that holds a third of all rows is finished at its first
level. Buckets that are still large at the last level are compared in blocks, exactly.

The number of roots follows from the target recall. Tokens move as 16 bits: the symmetric difference of what is left of two
sets never exceeds theirs, nor does the Hamming distance of their parity sketches, so that the filters lose nothing. What
passes is verified on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import words
from loomspark.llm.components import components
from loomspark.session import materialise

BRANCH = 2
SMALL = 200
LEVELS = 7
RECALL = 0.9999
PIVOTS = 3
SKETCH_WORDS = 4
MOST_ROWS, MOST_TOKENS = 20_000, 4_000_000
"""A bucket of more is grown or split as a table; both bound what a task holds."""
MARGIN = 4
"""Two sets count as settled in one class if their tokens' 16 bits differ by so much less than allowed: two pairs of tokens may be mistaken for equal."""

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on each bit of the number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


def path_recall(threshold: float, levels: int = LEVELS, branch: int = BRANCH) -> float:
    """Probability that two sets of this similarity share a path of ``levels`` tokens from one root: a branching process.

    Going through the tokens in the order of the hash, each is common with the probability of the similarity, else of one
    set; a set takes the first ``branch`` of its own. The common ones that both take are the children.
    """
    apart = (1 - threshold) / 2
    grid: dict[tuple[int, int], list[float]] = {}
    for a in range(branch + 1):
        for b in range(branch + 1):
            out = [0.0] * (branch + 1)
            if not a or not b:
                out[0] = 1.0
            else:
                for p, before, more in ((threshold, grid[a - 1, b - 1], 1), (apart, grid[a - 1, b], 0), (apart, grid[a, b - 1], 0)):
                    for n in range(branch + 1 - more):
                        out[n + more] += p * before[n]
            grid[a, b] = out
    lost = 0.0
    for _ in range(levels):
        lost = sum(p * lost**n for n, p in enumerate(grid[branch, branch]))
    return 1 - lost


def roots(threshold: float, recall: float = RECALL, branch: int = BRANCH, levels: int = LEVELS) -> int:
    """Runs needed so that a pair at the threshold is found with the target recall, even if its bucket is large up to the last level."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - path_recall(threshold, levels, branch)))))


def numbered_sets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat, offsets) of distinct numbers for each multiset: the k-th occurrence of a word has a number of its own."""
    seg = np.repeat(np.arange(len(off) - 1), np.diff(off))
    h = hashes.view(np.uint64)
    order = np.lexsort((h, seg))
    h, seg = h[order], seg[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])][: len(h)]
    first = np.flatnonzero(new)
    nth = (np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return sorted_sets(mix(h + nth * np.uint64(0x9E3779B97F4A7C15)), seg, len(off) - 1)


def sorted_sets(flat: np.ndarray, seg: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat, offsets) of the distinct numbers of each of ``n`` segments, in order."""
    order = np.lexsort((flat, seg))
    flat, seg = flat[order], seg[order]
    new = np.r_[True, (flat[1:] != flat[:-1]) | (seg[1:] != seg[:-1])][: len(flat)]
    return flat[new], np.r_[0, np.cumsum(np.bincount(seg[new], minlength=n))]


def parity_sketches(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per set of tokens the parities of their numbers in 256 classes, as four words."""
    n, bits = len(off) - 1, 64 * SKETCH_WORDS
    out = np.zeros((n, SKETCH_WORDS), dtype=np.uint64)
    for lo in range(0, n, 4096):
        hi = min(n, lo + 4096)
        row = np.repeat(np.arange(hi - lo), np.diff(off[lo : hi + 1]))
        count = np.bincount(row * bits + (flat[off[lo] : off[hi]] & (bits - 1)), minlength=(hi - lo) * bits) & 1
        out[lo:hi] = np.packbits(count.astype(np.uint8).reshape(hi - lo, bits), axis=1).view(np.uint64)
    return out


_NODE = "node bigint, size int, tokens array<bigint>, short binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        at = np.asarray(lists.offsets).astype(np.int64)
        flat, off = numbered_sets(np.asarray(lists.values).astype(np.int64)[at[0] : at[-1]], at - at[0])
        size = np.diff(off)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(mix(flat + np.uint64(1)), dtype=np.uint64)]
            node = (sums[off[1:]] - sums[off[:-1]]).view(np.int64)
        cut, ends = sorted_sets((flat >> np.uint64(40)).astype(np.uint16), np.repeat(np.arange(len(size)), size), len(size))
        data = cut.tobytes()
        short = [data[2 * x : 2 * y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        tokens = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array(size.astype(np.int32)), tokens, pa.array(short, pa.binary())], names=["id", "node", "size", "tokens", "short"])


def word_sets(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows (id, node, size, tokens, short) of records; ``content`` is the array of a record's words, null as none. ``short`` has 16 bits of each token."""
    hashes = F.transform(F.coalesce(content, F.array().cast("array<string>")), lambda w: F.xxhash64(w))
    kind = df.schema[key].dataType.simpleString()
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), hashes.alias("h")).mapInArrow(_sets, f"id {kind}, {_NODE}")


def _short(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat, offsets) of a column of 16-bit tokens."""
    rows = column.to_pylist()
    off = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(x) // 2 for x in rows], out=off[1:])
    return np.frombuffer(b"".join(rows), dtype=np.uint16).astype(np.int64), off


def token_hashes(flat: np.ndarray) -> np.ndarray:
    return mix(flat.astype(np.uint64) + np.uint64(0x51ED27))


def children(hashes: np.ndarray, off: np.ndarray, row: np.ndarray, path: np.ndarray, branch: int = BRANCH, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``row``, path) of the paths grown by the ``branch`` tokens that a hash drawn from the path puts first; ``hashes`` are those of the sets' tokens."""
    length = off[row + 1] - off[row]
    ends = np.cumsum(length)
    at, grown, lo = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        some = np.flatnonzero(length[lo:hi] > 0) + lo
        lo = hi
        if not len(some):
            continue
        n = length[some]
        begin = np.cumsum(n) - n
        seg = np.repeat(np.arange(len(some)), n)
        h = mix(hashes[np.repeat(off[row[some]] - begin, n) + np.arange(len(seg))] ^ mix(path[some])[seg])
        for k in range(branch):
            best = np.minimum.reduceat(h, begin)
            use = np.flatnonzero(n > k)
            with np.errstate(over="ignore"):
                grown.append(mix(best[use] + path[some][use] * np.uint64(3)))
            at.append(some[use])
            h[h == best[seg]] = np.iinfo(np.uint64).max
    return np.concatenate(at), np.concatenate(grown)


_ROW = "path bigint, rest int, node bigint, size int, done boolean"


def _grow(rest: int, tokens: bool):
    """Rows of the nodes' children paths; ``rest`` levels remain after them."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, off = _short(batch.column(2))
            lists = batch.column(3)
            n = np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(batch.num_rows), n)
            path = np.asarray(lists.flatten().field("path")).astype(np.int64).view(np.uint64)
            done = np.asarray(lists.flatten().field("done").to_numpy(zero_copy_only=False), dtype=bool)
            at, grown = children(token_hashes(flat), off, row, path)
            r = pa.array(row[at])
            cols = [pa.array(grown.view(np.int64)), pa.array(np.full(len(at), rest, dtype=np.int32)), batch.column(0).take(r), batch.column(1).take(r), pa.array(done[at])]
            if tokens:
                cols.append(batch.column(2).take(r))
            yield pa.RecordBatch.from_arrays(cols, names=["path", "rest", "node", "size", "done", "short"][: len(cols)])

    return grow


class Bucket:
    """The rows of whole buckets that one task holds, and their comparisons."""

    def __init__(self, node: np.ndarray, size: np.ndarray, flat: np.ndarray, off: np.ndarray, threshold: float, small: int):
        self.node, self.size, self.flat, self.off, self.threshold, self.small = node, size, flat, off, threshold, small
        self.sketch, self.hashes = parity_sketches(flat, off), token_hashes(flat)
        self.kinds, self.local = np.unique(node, return_inverse=True)
        self.sets: dict[int, set[int]] = {}
        self.seen: set[int] = set()
        self.links: list[tuple[int, int]] = []

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens by which two sets of the similarity differ at most."""
        return (self.size[a] + self.size[b]) * ((1 - self.threshold) / (1 + self.threshold)) + 1e-6

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs of rows that sizes and sketches allow."""
        x, y = self.size[a], self.size[b]
        at = np.flatnonzero((np.minimum(x, y) >= np.maximum(x, y) * self.threshold - 1e-9) & (self.node[a] != self.node[b]))
        # half of the sketch rules most pairs out
        for half in (self.sketch[:, :2], self.sketch):
            a1, b1 = a[at], b[at]
            at = at[np.bitwise_count(half[a1] ^ half[b1]).sum(axis=1, dtype=np.int64) <= self.most(a1, b1)]
        return at

    def tokens(self, row: int) -> set[int]:
        k = int(self.local[row])
        if k not in self.sets:
            self.sets[k] = set(self.flat[self.off[row] : self.off[row + 1]].tolist())
        return self.sets[k]

    def link(self, a: int, b: int) -> tuple[bool, bool]:
        """(whether two rows are linked, surely so); a link is kept."""
        x, y = self.tokens(a), self.tokens(b)
        apart, most = len(x) + len(y) - 2 * len(x & y), float(self.most(a, b))
        if apart <= most:
            i, j = sorted((int(self.local[a]), int(self.local[b])))
            key = i * len(self.kinds) + j
            if key not in self.seen:
                self.seen.add(key)
                self.links.append((i, j))
        return apart <= most, apart <= most - MARGIN

    def small_buckets(self, rows: np.ndarray, done: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        for m in np.unique(count):
            i, j = np.triu_indices(m, 1)
            of = begin[count == m]
            step = max(1, 1_000_000 // len(i))
            for lo in range(0, len(of), step):
                place = of[lo : lo + step, None] + np.arange(m)
                r, d = rows[place], done[place]
                a, b, known = r[:, i].ravel(), r[:, j].ravel(), (d[:, i] & d[:, j]).ravel()
                a, b = a[~known], b[~known]
                at = self.possible(a, b)
                x, y = self.local[a[at]], self.local[b[at]]
                key, first = np.unique(np.minimum(x, y) * len(self.kinds) + np.maximum(x, y), return_index=True)
                for k, n in zip(key.tolist(), at[first], strict=True):
                    if k not in self.seen:
                        self.link(a[n], b[n])

    def against(self, row: int, rows: np.ndarray) -> np.ndarray:
        """Compares one row with others; places of those that are surely in its class."""
        at = self.possible(np.full(len(rows), row), rows)
        return np.array([n for n in at if self.link(row, rows[n])[1]], dtype=np.int64)

    def crowd(self, rows: np.ndarray, done: np.ndarray, last: bool) -> np.ndarray | None:
        """Compares some nodes of a large bucket with all; None if that finishes it, else which rows are settled in one class."""
        done, tried = done.copy(), np.zeros(len(rows), dtype=bool)
        for _ in range(PIVOTS):
            able = np.flatnonzero(~done & ~tried)
            if len(able) <= self.small:
                break
            p = able[np.argmin(self.node[rows[able]])]
            tried[p] = True
            star = np.zeros(len(rows), dtype=bool)
            star[self.against(rows[p], rows)] = star[p] = True
            if not done.any() or (star & done).any():
                done |= star
            elif star.sum() > done.sum():
                done = star
            if star.sum() * 8 < len(rows):
                # no crowd of copies
                break
        left = np.flatnonzero(~done)
        if len(left) > self.small and not last:
            return done
        for n, p in enumerate(left):
            self.against(rows[p], np.r_[rows[done], rows[left[n + 1 :]]])
        return None

    def run(self, path: np.ndarray, rest: np.ndarray, done: np.ndarray) -> None:
        row = np.arange(len(path))
        while len(row):
            order = np.argsort(path, kind="stable")
            path, row, rest, done = path[order], row[order], rest[order], done[order]
            begin = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            count = np.diff(np.r_[begin, len(path)])
            few = (count > 1) & (count <= self.small)
            self.small_buckets(row, done, begin[few], count[few])
            keep = np.zeros(len(path), dtype=bool)
            for b, n in zip(begin[count > self.small], count[count > self.small], strict=True):
                settled = self.crowd(row[b : b + n], done[b : b + n], rest[b] <= 0)
                if settled is not None:
                    done[b : b + n] = settled
                    keep[b : b + n] = True
            open_ = np.flatnonzero(keep)
            at, path = children(self.hashes, self.off, row[open_], path[open_])
            at = open_[at]
            row, rest, done = row[at], rest[at] - 1, done[at]


def whole_buckets(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Tables of at least so many rows, if there are, that end with a bucket's end; batches are sorted by path."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(x.num_rows for x in kept) < least:
            continue
        t = pa.Table.from_batches(kept)
        path = t.column(0).to_numpy()
        other = np.flatnonzero(path != path[-1])
        if len(other):
            yield t.slice(0, int(other[-1]) + 1)
            kept = t.slice(int(other[-1]) + 1).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _resolve(threshold: float, small: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_buckets(batches, MOST_ROWS):
            path, rest, node, size = (t.column(c).to_numpy() for c in range(4))
            flat, off = _short(t.column(5))
            b = Bucket(node, size.astype(np.int64), flat, off, threshold, small)
            b.run(path.astype(np.int64).view(np.uint64), rest.astype(np.int64), np.asarray(t.column(4).to_numpy(), dtype=bool))
            if b.links:
                x = b.kinds[np.array(b.links)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["a", "b"])

    return rows


def _beside(threshold: float):
    """(path, node, done, linked, sure) of rows beside their bucket's pivot."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, theirs = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            most = (np.asarray(batch.column(4)).astype(float) + np.asarray(batch.column(6))) * ((1 - threshold) / (1 + threshold)) + 1e-6
            apart = np.array([len(np.setxor1d(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), True)) for x, y in zip(mine, theirs, strict=True)], dtype=float)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(apart <= most), pa.array(apart <= most - MARGIN)], names=["path", "node", "done", "linked", "sure"])

    return rows


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sets have the similarity."""
    t = nodes.select("node", "tokens")
    j = pairs.join(t.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(t.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return j.where(common >= threshold * (F.size("ta") + F.size("tb") - common) - 1e-9).select("a", "b")


def similar_pairs(nodes: DataFrame, threshold: float, recall: float = RECALL, small: int = SMALL, levels: int = LEVELS, most_rows: int = MOST_ROWS, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Links (a, b), a < b, among distinct sets that connect all sets of a similarity of at least the threshold.

    Within a bucket's settled class the links to the nodes that settled it stand for all others. ``nodes``: one row per
    distinct set, as :func:`word_sets` gives. Empty sets link to nothing.
    """
    spark = nodes.sparkSession
    full = nodes.where("size > 0").select("node", "size", "short")
    seeds = F.transform(F.lit([1_000_003 * (r + 1) for r in range(roots(threshold, recall, levels=levels))]), lambda x: F.struct(x.cast("bigint").alias("path"), F.lit(False).alias("done")))
    source, ready, pairs = full.withColumn("paths", seeds), [], []
    for rest in range(levels - 1, -1, -1):
        light = source.mapInArrow(_grow(rest, False), _ROW)
        weigh = light.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("bigint")).alias("weight"))
        crowded = materialise(weigh.where(f"n > {most_rows} or n > {small} and weight > {most_tokens}"))
        ready.append(source.mapInArrow(_grow(rest, True), _ROW + ", short binary").join(crowded.select("path"), "path", "left_anti"))
        if crowded.isEmpty():
            break
        rows = materialise(light.join(crowded.select("path"), "path").select("path", "node", "size", "done"))
        pivot = rows.where("not done").groupBy("path").agg(F.min("node").alias("pivot"))
        two = rows.join(pivot, "path").join(full.select("node", "short"), "node").join(full.select(F.col("node").alias("pivot"), F.col("short").alias("short2"), F.col("size").alias("size2")), "pivot")
        star = materialise(two.select("path", "node", "done", "short", "size", "short2", "size2").mapInArrow(_beside(threshold), "path bigint, node bigint, done boolean, linked boolean, sure boolean"))
        pairs.append(star.join(pivot, "path").where("linked and node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
        yes = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
        state = star.groupBy("path").agg(F.count("*").alias("n"), yes("done").alias("d"), yes("sure").alias("s"), yes("done and sure").alias("both"))
        joined = star.join(state, "path").withColumn("done", F.expr("case when d = 0 or both > 0 then done or sure when s > d then sure else done end")).select("path", "node", "done", "n")
        joined = joined.unionByName(rows.join(pivot, "path", "left_anti").join(crowded.select("path", "n"), "path").select("path", "node", "done", "n"))
        left = joined.groupBy("path").agg(yes("not done").alias("left"))
        placed = materialise(joined.join(left, "path"))
        # blocks of a crowd: with the few that aren't settled in each of them, or each two of them together
        parts = F.ceil(F.col("n") * 2 / most_rows).cast("int")
        mine, key = F.pmod(F.xxhash64("node"), parts).cast("int"), lambda x, y: F.xxhash64("path", x, y)
        every = F.sequence(F.lit(0), parts - 1)
        closed = placed.where(F.col("left") <= small).select(F.explode(F.when(F.col("done"), F.array(key(mine, F.lit(-1)))).otherwise(F.transform(every, lambda i: key(i, F.lit(-1))))).alias("path"), "node", "done")
        blocks = [closed]
        if rest == 0:
            blocks.append(placed.where(F.col("left") > small).select(F.explode(F.transform(every, lambda i: key(F.least(mine, i), F.greatest(mine, i)))).alias("path"), "node", "done"))
        for x in blocks:
            ready.append(x.join(full, "node").select("path", F.lit(0).alias("rest"), "node", "size", "done", "short"))
        source = full.join(placed.where(F.col("left") > small).groupBy("node").agg(F.collect_list(F.struct("path", "done")).alias("paths")), "node")
    # hashing costs more than its bytes suggest: the number of tasks isn't left to their size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    buckets = reduce(DataFrame.unionByName, ready).repartition(tasks, "path").sortWithinPartitions("path")
    pairs.append(buckets.mapInArrow(_resolve(threshold, small), "a bigint, b bigint"))
    return _verified(reduce(DataFrame.unionByName, pairs).distinct(), nodes, threshold)


def near_classes(df: DataFrame, key: str, content: Column, threshold: float, recall: float = RECALL) -> DataFrame:
    """Rows (id, class_id, links): every id with its class; ids alone are a class of their own.

    ``links`` counts the similar sets other than its own that were linked to the id's set. Equal sets, empty ones too, are
    one class. Rows without id are left out; repeated rows count once; an id with several different rows joins their
    classes. ``class_id`` is the smallest id of the class.
    """
    sets = word_sets(df, key, content)
    members = materialise(sets.select("id", "node").distinct())
    nodes = materialise(sets.groupBy("node").agg(F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("short").alias("short")))
    links = materialise(similar_pairs(nodes, threshold, recall))
    same = members.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    joined = members.join(same.select("id", "a"), "id").select("a", F.col("node").alias("b"))
    comp = components(links.unionByName(joined))
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    placed = members.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).join(degree, "node", "left")
    smallest = placed.groupBy("c").agg(F.min("id").alias("class_id"))
    return placed.join(smallest, "c").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))


def candidate_words(df: DataFrame) -> Column:
    """Words of name, headline, summary and the elements of the skill list; a list that can't be parsed has none."""
    skills = F.coalesce(F.from_json(F.col("skill_names_json"), "array<string>"), F.array().cast("array<string>"))
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("anonymized_name", "headline", "summary")]
    return words(F.concat_ws(" ", *text, F.array_join(F.filter(skills, lambda s: s.isNotNull()), " ")))


def candidate_classes(candidates: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Classes of candidates whose profiles are at least 0.7 similar, directly or through others."""
    return near_classes(candidates, "candidate_id", candidate_words(candidates), threshold)


def candidate_pairs(candidates: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All pairs (candidate_a, candidate_b) of each class, smaller id first: the result that is asked for lists pairs."""
    c = materialise(candidate_classes(candidates, threshold).select("id", "class_id"))
    many = c.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    m = c.join(many, "class_id")
    return m.alias("x").join(m.alias("y"), (F.col("x.class_id") == F.col("y.class_id")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("candidate_a"), F.col("y.id").alias("candidate_b"))
