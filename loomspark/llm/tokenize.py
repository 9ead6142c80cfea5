"""Encoding of a corpus with a public byte-level BPE tokenizer, by a prefix-sharing trie traversal.

The distinct words of a task's texts are laid out as a trie by sorting them. A depth-first walk keeps, for each prefix on
the path, the last token of its encoding; a child's state follows from its ancestors' states alone (the longest token
that ends there and may stand after the last token of the rest), so that the encoding of a shared prefix is computed
once. A word's ids are read back from the states on its path. Each task walks its own words: nothing is shuffled.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("LOOMSPARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
# Fixed value: the published pre-tokenisation pattern of this byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_VOCABULARY_BYTES = 32_000_000
CACHED_WORDS = 400_000
CACHED_LENGTH = 256


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Tokens by id and, of each, the two ids it is merged from (itself twice for a single byte).

    Raises if the file is larger than ``MAX_VOCABULARY_BYTES``, the bound of what is broadcast.
    """
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    as_bytes = lambda s: bytes(letters[c] for c in s)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = {"".join(m) for m in merges}
    ids = {s: i for s, i in model["vocab"].items() if s in made or len(s) == 1 and s in letters}
    tokens: list[bytes] = [b""] * (max(ids.values()) + 1)
    parts = [(i, i) for i in range(len(tokens))]
    for s, i in ids.items():
        tokens[i] = as_bytes(s)
    for a, b in merges:
        i = ids[a + b]
        if parts[i] == (i, i):
            parts[i] = (ids[a], ids[b])
    return tokens, parts


class TrieEncoder:
    """Encodes words by last-token states; ``encode_words`` takes distinct words, ``encode`` a text."""

    def __init__(self, tokens: list[bytes], parts: list[tuple[int, int]]):
        self.tokens = tokens
        self.parts = parts
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.merged = {p: i for i, p in enumerate(parts) if p != (i, i)}
        self.length = [len(t) for t in tokens]
        self.longest = max(self.length)
        self.lengths_by_end = {}
        for t in self.ids:
            self.lengths_by_end.setdefault(t[-2:], set()).add(len(t))
        self.lengths_by_end = {e: tuple(sorted(s, reverse=True)) for e, s in self.lengths_by_end.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart when their texts stand side by side.

        Their merges are undone from the latest one back; if at some point the two pieces at the border would have been
        merged by a rule that comes before the one just undone, BPE would have crossed the border.
        """
        key = (left, right)
        said = self.pairs.get(key)
        if said is not None:
            return said
        a, b, below = left, right, len(self.tokens) + 1
        result = True
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < below:
                result = False
                break
            whole_a, whole_b = self.parts[a] == (a, a), self.parts[b] == (b, b)
            if whole_a and whole_b:
                break
            if not whole_a and (whole_b or a > b):
                below, a = a, self.parts[a][1]
            else:
                below, b = b + 1, self.parts[b][0]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[key] = result
        return result

    def _walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """Ids of sorted distinct words; ``last[d]`` is the last token of the encoding of the path's first d bytes."""
        ids, follow, length, by_end = self.ids, self._may_follow, self.length, self.lengths_by_end
        last: list[int] = [-1]
        before = b""
        for w in words:
            n = min(len(w), len(before))
            d = 0
            while d < n and w[d] == before[d]:
                d += 1
            del last[d + 1 :]
            for end in range(d + 1, len(w) + 1):
                for k in by_end.get(w[max(0, end - 2) : end], ()) if end > 1 else ():
                    if k > end:
                        continue
                    t = ids.get(w[end - k : end])
                    if t is not None and (k == end or follow(last[end - k], t)):
                        break
                else:
                    t = ids[w[end - 1 : end]]
                last.append(t)
            before = w
            out, d = [], len(w)
            while d:
                out.append(last[d])
                d -= length[last[d]]
            out.reverse()
            yield out

    def learn(self, words: set[str]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words if w not in self.known)
        for (_, w), ids in zip(new, self._walk([b for b, _ in new]), strict=True):
            self.known[w] = ids

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins and ends; null and empty texts have none."""
        at = np.zeros(len(texts) + 1, dtype=np.int32)
        pieces: list[np.ndarray] = []
        for i, text in enumerate(texts):
            n = 0
            if text:
                words = self.split(text)
                missing = {w for w in words if w not in self.known}
                if missing:
                    self.learn(missing | set(words) if len(self.known) > CACHED_WORDS else missing)
                known = self.known
                ids = [t for w in words for t in known[w]]
                pieces.append(np.array(ids, dtype=np.int32))
                n = len(ids)
                for w in missing:
                    if len(w) > CACHED_LENGTH:
                        known.pop(w, None)
            at[i + 1] = at[i] + n
        return (np.concatenate(pieces) if pieces else np.zeros(0, dtype=np.int32)), at


_ENCODERS: dict[str, TrieEncoder] = {}


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (key, ids ARRAY<INT>), one per input row; null and empty texts give an empty list.

    Texts are encoded as they stand, whatever their length; strings that look like special tokens are ordinary text.
    Repeated rows give repeated rows; an empty table gives an empty one. The vocabulary is broadcast; its size is checked
    in :func:`load_vocabulary`.
    """
    spark = df.sparkSession
    tables = spark.sparkContext.broadcast(load_vocabulary(vocabulary))
    kind = df.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _ENCODERS.get(vocabulary)
        if enc is None:
            enc = _ENCODERS[vocabulary] = TrieEncoder(*tables.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                flat, at = enc.encode_batch(batch.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
