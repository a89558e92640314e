"""Byte-level BPE by prefix dynamic programming: encoding, decoding, re-encoding near edits.

For every prefix of a byte string exactly one token can come last in its encoding. The table of these
last tokens is filled from left to right: a token that ends at a position is the last one if the
token before it, which the table already holds, may stand before it. Two tokens may stand side by side
if merging their bytes alone gives these two tokens back. An append only adds entries; after an edit
the table is filled again until it agrees with the old one over the length of the longest token.

Texts are cut into words by a pattern first; each word is a byte string of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 18  # code points cut into words at once
CACHE_WORDS = 200_000  # encoded words a task keeps
CACHE_LENGTH = 48  # code points; longer words are encoded each time


def read_ranks(path: str) -> list[bytes]:
    """Bytes of every token by rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    return [ranks[r] for r in range(len(ranks))]


def merge(word: bytes, ranks: dict[bytes, int], parts: int = 1) -> list[bytes]:
    """Merges the pair of least rank, the leftmost of equals, until none is left or only `parts` are."""
    out = [word[i : i + 1] for i in range(len(word))]
    while len(out) > parts:
        rank, at = min((ranks.get(out[i] + out[i + 1], 1 << 30), i) for i in range(len(out) - 1))
        if rank == 1 << 30:
            break
        out[at : at + 2] = [out[at] + out[at + 1]]
    return out


class Vocabulary:
    """Tokens and, for each, the two tokens it is merged from. Bounded by the vocabulary file."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.reached = [True] * len(tokens)  # by merges; others only stand for a whole word
        for r, t in enumerate(tokens):
            if len(t) > 1:
                halves = merge(t, self.ranks, 2)
                self.reached[r] = len(halves) == 2
                if self.reached[r]:
                    self.left[r], self.right[r] = (self.ranks[x] for x in halves)
        self.longest = max(map(len, tokens), default=0)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


class Encoder:
    """Fills tables of last tokens. One per task; what it remembers of pairs and words is bounded."""

    def __init__(self, vocab: Vocabulary):
        import ahocorasick

        self.v = vocab
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.matcher = ahocorasick.Automaton()
        for r, t in enumerate(vocab.tokens):
            if vocab.reached[r]:
                self.matcher.add_word(t.decode("latin-1"), (r, len(t)))
        self.matcher.make_automaton()

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges of a's and b's bytes leave the tokens a, b? They do not if some token at
        a's right edge and some token at b's left edge are both there when their own merge comes first."""
        tokens, ranks, left, right = self.v.tokens, self.v.ranks, self.v.left, self.v.right
        x, until_x = a, 1 << 30  # x is there until the merge of rank until_x takes it up
        y, until_y = b, 1 << 30
        while True:
            joined = ranks.get(tokens[x] + tokens[y])
            if joined is not None and joined < until_x and joined <= until_y:
                return False
            # go back in time: undo the later of the merges that made x and y
            x_made, y_made = x if right[x] != x else -1, y if left[y] != y else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                x, until_x = right[x], x
            else:
                y, until_y = left[y], y

    def fill(self, data: bytes, last: list[int], start: int = 0, stop: Callable[[int], bool] | None = None) -> None:
        """Fills last[start+1:] of the table over data; last[0] stands for the empty prefix. Ends early
        where stop(position) is true."""
        pairs, compatible = self.pairs, self.compatible
        known = max(0, start - self.v.longest + 1)  # matches that end behind start begin behind this
        done = start
        for end, (token, n) in self.matcher.iter(data[known:].decode("latin-1")):
            end += known + 1
            if end <= done:
                continue
            at = end - n
            if at:
                key = last[at] << 32 | token
                ok = pairs.get(key)
                if ok is None:
                    if len(pairs) > 1_000_000:
                        pairs.clear()
                    ok = pairs[key] = compatible(last[at], token)
                if not ok:
                    continue
            last[end] = token
            done = end
            if stop is not None and stop(end):
                return

    def back(self, last: list[int], sizes: list[bytes]) -> list[int]:
        """The tokens of the whole string, read off the table from its end."""
        out, at = [], len(last) - 1
        while at:
            out.append(last[at])
            at -= len(sizes[last[at]])
        return out[::-1]

    def word(self, data: bytes) -> list[int]:
        whole = self.v.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [-1] * (len(data) + 1)
        self.fill(data, last)
        return self.back(last, self.v.tokens)

    def ids(self, words: list[str]) -> bytes:
        """Ids of words one after the other, as 32-bit integers."""
        get = self.words.get
        got = list(map(get, words))
        if None in got:
            for i, g in enumerate(got):
                if g is None:
                    w = words[i]
                    g = get(w)
                    if g is None:
                        g = np.array(self.word(w.encode()), np.int32).tobytes()
                        if len(w) <= CACHE_LENGTH:
                            if len(self.words) >= CACHE_WORDS:
                                self.words.clear()
                            self.words[w] = g
                    got[i] = g
        return b"".join(got)


class Prefixes:
    """The table of one byte string. append() and replace() keep it right without a new start."""

    def __init__(self, encoder: Encoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self.encoder.fill(self.data, self.last, start)

    def replace(self, start: int, end: int, by: bytes) -> int:
        """Puts `by` in the place of bytes start to end. Returns how many entries were computed."""
        old, shift = self.last, len(by) - (end - start)
        self.data = self.data[:start] + by + self.data[end:]
        self.last = old[: start + 1] + [-1] * len(by) + old[end + 1 :]
        agreed, computed = 0, 0

        def same(at: int) -> bool:
            nonlocal agreed, computed
            computed += 1
            if at <= start + len(by):
                return False
            agreed = agreed + 1 if self.last[at] == old[at - shift] else 0
            return agreed >= self.encoder.v.longest

        self.encoder.fill(self.data, self.last, start, same)
        return computed

    def tokens(self) -> list[int]:
        whole = self.encoder.v.ranks.get(self.data)
        return [whole] if whole is not None else self.encoder.back(self.last, self.encoder.v.tokens)


def safe_cut(text: str, at: int) -> int:
    """The first position from `at` on before white space that follows none: a match of the pattern
    always ends there. The end of the text if there is no such position."""
    import regex

    m = regex.compile(r"(?<=\S)(?=\s)").search(text, at)
    return m.start() if m else len(text)


def safe_cut_before(text: str, at: int) -> int:
    """The last such position before `at`, or 0."""
    import regex

    m = regex.compile(r"(?r)(?<=\S)(?=\s)").search(text, 0, at)
    return m.start() if m else 0


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Pieces of about `size` code points, cut where a match of the pattern ends anyway."""
    at = 0
    while at < len(text):
        to = safe_cut(text, at + size) if len(text) - at > size else len(text)
        yield text[at:to]
        at = to


def encode_text(encoder: Encoder, pattern, text: str) -> np.ndarray:
    return np.frombuffer(b"".join(encoder.ids(pattern.findall(part)) for part in segments(text)), np.int32)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def _batches(batch: pa.RecordBatch, column: str, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes in a column of texts, so that results stay small too."""
    if not len(batch):
        return
    ends = np.cumsum(np.nan_to_num(batch.column(column).cast(pa.large_string()).to_pandas().str.len().to_numpy(float)))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each text in ids_col, an array<int> (in the place of a column of that name).

    A null text counts as empty and has no ids. Repeated rows are encoded each; an empty table gives no
    rows; texts of any length are taken whole, in segments cut where words end. Nothing is shuffled.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    columns = [c for c in docs.columns if c != ids_col]
    source = docs.select(*columns)

    def run(batches):
        import regex

        words, encoder = regex.compile(pattern), Encoder(ranks.value)
        for whole in batches:
            for batch in _batches(whole, text_col):
                rows = [encode_text(encoder, words, t or "") for t in batch.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(rows)], names=[*columns, ids_col])

    return source.mapInArrow(run, source.withColumn(ids_col, F.lit(None).cast("array<int>")).schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """encoded with the bytes of its ids in bytes_col (binary; null ids: no bytes). Other columns stay."""
    ranks = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    columns = [c for c in encoded.columns if c != bytes_col]
    source = encoded.select(*columns)

    def run(batches):
        tokens = ranks.value.tokens
        pool = np.frombuffer(b"".join(tokens), np.uint8)
        size = np.array([len(t) for t in tokens])
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        for batch in batches:
            out = []
            for ids in batch.column(ids_col):
                ids = np.asarray(ids.values) if ids.is_valid and len(ids.values) else np.zeros(0, np.int64)
                parts = []
                for a in range(0, len(ids), 1 << 20):
                    part = ids[a : a + (1 << 20)]
                    n = size[part]
                    before = np.cumsum(n) - n
                    parts.append(pool[np.arange(n.sum()) + np.repeat(first[part] - before, n)].tobytes())
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*columns, bytes_col])

    return source.mapInArrow(run, source.withColumn(bytes_col, F.lit(None).cast("binary")).schema)


def reencode(
    encoded: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
    start_col: str = "start", length_col: str = "length", by_col: str = "replacement",
) -> DataFrame:
    """Applies one edit a row to encoded texts: code points start to start+length give way to the
    replacement (an append: start is the text's length, length 0). Text and ids are renewed.

    Only the words between the nearest safe cuts around the edit are encoded; the ids outside are those
    already there. The result equals encoding the new text. A null text or replacement is empty, a null
    start or length 0; positions beyond the text end at its end.
    """
    ranks = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    columns = encoded.columns

    def edit(encoder, words, sizes, text, ids, start, length, by):
        text, by, start = text or "", by or "", min(max(start or 0, 0), len(text or ""))
        end = min(start + max(length or 0, 0), len(text))
        a, b = safe_cut_before(text, start), safe_cut(text, end + 1)
        if b < len(text) and a == b:
            b = len(text)
        ids = np.array(ids if ids is not None else [], np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])
        i = int(np.searchsorted(ends, len(text[:a].encode())))
        j = int(np.searchsorted(ends, ends[-1] - len(text[b:].encode())))
        fresh = encode_text(encoder, words, text[a:start] + by + text[end:b])
        return text[:start] + by + text[end:], np.concatenate([ids[:i], fresh, ids[j:]])

    def run(batches):
        import regex

        words, encoder = regex.compile(pattern), Encoder(ranks.value)
        sizes = np.array([len(t) for t in ranks.value.tokens])
        for batch in batches:
            args = (batch.column(c).to_pylist() for c in (text_col, ids_col, start_col, length_col, by_col))
            rows = [edit(encoder, words, sizes, *r) for r in zip(*args)]
            new = {text_col: pa.array([t for t, _ in rows], pa.string()), ids_col: _lists([r for _, r in rows])}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns)

    return encoded.mapInArrow(run, encoded.schema)
