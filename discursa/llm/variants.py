"""Spelling variants: words one edit apart, by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols. Each word's reduced form has a small full neighbourhood (one
symbol deleted, replaced or inserted, or none changed); it is joined with the reduced vocabulary, and
pairs that meet are verified on the original strings. An edit leaves one half of a word as it is, so
words travel by their halves: a task holds all words with one half in common and edits the other half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discursa.llm.tables import staged

SYMBOLS = 4
GROUP = 50_000  # words with one half in common that a task compares at once
AREA = 1 << 20  # letters compared at once
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word) of every run of letters in the texts, in lower case. Null texts have none."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("word"),
    ).withColumn("word", lower_ascii(F.col("word")))


def with_slips(runs: DataFrame, one_in: int = 97) -> DataFrame:
    """Deletes code point h % length of the runs whose h = crc32("<id>:<run>") is divisible by `one_in`.
    A null id counts as the empty text."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    word = F.col("word")
    cut = F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))
    return runs.withColumn("h", h).select("id", F.when(F.col("h") % one_in == 0, cut).otherwise(word).alias("word"))


def count_words(runs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur `least` times or more."""
    long = runs.where(F.length("word") >= shortest)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _halves(words: DataFrame) -> DataFrame:
    """Four rows a word: as the longer word of a pair and, with size one more, as the shorter, each with
    its first and its last half. Both words of a pair agree in size and in the half without the edit."""
    n, word = F.length("word"), F.col("word")
    rows = []
    for size in (n, n + 1):
        half = (size / 2).cast("int")
        tail = size - half
        rows += [
            F.struct(size.alias("size"), F.lit(True).alias("front"), F.substr(word, F.lit(1), half).alias("half")),
            F.struct(size.alias("size"), F.lit(False).alias("front"), F.substr(word, n - tail + 1, tail).alias("half")),
        ]
    return words.select("word", "n", F.explode(F.array(*rows)).alias("x")).select(
        "word", "n", "x.size", "x.front", F.xxhash64("x.size", "x.front", "x.half").alias("g")
    )


def _split(rows: DataFrame, group: int) -> DataFrame:
    """Adds part, asks, answers: in a group of more than `group` words, each of k x k parts holds a k-th
    of its words that ask for neighbours and a k-th of those that answer; elsewhere all do both."""
    whole = rows.withColumns({"part": F.lit(0), "asks": F.lit(True), "answers": F.lit(True)})
    large = staged(rows.groupBy("g").count().where(F.col("count") > group), "large-groups")
    if large.isEmpty():
        return whole
    k = F.ceil(F.col("count") / group).cast("int")
    hot = rows.join(large, "g").withColumns({"k": k, "own": F.pmod(F.xxhash64("word"), k).cast("int")})
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    asking = hot.withColumn("o", other).withColumn("part", F.col("own") * F.col("k") + F.col("o"))
    answering = hot.withColumn("o", other).withColumn("part", F.col("o") * F.col("k") + F.col("own"))
    parts = [
        asking.withColumns({"asks": F.lit(True), "answers": F.lit(False)}),
        answering.withColumns({"asks": F.lit(False), "answers": F.lit(True)}),
    ]
    return whole.join(large, "g", "left_anti").unionByName(
        parts[0].unionByName(parts[1]).select(*whole.columns)
    )


class _Chunk:
    """Whole groups of words, compared by arrays."""

    def __init__(self, table: pa.Table, symbols: int):
        words = table["word"].to_pylist()
        self.words = np.array(words, object)
        self.n = table["n"].to_numpy()
        self.size = table["size"].to_numpy().astype(np.int64)
        self.half = self.size // 2
        self.front = table["front"].to_numpy(zero_copy_only=False)
        self.asks = table["asks"].to_numpy(zero_copy_only=False)
        self.answers = table["answers"].to_numpy(zero_copy_only=False)
        self.length = np.array([len(w) for w in words])
        width = int(self.length.max())
        points = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
        self.letters = points.reshape(len(words), width)
        mixed = (self.letters.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        self.reduced = np.where(self.letters > 0, (mixed * np.uint64(symbols) >> np.uint64(32)) + np.uint64(1), np.uint64(0))
        power = np.ones(width + 2, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(width + 1, BASE))
        self.power, self.symbols = power, symbols
        code = (self.reduced * power[:width]).sum(axis=1, dtype=np.uint64)
        group = np.array(table["g"].to_numpy()).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.group = group + table["part"].to_numpy().astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        self.key = code + self.group

    def neighbourhoods(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, key) of every reduced word within one edit in the open half of the rows' words: for the
        longer words of their groups deletions and replacements, for the shorter ones insertions."""
        width = self.letters.shape[1]
        position = np.arange(width + 1)
        value, power = self.reduced[rows], self.power
        before = np.zeros((len(rows), width + 1), np.uint64)
        np.cumsum(value * power[:width], axis=1, out=before[:, 1:])
        total = before[:, -1:]
        front, half, length = self.front[rows, None], self.half[rows, None], self.length[rows, None]
        longer = self.length[rows] == self.size[rows]
        open_half = np.where(front, position >= half, position < half)
        edits = open_half & (position < length) & longer[:, None]
        inserts = open_half & (position <= length) & ~longer[:, None]
        own = self.group[rows, None]
        yield rows[longer], self.key[rows[longer]]
        at = edits[:, :width]
        yield self._of(rows, at, before[:, :-1] + (total - before[:, 1:]) * BACK + own)
        for s in range(1, self.symbols + 1):
            changed = total + (np.uint64(s) - value) * power[:width] + own
            yield self._of(rows, at & (value != s), changed)
            yield self._of(rows, inserts, before + np.uint64(s) * power[: width + 1] + (total - before) * BASE + own)

    @staticmethod
    def _of(rows: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r, _ = np.nonzero(at)
        return rows[r], keys[at]

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows are one edit apart, the edit lying in the open half of their group."""
        same = (self.group[a] == self.group[b]) & (self.size[a] == self.size[b]) & (self.front[a] == self.front[b])
        a, b, at = a[same], b[same], np.flatnonzero(same)
        short = np.minimum(self.length[a], self.length[b])
        equal = self.letters[a] == self.letters[b]
        width = equal.shape[1]
        inside = np.arange(width) < short[:, None]
        prefix = np.where(inside & ~equal, np.arange(width), width).min(axis=1, initial=width)
        prefix = np.minimum(prefix, short)
        gap = self.length[a] - self.length[b]
        ok = (gap == 0) & ((inside & ~equal).sum(axis=1) == 1) & (self.length[a] == self.size[a])
        uneven = np.flatnonzero(gap != 0)
        if len(uneven):  # the longer word without its first differing letter is the shorter word
            x, y = a[uneven], b[uneven]
            swap = gap[uneven] < 0
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            p = prefix[uneven]
            rest = np.arange(width - 1)
            differ = (self.letters[x][:, 1:] != self.letters[y][:, : width - 1]) & (rest >= p[:, None]) & (rest < self.length[y][:, None])
            ok[uneven] = ~differ.any(axis=1)
        ok &= np.where(self.front[a], prefix >= self.half[a], prefix < self.half[a])
        return at[ok]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(asking row, answering row) of all verified pairs."""
        answering = np.flatnonzero(self.answers)
        order = answering[np.argsort(self.key[answering], kind="stable")]
        classes, first, members = np.unique(self.key[order], return_index=True, return_counts=True)
        asking = np.flatnonzero(self.asks)
        kinds, leader, of = np.unique(self.key[asking], return_index=True, return_inverse=True)
        # rows of one reduced word and group ask together; both roles (longer, shorter) differ in length
        askers = asking[np.argsort(of, kind="stable")]
        ask_count = np.bincount(of, minlength=len(kinds))
        ask_first = np.cumsum(ask_count) - ask_count
        left, right = [], []
        if not len(classes) or not len(asking):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        leaders = asking[leader]
        step = max(1, AREA // (self.letters.shape[1] + 1))
        for a in range(0, len(leaders), step):
            block = leaders[a : a + step]
            meet = []
            for rows, keys in self.neighbourhoods(block):
                i = np.minimum(np.searchsorted(classes, keys), len(classes) - 1)
                hit = classes[i] == keys
                if hit.any():
                    meet.append(np.stack([np.searchsorted(kinds, self.key[rows[hit]]), i[hit]]))
            if not meet:
                continue
            k, c = np.unique(np.concatenate(meet, axis=1), axis=1)
            for x, y in self._members(k, c, ask_first, ask_count, askers, first, members, order):
                good = self.verified(x, y)
                left.append(x[good])
                right.append(y[good])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)

    def _members(self, k, c, ask_first, ask_count, askers, first, members, order) -> Iterator[tuple]:
        """Rows of meeting classes against each other, in blocks."""
        most = max(1, AREA // self.letters.shape[1])
        pairs = ask_count[k] * members[c]
        ends = np.cumsum(pairs)
        for at in range(0, int(ends[-1]), most):
            number = np.arange(at, min(at + most, int(ends[-1])))
            p = np.searchsorted(ends, number, "right")
            inside = number - (ends[p] - pairs[p])
            x = askers[ask_first[k[p]] + inside // members[c[p]]]
            y = order[first[c[p]] + inside % members[c[p]]]
            other = x != y
            yield x[other], y[other]


FOUND = "word string, near long, form string, form_n long"


def _compare(symbols: int):
    def summary(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per asking word: how many words are near, and the commonest of them."""
        chunk = _Chunk(pa.Table.from_batches(rows), symbols)
        a, b = chunk.links()
        if not len(a):
            return
        rank = np.empty(len(chunk.words), np.int64)
        rank[np.argsort(chunk.words, kind="stable")] = np.arange(len(chunk.words))  # code-point order
        order = np.lexsort((rank[b], -chunk.n[b], a))
        a, b = a[order], b[order]
        word, first, near = np.unique(a, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.words[word], pa.string()), pa.array(near, pa.int64()),
             pa.array(chunk.words[b[first]], pa.string()), pa.array(chunk.n[b[first]], pa.int64())],
            names=[x.split()[0] for x in FOUND.split(", ")],
        )

    def run(batches):
        kept: list[pa.RecordBatch] = []
        count = longest = 0
        end = None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column("g").to_numpy(), batch.column("part").to_numpy().astype(np.int64)])
            starts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(batch)]])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                size = int(batch.column("size")[a].as_py())
                new = end is None or (keys[:, a] != end).any()
                if new and kept and (count + b - a) * max(longest, size) > AREA:
                    yield from summary(kept)
                    kept, count, longest = [], 0, 0
                kept.append(batch.slice(a, b - a))
                count, longest, end = count + b - a, max(longest, size), keys[:, a]
        if kept:
            yield from summary(kept)

    return run


def near_words(words: DataFrame, symbols: int = SYMBOLS, group: int = GROUP) -> DataFrame:
    """(word, near, form, form_n) partial results of the words with near words: add up near, and take
    the form of largest form_n (ties: the smallest form)."""
    rows = _split(_halves(words), group)
    dealt = rows.repartition("g", "part").sortWithinPartitions("size", "g", "part")
    return dealt.mapInArrow(_compare(symbols), FOUND)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the last of the chain of forms, by doubling steps."""
    up = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("above"))
        joined = staged(up.join(above, "root", "left"), "forms")
        if joined.where("above is not null").isEmpty():
            return up
        up = joined.select("word", F.coalesce("above", "root").alias("root"))


def group_variants(words: DataFrame, ratio: int = 2, symbols: int = SYMBOLS, group: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of `words` (word, n).

    n_near counts the words exactly one inserted, deleted or replaced code point away. form is the near
    word of largest n (ties: the smallest in code-point order) if that n is at least `ratio` times the
    word's n, else null; root follows the forms to the last, and is the word itself where there is none.
    A ratio below 2 could make chains run in circles and is refused. Null words and null counts are
    passed over, repeated words are added up, an empty table gives no rows, other columns are not
    looked at. Long words take memory in proportion to their length.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    clean = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = staged(clean, "words")
    none = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    found = near_words(words, symbols, group).withColumn("n", F.lit(None).cast("long"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form")))
    one = none.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("b"))
    common = -F.col("b.m") >= ratio * F.col("n")
    linked = staged(
        one.select("word", "n", "n_near", F.when(common, F.col("b.form")).alias("form"), F.when(common, -F.col("b.m")).alias("form_n")),
        "linked",
    )
    roots = _roots(linked.where("form is not null"))
    return linked.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
