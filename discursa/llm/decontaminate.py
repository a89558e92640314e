"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact
weighted-shingle similarity.

A window is as many consecutive words of a document as an item has; with `short`, a document of fewer
words is one window of its own. Windows that share no shingle
with any item have similarity 0 and are passed over; of the others every one is fingerprinted. The
64 bits are cut into RADIUS + 1 blocks: fingerprints within RADIUS bits agree in one block at least
(pigeonhole), so looking the blocks up in an index of the items finds all of them. What is found is
verified on the shingle weights themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.tables import staged
from discursa.llm.textbatch import grams, mix, spans, text_slices, tidy

SHINGLE = 5
SIMILARITY = 0.8
#: Bits; at similarity 0.8 the mean distance is under 10 and the standard deviation under 3, so this
#: is over four of them away.
RADIUS = 22
#: Items of one pass, so what one task holds of the benchmark.
PASS_ITEMS = 20_000


def _lower(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 in lower case. Where all letters are ASCII or Latin-1, and so keep their length, only the
    Latin-1 ones are changed here: hashing folds ASCII."""
    if len(raw) and raw.max() >= 0xC4:
        low = [raw[a:b].tobytes().decode().lower().encode() for a, b in zip(off[:-1], off[1:])]
        return np.frombuffer(b"".join(low), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in low])])
    at = np.flatnonzero(raw == 0xC3) + 1
    at = at[(raw[at] <= 0x9E) & (raw[at] != 0x97)]
    if len(at):
        raw = raw.copy()
        raw[at] += 0x20
    return raw, off


def _letters(texts):
    """Slices of lower-cased texts as word hashes; words are runs of letters and digits."""
    for a, b, raw, off in text_slices(texts):
        h, _, _, woff = spans(*_lower(raw, off), letters=True)
        yield a, b, h, woff


def _bits(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each shingle."""
    x = mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1


def _simhash(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints from sums of signed bits, one row a window."""
    return ((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Index:
    """Items of a benchmark: shingles with weights (their counts), fingerprints, block tables."""

    def __init__(self, ids: list, texts: list[str], k: int, radius: int):
        self.items, self.by_size = [], {}
        self.k, self.radius = k, radius
        self.edges = np.linspace(0, 64, radius + 2).astype(int)
        for a, _, h, woff in _letters(pa.array(texts, pa.string())):
            for i in range(len(woff) - 1):
                n = int(woff[i + 1] - woff[i])
                if n:
                    size = min(k, n)
                    g = grams(h[woff[i] : woff[i + 1]], np.array([0, n]), size)[0]
                    self.items.append((ids[a + i], n, size, *np.unique(g, return_counts=True), _simhash(_bits(g).sum(axis=0)[None, :])[0]))
        for j, item in enumerate(self.items):
            self.by_size.setdefault((item[1], item[2]), []).append(j)
        self.known = {s: np.unique(np.concatenate([i[3] for i in self.items if i[2] == s])) for s in {i[2] for i in self.items}}
        # For each known shingle the (words, shingle size) of the items that have it.
        self.owners = {s: [set() for _ in known] for s, known in self.known.items()}
        for _, n, size, values, *_rest in self.items:
            for at in np.searchsorted(self.known[size], values):
                self.owners[size][at].add((n, size))
        self.sieve = {}
        for s, known in self.known.items():
            self.sieve[s] = np.zeros(1 << 20, bool)
            self.sieve[s][(known >> np.uint64(44)).astype(np.int64)] = True
        self.tables = {}
        for key, js in self.by_size.items():
            prints = np.array([self.items[j][5] for j in js], np.uint64)
            blocks = [self._block(prints, b) for b in range(radius + 1)]
            order = [np.argsort(x, kind="stable") for x in blocks]
            self.tables[key] = (np.array(js), prints, [(x[o], o) for x, o in zip(blocks, order)])

    def hits(self, g: np.ndarray, size: int) -> np.ndarray:
        """Positions of shingles that some item has."""
        known = self.known[size]
        at = np.flatnonzero(self.sieve[size][(g >> np.uint64(44)).astype(np.int64)])
        return at[known[np.minimum(np.searchsorted(known, g[at]), len(known) - 1)] == g[at]]

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        lo, hi = int(self.edges[b]), int(self.edges[b + 1])
        return (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def near(self, key: tuple[int, int], prints: np.ndarray):
        """(window, item) of all fingerprints within the radius."""
        js, items, tables = self.tables[key]
        found = []
        for b, (values, order) in enumerate(tables):
            mine = self._block(prints, b)
            lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
            n = hi - lo
            w = np.repeat(np.arange(len(prints)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(w * len(js) + order[at])
        both = np.unique(np.concatenate(found))
        w, j = both // len(js), both % len(js)
        close = np.bitwise_count(prints[w] ^ items[j]) <= self.radius
        return w[close], js[j[close]]


def _similarity(g: np.ndarray, values: np.ndarray, counts: np.ndarray) -> float:
    """Weighted Jaccard of a window's shingles and an item's."""
    mine, n = np.unique(g, return_counts=True)
    at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
    both = np.minimum(n, counts[at])[values[at] == mine].sum()
    return both / (n.sum() + counts.sum() - both)


def _matches(index: Index, h: np.ndarray, least: float, short: bool):
    """(item, start word, windows's similarity) of every window of one document that reaches least."""
    shingles = {}
    for size in index.known:
        g = grams(h, np.array([0, len(h)]), size)[0]
        for hit in index.hits(g, size).tolist():
            for key in index.owners[size][int(np.searchsorted(index.known[size], g[hit]))]:
                shingles.setdefault(key, (g, []))[1].append(hit)
    for key, (g, hits) in sorted(shingles.items()):
        n, size = key
        if len(h) < n:
            if not short:
                continue
            n = len(h)
        hits = np.array(hits)
        mark = np.zeros(len(h) + 2, np.int32)  # window starts with a known shingle inside
        np.add.at(mark, np.maximum(hits - (n - size), 0), 1)
        np.add.at(mark, hits + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark)[: len(h) - n + 1] > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):  # runs of windows
            for cut in range(0, len(part), 4096):
                run = part[cut : cut + 4096]
                if not len(run):
                    continue
                total = np.zeros((len(run) + n - size + 1, 64), np.int32)
                np.cumsum(_bits(g[run[0] : run[-1] + n - size + 1]), axis=0, out=total[1:])
                sums = total[n - size + 1 :] - total[: len(run)]
                for w, j in zip(*index.near(key, _simhash(sums))):
                    item = index.items[j]
                    s = _similarity(g[run[w] : run[w] + n - size + 1], item[3], item[4])
                    if s >= least:
                        yield j, int(run[w]), s


def _search(index: Index, least: float, short: bool) -> Callable:
    def run(batches):
        for batch in batches:
            rows = []
            doc_ids, marks = batch.column(0), batch.column(2)
            for a, b, h, woff in _letters(batch.column(1)):
                for size in index.known:  # most texts end here
                    g, goff = grams(h, woff, size)
                    at = index.hits(g, size)
                    texts = np.unique(np.searchsorted(goff, at, "right") - 1) if len(at) else []
                    for i in texts:
                        best = {}
                        for j, start, s in _matches(index, h[woff[i] : woff[i + 1]], least, short):
                            if index.items[j][2] == size and (j not in best or s > best[j][0]):
                                best[j] = (s, start)
                        rows += [(doc_ids[int(a + i)].as_py(), marks[int(a + i)].as_py(), index.items[j][0], float(s), start, index.items[j][1]) for j, (s, start) in best.items()]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "_row", "item_id", "similarity", "start_word", "n_words"])

    return tidy(run)


SCHEMA = "doc_id long, _row long, item_id long, similarity double, start_word long, n_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS, short: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): for each document and item the best window
    (the first of equals) whose weighted Jaccard similarity on `shingle`-word shingles reaches `least`.

    short: a document of fewer words than the item is one window of all its words; else it has none.
    n_words is the item's. Words are lower-cased runs of letters and digits; weights are counts. An item
    of fewer words than a shingle is one shingle; an item without words matches nothing, nor does a null
    or empty text. Repeated documents each give their rows, items with equal texts each match. Null ids
    stay null. Empty tables give no rows; other columns are not looked at. The benchmark is read in
    passes of PASS_ITEMS items, each a pass over the documents, so tasks hold a bounded part of it.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("_row"))
    return _leaks(src, benchmark, shingle, least, radius, short).drop("_row")


def _leaks(src: DataFrame, benchmark: DataFrame, shingle: int, least: float, radius: int, short: bool) -> DataFrame:
    """find_leaks with the mark _row of each row of src (doc_id, text, _row)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
    out = src.sparkSession.createDataFrame([], SCHEMA)
    n = items.count()
    passes = -(-n // PASS_ITEMS)
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(passes)) == p).orderBy("item_id", "item").collect()
        index = Index([r.item_id for r in part], [r.item or "" for r in part], shingle, radius)
        if index.items:
            out = out.union(src.mapInArrow(_search(index, least, short), SCHEMA))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the rows whose id is that of a row in which an item is found; rows without id stay.
    All columns stay."""
    bad = staged(find_leaks(docs, benchmark, **how).select("doc_id").distinct(), "leaks")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def without_leaking_rows(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """docs without the rows in which an item is found, rows without id included; documents shorter
    than an item are one window. Rows are marked by id and text hash, so another text under the same id
    stays. All columns stay."""
    keyed = docs.withColumn("_row", F.xxhash64("text"))
    src = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_row")
    bad = staged(_leaks(src, benchmark, shingle, least, radius, True).select("doc_id", "_row").distinct(), "leaks")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d._row") == F.col("b._row"))
    return keyed.alias("d").join(bad.alias("b"), same, "left_anti").select(*docs.columns)
