"""The next word from the text's own past, by online logistic mixing.

Contexts of the last one, two and three words are hashed. Each remembers the word that followed it
last and how often that came true; the longest context met before says which word is expected. One bit
is predicted for a token: does the expected word follow? The log odds of the three contexts and of the
text's record so far are combined by weights that a gate selects (the longest context and the length
of the run of right guesses), and an adaptive table refines the result. All counts are updated token by
token along the text; weights and table are learned over all training texts, per partition, and
averaged by an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.textbatch import mix, spans, text_slices, tidy

ORDERS, RUNS, STEPS = 3, 4, 33
INPUTS = ORDERS + 2
LEAST = 1e-4
#: Bytes of the texts that are looked at together.
SLICE = 1 << 20


def tokens(texts: pa.Array, size: int = SLICE) -> Iterator[tuple]:
    """(first text, bytes in lower case, hash, start byte and end byte of each token, offsets by text) of
    runs of texts of some `size` bytes; a longer text is one run. Tokens are words and, after each text's
    words, an end: the empty word, of hash 0."""
    for a, b, raw, off in text_slices(texts, size):
        h, start, end, woff = spans(raw, off)
        h, start, end = (np.insert(v, woff[1:], 0) for v in (h, start, end))
        low = raw | ((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5
        yield a, low, h, start, end, woff + np.arange(b - a + 1)


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, does each go on with the value before it), equal hashes together and in their own order.
    One sort by the top bits and the position below them: values that share the top bits only may come
    apart into several groups."""
    low = int(max(len(h) - 1, 1)).bit_length()
    key = np.sort((h >> np.uint64(low)) << np.uint64(low) | np.arange(len(h), dtype=np.uint64))
    order = (key & np.uint64((1 << low) - 1)).astype(np.int64)
    same = np.zeros(len(h), bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    return order, same


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _met(context: np.ndarray, ids: np.ndarray, at: np.ndarray):
    """For the positions of `at`, in order, and their contexts' hashes: (positions whose context was met
    before, where it was met last, how often it has guessed so far, how often right), and the positions
    whose context occurs twice or more."""
    order, same = groups(context)
    place, same = at[order], np.append(same, False)
    keep = np.flatnonzero(same[:-1] | same[1:])  # groups of two or more
    place, same = place[keep], same[:-1][keep]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(place))))
    right = np.zeros(len(place), np.int64)
    right[1:] = same[1:] & (ids[place[1:]] == ids[place[:-1]])
    before = np.cumsum(right) - right
    j = np.flatnonzero(same)
    return (place[j], place[j - 1], j - start[j] - 1, before[j] - before[start[j]]), np.sort(place)


def guesses(ids: np.ndarray, off: np.ndarray):
    """(positions that have an expected word, inputs, gate, longest context, did it follow)."""
    n = len(ids)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    first = off[text]
    h = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    word, longest, met, at = np.zeros(n, np.uint64), np.zeros(n, np.int64), [], np.arange(n)
    for k in range(1, ORDERS + 1):
        # A context of k words is met again only where that of k - 1 words is.
        at = at[at - first[at] >= k]
        h[at] = mix(h[at] ^ (ids[at - k] + np.uint64(1)))
        found, at = _met(h[at], ids, at)
        word[found[0]], longest[found[0]] = ids[found[1]], k
        met.append(found)
    bit = (longest > 0) & (word == ids)
    has = np.flatnonzero(longest)
    row = np.full(n, -1)
    row[has] = np.arange(len(has))
    x = np.zeros((len(has), INPUTS))
    for k, (place, last, seen, hits) in enumerate(met):
        x[row[place], k] = np.where(ids[last] == word[place], _stretch((hits + 0.4) / (seen + 0.8)), -1.0)
    good = np.cumsum(bit[has]) - bit[has]
    begin = np.searchsorted(has, first[has])
    x[:, ORDERS] = _stretch((good - good[begin] + 0.2) / (np.arange(len(has)) - begin + 1.0))
    x[:, ORDERS + 1] = 1
    miss = np.maximum.accumulate(np.where(bit, -1, np.arange(n)))
    miss = np.concatenate([[-1], miss[:-1]])
    run = has - 1 - np.maximum(miss[has], first[has] - 1)
    gate = (longest[has] - 1) * RUNS + np.searchsorted([1, 4, 16], run, "right")
    return has, x, gate, longest[has], bit[has].astype(np.int64)


class History:
    """Gated weights and the adaptive table behind them."""

    def __init__(self):
        self.weights = np.full((ORDERS * RUNS, INPUTS), 0.3)
        self.weights[:, -1] = 0
        self.apm = np.tile(_squash(np.linspace(-8, 8, STEPS)), (ORDERS, 1))

    def _place(self, z: np.ndarray):
        at = (np.clip(z, -7.999, 7.999) + 8) * (STEPS - 1) / 16
        lo = at.astype(np.int64)
        return lo, at - lo

    def predict(self, x: np.ndarray, gate: np.ndarray, longest: np.ndarray) -> np.ndarray:
        """Probability that the expected word follows."""
        z = (x * self.weights[gate]).sum(axis=1)
        lo, f = self._place(z)
        t = self.apm[longest - 1]
        rows = np.arange(len(z))
        return np.clip((_squash(z) + t[rows, lo] * (1 - f) + t[rows, lo + 1] * f) / 2, LEAST, 1 - LEAST)

    def learn(self, x, gate, longest, bit, batch: int = 2048, rate: float = 0.02) -> None:
        """One pass, a batch of bits at a time."""
        for a in range(0, len(bit), batch):
            xs, g, o, y = x[a : a + batch], gate[a : a + batch], longest[a : a + batch] - 1, bit[a : a + batch]
            z = (xs * self.weights[g]).sum(axis=1)
            step = (y - _squash(z))[:, None] * xs
            n = np.bincount(g, minlength=len(self.weights))
            total = np.stack([np.bincount(g, weights=step[:, k], minlength=len(n)) for k in range(INPUTS)], axis=1)
            self.weights += rate * total / np.maximum(np.sqrt(n), 1)[:, None]
            lo, f = self._place(z)
            near = o * STEPS + lo + (f > 0.5)
            n = np.bincount(near, minlength=self.apm.size)
            ones = np.bincount(near, weights=y, minlength=self.apm.size)
            flat = self.apm.reshape(-1)
            flat += np.minimum(0.02 * n, 0.5) * (ones / np.maximum(n, 1) - flat)


def _lesson() -> Callable:
    """Texts to the weights and table entries learned from them, with the number of bits behind each."""

    def run(batches):
        h, gates, tops = History(), np.zeros(ORDERS * RUNS), np.zeros(ORDERS)
        for batch in batches:
            for _, _, ids, _, _, off in tokens(batch.column(0)):
                _, x, gate, longest, bit = guesses(ids, off)
                h.learn(x, gate, longest, bit)
                gates += np.bincount(gate, minlength=len(gates))
                tops += np.bincount(longest - 1, minlength=ORDERS)
        value = np.concatenate([h.weights.ravel(), h.apm.ravel()])
        bits = np.concatenate([np.repeat(gates, INPUTS), np.repeat(tops, STEPS)])
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(value[at]), pa.array(bits[at])], names=["place", "value", "bits"])

    return tidy(run)


def train(texts: DataFrame) -> History:
    """A History learned from all rows of the single column of `texts`: each partition learns by itself,
    and entries are averaged by the bits they were learned from. What comes to the driver is one number
    an entry. Entries that no bit selected keep their first value."""
    h = History()
    sums = texts.mapInArrow(_lesson(), "place int, value double, bits double").groupBy("place").agg((F.sum(F.col("value") * F.col("bits")) / F.sum("bits")).alias("v"))
    flat = np.concatenate([h.weights.ravel(), h.apm.ravel()])
    for r in sums.collect():
        flat[r.place] = r.v
    h.weights = flat[: h.weights.size].reshape(h.weights.shape)
    h.apm = flat[h.weights.size :].reshape(h.apm.shape)
    return h
