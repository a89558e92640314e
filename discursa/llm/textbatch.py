"""Words of a batch of texts as arrays: one 64-bit hash per word, no Python object per word.

Used inside mapInArrow. Texts stay in the Arrow buffer they came in; hashing walks it in blocks of
about a megabyte cut between words, so memory follows the number of words, not the longest text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_TABLES: dict = {}


def _odd_powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, P odd and drawn from seed."""
    have = _TABLES.get(("pow", seed))
    if have is None or len(have[0]) < n:
        n = max(n, BLOCK)
        p = int(np.random.default_rng(seed).integers(1 << 62, dtype=np.int64)) * 2 + 1
        up, down = np.full(n, p, np.uint64), np.full(n, pow(p, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _TABLES[("pow", seed)] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


def _bytes_table(seed: int) -> np.ndarray:
    if ("byte", seed) not in _TABLES:
        _TABLES[("byte", seed)] = np.random.default_rng(seed + 1).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _TABLES[("byte", seed)]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of UTF-8 texts; a null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _classes(fold: bool, letters: bool) -> np.ndarray:
    """256 entries: 0 between words, else the byte to hash.

    letters: only letters, digits and all non-ASCII bytes make words, else everything but white space.
    """
    if ("class", fold, letters) not in _TABLES:
        lut = np.arange(256, dtype=np.uint8)
        if fold:
            lut[65:91] += 32
        keep = np.ones(256, bool)
        if letters:
            keep[:128] = False
            for a, b in ((48, 58), (65, 91), (97, 123)):
                keep[a:b] = True
        keep[list(SPACE)] = False
        keep[0] = keep[0] and not letters
        lut[~keep] = 0
        _TABLES[("class", fold, letters)] = (lut, keep)
    return _TABLES[("class", fold, letters)]


def spans(raw: np.ndarray, off: np.ndarray, fold: bool = True, letters: bool = False, seed: int = 11):
    """(hash, start byte, end byte, offsets of each text's words) of all words of the texts."""
    lut, keep = _classes(fold, letters)
    table = _bytes_table(seed)
    hashes, starts, ends = [], [], []
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[off] = True
    at = 0
    while at < len(raw):
        to = min(len(raw), at + BLOCK)
        while to < len(raw) and keep[raw[to]] and not cuts[to]:  # not inside a word
            step = ~keep[raw[to : to + 4096]] | cuts[to : to + 4096][: len(raw[to : to + 4096])]
            hit = int(step.argmax()) if step.any() else len(step)
            to += hit
            if hit < len(step):
                break
        part = raw[at:to]
        word = keep[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | cuts[at + 1 : to]
        last = word.copy()
        last[:-1] &= ~word[1:] | cuts[at + 1 : to]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            up, down = _odd_powers(len(part), seed)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[lut[part]] * up[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, off)


def grams(h: np.ndarray, woff: np.ndarray, k: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """(hash, offsets of each text's k-grams): k consecutive words of one text."""
    n = np.maximum(np.diff(woff) - k + 1, 0)
    goff = np.concatenate([[0], np.cumsum(n)])
    if not goff[-1]:
        return np.zeros(0, np.uint64), goff
    at = np.arange(goff[-1]) + np.repeat(woff[:-1] - goff[:-1], n)
    up, down = _odd_powers(len(h), seed)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[at + k] - total[at]) * down[at]), goff


def slices(off: np.ndarray, size: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about `size` bytes together, one text at least."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, b
        a = b


def text_slices(texts, size: int = 2 * BLOCK):
    """(first, last, bytes, offsets) of runs of texts."""
    raw, off = text_buffer(texts)
    for a, b in slices(off, size):
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]


def tidy(run: Callable) -> Callable:
    """run, a function from batches to batches, after which the worker gives its memory back: workers
    live on, and what one task needed must not stay while the next ones run."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _TABLES.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidied
