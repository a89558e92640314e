"""Repeated passages: fixed-block anchors, probed by every rolling window, extended to exact repeats.

A window of `window` words holds a whole block of (window + 1) // 2 words that starts at a multiple
of the block length in its text. So the blocks of all texts are the index, every rolling window of
block length probes it, and a window that is repeated holds a hit. Hashes travel packed, a few bytes
each, grouped by hash range; what comes back are hit positions. The windows around hits are then
matched whole, by 128-bit hashes of their words, which extends the hits to the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.tables import parts, staged
from discursa.llm.textbatch import grams, spans, text_slices

WINDOW = 35
#: Words whose hashes one range holds, so one task's arrays.
RANGE_WORDS = 3_000_000


def _words(raw, off):
    h, s, e, woff = spans(raw, off, fold=False)
    return h, s, e, woff


def _digests() -> Callable:
    """(id, text) to (id, n words, 128-bit digest of the word sequence)."""

    def run(batches):
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column(1)):
                h, _, _, woff = _words(raw, off)
                n = np.diff(woff)
                d = np.zeros((2, len(n)), np.int64)
                for i in range(len(n)):
                    d[:, i] = np.frombuffer(hashlib.md5(h[woff[i] : woff[i + 1]].tobytes()).digest(), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(d[0]), pa.array(d[1])], names=["id", "n", "d0", "d1"]
                )

    return run


def _by_range(values: np.ndarray, ranges: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Positions of values by values modulo ranges, in their order."""
    part = (values % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(ranges + 1))
    return part, [(int(r), order[cut[r] : cut[r + 1]]) for r in np.flatnonzero(np.diff(cut))]


def _owners(text: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """Runs of equal text numbers as (keys, run lengths)."""
    n = np.bincount(text, minlength=len(keys))
    own = np.flatnonzero(n)
    return keys[own].astype(np.int64).tobytes(), n[own].astype(np.uint32).tobytes()


def _batch(rows: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=names)


def _tops(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(32)).astype(np.uint32)


def _probes(window: int, block: int, ranges: int) -> Callable:
    """(key, text) to packed rolling hashes by hash range: index entries (windows of block length
    that start at multiples of it) and all the others. A task sends a repeated text once."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            new = np.zeros(len(keys), bool)
            for i, k in enumerate(keys.tolist()):
                new[i] = k not in seen
                seen.add(k)
            for a, b, raw, off in text_slices(batch.column(1)):
                h, _, _, woff = _words(raw, off)
                g, goff = grams(h, woff, block)
                per = np.diff(goff)
                use = np.repeat((np.diff(woff) >= window) & new[a:b], per)
                text = np.repeat(np.arange(b - a), per)[use]
                at = (np.arange(len(g)) - np.repeat(goff[:-1], per))[use]
                g = g[use]
                rows = []
                for r, i in _by_range(g, ranges)[1]:
                    index, other = i[at[i] % block == 0], i[at[i] % block != 0]
                    rows.append((r, *_owners(text[index], keys[a:b]), _tops(g[index]).tobytes(), *_owners(text[other], keys[a:b]), _tops(g[other]).tobytes()))
                if rows:
                    yield _batch(rows, PROBES)

    return run


PROBES = ["range", "index_keys", "index_n", "index", "other_keys", "other_n", "other"]


def _hits(routes: int) -> Callable:
    """One hash range: windows equal to an indexed block elsewhere, packed by key. 32 bits
    of hash within a range may claim a hit that the whole windows then refute."""

    def run(table: pa.Table) -> pa.Table:
        keys, tops, indexed = [], [], []
        for side in ("index", "other"):
            for t, n, hs in zip(*(table.column(c).to_pylist() for c in (f"{side}_keys", f"{side}_n", side))):
                keys.append(np.repeat(np.frombuffer(t, np.int64), np.frombuffer(n, np.uint32)))
                tops.append(np.frombuffer(hs, np.uint32))
                indexed.append(np.full(len(tops[-1]), side == "index"))
        keys, tops, indexed = np.concatenate(keys), np.concatenate(tops), np.concatenate(indexed)
        order = np.argsort(tops, kind="stable")
        keys, tops, indexed = keys[order], tops[order], indexed[order]
        start = np.flatnonzero(np.concatenate([[True], tops[1:] != tops[:-1]]))
        size = np.diff(np.append(start, len(tops)))
        hit = np.repeat((size > 1) & np.logical_or.reduceat(indexed, start), size)
        r = int(table.column("range")[0].as_py())
        return _by_key(keys[hit], (np.uint64(r) << np.uint64(32)) | tops[hit].astype(np.uint64), routes)

    return run


def _by_key(keys: np.ndarray, values: np.ndarray, routes: int) -> pa.Table:
    """Keys and values packed in one row for each of `routes` groups of keys."""
    rows = _by_range(keys.astype(np.int64).view(np.uint64), routes)[1]
    return pa.table(
        {
            "route": pa.array([r for r, _ in rows], pa.int32()),
            "keys": pa.array([keys[i].astype(np.int64).tobytes() for _, i in rows], pa.binary()),
            "values": pa.array([values[i].astype(np.uint64).tobytes() for _, i in rows], pa.binary()),
        }
    )


PACKED = "route int, keys binary, values binary"


def _gather(table: pa.Table) -> pa.Table:
    """One group of keys: (key, its distinct values packed)."""
    keys = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("keys").to_pylist()])
    values = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()])
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])])[: len(keys)]
    keys, values = keys[new], values[new]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    ends = np.append(cut[1:], len(keys))
    return pa.table(
        {"key": pa.array(keys[cut], pa.int64()), "at": pa.array([values[x:y].tobytes() for x, y in zip(cut, ends)], pa.binary())}
    )


def _gathered(packed: DataFrame, name: str) -> DataFrame:
    return staged(packed.groupBy("route").applyInArrow(_gather, "key long, at binary"), name)


def _split(window: int, keep_text: bool) -> Callable:
    """Finishes the texts without hits and copies; the others go on with their text."""

    def run(batches):
        for batch in batches:
            many, found = batch.column("copies").to_pylist(), batch.column("at").to_pylist()
            for a, b, raw, off in text_slices(batch.column("text")):
                _, s, e, woff = _words(raw, off)
                data = raw.tobytes()
                rows, go = [], np.zeros(b - a, bool)
                for i in range(b - a):
                    n = int(woff[i + 1] - woff[i])
                    go[i] = n >= window and (found[a + i] is not None or many[a + i] > 1)
                    gone = n >= window and many[a + i] > 1
                    kept = range(0 if gone else n)
                    left = b"" if go[i] and not gone else b" ".join([data[s[k] : e[k]] for k in (woff[i] + j for j in kept)])
                    rows.append((n, n if gone else 0, None if go[i] and not gone else hashlib.sha256(left).hexdigest(), left.decode() if keep_text else None))
                cols = list(zip(*rows))
                text = pa.array([data[off[i] : off[i + 1]].decode() if go[i] else None for i in range(b - a)], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(a, b - a) for c in ("id", "key", "copies", "at")]
                    + [text, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
                    names=["id", "key", "copies", "at", "text", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


def _near_hits(g: np.ndarray, hits: bytes, n_windows: int, window: int, block: int, ranges: int) -> np.ndarray:
    """Which window starts hold a hit, from the text's rolling hashes."""
    mine = ((g % np.uint64(ranges)) << np.uint64(32)) | _tops(g).astype(np.uint64)
    at = np.flatnonzero(np.isin(mine, np.frombuffer(hits, np.uint64)))
    mark = np.zeros(len(g) + 2, np.int32)
    np.add.at(mark, np.maximum(at - (window - block), 0), 1)
    np.add.at(mark, at + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[:n_windows] > 0)


WINDOWS = ["range", "keys", "n", "copies", "x", "y", "positions"]


def _windows(window: int, block: int, ranges: int) -> Callable:
    """(key, copies, at, text) to the whole windows around hits, packed by hash range. A task sends
    a repeated text once, as its copies are counted."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            many = batch.column("copies").to_numpy(zero_copy_only=False)
            found = batch.column("at").to_pylist()
            for a, b, raw, off in text_slices(batch.column("text")):
                h, _, _, woff = _words(raw, off)
                small, soff = grams(h, woff, block)
                g, goff = grams(h, woff, window)
                g2, _ = grams(h, woff, window, seed=91)
                picks = []
                for i in range(b - a):
                    new = int(keys[a + i]) not in seen and found[a + i] is not None
                    seen.add(int(keys[a + i]))
                    n = int(goff[i + 1] - goff[i])
                    picks.append(_near_hits(small[soff[i] : soff[i + 1]], found[a + i], n, window, block, ranges) if new else np.zeros(0, np.int64))
                at = np.concatenate(picks)
                text = np.repeat(np.arange(b - a), [len(p) for p in picks])
                x, y = g[at + goff[text]], g2[at + goff[text]]
                rows = []
                for r, i in _by_range(x, ranges)[1]:
                    own, n = _owners(text[i], keys[a:b])
                    copies = many[a:b][np.unique(text[i])].astype(np.int64).tobytes()
                    rows.append((r, own, n, copies, x[i].tobytes(), y[i].tobytes(), at[i].astype(np.uint32).tobytes()))
                if rows:
                    yield _batch(rows, WINDOWS)

    return run


def _repeated(routes: int) -> Callable:
    """One hash range: window starts whose words also start elsewhere, packed by key."""

    def run(table: pa.Table) -> pa.Table:
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for t, n, m, hx, hy, ps in zip(*(table.column(c).to_pylist() for c in WINDOWS[1:])):
            n = np.frombuffer(n, np.uint32)
            row = (np.repeat(np.frombuffer(t, np.int64), n), np.repeat(np.frombuffer(m, np.int64), n),
                   np.frombuffer(hx, np.uint64), np.frombuffer(hy, np.uint64), np.frombuffer(ps, np.uint32))
            for into, v in zip(got, row):
                into.append(v)
        keys, many, x, y, at = (np.concatenate(v) for v in got)
        order = np.lexsort((y, x))
        new = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])])
        group = np.empty(len(x), np.int64)
        group[order] = np.cumsum(new) - 1
        hit = np.bincount(group, weights=many)[group] > 1
        return _by_key(keys[hit], at[hit], routes)

    return run


def _cut(window: int, keep_text: bool) -> Callable:
    """(id, text, packed starts) to what is left of each text."""

    def run(batches):
        for batch in batches:
            found, ids = batch.column("at").to_pylist(), batch.column("id")
            for a, b, raw, off in text_slices(batch.column("text")):
                _, s, e, woff = _words(raw, off)
                data = raw.tobytes()
                rows = []
                for i in range(b - a):
                    n = int(woff[i + 1] - woff[i])
                    mark = np.zeros(n + 1, np.int32)
                    at = np.frombuffer(found[a + i] or b"", np.uint64).astype(np.int64)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + window, -1)
                    gone = np.cumsum(mark)[:n] > 0
                    keep = np.flatnonzero(~gone) + woff[i]
                    left = b" ".join([data[p:q] for p, q in zip(s[keep].tolist(), e[keep].tolist())])
                    rows.append((n, int(gone.sum()), hashlib.sha256(left).hexdigest(), left.decode() if keep_text else None))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string())))],
                    names=["id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept]) for every row of docs.

    Removes each word that a window of `window` consecutive words covers whose word sequence also
    starts anywhere else, in the same text or another; windows are those of the input. Texts with
    equal word sequences are one entry with a count, so a group of copies of any size costs one.
    Null and empty texts have no words. Repeated rows are copies of one another; null ids come back
    as they are; an empty table gives no rows; columns besides id and text are not looked at. Texts
    of any length are taken whole.
    """
    block = (window + 1) // 2
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    src = src.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    digest = staged(src.select("key", "text").mapInArrow(_digests(), "id long, n long, d0 long, d1 long"), "digests")
    words = digest.agg(F.sum("n")).first()[0] or 0
    ranges = max(parts(docs.sparkSession), -(-words // RANGE_WORDS))
    groups = digest.groupBy("d0", "d1", "n").agg(F.count("*").alias("copies"), F.collect_set("id").alias("keys"))
    # Equal word sequences may differ in white space, so a group can have several keys.
    copied = staged(groups.where("copies > 1").select(F.explode("keys").alias("key"), "copies"), "copies")

    probes = src.select("key", "text").mapInArrow(_probes(window, block, ranges), "range int" + "".join(f", {c} binary" for c in PROBES[1:]))
    per_text = _gathered(probes.groupBy("range").applyInArrow(_hits(ranges), PACKED), "hits")
    per_text = staged(per_text.join(copied, "key", "full").select("key", "at", F.coalesce("copies", F.lit(1)).alias("copies")), "hits-of-texts")
    first = staged(
        src.join(per_text, "key", "left").select("id", "key", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "at")
        .mapInArrow(_split(window, keep_text), "id long, key long, copies long, at binary, text string, n_words long, n_removed long, kept_sha256 string, kept string"),
        "first-pass",
    )
    near = first.where("text is not null and at is not null").select("key", "copies", "at", "text")
    around = near.mapInArrow(_windows(window, block, ranges), "range int" + "".join(f", {c} binary" for c in WINDOWS[1:]))
    starts = _gathered(around.groupBy("range").applyInArrow(_repeated(ranges), PACKED), "starts")
    open_ = first.where("kept_sha256 is null").select("id", "key", "text").join(starts, "key", "left")
    result = "id long, n_words long, n_removed long, kept_sha256 string, kept string"
    done = first.where("kept_sha256 is not null").select("id", "n_words", "n_removed", "kept_sha256", "kept")
    done = done.union(open_.select("id", "text", "at").mapInArrow(_cut(window, keep_text), result))
    done = done.withColumnRenamed("id", id_col)
    return done if keep_text else done.drop("kept")
