"""Near-duplicates: minima of many universal hashes, banding, verification, components.

Every pair that shares a band is decided on the full shingle sets, without forming the pairs of a
bucket. Documents of equal sets are one class from the start. Each bucket then compares its members
with one pivot, the member that shares most buckets with others, and components are found. Where a
bucket still holds several components, the members outside its largest one are compared with the
others in blocks of bounded size inside tasks; only links leave them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.components import components
from discursa.llm.tables import staged
from discursa.llm.textbatch import grams, mix, spans, text_slices, tidy

ROWS, BANDS = 6, 40
#: Signature agreement under which a pair is not looked at: at similarity 0.8 the mean is 0.8 and
#: the standard deviation of 240 minima 0.026, so this is over five of them away.
SURE = 0.66
#: Most documents on either side of a block.
BLOCK_ROWS = 512


def shingle_sets(raw, off, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one."""
    h, _, _, woff = spans(raw, off)
    g, goff = grams(h, woff, words)
    short = {}
    for n in range(1, words):
        s, soff = grams(h, woff, n)
        for i in np.flatnonzero(np.diff(woff) == n):
            short[int(i)] = s[soff[i] : soff[i] + 1]
    for i in range(len(off) - 1):
        yield short[i] if i in short else np.unique(g[goff[i] : goff[i + 1]])


def _minima(sets: list[np.ndarray], rows: int, bands: int, seed: int = 7):
    """(minima of each set, band keys of each set) under rows * bands universal hashes."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1 << 31, size=rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(1 << 32, size=rows * bands, dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    minima = np.zeros((len(sets), rows * bands), np.uint32)
    if full:
        low = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])])[:-1].astype(np.int64)
        for j in range(rows * bands):
            minima[full, j] = np.minimum.reduceat(low * a[j] + b[j], starts)
    keys = np.zeros((len(sets), bands), np.uint64)
    for j in range(rows):
        keys = mix(keys * np.uint64(31) + minima[:, j::rows])
    return minima, mix(keys + np.arange(bands, dtype=np.uint64)[None, :])


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Size and 128-bit digest of each set."""
    d0 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    d1 = [int(mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
    return pa.array([len(s) for s in sets], pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64())


def signatures(words: int, rows: int, bands: int) -> Callable:
    """mapInArrow function: (id, text) to set size, 128-bit set digest and band keys."""

    def run(batches):
        for batch in batches:
            for at, to, raw, off in text_slices(batch.column(1)):
                sets = list(shingle_sets(raw, off, words))
                _, keys = _minima(sets, rows, bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), *_digests(sets), pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))],
                    names=["id", "n", "d0", "d1", "keys"],
                )

    return tidy(run)


def _contents(words: int, rows: int, bands: int) -> Callable:
    """mapInArrow function: (id, text) to set size and digest, a byte of each minimum, 32 bits of each
    band key, the set."""

    def run(batches):
        for batch in batches:
            for at, to, raw, off in text_slices(batch.column(1)):
                sets = list(shingle_sets(raw, off, words))
                minima, keys = _minima(sets, rows, bands)
                small = ((minima * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                keys = (keys >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at), *_digests(sets), pa.array([x.tobytes() for x in small], pa.binary()),
                        pa.array([x.tobytes() for x in keys], pa.binary()),
                        pa.array([x.tobytes() for x in sets], pa.binary()),
                    ],
                    names=["id", "n", "d0", "d1", "sig", "keys", "members"],
                )

    return tidy(run)


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """den * |both| >= num * |either| for sorted sets."""
    if num * max(len(x), len(y)) > den * min(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _verify(num: int, den: int, sure: float) -> Callable:
    """mapInArrow function on pairs with both contents: signatures first, then the full sets."""

    def run(batches):
        for batch in batches:
            sx, sy, x, y = (batch.column(c).to_pylist() for c in ("sx", "sy", "x", "y"))
            keep = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                if np.mean(np.frombuffer(sx[i], np.uint8) == np.frombuffer(sy[i], np.uint8)) >= sure:
                    keep[i] = _linked(np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64), num, den)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return tidy(run)


def _block(num: int, den: int, sure: float) -> Callable:
    """applyInArrow function on one block of a bucket: rows with side 1 against rows with side 0.

    A pair that shares several bands is decided in the first of them only."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, c = table.column("id").to_numpy(), table.column("c").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint32).reshape(len(ids), -1)
        here = np.uint32((int(table.column("bucket")[0].as_py()) & (1 << 64) - 1) >> 32)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("members").to_pylist()]
        rest = table.column("rest").to_numpy(zero_copy_only=False)
        mine, others = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        out = []
        for i in mine:
            # Two documents outside the largest component meet twice; the lower id leaves it to the other.
            js = others[(c[others] != c[i]) & ~(rest[others] & (ids[others] > ids[i]))]
            js = js[(sig[js] == sig[i]).mean(axis=1) >= sure]
            if len(js):
                same = keys[js] == keys[i]
                js = js[keys[i][same.argmax(axis=1)] == here]
            out += [(ids[i], ids[j]) for j in js if _linked(sets[i], sets[j], num, den)]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, num: int = 80, den: int = 100,
    rows: int = ROWS, bands: int = BANDS, sure: float = SURE,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked when den * |A and B| >= num * |A or B| over their sets of distinct
    shingles of `words` lower-cased (A-Z) words. The chance that a pair at the bound of 0.8 shares no
    band is (1 - 0.8**rows)**bands, 5e-6 with the defaults.

    Null and empty texts have an empty set and are linked with nothing. A row without id keeps a null
    component and kept = false. Rows of one id are one document, whatever their texts: a link of one of them
    is a link of the document, and all come back with one component. Fewer words
    than a shingle make one shingle. An empty table gives an empty result; columns besides id and text
    are not looked at. Texts of any length are taken whole.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = staged(
        src.mapInArrow(signatures(words, rows, bands), "id long, n long, d0 long, d1 long, keys array<long>"),
        "signatures",
    )
    sig, alias = _nodes(sig)
    known = sig.where("n > 0 and id is not null")
    copies = staged(
        known.groupBy("d0", "d1", "n").agg(F.min("node").alias("rep"), F.max("node").alias("top")).where("rep < top"),
        "copies",
    )
    member = staged(
        sig.select("id", "node", "n", "d0", "d1").join(copies.drop("top"), ["d0", "d1", "n"], "left")
        .select("id", "node", "n", F.when(F.col("n") > 0, F.coalesce("rep", "node")).otherwise(F.col("node")).alias("rep")),
        "classes",
    )
    copied = member.where("n > 0 and node != rep").select("node").distinct()
    bucket = staged(
        known.select("node", "keys").join(copied, "node", "left_anti").select(F.col("node").alias("id"), F.explode("keys").alias("bucket")),
        "bands",
    )
    full = bucket.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("k"))
    members = staged(bucket.join(staged(full.where("least < most").select("bucket", "k"), "buckets"), "bucket"), "members")
    weight = staged(members.groupBy("id").agg(F.sum("k").alias("weight")), "weights")
    content = _content_of(src, weight, alias, _contents(words, rows, bands))

    heavy = F.max(F.struct("weight", (-F.col("id")).alias("order")))
    pivots = staged(
        members.join(weight, "id").groupBy("bucket").agg((-heavy["order"]).alias("p")), "pivots"
    )
    at_pivot = staged(members.select("bucket", "id").join(pivots, "bucket"), "at-pivot")
    pairs = at_pivot.where("id != p").select(F.col("id").alias("a"), F.col("p").alias("b")).distinct()
    one = content.select(F.col("id").alias("a"), F.col("sig").alias("sx"), F.col("members").alias("x"))
    two = content.select(F.col("id").alias("b"), F.col("sig").alias("sy"), F.col("members").alias("y"))
    links = pairs.join(one, "a").join(two, "b").mapInArrow(_verify(num, den, sure), "a long, b long")
    if alias is not None:  # rows of one document belong together, and so do those of equal sets
        same = alias.join(alias.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b")
        equal = member.where("n > 0 and node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
        links = links.union(same).union(equal)
    comp = staged(components(staged(links, "verified")), "components")

    rest = _rest(at_pivot.where("id != p").select("bucket", "id"), comp)
    more = (
        rest.join(content, "id").groupBy("bucket", "mine", "other")
        .applyInArrow(_block(num, den, sure), "a long, b long")
    )
    comp = staged(_merged(comp, staged(more, "verified")), "components")
    done = member.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "id", "n", F.coalesce("component", "rep").alias("component")
    )
    if alias is not None:
        done = _by_id(staged(done, "by-node"))
    done = done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _nodes(sig: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Adds node, what links are found between: the id, or where an id has several sets, a number beyond
    all ids for each of them. The second result names these (id, n, d0, d1, node); None if there are none."""
    first, last = F.min(F.struct("d0", "d1", "n")), F.max(F.struct("d0", "d1", "n"))
    several = sig.where("id is not null").groupBy("id").agg(first.alias("a"), last.alias("b")).where("a != b").select("id")
    several = staged(several, "several-sets")
    if several.isEmpty():
        return sig.withColumn("node", F.col("id")), None
    beyond = sig.agg(F.max("id")).first()[0] + 1
    sets = sig.join(several, "id", "left_semi").select("id", "n", "d0", "d1").distinct()
    alias = staged(sets.withColumn("node", F.monotonically_increasing_id() + beyond), "nodes")
    sig = sig.join(alias, ["id", "n", "d0", "d1"], "left").withColumn("node", F.coalesce("node", "id"))
    return staged(sig.select("id", "n", "d0", "d1", "keys", "node"), "signatures"), alias.where("n > 0")


def _content_of(src: DataFrame, weight: DataFrame, alias: DataFrame | None, run: Callable) -> DataFrame:
    """(id, sig, keys, members) of the nodes in weight, once each; the nodes are called id."""
    schema = "id long, n long, d0 long, d1 long, sig binary, keys binary, members binary"
    if alias is None:
        return staged(src.join(weight, "id", "left_semi").mapInArrow(run, schema).select("id", "sig", "keys", "members"), "contents")
    ids = weight.select("id").union(alias.join(weight.select(F.col("id").alias("node")), "node", "left_semi").select("id")).distinct()
    rows = src.join(ids, "id", "left_semi").mapInArrow(run, schema).join(alias, ["id", "n", "d0", "d1"], "left")
    rows = rows.select(F.coalesce("node", "id").alias("id"), "sig", "keys", "members").join(weight.select("id"), "id", "left_semi")
    return staged(rows.dropDuplicates(["id"]), "contents")


def _by_id(done: DataFrame) -> DataFrame:
    """Components named by the smallest id in them, the same for all rows of an id, empty ones too."""
    least = done.where("n > 0 and id is not null").groupBy("component").agg(F.min("id").alias("least"))
    of = done.where("n > 0 and id is not null").select("id", "component").distinct().join(least, "component")
    of = staged(of.groupBy("id").agg(F.min("least").alias("least")), "of-ids")
    return done.join(of, "id", "left").join(
        least.withColumnRenamed("least", "own"), "component", "left"
    ).select("id", "n", F.coalesce("least", "own", "id").alias("component"))


def keep_one(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group of linked texts the one of smallest id stays, once.

    Rows are told apart by id and text, so of rows that share an id the unlike texts stay. Of rows with
    equal id and text the least by their other columns stays; of linked texts with one id, that of least
    digest. Rows without id all stay, as do rows without words (one for each id and text). An empty
    table stays empty; columns must be orderable. Groups are those of near_duplicates.
    """
    cols = docs.columns
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    twice = docs.groupBy(id_col).count().where(F.col("count") > 1).where(F.col(id_col).isNotNull()).select(id_col)
    twice = staged(twice, "repeated-ids")
    if twice.isEmpty():
        groups = near_duplicates(docs, id_col, text_col, words)
        gone = staged(groups.where("not kept").where(F.col(id_col).isNotNull()).select(id_col), "near-copies")
        return docs.join(gone, id_col, "left_anti").select(*cols)
    unlike = docs.join(twice, id_col, "left_anti")
    alike = docs.join(twice, id_col, "left_semi").groupBy(id_col, digest.alias("_digest")).agg(F.min(F.struct(*cols)).alias("_r"))
    beyond = docs.agg(F.max(id_col)).first()[0] + 1
    alike = alike.select("_r.*", "_digest", (F.monotonically_increasing_id() + beyond).alias("_key"))
    rows = staged(unlike.select(*cols, F.lit("").alias("_digest"), F.col(id_col).alias("_key")).unionByName(alike), "rows")
    groups = near_duplicates(rows, "_key", text_col, words).where("_key is not null").select("_key", "component_id")
    order = rows.select("_key", F.struct(F.col(id_col), "_digest", "_key").alias("o"))
    first = groups.join(order, "_key").groupBy("component_id").agg(F.min("o").alias("o"))
    kept = staged(first.select("o._key"), "kept")
    return rows.join(kept, "_key", "left_semi").select(*cols).union(rows.where("_key is null").select(*cols))


def _rest(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (bucket, mine, other, side, id, c, rest) of the blocks to compare: in every bucket with
    several components, what is outside its largest one (side 1) against all of it (side 0)."""
    lab = members.join(comp.select(F.col("node").alias("id"), "component"), "id", "left")
    lab = staged(lab.select("bucket", "id", F.coalesce("component", "id").alias("c")), "labelled")
    by_c = lab.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    live = (
        by_c.groupBy("bucket").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all"), F.count("*").alias("nc"))
        .where("nc > 1")
        .select(
            "bucket", F.col("top.c").alias("most"), F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("others"),
            F.ceil((F.col("all") - F.col("top.k")) / BLOCK_ROWS).cast("int").alias("mines"),
        )
    )
    lab = staged(lab.join(staged(live, "live-buckets"), "bucket"), "live")
    lab = lab.select("*", (F.col("c") != F.col("most")).alias("rest"))
    block = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    mine = lab.where("rest").select(
        "bucket", (block % F.col("mines")).alias("mine"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"),
        F.lit(1).alias("side"), "id", "c", "rest",
    )
    other = lab.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("mines") - 1)).alias("mine"), (block % F.col("others")).alias("other"),
        F.lit(0).alias("side"), "id", "c", "rest",
    )
    long = lambda df: df.withColumns({"mine": F.col("mine").cast("long"), "other": F.col("other").cast("long")})
    return long(mine).union(long(other))


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after new links: only the graph between components found before is walked."""
    for end in ("a", "b"):
        at = comp.select(F.col("node").alias(end), F.col("component").alias(f"{end}c"))
        links = links.join(at, end, "left").withColumn(f"{end}c", F.coalesce(f"{end}c", end))
    links = staged(links, "links")
    merged = staged(components(links, "ac", "bc"), "merged").select(F.col("node").alias("component"), F.col("component").alias("to"))
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comp, "node", "left_anti")
    now = comp.union(alone.select("node", F.col("node").alias("component")))
    return now.join(merged, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
