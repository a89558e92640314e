"""Hard negatives from vectors, found with a multiway hyperplane tree (GNAT).

A node of the tree has several split points; a row goes to the subtree of the nearest one. For each
subtree the node stores the least and the largest distance of its rows to each of the split points.
A search asks for scores in a window. With the norms of a subtree's rows the window is an annulus
around the anchor, and the triangle inequality turns it into a range of distances to each split point; a
subtree whose stored range does not meet it holds no answer. Leaves are compared exactly, in blocks.

The split points come from a bounded sample, every row is in the tree, and nothing that could be an
answer is passed over: results are exact. The sample's own rows also tell how good an answer must
be, which narrows the windows before any row is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discursa.llm.tables import staged

SAMPLE = 4096  # rows the tree is fitted on
BRANCHES = 16  # split points of a node
LEAF_ROWS = 2048  # expected rows from which a subtree is split again
BLOCK = 4096  # rows compared at once
CELLS = 1 << 22  # numbers of an array at once
LEAST, MOST = -(1 << 62), 1 << 62


def integer_rows(table: DataFrame, id_col: str, label: Column, vec_col: str, factor: int = 256) -> DataFrame:
    """(id, label, vec) with components floor(factor * x). Rows with a null id or label, a null vector
    or a null or non-finite component are left out."""
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.when(~bad, F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("long")))
    return table.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), whole.alias("vec")).where(
        "id is not null and label is not null and vec is not null"
    )


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of integers; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    if len(vectors):
        n = np.asarray(vectors.value_lengths())
        out[np.arange(width) < n[:, None]] = vectors.flatten().to_numpy()
    return out


class Tree:
    """Split points by node. A child k >= 0 is a node, else the leaf -k-1."""

    def __init__(self, sample: np.ndarray, total: int, branches: int, leaf_rows: int):
        self.nodes: list = []
        self.leaves = 0
        self.root = self._grow(sample.astype(float), np.arange(len(sample)), total, branches, leaf_rows)
        self.ranges: dict = {}  # (node, child): least and largest distance by split point, squared norms

    def _grow(self, x, at, total, branches, leaf_rows) -> int:
        points = self._split_points(x[at], branches) if len(at) * total > leaf_rows * len(x) and len(at) >= 2 * branches else []
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        k, centres = len(self.nodes), x[at[points]]
        self.nodes.append(None)
        near = _squares(x[at], centres).argmin(axis=1)
        self.nodes[k] = (centres, [self._grow(x, at[near == j], total, branches, leaf_rows) for j in range(len(points))])
        return k

    @staticmethod
    def _split_points(x: np.ndarray, branches: int) -> list[int]:
        """Points far from each other: each next one is the farthest from those there are."""
        out, far = [0], _squares(x, x[:1])[:, 0]
        while len(out) < branches and far.max() > 0:
            out.append(int(far.argmax()))
            far = np.minimum(far, _squares(x, x[out[-1:]])[:, 0])
        return out

    def place(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Leaf of every row, and what the rows add to the ranges."""
        x = x.astype(float)
        leaf, add = np.zeros(len(x), np.int64), {}
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                leaf[at] = -node - 1
                continue
            centres, kids = self.nodes[node]
            d = _squares(x[at], centres)
            near = d.argmin(axis=1)
            norm = (x[at] * x[at]).sum(axis=1)
            for j, kid in enumerate(kids):
                own = near == j
                if own.any():
                    add[node, j] = (np.sqrt(d[own].min(axis=0)), np.sqrt(d[own].max(axis=0)), norm[own].min(), norm[own].max())
                    todo.append((kid, at[own]))
        return leaf, add

    def survivors(self, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of a) that may meet. Each row of a asks for scores from low to high, in one of
        several windows; a window with low > high asks for nothing."""
        a = a.astype(float)
        low = np.where(low <= LEAST, -np.inf, low.astype(float))
        high = np.where(high >= MOST, np.inf, high.astype(float))
        norm = (a * a).sum(axis=1)
        todo = [(self.root, np.flatnonzero((low <= high).any(axis=1)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                yield -node - 1, at
                continue
            centres, kids = self.nodes[node]
            d = np.sqrt(_squares(a[at], centres))[:, None, :]
            for j, kid in enumerate(kids):
                if (node, j) not in self.ranges:
                    continue
                least, largest, small, large = self.ranges[node, j]
                n = norm[at, None]
                slack = 1e-7 * (n + large) + 1e-6  # for rounding
                far = n + large - 2 * low[at] + slack
                near = n + small - 2 * high[at] - slack
                ok = (low[at] <= high[at]) & (far >= 0) & (low[at] <= np.sqrt(n * large) + slack)
                far, near = np.sqrt(np.maximum(far, 0))[:, :, None], np.sqrt(np.maximum(near, 0))[:, :, None]
                root = np.sqrt(slack)[:, :, None]
                ok &= (np.maximum(d - far, near - d) <= largest + root).all(axis=2) & (d + far >= least - root).all(axis=2)
                keep = ok.any(axis=1)
                if keep.any():
                    todo.append((kid, at[keep]))


def scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where that is exact, else in 64-bit arithmetic."""
    if not a.size or not x.size:
        return np.zeros((len(a), len(x)), np.int64)
    bound = np.abs(a.astype(float)).max() * np.abs(x.astype(float)).max() * a.shape[1]
    if bound < 2**53:
        return (a.astype(float) @ x.T.astype(float)).astype(np.int64)
    return a @ x.T


def top(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row of s among ok; ties go to the earlier column."""
    n = s.shape[1]
    if not s.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if np.abs(s.astype(float)).max() * n >= 2**62:
        s = np.unique(s, return_inverse=True)[1].reshape(s.shape)
    key = np.where(ok, s * n + (n - 1 - np.arange(n)), LEAST * 2)
    if n > k:
        part = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        part = np.tile(np.arange(n), (len(s), 1))
    row, j = np.nonzero(np.take_along_axis(ok, part, axis=1))
    return row, part[row, j]


class Search:
    """What a search for the best rows needs: bounded by the sample and the tree."""

    def __init__(self, tree: Tree, sample: tuple, width: int, blocks: np.ndarray):
        self.tree, self.width, self.blocks = tree, width, blocks
        self.ids, self.labels, self.vectors = sample
        self.block_rows = max(1, min(BLOCK, CELLS // max(1, width)))

    def narrow(self, ids, labels, a, low, high, k, same) -> np.ndarray:
        """low, raised to the k-th best score that sample rows have in each window."""
        low = low.copy()
        step = max(1, CELLS // max(1, len(self.ids)))
        for i in range(0, len(a), step):
            at = slice(i, i + step)
            s = scores(a[at], self.vectors)
            fits = ((labels[at, None] == self.labels) == same) & (ids[at, None] != self.ids)
            for w in range(low.shape[1]):
                ok = fits & (s >= low[at, w, None]) & (s <= high[at, w, None])
                if len(self.ids) >= k:
                    best = np.partition(np.where(ok, s, LEAST), len(self.ids) - k, axis=1)[:, len(self.ids) - k]
                    low[at, w] = np.maximum(low[at, w], best)
        return low


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """low and high of the anchors as matrices; missing windows ask for nothing."""
    low, high = batch.column("low"), batch.column("high")
    n = np.asarray(low.value_lengths())
    width = max(int(n.max(initial=0)), 1)
    a, b = np.ones((len(batch), width), np.int64), np.zeros((len(batch), width), np.int64)
    inside = np.arange(width) < n[:, None]
    a[inside], b[inside] = low.flatten().to_numpy(), high.flatten().to_numpy()
    return a, b


ROUTED = "leaf long, block int, kind int, id long, label long, vec array<long>, low array<long>, high array<long>"
FOUND = "anchor long, w int, id long, score long"


def _route(search, k: int, same: bool):
    """Sends each anchor to the blocks of the leaves that its windows do not rule out."""

    def run(batches):
        s = search.value
        for whole in batches:
            for i in range(0, len(whole), 512):
                batch = whole.slice(i, 512)
                a = _matrix(batch.column("vec"), s.width)
                low, high = _windows(batch)
                ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
                low = s.narrow(ids, labels, a, low, high, k, same)
                for leaf, at in s.tree.survivors(a, low, high):
                    part = batch.take(pa.array(at))
                    bounds = pa.array(low[at].tolist(), pa.list_(pa.int64())), pa.array(high[at].tolist(), pa.list_(pa.int64()))
                    for block in range(int(s.blocks[leaf])):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, leaf)), pa.array(np.full(n, block, np.int32)), pa.array(np.ones(n, np.int32)),
                             part.column("id"), part.column("label"), part.column("vec"), *bounds],
                            names=[c.split()[0] for c in ROUTED.split(", ")],
                        )

    return run


def _compare(search, k: int, same: bool):
    """Rows of a block come first, the anchors sent there stream past them."""

    def best(rows: tuple, batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
        ids, labels, x = rows
        step = max(1, CELLS // max(1, len(ids)))
        for i in range(0, len(batch), step):
            part = batch.slice(i, step)
            anchor, own = part.column("id").to_numpy(), part.column("label").to_numpy()
            s = scores(_matrix(part.column("vec"), width), x)
            fits = ((own[:, None] == labels) == same) & (anchor[:, None] != ids)
            low, high = _windows(part)
            for w in range(low.shape[1]):
                row, at = top(s, fits & (s >= low[:, w, None]) & (s <= high[:, w, None]), k)
                if len(row):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[row]), pa.array(np.full(len(row), w, np.int32)), pa.array(ids[at]), pa.array(s[row, at])],
                        names=["anchor", "w", "id", "score"],
                    )

    def run(batches):
        width = search.value.width
        key, parts, rows = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("leaf", "block", "kind")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if key is None or (keys[:2, a] != key).any():
                    key, parts, rows = keys[:2, a], [], None
                part = batch.slice(a, b - a)
                if keys[2, a] == 0:
                    parts.append((part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("vec"), width)))
                elif parts:
                    if rows is None:
                        rows = tuple(np.concatenate(c) for c in zip(*parts))
                    yield from best(rows, part, width)

    return run


def _best(points: DataFrame, anchors: DataFrame, search, k: int, same: bool) -> DataFrame:
    """(anchor, w, id, score, rank): the k best rows of each window of each anchor, of the anchor's
    label or of another one."""
    routed = anchors.mapInArrow(_route(search, k, same), ROUTED)
    none = F.lit(None).cast("array<long>")
    both = points.select("leaf", "block", F.lit(0).alias("kind"), "id", "label", "vec", none.alias("low"), none.alias("high")).union(routed)
    dealt = both.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind", "id")
    found = dealt.mapInArrow(_compare(search, k, same), FOUND)
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(rows: DataFrame, sample: int = SAMPLE, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, Search]:
    """Rows (id, label, vec) placed in a tree: (leaf, block, id, label, vec), and the search.

    The tree is fitted on at most `sample` rows, drawn by a hash of the id; ranges and sizes cover all
    rows. What the driver holds is bounded by `sample` and `branches`.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    share = min(1.0, 1.3 * sample / max(1, size.n)) * (1 << 40)
    drawn = rows.where(h < int(share)).orderBy(h, "id").limit(sample).toArrow()
    width = max(1, size.width)
    vectors = np.concatenate([np.zeros((0, width), np.int64), *(_matrix(c, width) for c in drawn["vec"].chunks)])
    tree = Tree(vectors, size.n, branches, leaf_rows)
    shared = spark.sparkContext.broadcast((tree, width))

    def place(batches):
        tree, width = shared.value
        for batch in batches:
            leaf, _ = tree.place(_matrix(batch.column("vec"), width))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "id", "label", "vec"])

    placed = staged(rows.select("id", F.col("label").cast("long").alias("label"), "vec").mapInArrow(place, "leaf long, id long, label long, vec array<long>"), "placed")

    def ranges(batches):
        tree, width = shared.value
        add: dict = {}
        for batch in batches:
            for key, (a, b, c, d) in tree.place(_matrix(batch.column("vec"), width))[1].items():
                if key in add:
                    e, f, g, h = add[key]
                    a, b, c, d = np.minimum(a, e), np.maximum(b, f), min(c, g), max(d, h)
                add[key] = (a, b, c, d)
        out = [(n, j, i, float(x), float(y)) for (n, j), (a, b, c, d) in add.items() for i, (x, y) in enumerate([(c, d), *zip(a, b)])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["node", "child", "i", "least", "largest"])

    found = placed.mapInArrow(ranges, "node long, child long, i long, least double, largest double")
    found = found.groupBy("node", "child", "i").agg(F.min("least").alias("a"), F.max("largest").alias("b")).orderBy("node", "child", "i")
    for r in found.collect():
        entry = tree.ranges.setdefault((r.node, r.child), [])
        entry.append((r.a, r.b))
    tree.ranges = {k: (np.array([a for a, _ in v[1:]]), np.array([b for _, b in v[1:]]), *v[0]) for k, v in tree.ranges.items()}
    blocks = np.zeros(tree.leaves, np.int64)
    search = Search(tree, (drawn["id"].to_numpy(), drawn["label"].to_numpy().astype(np.int64), vectors), width, blocks)
    for r in placed.groupBy("leaf").count().collect():
        blocks[r.leaf] = -(-r["count"] // search.block_rows)
    number = F.create_map(*[F.lit(int(x)) for p in enumerate(blocks) for x in p])
    block = F.pmod(F.xxhash64("id"), F.greatest(F.element_at(number, F.col("leaf").cast("int")), F.lit(1))).cast("int")
    return placed.withColumn("block", block), search


def _one_per_id(rows: DataFrame) -> DataFrame:
    """An id names one row: of several the one of least label and then least vector stays."""
    twice = staged(rows.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if twice.isEmpty():
        return rows
    least = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r"))
    return rows.join(twice, "id", "left_anti").union(least.select("id", "r.label", "r.vec"))


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, **tree
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has id, label, vec (array<long>); a score is the inner product with the anchor, higher ones come
    first, ties by smaller id. Anchors are the rows where `anchor` (a condition on id and label) holds.
    Positives of an anchor are its first other rows of the same label. Negatives of a positive are the
    first rows of another label with low*positive_score <= 100*negative_score <= high*positive_score, so a
    negative positive_score has none. Fewer rows than asked for are all returned.

    Vectors of different lengths count as if the shorter ended in zeros; scores are 64-bit. Repeated rows
    count once, of different rows with one id the least by label and vector is the row of that id. Rows with a
    null are left out; no rows give none. Other columns are not looked at.
    """
    rows = _one_per_id(rows.where("id is not null and label is not null and vec is not null").select("id", "label", "vec"))
    points, search = build(rows, **tree)
    search = rows.sparkSession.sparkContext.broadcast(search)
    anchors = points.where(anchor).select("id", "label", "vec")
    bounds = (F.array(F.lit(x).cast("long")) for x in (LEAST, MOST))
    open_windows = anchors.select("id", "label", "vec", *(b.alias(c) for b, c in zip(bounds, ("low", "high"))))
    near = staged(_best(points, open_windows, search, positives, True), "positives")

    wide = "cast(score as decimal(25, 0))"
    below = "({0} - pmod({0}, 100)) div 100".format  # rounds down, as the signs may differ
    window = near.select(
        F.col("anchor").alias("id"), "rank", F.expr("-(" + below(f"(-{low} * {wide})") + ")").alias("low"),
        F.expr(below(f"({high} * {wide})")).alias("high"),
    )
    sorted_windows = F.array_sort(F.collect_list(F.struct("rank", "low", "high")))
    asked = window.groupBy("id").agg(sorted_windows.alias("x")).select("id", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    found = _best(points, anchors.join(asked, "id"), search, negatives, False)
    given = near.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(given, ["anchor", "w"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
