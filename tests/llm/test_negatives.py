import random

import numpy as np
from discursa.llm import negatives
from pyspark.sql import functions as F

SCHEMA = "id long, label int, vec array<long>, score string"


def brute(rows, step=5, positives=5, negatives=3):
    one = {}
    for i, label, vec, *_ in rows:
        if None not in (i, label, vec):
            one[i] = min(one.get(i, (label, vec)), (label, vec))
    out = []
    for a in one:
        if a % step:
            continue
        s = [(-sum(x * y for x, y in zip(one[a][1], v)), i, label) for i, (label, v) in one.items() if i != a]
        for p, pid, _ in sorted(x for x in s if x[2] == one[a][0])[:positives]:
            fits = sorted(x for x in s if x[2] != one[a][0] and -50 * p <= -100 * x[0] <= -95 * p)
            out += [(a, pid, k + 1, i, -p, -n) for k, (n, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **tree):
    df = spark.createDataFrame([(*r, "x")[:4] for r in rows], SCHEMA)
    return sorted(map(tuple, negatives.mine(df, F.col("id") % 5 == 0, **tree).collect()))


def clustered(seed, n, labels=3, width=6):
    rng = random.Random(seed)
    centres = [[rng.randint(-90, 90) for _ in range(width)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, rng.randrange(labels), [x + rng.randint(-9, 9) for x in c]))
    return rows


def test_against_all_pairs(spark):
    for seed, n in ((1, 400), (2, 700)):
        rows = clustered(seed, n)
        want = brute(rows)
        assert len(want) > n
        assert mined(spark, rows) == want
        assert mined(spark, rows, sample=200, branches=4, leaf_rows=20) == want


def test_ties_and_a_common_vector(spark):
    rows = [(i, i % 2, [3, 4] if i % 3 else [i % 7, i % 5]) for i in range(300)]
    assert mined(spark, rows, sample=100, branches=3, leaf_rows=10) == brute(rows)


def test_edges(spark):
    rows = [(0, 1, [10, 0]), (0, 1, [10, 0]), (1, 1, [9]), (2, 2, [8, 5, 1]), (3, 2, []), (4, None, [9, 9]), (5, 1, None), (None, 1, [8, 8]), (6, 2, [-4, 0]), (7, 2, [7, 0]), (7, 1, [9, 9]), (10, 3, [1, 1])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    big = [(i, i % 2, [(1 << 29) + i * 3, i]) for i in range(40)]
    assert mined(spark, big) == brute(big)


def test_unfit_components(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, 1, [0.5, -0.001]), (2, 1, [inf]), (3, 1, [nan]), (4, 1, [None, 1.0]), (5, None, [1.0]), (6, 1, None)], "i long, l int, v array<float>")
    got = negatives.integer_rows(df, "i", F.col("l"), "v").collect()
    assert [tuple(r) for r in got] == [(1, 1, [128, -1])]


def test_tree_rules_out(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(20, 8)) * 400)[rng.integers(20, size=3000)] + rng.normal(size=(3000, 8)) * 5
    x = x.astype(np.int64)
    tree = negatives.Tree(x[:1000], 3000, 8, 100)
    leaf, add = tree.place(x)
    tree.ranges = add
    a = x[:50]
    s = negatives.scores(a, x)
    high = s.max(axis=1)
    low = (high * 0.98).astype(np.int64)
    seen = {(int(r), k) for k, at in tree.survivors(a, low[:, None], high[:, None]) for r in at}
    need = {(int(r), int(leaf[c])) for r, c in zip(*np.nonzero(s >= low[:, None]))}
    assert tree.leaves >= 20 and need <= seen
    assert len(seen) < 0.6 * len(a) * tree.leaves
