"""Ranks, look-ups and running sums that must not gather rows, and the statistics built on them."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from discursa.operators import calibration, metrics, ranking


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_rank(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 1, 5]), i) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, id int")
    ranked = ranking.global_rank(df, [F.col("k"), F.col("id")], "position", partitions=7)
    assert "SinglePartition" not in plan(ranked)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.id) for r in sorted(ranked.collect(), key=lambda r: r.position)] == want
    assert sorted(r.position for r in ranked.collect()) == list(range(1, 501))
    assert ranking.global_rank(df.limit(0), [F.col("id")]).count() == 0


def test_places(spark):
    bounds = [1, 4, 4, 9, 20]
    df = spark.range(-1, 25).select("id", F.array(*[F.lit(b).cast("long") for b in bounds]).alias("b"))
    got = {r.id: r.p for r in ranking.with_place(df, "p", F.col("id"), "b", 5).collect()}
    assert got == {v: sum(b <= v for b in bounds) for v in range(-1, 25)}
    empty = df.withColumn("b", F.array().cast("array<bigint>"))
    assert {r.p for r in ranking.with_place(empty, "p", F.col("id"), "b", 5).collect()} == {0}


def test_crowded_confidences(spark):
    """99 % of the confidences lie above 0.999; no bucket may hold more than a small share of them."""
    rng = random.Random(2)
    rows = [("t", 0.999 + rng.random() / 1000 if rng.random() < 0.99 else rng.random(), int(rng.random() < 0.8)) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "task string, confidence double, correct int")
    got = sorted(calibration.coverage_curve(df, ["task"]).collect(), key=lambda r: -r.confidence)
    answered = right = 0
    for (_, c, k), r in zip(sorted(rows, key=lambda r: -r[1]), got):
        answered, right = answered + 1, right + k
        assert (r.confidence, r.answered, r.n_correct) == (c, answered, right)
    assert len(got) == 20_000
    cuts = [i / calibration.CONF_BUCKETS for i in range(1, calibration.CONF_BUCKETS)]
    q = df.groupBy("task").agg(F.percentile_approx("confidence", cuts, 10 * calibration.CONF_BUCKETS).alias("cuts"))
    placed = ranking.with_place(df.join(q, "task"), "p", F.col("confidence"), "cuts", calibration.CONF_BUCKETS)
    assert placed.groupBy("p").count().agg(F.max("count")).first()[0] < 200


def test_newton_temperature(spark):
    rng = random.Random(3)
    rows = []
    for task, k, sharp in (("a", 3, 2.0), ("b", 5, 0.8), ("flat", 4, 0.0), ("sure", 3, 50.0)):
        for _ in range(400):
            z = [rng.gauss(0, 2) for _ in range(k)]
            p = [math.exp(sharp * x / 2) for x in z]
            rows.append((task, z, rng.choices(range(k), p)[0]))
    rows += [(None, [1.0, 2.0], 0), ("a", None, 1), ("a", [1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "task string, logits array<double>, target int")
    got = calibration.fit_temperature(df)

    def loss(task, t):
        out = 0
        for k, z, y in rows:
            if k == task and z and y is not None:
                out += math.log(sum(math.exp((x - max(z)) / t) for x in z)) + (max(z) - z[y]) / t
        return out

    for task, t in got.items():
        grid = min((loss(task, 0.5 + i * 0.005), 0.5 + i * 0.005) for i in range(901))
        assert abs(t - grid[1]) < 0.006 and loss(task, t) <= grid[0] + 1e-4
    assert set(got) == {"a", "b", "flat", "sure"} and got["flat"] > 4 and got["sure"] == pytest.approx(0.5)
    assert calibration.fit_temperature(df.limit(0)) == {}
    snapped = {r.task: r.temperature for r in calibration.snap_temperature(df.where("logits is not null and target is not null"), got, 0.01).collect()}
    assert snapped == {t: pytest.approx(v, abs=0.0101) for t, v in got.items()}


def test_hash_bootstrap_is_a_resample_of_rows(spark):
    rng = random.Random(4)
    classes = ["x", "y"]
    rows = [(m, i, rng.choice("xyz"), rng.choice(["x", "y", None])) for m in ("m1", "m2") for i in range(60)]
    df = spark.createDataFrame(rows, "model string, id int, y_true string, y_pred string")
    scores = metrics.bootstrap_scores_by_hash(df, classes, 40, keys=["model"])
    assert "CartesianProduct" not in plan(scores)
    got = {(r.model, r.rep): r.macro_f1 for r in scores.collect()}
    for m in ("m1", "m2"):
        known = [(i, t if t in classes else "(other)", p) for k, i, t, p in rows if k == m and p]
        order = sorted((t, p) for _, t, p in known)  # a drawn position is a row in this order
        for rep in range(1, 41):
            drawn = Counter(order[int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:15], 16) % len(order)] for i, _, _ in known)
            f1 = []
            for c in classes:
                tp = drawn[c, c]
                wrong = sum(n for (t, p), n in drawn.items() if (t == c) != (p == c))
                f1.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
            assert got[m, rep] == pytest.approx(sum(f1) / 2)
    alone = metrics.bootstrap_scores_by_hash(df.where("model = 'm1'"), classes, 3).collect()
    assert {r.rep: r.macro_f1 for r in alone} == {rep: got["m1", rep] for rep in (1, 2, 3)}


def test_hash_bootstrap_draws_once_for_an_id(spark, monkeypatch):
    """Rows of an id share its draws, in every group, however often they come; a null id is one too."""
    monkeypatch.setattr(metrics, "GROUPS", 1)
    rows = [(m, i, t, "x") for m in ("m1", "m2") for i in ("a", "a", "b", None) for t in ("x", "y")]
    df = spark.createDataFrame(rows, "model string, id string, y_true string, y_pred string")
    scores = metrics.bootstrap_scores_by_hash(df, ["x", "y"], 5, keys=["model"])
    assert "MapInArrow" in plan(scores) and "Generate explode(" not in plan(scores)
    got = {(r.model, r.rep): r.macro_f1 for r in scores.collect()}
    for rep in range(1, 6):
        u = {i: int(hashlib.md5(f"42:{rep}{i}".encode()).hexdigest()[:15], 16) for i in (":a", ":b", "")}
        tp = sum(n for i, n in ((":a", 4), (":b", 2), ("", 2)) if u[i] % 8 < 4)  # (x, x) comes first
        f1 = 2 * tp / (2 * tp + 8 - tp) if tp else 0.0
        assert got["m1", rep] == got["m2", rep] == pytest.approx(f1 / 2)
