import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from discursa.functions import scores as sc
from discursa.operators import calibration, metrics

CLASSES = ["a", "b", "c", "never"]


def f1(pairs, classes):
    out = {}
    for c in classes:
        tp = sum(t == c == p for t, p in pairs)
        wrong = sum((t == c) != (p == c) for t, p in pairs)
        out[c] = 2 * tp / (2 * tp + wrong) if 2 * tp + wrong else 0.0
    return out


@pytest.fixture(scope="module")
def pairs():
    random.seed(3)
    rows = [(random.choice("aaabbc"), random.choice(["a", "b", "c", "odd"])) for _ in range(300)]
    return [(t, t if i % 2 else p) for i, (t, p) in enumerate(rows)]


@pytest.fixture(scope="module")
def preds(spark, pairs):
    rows = [("m", "t", str(i), t, p) for i, (t, p) in enumerate(pairs)]
    rows += [("m", "t", "x1", "a", None), ("m", "t", "x2", "b", None)]
    return spark.createDataFrame(rows, "model string, task string, id string, y_true string, y_pred string")


def test_scores(preds, pairs):
    counts = metrics.confusion_counts(preds)
    want = f1(pairs, CLASSES)
    got = {r["class"]: r for r in metrics.class_scores(counts, CLASSES).collect()}
    assert {c: got[c].f1 for c in CLASSES} == pytest.approx(want)
    assert got["a"].support == sum(t == "a" for t, _ in pairs) and got["never"].small_support
    row = metrics.evaluation(preds, {"t": CLASSES}).collect()[0]
    assert row.macro_f1 == pytest.approx(sum(want.values()) / 4)
    assert row.accuracy == pytest.approx(sum(t == p for t, p in pairs) / len(pairs))
    assert row.coverage == pytest.approx(300 / 302)
    cells = {(r.y_true, r.y_pred): r.n for r in metrics.confusion_matrix(counts, CLASSES).collect()}
    assert len(cells) == 16 and cells[("never", "a")] == 0
    assert cells[("a", "b")] == sum(p == ("a", "b") for p in pairs)


def test_known_baseline_value(spark):
    """A constant prediction that is right on 70 of 283 rows of six classes."""
    sizes = {"s1": 70, "s2": 64, "s3": 60, "s4": 45, "s5": 25, "s6": 19}
    rows = [("m", "t", k, "s1") for k, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "model string, task string, y_true string, y_pred string")
    row = metrics.summary(metrics.confusion_counts(df), list(sizes)).collect()[0]
    assert round(row.macro_f1, 4) == 0.0661 and round(row.accuracy, 3) == 0.247


def test_bootstrap_agrees_with_resampled_rows(preds, pairs):
    counts = metrics.confusion_counts(preds)
    row = metrics.bootstrap_ci(counts, CLASSES).collect()[0]
    again = metrics.bootstrap_ci(counts.repartition(3), CLASSES).collect()[0]
    assert (row.ci_low, row.ci_high) == (again.ci_low, again.ci_high)
    rng = np.random.default_rng(1)
    n = len(pairs)
    scores = []
    for _ in range(1000):
        drawn = [pairs[i] for i in rng.integers(0, n, n)]
        scores.append(sum(f1(drawn, CLASSES).values()) / 4)
    low, high = np.percentile(scores, [2.5, 97.5])
    assert abs(row.ci_low - low) < 0.01 and abs(row.ci_high - high) < 0.01


def test_majority_and_selection(spark):
    train = spark.createDataFrame([("z",), ("b",), ("a",), ("b",), ("a",)], "stance string")
    assert metrics.majority_class(train, "stance").collect()[0][0] == "a"
    s = spark.createDataFrame([("e0", 0, 0.4), ("e1", 1, 0.5), ("e2", 2, 0.5)], "candidate string, ordinal int, macro_f1 double")
    assert metrics.select_model(s).collect()[0].candidate == "e1"


def plain_threshold(conf, correct, target=0.8):
    order = np.argsort(-np.asarray(conf), kind="stable")
    c, ok = np.asarray(conf)[order], np.asarray(correct)[order]
    acc = np.cumsum(ok) / np.arange(1, len(ok) + 1)
    cap = float(np.sort(conf)[(len(conf) - 1) // 2])
    hit = np.where(acc >= target)[0]
    return min(float(c[hit.max()]) if len(hit) else cap, cap)


@pytest.mark.parametrize("seed,all_wrong", [(0, False), (1, False), (2, True), (3, False)])
def test_abstain_threshold(spark, seed, all_wrong):
    rng = np.random.default_rng(seed)
    conf = rng.random(101 + seed)
    correct = np.zeros(len(conf), int) if all_wrong else (rng.random(len(conf)) < 0.5 + conf / 2).astype(int)
    df = spark.createDataFrame([("t", float(c), int(k)) for c, k in zip(conf, correct)], "task string, confidence double, correct bigint")
    row = calibration.abstain_threshold(df, ["task"]).collect()[0]
    assert row.threshold == pytest.approx(plain_threshold(conf, correct))
    bins = calibration.reliability(df, ["task"])
    ece = calibration.expected_calibration_error(bins, ["task"]).collect()[0].ece
    b = np.minimum((conf * 10).astype(int), 9)
    want = sum(abs(conf[b == i].mean() - correct[b == i].mean()) * (b == i).sum() for i in set(b)) / len(conf)
    assert ece == pytest.approx(want)


def test_temperature_matches_fine_search(spark):
    rng = np.random.default_rng(5)
    logits = rng.normal(size=(200, 4)) * 3
    y = np.array([rng.choice(4, p=np.exp(z / 2.2) / np.exp(z / 2.2).sum()) for z in logits])
    df = spark.createDataFrame([("t", [float(v) for v in z], int(k)) for z, k in zip(logits, y)], "task string, logits array<double>, target int")
    got = calibration.fit_temperature(df)["t"]

    def loss(t):
        z = logits / t
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(200), y]))

    grid = np.linspace(0.5, 5, 4501)
    assert abs(got - grid[np.argmin([loss(t) for t in grid])]) < 0.01


def test_first_maximum_wins(spark):
    p = F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))
    row = spark.range(1).select(sc.top_class(p, ["x", "y", "z"]).alias("c"), sc.distribution(p, ["x", "y", "z"]).alias("d")).collect()[0]
    assert row.c == "x" and row.d == {"x": 0.4, "y": 0.4, "z": 0.2}


def test_kappa(spark):
    rows = [("t", "y", "y")] * 20 + [("t", "y", "n")] * 5 + [("t", "n", "y")] * 10 + [("t", "n", "n")] * 15
    row = metrics.kappa(spark.createDataFrame(rows, "task string, first string, second string"), ["task"]).collect()[0]
    assert row.agreement == pytest.approx(0.7) and row.kappa == pytest.approx(0.4)
