import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from discursa.llm import textbatch, toxicity
from discursa.llm.tables import documents, remainder
from pyspark.sql import functions as F


def test_held_out(spark):
    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.where(~held), labels.where(~held))
    got = toxicity.score(docs, model).join(labels, "doc_id").where(held).collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.85 * len(toxic) and sum(r.predicted for r in clean) < 0.05 * len(clean)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "bad bad"), (3, "bad bad"), (None, "fine"), (4, "word " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    assert {round(r.score, 6) for r in toxicity.score(docs, model).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1), (2, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, some)).count() == 6
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_fit(positive, unlabelled, prior, rounds, rate, l2):
    """The non-negative risk and Adam by plain loops over texts and words."""
    seen, usual = Counter(w for x in positive for w in x), Counter(w for x in unlabelled for w in x)
    scale = len(positive) / len(unlabelled)
    kept = {w for w in seen if seen[w] >= 3 and seen[w] - usual[w] * scale >= 3 * math.sqrt(usual[w] * scale + 1)}
    v = {w: 0.0 for w in kept} | {"b": math.log(prior / (1 - prior))}
    m, s, turned = dict.fromkeys(v, 0.0), dict.fromkeys(v, 0.0), 0

    def margin(x):
        return v["b"] + sum(v[w] for w in x if w in kept)

    for t in range(1, rounds + 1):
        grad = {w: l2 * v[w] if w != "b" else 0.0 for w in v}
        as_clean = lambda x: math.log1p(math.exp(margin(x)))
        slack = sum(map(as_clean, unlabelled)) / len(unlabelled) - prior * sum(map(as_clean, positive)) / len(positive)
        sign = 1 if slack >= 0 else -1
        turned += sign < 0
        parts = [(x, sign / len(unlabelled), 0) for x in unlabelled]
        parts += [(x, -sign * prior / len(positive), prior / len(positive) if sign > 0 else 0) for x in positive]
        for x, clean, toxic in parts:
            p = 1 / (1 + math.exp(-margin(x)))
            for w in [*(w for w in x if w in kept), "b"]:
                grad[w] += clean * p + toxic * (p - 1)
        for w in v:
            m[w] = 0.9 * m[w] + 0.1 * grad[w]
            s[w] = 0.999 * s[w] + 0.001 * grad[w] ** 2
            v[w] -= rate * (m[w] / (1 - 0.9**t)) / (math.sqrt(s[w] / (1 - 0.999**t)) + 1e-8)
    return v, turned


@pytest.mark.parametrize("prior, rate", [(0.2, 0.05), (0.6, 0.3)])
def test_risk_equals_plain_loops(prior, rate):
    rng = np.random.default_rng(5)
    draw = lambda lo, hi, n: [np.unique(rng.integers(lo, hi, 6)) for _ in range(n)]
    positive, unlabelled = draw(0, 12, 40), draw(4, 40, 60)
    w, b = toxicity.fit(positive, unlabelled, prior, rounds=60, rate=rate)
    v, turned = plain_fit([x.tolist() for x in positive], [x.tolist() for x in unlabelled], prior, 60, rate, 3e-4)
    assert b == pytest.approx(v.pop("b"), abs=1e-7) and len(v) > 2
    assert {int(i) for i in np.flatnonzero(w)} == set(v)
    assert all(w[i] == pytest.approx(x, abs=1e-7) for i, x in v.items())
    assert turned > 0 if prior > 0.5 else True  # the step that undoes a negative part is met


def test_scores_equal_plain_sums(spark):
    texts = ["Bad, bad WORDS here", None, "", "fine words", "x" * 5000 + " bad", "ÄRGER ärger é"]
    weights = np.random.default_rng(2).normal(size=toxicity.DIMS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, (weights, -0.4), 0.5).collect()}
    for i, text in enumerate(texts):
        ((_, _, raw, off),) = textbatch.text_slices(pa.array([text], pa.string()))
        distinct = {int(h) % toxicity.DIMS for h in textbatch.spans(raw, off, letters=True)[0]}
        want = 1 / (1 + math.exp(0.4 - sum(weights[j] for j in distinct)))
        assert got[i].score == pytest.approx(want) and got[i].predicted == (want >= 0.5)
