"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence of hashed words is fitted with numpy on a bounded sample of
confirmed toxic texts and of unlabelled ones. With class prior p, positive risk R+ and R- on the
confirmed texts and negative risk on the unlabelled ones, the risk p * R+ + max(0, U- - p * R-) is
unbiased for the labelled risk as long as its second part is not negative; where it would be, the
step undoes it instead. The prior is the toxic share of the training labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.textbatch import spans, text_slices

DIMS = 1 << 18
POSITIVES, UNLABELLED = 4_000, 24_000
#: A word needs this many confirmed texts, and so many standard deviations more of them than its share
#: of the unlabelled ones lets expect; other weights would only remember single texts.
LEAST_TEXTS, EXCESS = 3, 3.0
THRESHOLD = 0.3


def _buckets(h: np.ndarray, woff: np.ndarray):
    """Distinct buckets of each text's words."""
    b = (h % np.uint64(DIMS)).astype(np.int64)
    for i in range(len(woff) - 1):
        yield np.unique(b[woff[i] : woff[i + 1]])


def _sample(batches):
    for batch in batches:
        for a, b, raw, off in text_slices(batch.column("text")):
            h, _, _, woff = spans(raw, off, letters=True)
            packed = [x.astype(np.int32).tobytes() for x in _buckets(h, woff)]
            yield pa.RecordBatch.from_arrays([batch.column("positive").slice(a, b - a), pa.array(packed, pa.binary())], names=["positive", "words"])


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05, l2: float = 3e-4):
    """(weights, intercept) by Adam on the non-negative risk with logistic loss."""
    w, b = np.zeros(DIMS), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return w, b
    rows = [*positive, *unlabelled]
    is_p = np.arange(len(rows)) < len(positive)
    seen = np.bincount(np.concatenate(positive), minlength=DIMS)
    usual = np.bincount(np.concatenate(unlabelled), minlength=DIMS) * len(positive) / len(unlabelled)
    frequent = (seen >= LEAST_TEXTS) & (seen - usual >= EXCESS * np.sqrt(usual + 1))
    words, column = np.unique(np.concatenate([r[frequent[r]] for r in rows]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [int(frequent[r].sum()) for r in rows])
    n_p, n_u = is_p.sum(), (~is_p).sum()
    v, m, s = np.zeros(len(words) + 1), np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    v[-1] = b
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=v[column], minlength=len(rows)) + v[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = np.logaddexp(0, z)  # of calling a text clean
        slack = loss[~is_p].mean() - prior * loss[is_p].mean()
        g = np.where(is_p, -prior * p / n_p, p / n_u)  # of U- - p * R-
        if slack >= 0:
            g = g + np.where(is_p, prior * (p - 1) / n_p, 0)
        else:
            g = -g
        grad = np.append(np.bincount(column, weights=g[row], minlength=len(words)), g.sum())
        grad[:-1] += l2 * v[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        v = v - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    w[words] = v[:-1]
    return w, float(v[-1])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """Model from labels (doc_id, toxic), which the caller has cut down to the training rows, and docs
    (doc_id, text), from which unlabelled texts are drawn. The samples are bounded by the arguments
    and drawn by hash. Null ids and null labels are left out; without toxic labels the model answers
    with the prior (0.5 without labels) for every text."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(toxic / n, 1e-3), 0.999) if n else 0.5
    order = (F.xxhash64("doc_id", F.lit(3)), F.col("doc_id"))
    ids = known.where("toxic = 1").orderBy(*order).limit(positives).select("doc_id", F.lit(True).alias("positive"))
    others = docs.where("doc_id is not null").select("doc_id").orderBy(*order).limit(unlabelled).select("doc_id", F.lit(False).alias("positive"))
    picked = docs.select("doc_id", "text").join(F.broadcast(ids.union(others)), "doc_id")
    got = picked.mapInArrow(_sample, "positive boolean, words binary").collect()
    rows = [(r.positive, np.frombuffer(r.words, np.int32).astype(np.int64)) for r in got]
    rows.sort(key=lambda r: (not r[0], len(r[1]), r[1].tobytes()))
    return fit([x for p, x in rows if p], [x for p, x in rows if not p], prior)


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) of every row, from the whole text
    alone. Null and empty texts get the intercept's score. Repeated rows, null ids and other columns
    make no difference; an empty table gives no rows."""
    weights, intercept = model

    def run(batches):
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column(1)):
                h, _, _, woff = spans(raw, off, letters=True)
                z = np.array([weights[x].sum() for x in _buckets(h, woff)]) + intercept
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
