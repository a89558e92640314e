"""Evaluation of predictions. Everything is derived from confusion counts.

A prediction frame is long: model, task, id, y_true, y_pred (NULL when the model gave no
usable answer). One aggregation turns it into at most K*K counts per (model, task); all
scores are computed on those.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discursa import config
from discursa.session import stage

KEYS = ["model", "task"]


def pair_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Inner join on id; rows without a usable prediction drop out."""
    return truth.join(predictions.where(F.col("y_pred").isNotNull()), "id")


def confusion_counts(preds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return (
        preds.where(F.col("y_pred").isNotNull())
        .groupBy(*keys, "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _domain(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def observed_classes(counts: DataFrame) -> DataFrame:
    """Sorted union of true and predicted classes, for when no class list is given."""
    return (
        counts.select(F.explode(F.array("y_true", "y_pred")).alias("class")).distinct().orderBy("class")
    )


def confusion_matrix(counts: DataFrame, classes: list[str], keys: list[str] = KEYS) -> DataFrame:
    """All class pairs in fixed order, empty cells as 0."""
    grid = (
        counts.select(*keys)
        .distinct()
        .select(*keys, F.posexplode(_domain(classes)).alias("i", "y_true"))
        .select(*keys, "i", "y_true", F.posexplode(_domain(classes)).alias("j", "y_pred"))
    )
    return grid.join(counts, [*keys, "y_true", "y_pred"], "left").select(
        *keys, "i", "j", "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def class_scores(counts: DataFrame, classes: list[str], keys: list[str] = KEYS) -> DataFrame:
    """F1 and support of every class of the domain (0 when undefined)."""
    hit = F.col("y_true") == F.col("y_pred")
    n, zero = F.col("n"), F.lit(0)

    def part(cls: str, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(
            F.col(cls).alias("class"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn")
        )

    parts = counts.select(
        *keys,
        F.inline(
            F.array(
                part("y_true", F.when(hit, n).otherwise(zero), zero, F.when(hit, zero).otherwise(n)),
                part("y_pred", zero, F.when(hit, zero).otherwise(n), zero),
            )
        ),
    )
    sums = parts.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    grid = counts.select(*keys).distinct().select(
        *keys, F.posexplode(_domain(classes)).alias("ord", "class")
    )
    full = grid.join(sums, [*keys, "class"], "left").fillna(0, ["tp", "fp", "fn"])
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return full.select(
        *keys,
        "ord",
        "class",
        F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(F.lit(0.0)).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support"),
        ((F.col("tp") + F.col("fn")) < config.SMALL_SUPPORT).alias("small_support"),
    )


def summary(counts: DataFrame, classes: list[str], keys: list[str] = KEYS) -> DataFrame:
    """macro-F1 over the class domain and plain accuracy."""
    macro = class_scores(counts, classes, keys).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    acc = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias(
            "accuracy"
        ),
    )
    return macro.join(acc, keys)


def coverage(preds: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """How many rows a model answered at all."""
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count("y_pred").alias("n_answered"),
        (F.count("y_pred") / F.count(F.lit(1))).alias("coverage"),
    )


def evaluation(preds: DataFrame, tasks: dict[str, list[str]]) -> DataFrame:
    """One row per model and task: macro-F1, accuracy, coverage; tasks have their own classes."""
    counts = confusion_counts(preds)
    parts = [summary(counts.where(F.col("task") == t), cls) for t, cls in tasks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(coverage(preds).select(*KEYS, "coverage"), KEYS)


def majority_class(train: DataFrame, label: str) -> DataFrame:
    """Most frequent label, the smallest one on ties."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("majority"))


def majority_predictions(train: DataFrame, test: DataFrame, label: str, task: str) -> DataFrame:
    """Constant prediction: the majority class of the training set (a one-row broadcast)."""
    major = majority_class(train, label).withColumn("task", F.lit(task))
    rows = test.select(
        F.lit("majority").alias("model"), F.lit(task).alias("task"), "id", F.col(label).alias("y_true")
    )
    return rows.join(F.broadcast(major), "task").select(
        *KEYS, "id", "y_true", F.col("majority").alias("y_pred")
    )


def bootstrap_ci(
    counts: DataFrame, classes: list[str], n_resamples: int = 2000, seed: int = config.SEED,
    keys: list[str] = KEYS,
) -> DataFrame:
    """95 % interval of macro-F1 from seeded resamples with replacement.

    Resampling rows and re-counting is the same as a multinomial draw over the K*K cells,
    so the cost does not depend on the number of rows. Resamples run in blocks per group.
    Pairs outside the domain share one extra class that enters no average.
    """
    k, block = len(classes), 100
    names = _domain(classes)

    def index(c: str) -> Column:
        return F.coalesce(F.nullif(F.array_position(names, F.col(c)), F.lit(0)), F.lit(k + 1)) - 1

    cell = (index("y_true") * (k + 1) + index("y_pred")).cast("int")
    cells = (
        counts.groupBy(*keys, cell.alias("cell"))
        .agg(F.sum("n").alias("n"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    )
    jobs = cells.select(
        *keys, "cells", F.explode(F.sequence(F.lit(0), F.lit((n_resamples - 1) // block))).alias("b")
    ).repartition(*keys, "b")
    schema = ", ".join(f"{x} string" for x in keys) + ", f1 double"

    def resample(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = np.zeros((k + 1) * (k + 1))
                for c in row.cells:
                    n[c["cell"]] = c["n"]
                size = min(block, n_resamples - row.b * block)
                rng = np.random.default_rng([seed, row.b])
                draws = rng.multinomial(int(n.sum()), n / n.sum(), size=size)
                m = draws.reshape(-1, k + 1, k + 1)
                tp = np.diagonal(m, axis1=1, axis2=2)[:, :k]
                denom = m.sum(axis=1)[:, :k] + m.sum(axis=2)[:, :k]
                f1 = np.divide(2.0 * tp, denom, out=np.zeros(tp.shape), where=denom > 0)
                out = {x: [getattr(row, x)] * size for x in keys}
                yield pd.DataFrame({**out, "f1": f1.mean(axis=1)})

    draws = jobs.mapInPandas(resample, schema)
    ci = F.percentile("f1", F.array(F.lit(0.025), F.lit(0.975)))
    return draws.groupBy(*keys).agg(ci.alias("ci")).select(
        *keys, F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high")
    )


DRAWS = 1 << 17  # draws that a task holds at once
GROUPS = 64  # groups whose counts a task holds at once


def _drawn(n_resamples: int, seed: int):
    """(_group, _id, _n, bounds) in order of _id to (_group, rep, cell, n): how often each cell is drawn."""

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        heads = [f"{seed}:{rep}".encode() for rep in range(1, n_resamples + 1)]

        def emit():
            for group, n in counts.items():
                rep, cell = np.nonzero(n)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                columns = (np.full(len(rep), group), rep + 1, cell, n[rep, cell])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["_group", "rep", "cell", "n"])
            counts.clear()

        def draw(part):
            coded = part.column("_id").dictionary_encode("encode")
            tails = [b"" if x is None else b":" + x.encode() for x in coded.dictionary.to_pylist()]
            of, n, group = coded.indices.to_numpy(), part.column("_n").to_numpy(), part.column("_group").to_numpy()
            found = []
            for g, first in zip(*np.unique(group, return_index=True)):
                bounds, rows = np.array(part.column("bounds")[int(first)].as_py(), np.int64), np.flatnonzero(group == g)
                found.append((bounds, of[rows], n[rows], counts.setdefault(int(g), np.zeros((n_resamples, len(bounds)), np.int64))))
            step = max(1, DRAWS // len(part))
            for a in range(0, n_resamples, step):
                digests = b"".join([md5(h + t).digest() for h in heads[a : a + step] for t in tails])
                u = (np.frombuffer(digests, ">u8")[::2] >> 4).astype(np.int64).reshape(-1, len(tails))
                for bounds, ids, times, total in found:
                    cell = np.searchsorted(bounds, u[:, ids] % bounds[-1], "right")
                    cell += np.arange(len(u))[:, None] * len(bounds)
                    sums = np.bincount(cell.ravel(), weights=np.tile(times, len(u)), minlength=len(u) * len(bounds))
                    total[a : a + step] += sums.astype(np.int64).reshape(len(u), -1)

        for batch in batches:
            for a in range(0, len(batch), 1024):
                draw(batch.slice(a, 1024))
                if len(counts) > GROUPS:
                    yield from emit()
        yield from emit()

    return run


def bootstrap_scores_by_hash(
    preds: DataFrame, classes: list[str], n_resamples: int, id_col: str = "id", seed: int = config.SEED,
    keys: list[str] | None = None,
) -> DataFrame:
    """Row-level variant with hash-driven draws (reproducible in plain SQL), for every group of keys.

    Every row makes one draw per resample, hashed once for all groups that its id is in. The draw's position
    is looked up in the group's cumulated confusion counts, an array of at most (K+1)^2 bounds (labels
    outside the domain count as one) that travels with the row; no resample is joined with anything.
    """
    keys, asked = (keys, keys) if keys else (["_all"], [])
    known = {
        c: F.when(F.col(c).isin(classes), F.col(c)).otherwise("(other)") for c in ("y_true", "y_pred")
    }
    preds = preds.where(F.col("y_pred").isNotNull()).withColumns(known)
    preds = preds if asked else preds.withColumn("_all", F.lit(1))
    counts = preds.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y_true", "y_pred", "n"))).alias("cells"))
    zero = F.array().cast("array<bigint>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint"))
    bounds = F.aggregate("cells", zero, lambda acc, c: F.concat(acc, F.array(last(acc) + c["n"])))
    cells = cells.withColumn("bounds", bounds).withColumn("total", F.element_at(bounds, -1))
    cells = stage(cells.withColumn("_group", F.monotonically_increasing_id()), "cells")
    narrow = preds.groupBy(*keys, F.col(id_col).cast("string").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    same = [narrow[k].eqNullSafe(cells[k]) for k in keys]
    rows = narrow.join(cells, same).select("_group", "_id", "_n", "bounds")
    parts = int(preds.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a draw costs more than its bytes tell
    rows = rows.repartition(parts, "_id").sortWithinPartitions("_id")
    draws = rows.mapInArrow(_drawn(n_resamples, seed), "_group long, rep int, cell int, n long")
    drawn = draws.groupBy("_group", "rep", "cell").agg(F.sum("n").alias("n"))
    named = drawn.join(cells, "_group").select(
        *keys, "rep", "n",
        *[F.element_at("cells", F.col("cell") + 1)[c].alias(c) for c in ("y_true", "y_pred")],
    )
    return class_scores(named, classes, [*keys, "rep"]).groupBy(*asked, "rep").agg(F.avg("f1").alias("macro_f1"))


def percentile_interval(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    ci = F.percentile("macro_f1", F.array(F.lit(0.025), F.lit(0.975)))
    return scores.groupBy(*(keys or [])).agg(ci.alias("ci")).select(
        *(keys or []), F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high")
    )


def error_sample(preds: DataFrame, text: str = "clean", k: int = 12) -> DataFrame:
    """First misclassified rows: text cut to 120 characters, confidence to two decimals."""
    return (
        preds.where(F.col("y_true") != F.col("y_pred"))
        .orderBy("post", "row_no")
        .limit(k)
        .select(
            "id",
            F.substring(text, 1, 120).alias("text"),
            F.col("y_true").alias("gold"),
            F.col("y_pred").alias("predicted"),
            F.bround("confidence", 2).alias("confidence"),
        )
    )


def error_rate_by(preds: DataFrame, segment: Column, name: str = "segment") -> DataFrame:
    wrong = (F.col("y_true") != F.col("y_pred")).cast("bigint")
    return preds.groupBy(segment.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.sum(wrong).alias("errors"), F.avg(wrong).alias("error_rate")
    )


def class_weights(train: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Inverse-frequency weight per class: clipped, and the unclipped balanced variant."""
    counts = train.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    grid = train.sparkSession.range(1).select(F.explode(_domain(classes)).alias("class"))
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    full = grid.join(counts, "class", "left").withColumn("c", n)
    every = W.partitionBy()
    inverse = F.sum("c").over(every) / (F.lit(len(classes)) * F.col("c"))
    lo, hi = config.CLASS_WEIGHT_CLIP
    present = F.col("n").isNotNull()
    balanced = F.sum("n").over(every) / (F.sum(present.cast("bigint")).over(every) * F.col("n"))
    return full.select(
        "class",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.least(F.greatest(inverse, F.lit(lo)), F.lit(hi)).alias("weight"),
        balanced.alias("balanced"),
    )


def select_model(scores: DataFrame, candidate: str = "candidate", ordinal: str = "ordinal") -> DataFrame:
    """Candidate with the highest macro-F1; the earliest one on ties."""
    return scores.agg(
        F.max_by(F.struct(candidate, "macro_f1"), F.struct("macro_f1", -F.col(ordinal))).alias("b")
    ).select(F.col(f"b.{candidate}").alias(candidate), F.col("b.macro_f1").alias("macro_f1"))


def leaderboard(report: DataFrame, model_order: list[str], tasks: list[str]) -> DataFrame:
    """One row per model in fixed order; score, interval and accuracy of every task side by side.

    Models that are not in the order come last; models without scores do not appear.
    """
    cols = [c for c in ("macro_f1", "ci_low", "ci_high", "accuracy") if c in report.columns]
    wide = report.groupBy("model").agg(
        *[
            F.max(F.when(F.col("task") == t, F.col(c))).alias(f"{t}_{c}")
            for t in tasks
            for c in cols
        ]
    )
    pos = F.array_position(_domain(model_order), F.col("model"))
    ordinal = F.when(pos > 0, pos).otherwise(F.lit(len(model_order) + 1)).cast("bigint")
    return wide.withColumn("ordinal", ordinal).orderBy("ordinal", "model")


def kappa(pairs: DataFrame, keys: list[str], a: str = "first", b: str = "second") -> DataFrame:
    """Agreement share and Cohen's kappa of two label columns per group."""
    counts = pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col(a).alias("class"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb"),
                         F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0).alias("same")),
                F.struct(F.col(b).alias("class"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb"),
                         F.lit(0).cast("bigint").alias("same")),
            )
        ),
    )
    by_class = parts.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("na", "nb", "same")])
    total = F.sum("na")
    agree = F.sum("same") / total
    chance = F.sum(F.col("na").cast("double") * F.col("nb")) / (total.cast("double") * total)
    return by_class.groupBy(*keys).agg(
        total.alias("n"),
        agree.alias("agreement"),
        F.when(chance < 1, (agree - chance) / (1 - chance)).alias("kappa"),
    )
