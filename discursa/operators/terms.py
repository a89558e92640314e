"""Vocabulary reports: document frequency, characteristic class, display scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discursa import config
from discursa.functions import text as tx


def term_class_counts(df: DataFrame, text: str = "clean", label: str = "stance") -> DataFrame:
    """Comments per (term, class); every comment counts once per term."""
    terms = df.select(F.col(label).alias("label"), F.explode(tx.tokens(F.col(text))).alias("term"))
    return terms.groupBy("term", "label").agg(F.count(F.lit(1)).alias("n"))


def document_frequency(df: DataFrame, text: str = "clean") -> DataFrame:
    terms = df.select(F.explode(tx.tokens(F.col(text))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(freq: DataFrame, n: int = 60) -> DataFrame:
    return freq.orderBy(F.desc("n"), "term").limit(n)


def characteristic_class(
    df: DataFrame, n: int = 60, text: str = "clean", label: str = "stance",
    default: str = config.UNCLEAR,
) -> DataFrame:
    """Top terms with the class in which they are relatively most frequent.

    Class sizes come from the shown rows. The table of class sizes has one row per class.
    """
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("size"))
    counts = term_class_counts(df, text, label)
    per_term = counts.join(sizes, "label", "left").groupBy("term").agg(
        F.sum("n").alias("n"),
        F.min_by("label", F.struct(-(F.col("n") / F.col("size")), "label")).alias("label"),
    )
    return top_terms(per_term, n).select("term", "n", F.coalesce("label", F.lit(default)).alias(label))


def display_scale(terms: DataFrame, size_range=config.FONT_SIZE_RANGE) -> DataFrame:
    """Square-root scaled size and linear opacity of the (at most n) shown terms."""
    small, large = size_range
    lo, hi = F.min("n").over(W.partitionBy()), F.max("n").over(W.partitionBy())
    span = F.nullif(hi - lo, F.lit(0))
    part = (F.col("n") - lo) / span
    return terms.withColumn(
        "size",
        F.coalesce(F.bround(small + F.sqrt(part) * (large - small), 1), F.lit((small + large) / 2)),
    ).withColumn("opacity", F.bround(0.6 + 0.4 * F.coalesce(part, F.lit(1.0)), 2))
