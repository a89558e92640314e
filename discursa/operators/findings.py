"""Aggregates behind the reports and dashboards. Spam is excluded unless stated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discursa import config
from discursa.functions import lexicon as lx
from discursa.functions import text as tx
from discursa.session import stage

TOP_ENGAGED = 1000


def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side (a union and one aggregate, no join)."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])


def percent(part: Column, whole: Column) -> Column:
    return F.bround(100.0 * part / whole, 1)


def non_spam(scored: DataFrame) -> DataFrame:
    return scored.where(~F.col("spam"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Frequencies of several columns in one pass: (dimension, value, n)."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def composition(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of a column; the window runs over one row per class."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", percent(F.col("n"), F.sum("n").over(W.partitionBy())))


def spam_share(scored: DataFrame) -> DataFrame:
    n_spam = F.count_if("spam")
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        n_spam.alias("n_spam"),
        percent(n_spam, F.count(F.lit(1))).alias("pct_spam"),
    )


def spam_effect(scored: DataFrame, column: str = "stance") -> DataFrame:
    """The same composition with and without spam, side by side."""
    counts = scored.groupBy(column).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(~F.col("spam")).alias("n_clean")
    )
    every = W.partitionBy()
    return counts.select(
        column,
        "n_all",
        percent(F.col("n_all"), F.sum("n_all").over(every)).alias("pct_all"),
        "n_clean",
        percent(F.col("n_clean"), F.sum("n_clean").over(every)).alias("pct_clean"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Row-normalised percentages, one column per value, absent cells as 0."""
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    cells = [F.sum(F.when(F.col(column) == v, F.col("n")).otherwise(0)).alias(v) for v in values]
    wide = counts.groupBy(row).agg(F.sum("n").alias("n"), *cells)
    return wide.select(row, "n", *[percent(F.col(v), F.col("n")).alias(v) for v in values])


def target_counts(df: DataFrame, targets: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col("stance") == t).alias(t) for t in targets])


def headline_target(df: DataFrame, targets: list[str]) -> DataFrame:
    """Target with the most comments, the first one listed on ties."""
    counts = target_counts(df, targets)
    table = F.array(
        *[
            F.struct(F.col(t).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("target"))
            for i, t in enumerate(targets)
        ]
    )
    return counts.select(F.array_max(table).alias("m")).select("m.target", "m.n")


def phase_pair(df: DataFrame, early: tuple[str, str], late: tuple[str, str]) -> DataFrame:
    """Share of one stance in an early phase against one stance in a late phase."""

    def share(phase: str, stance: str) -> Column:
        here = F.col("phase") == phase
        return percent(F.count_if(here & (F.col("stance") == stance)), F.nullif(F.count_if(here), F.lit(0)))

    return df.agg(share(*early).alias("early_pct"), share(*late).alias("late_pct"))


def most_liked(df: DataFrame, k: int) -> DataFrame:
    """Top k by likes with a total order; Spark keeps k rows per task."""
    return df.orderBy(F.desc("likes"), "post", "row_no").limit(k)


def engagement_bias(df: DataFrame, k: int = TOP_ENGAGED) -> DataFrame:
    narrow = df.select("likes", "post", "row_no", "stance")
    return composition(most_liked(narrow, k), "stance")


def by_topic(df: DataFrame, text: str = "clean") -> DataFrame:
    """One row per (comment, topic); comments without a topic drop out."""
    return df.withColumn("topic", F.explode(lx.topics(F.col(text))))


def topic_summary(df: DataFrame, labels: dict | None = None) -> DataFrame:
    """Volume of every topic and its dominant stance."""
    counts = by_topic(df).groupBy("topic", "stance").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("topic").agg(
        F.sum("n").alias("n"), F.min_by("stance", F.struct(-F.col("n"), "stance")).alias("dominant")
    )
    return out.withColumn("label", lx.display_label(F.col("topic"), labels or config.TOPIC_LABELS))


def examples_per_class(df: DataFrame, classes: list[str], k: int = 3, chars: int = 140) -> DataFrame:
    """Most liked examples of every class; at most k per class and task cross the shuffle."""
    w = W.partitionBy("stance").orderBy(F.desc("likes"), "post", "row_no")
    return (
        df.where(F.col("stance").isin(classes))
        .select("stance", "likes", "post", "row_no", F.substring("clean", 1, chars).alias("text"))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )


def daily_volume(df: DataFrame) -> DataFrame:
    return df.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def kpi(scored: DataFrame) -> DataFrame:
    """One row: comments, spam left out, leading stance and emotion with their shares."""
    counts = scored.groupBy("spam", "stance", "emotion").agg(F.count(F.lit(1)).alias("n"))

    def lead(column: str) -> DataFrame:
        c = counts.where(~F.col("spam")).groupBy(column).agg(F.sum("n").alias("n"))
        return c.agg(F.min_by(F.struct(F.col(column), "n"), F.struct(-F.col("n"), column)).alias("m")).select(
            F.col(f"m.{column}").alias(f"top_{column}"), F.col("m.n").alias(f"n_{column}")
        )

    totals = counts.agg(
        F.sum(F.when(F.col("spam"), 0).otherwise(F.col("n"))).alias("n"),
        F.sum(F.when(F.col("spam"), F.col("n")).otherwise(0)).alias("n_spam"),
    )
    return one_row(totals, lead("stance"), lead("emotion")).select(
        "n",
        "n_spam",
        "top_stance",
        percent(F.col("n_stance"), F.col("n")).alias("pct_stance"),
        "top_emotion",
        percent(F.col("n_emotion"), F.col("n")).alias("pct_emotion"),
    )


def ordered_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows in the fixed order of the domain; values outside it drop out."""
    pos = F.array_position(F.array(*[F.lit(v) for v in domain]), F.col(column))
    return df.withColumn("ordinal", pos.cast("bigint")).where("ordinal > 0").orderBy("ordinal")


def top_rows(df: DataFrame, measure: str, tie: str, k: int = 3) -> DataFrame:
    return df.orderBy(F.desc(measure), tie).limit(k)


# ---- profile of a data set ---------------------------------------------------


def enrich(comments: DataFrame) -> DataFrame:
    """Derived columns of the comment table that depend on one row only."""
    text = F.col("text")
    normal = comments.withColumn("_forms", tx.nfkc_forms(text))
    clean = normal.withColumn("clean", tx.clean_of_nfkc(F.col("_forms.nfkc")))
    return clean.select(
        *comments.columns,
        "clean",
        lx.event_phase(F.col("ts")).alias("phase"),
        F.length("clean").alias("n_chars"),
        tx.emoji_only_of_nfkc(F.col("_forms.nfkc")).alias("emoji_only"),
        tx.emoji_string(text).alias("emoji"),
        tx.cluster_id(tx.dup_key_of_folded(F.col("_forms.fold"))).alias("cluster"),
    )


def profile_columns(enriched: DataFrame) -> DataFrame:
    """What a profile needs of every row, staged: the texts are read and folded once."""
    narrow = enriched.select(
        "post", "phase", "cluster", "username", "emoji_only", (F.col("n_chars") == 0).alias("empty_text")
    )
    return stage(narrow, "profile")


def profile_of(narrow: DataFrame) -> DataFrame:
    """One row of totals. Exact distinct counts; rows and flags are added up from one row per cluster."""
    clusters = narrow.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("emoji_only").alias("e"), F.count_if("empty_text").alias("t")
    )
    totals = clusters.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("emoji_only"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("empty_text"),
        F.count(F.lit(1)).alias("clusters"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_multi"),
    )
    users = narrow.select("username").distinct().agg(F.count("username").alias("users"))
    return one_row(totals, users)


def profile(enriched: DataFrame) -> DataFrame:
    """One row of totals of a comment table."""
    return profile_of(profile_columns(enriched)).select("total", "emoji_only", "empty_text", "users", "clusters", "rows_in_multi")


def profile_json(enriched: DataFrame, checksums: DataFrame | None = None) -> DataFrame:
    """The profile as one JSON document with maps per post and per phase."""
    narrow = profile_columns(enriched)
    counts = value_counts(narrow, ["post", "phase"])
    maps = counts.groupBy("dimension").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("m")
    )
    per = maps.agg(
        F.max_by("m", F.when(F.col("dimension") == "post", 1)).alias("per_post"),
        F.max_by("m", F.when(F.col("dimension") == "phase", 1)).alias("per_phase"),
    )
    parts = [profile_of(narrow), per]
    if checksums is not None:
        entries = F.array_sort(F.collect_list(F.struct("file", "sha256")))
        parts.append(checksums.agg(F.map_from_entries(entries).alias("sha256")))
    row = one_row(*parts)
    return row.select(F.to_json(F.struct(*row.columns)).alias("json"))
