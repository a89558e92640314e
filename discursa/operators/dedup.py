"""Near-duplicate clusters: ids, sizes, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discursa.functions import text as tx
from discursa.operators import ranking
from discursa.session import stage

MAX_HOT_KEYS = 1024
HOT_MIN_ROWS = 100_000


def with_cluster(df: DataFrame, text: str = "text", exact_key: bool = False) -> DataFrame:
    """Cluster id of every row: a 128-bit hash of its near-duplicate key, or the key itself."""
    key = tx.dup_key(F.col(text))
    return df.withColumn("cluster", key if exact_key else tx.cluster_id(key))


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))


def attach_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    weight: str,
    row_id: str,
    max_hot: int = MAX_HOT_KEYS,
    hot_min: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Left join with a table unique per (string) key, with hot keys taken out of the shuffle.

    The at most `max_hot` heaviest keys are broadcast; their rows get a spread key, so no
    task receives more than about hot_min rows, or 1/max_hot of all rows, for one key.
    The per-key table is staged: it is read twice and often costs a pass over all texts.
    """
    per_key = stage(per_key, "per-key")
    values = [c for c in per_key.columns if c != key]
    payload = F.struct(*values)
    hot = (
        per_key.where(F.col(weight) >= hot_min)
        .orderBy(F.desc(weight), key)
        .limit(max_hot)
        .select(key, payload.alias("_hot"))
    )
    probe = rows.join(F.broadcast(hot), key, "left")
    spread = F.concat(F.lit("\u0000"), F.xxhash64(row_id).cast("string"))
    probe = probe.withColumn(
        "_k", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key))
    )
    cold = per_key.select(F.col(key).alias("_k"), payload.alias("_cold"))
    return (
        probe.join(cold, "_k", "left")
        .withColumn("_v", F.coalesce("_hot", "_cold"))
        .select(*rows.columns, *[F.col(f"_v.{v}").alias(v) for v in values])
    )


def with_cluster_size(df: DataFrame, row_id: str = "id", **hot) -> DataFrame:
    return attach_per_key(df, cluster_sizes(df), "cluster", "cluster_size", row_id, **hot)


def first_in_order(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key. Spark cuts each map task to one row per key before the shuffle."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def representatives(df: DataFrame) -> DataFrame:
    """Most liked member of every cluster (first one on ties) with the size of its cluster.

    One pass and one shuffle: members are combined per map task first, so a cluster of any
    size sends one row per task. Meant for narrow frames; the row travels in the aggregate.
    """
    rest = [c for c in df.columns if c != "cluster"]
    order = F.struct((-F.col("likes")).alias("likes"), "post", "row_no")
    return (
        df.groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("cluster_size"), F.min_by(F.struct(*rest), order).alias("r"))
        .select("cluster", "r.*", "cluster_size")
    )


def dense_cluster_ids(df: DataFrame) -> DataFrame:
    """Opt-in dense ids: 0, 1, 2... by first appearance in (post, row_no) order."""
    firsts = df.groupBy("cluster").agg(
        F.min(F.struct("post", "row_no")).alias("first"), F.count(F.lit(1)).alias("cluster_size")
    )
    ranked = ranking.global_rank(firsts, [F.col("first"), F.col("cluster")], "dense")
    return ranked.select("cluster", "cluster_size", (F.col("dense") - 1).alias("dense_id"))


def dedupe_by_priority(df: DataFrame, id_col: str = "id", priority: str = "part") -> DataFrame:
    """One row per id, the one from the earliest part."""
    return first_in_order(df, [id_col], [F.col(priority)])
