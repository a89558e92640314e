"""Stratified, duplicate-safe samples for annotation.

Works on one narrow row per cluster (ids, sizes, strata); texts are fetched only for the
few rows that were drawn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discursa import config
from discursa.functions import lexicon as lx
from discursa.operators import dedup, ranking
from discursa.session import stage

STRATA = ["phase", "text_type", "tier"]
WORK_LIST = ["id", "cluster", "phase", "likes", "cluster_size", "clean"]


def with_strata(df: DataFrame) -> DataFrame:
    return df.withColumn("text_type", lx.text_type(F.col("emoji_only"), F.col("n_chars"))).withColumn(
        "tier", lx.like_tier(F.col("likes"))
    )


def candidates(enriched: DataFrame) -> DataFrame:
    """Narrow cluster representatives with text, strata and the spam vocabulary flag.

    Staged: samplers pass over this table several times, the texts are read once.
    """
    narrow = enriched.select(
        "id", "post", "row_no", "cluster", "phase", "likes", "n_chars", "emoji_only",
        lx.spam_flag_of_clean(F.col("clean")).alias("spam_ind"),
    )
    return stage(with_strata(dedup.representatives(narrow).where(F.col("n_chars") > 0)), "reps")


def strata_mass(reps: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Rows represented by every stratum; at most one row per combination of the domains."""
    return reps.groupBy(*(groups or STRATA)).agg(
        F.sum("cluster_size").alias("mass"), F.count(F.lit(1)).alias("available")
    )


def allocate(strata: DataFrame, total, within: list[str], by: list[str]) -> DataFrame:
    """Largest-remainder quotas: floor of the share, at least one, leftovers by fraction.

    `total` is a number or a column constant within each `within` group. May exceed the
    total when many strata are raised to one; that is intended.
    """
    total = total if not isinstance(total, (int, float)) else F.lit(total)
    all_of = W.partitionBy(*within)
    share = F.col("mass") / F.sum("mass").over(all_of) * total
    out = strata.withColumn("_share", share).withColumn(
        "_base", F.greatest(F.floor("_share"), F.lit(1)).cast("bigint")
    )
    out = out.withColumn("_left", total - F.sum("_base").over(all_of)).withColumn(
        "_rank",
        F.row_number().over(
            all_of.orderBy(F.desc(F.col("_share") - F.floor("_share")), *[F.col(c) for c in by])
        ),
    )
    bonus = (F.col("_rank") <= F.col("_left")).cast("bigint")
    return (
        out.withColumn("quota", F.when(total > 0, F.col("_base") + bonus).otherwise(F.lit(0)))
        .where("quota > 0")
        .drop("_share", "_base", "_left", "_rank")
    )


def silver_sample(reps: DataFrame, gold: DataFrame, plan=config.SamplingPlan()) -> DataFrame:
    """Representatives outside all gold clusters, emoji-only excluded, quota per stratum."""
    pool = reps.where(F.col("text_type") != "emoji").join(
        gold.select("cluster").distinct(), "cluster", "left_anti"
    )
    quotas = allocate(strata_mass(pool), plan.silver_target, [], STRATA)
    return ranking.sample_per_group(pool, STRATA, quotas, seed=plan.seed)


def gold_sample(reps: DataFrame, plan=config.SamplingPlan()) -> DataFrame:
    """Most liked, then spam-flagged, then emoji-only, then quotas per phase and stratum.

    The first three parts are bounded by the plan, so anti joins against them broadcast.
    """
    h = ranking.shuffle_key(F.col("id"), plan.seed)

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select("id", F.lit(name).alias("part"))

    def without(df: DataFrame, taken: DataFrame) -> DataFrame:
        return df.join(F.broadcast(taken), "id", "left_anti")

    top = part(reps.orderBy(F.desc("likes"), "post", "row_no").limit(plan.top_liked), "top")
    spam = part(
        without(reps.where("spam_ind"), top).orderBy(h, "id").limit(plan.spam_quota), "spam"
    )
    taken = top.unionByName(spam)
    emoji = part(
        without(reps.where("text_type = 'emoji'"), taken).orderBy(h, "id").limit(plan.emoji_quota),
        "emoji",
    )
    taken = stage(taken.unionByName(emoji), "taken")

    tagged = reps.join(F.broadcast(taken), "id", "left")
    rest = tagged.where("part IS NULL AND text_type <> 'emoji'").drop("part")
    # one small table: strata of the rest, plus the number of rows already taken
    strata = tagged.groupBy("part", *STRATA).agg(
        F.sum("cluster_size").alias("mass"), F.count(F.lit(1)).alias("available")
    )
    everything = W.partitionBy()
    strata = (
        strata.withColumn(
            "_taken",
            F.sum(F.when(F.col("part").isNotNull(), F.col("available")).otherwise(0)).over(
                everything
            ),
        )
        .where("part IS NULL AND text_type <> 'emoji'")
        .withColumn("_phase_mass", F.sum("mass").over(W.partitionBy("phase")))
        .withColumn("_mass", F.sum("mass").over(everything))
    )
    floors = F.coalesce(
        *[F.when(F.col("phase") == p, F.lit(n)) for p, n in plan.phase_floors.items()], F.lit(0)
    )
    share = (F.lit(plan.gold_target) - F.col("_taken")) * F.col("_phase_mass") / F.col("_mass")
    strata = strata.withColumn("_quota", F.greatest(floors, share.cast("bigint")))
    quotas = allocate(strata, F.col("_quota"), ["phase"], ["text_type", "tier"])
    drawn = ranking.sample_per_group(rest, STRATA, quotas, seed=plan.seed)
    return (
        tagged.where("part IS NOT NULL")
        .unionByName(drawn.withColumn("part", F.lit("quota")))
        .select("id", "cluster", "phase", "likes", "cluster_size", "text_type", "tier", "part")
    )


def work_list(sample: DataFrame, enriched: DataFrame, seed: int = config.SEED) -> DataFrame:
    """Sample in seeded order with its texts; only the drawn ids travel to the text table."""
    drawn = sample.select("id", "cluster_size")
    return ranking.seeded_order(enriched.join(F.broadcast(drawn), "id").select(*WORK_LIST), seed=seed)
