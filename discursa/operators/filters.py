"""Consumer-side filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUBLIC_COLUMNS = [
    "id", "post", "ts", "phase", "likes", "is_reply", "clean", "n_chars", "emoji_only", "emoji",
    "spam", "stance", "emotion", "stance_conf", "emotion_conf", "stance_abstain",
]


def public_view(scored: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Whitelisted columns only (never the account name) plus the date of the comment."""
    keep = [c for c in (allowed or PUBLIC_COLUMNS) if c in scored.columns]
    return scored.select(*keep, F.to_date("ts").alias("date"))


def filter_pack(
    df: DataFrame, post: str | None = None, phases=None, stances=None, include_spam: bool = False
) -> DataFrame:
    """Spam is left out unless asked for; an empty or missing choice does not filter."""
    if not include_spam:
        df = df.where(~F.col("spam"))
    if post and post != "all":
        df = df.where(F.col("post") == post)
    if phases:
        df = df.where(F.col("phase").isin(list(phases)))
    if stances:
        df = df.where(F.col("stance").isin(list(stances)))
    return df


def text_search(df: DataFrame, pattern: str, column: str = "clean") -> DataFrame:
    """Case-insensitive regular expression; rows without text never match."""
    if not pattern:
        return df
    return df.where(F.coalesce(F.col(column).rlike("(?iU)" + pattern), F.lit(False)))


def distinct_posts(df: DataFrame) -> DataFrame:
    return df.select("post").distinct().orderBy("post")
