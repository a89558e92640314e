"""Pseudonymised releases of every table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discursa.functions import fields as fx
from discursa.functions import privacy as pv
from discursa.operators import dedup
from discursa.operators.split import with_post
from discursa.functions.text import strip

CLEAN_COLUMNS = [
    "id", "post", "author_hash", "ts", "likes", "phase", "text", "clean", "n_chars", "emoji_only",
    "emoji", "cluster", "cluster_size",
]


def mask_columns(df: DataFrame, columns, salt: bytes) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: pv.mask_mentions(F.col(c), salt) for c in present})


def release_clean(df: DataFrame, salt: bytes) -> DataFrame:
    """Comment table with hashed author and masked texts; reply flag and name stay out."""
    out = df.withColumn("author_hash", pv.pseudonym(F.col("username"), salt))
    return mask_columns(out, ["text", "clean"], salt).select(*CLEAN_COLUMNS)


def release_labels(df: DataFrame, salt: bytes) -> DataFrame:
    """Label table with a post column, empty instead of missing notes, masked texts."""
    out = with_post(df)
    texts = [c for c in ("clean", "note") if c in out.columns]
    return mask_columns(out.fillna("", texts), texts, salt)


def release_scores(df: DataFrame, salt: bytes) -> DataFrame:
    return mask_columns(df.drop("username"), ["text", "clean"], salt)


def mask_records(records: DataFrame, salt: bytes) -> DataFrame:
    """Raw records with only identities changed; their shape, blanks included, is kept.

    records: fields array<string>, threaded boolean (as read by sources.ragged_csv). Names in rows that a stray
    quote swallowed are only masked if the records were read with resync; in the copy such rows are then records like
    any other, so later ones of the file count on from them.
    """
    f, n = F.col("fields"), F.size("fields")
    blank = ~F.exists(f, lambda x: strip(x) != "")
    user_at = F.when(F.col("threaded"), 2).otherwise(0)
    named = F.transform(
        f,
        lambda x, i: F.when(
            (i == user_at) | (F.col("threaded") & (i == 1)), pv.pseudonym(x, salt)
        ).otherwise(x),
    )
    masked = F.transform(
        named, lambda x, i: F.when(i == n - 1, pv.mask_mentions(x, salt)).otherwise(x)
    )
    return records.withColumn("fields", F.when(blank, f).otherwise(masked))


def raw_lines(records: DataFrame) -> DataFrame:
    part = ["part"] if "part" in records.columns else []
    return records.select("post", "record_no", *part, fx.join_record(F.col("fields")).alias("value"))


def write_lines(
    rows: DataFrame, header: str | DataFrame, path: str, per_file: int = 5_000_000
) -> None:
    """Lines (post, record_no, value, perhaps part) as text under path/post=.../first_record=N/, header first.

    A large post is spread over several files by record number, so no task holds it whole. The
    folder names the number of the file's first record, so that reading the files with
    sources.ragged_csv gives the records their numbers back; numbers in a post are consecutive
    from 2. header: one line for all posts, or a frame (post, header).
    """
    first = F.greatest(F.floor(F.col("record_no") / per_file) * per_file, F.lit(2)).cast("bigint")
    part = F.col("part") if "part" in rows.columns else F.lit(0)
    rows = rows.select("post", "record_no", part.cast("bigint").alias("part"), "value", first.alias("first_record"))
    slices = rows.select("post", "first_record").distinct()
    if isinstance(header, DataFrame):
        slices = slices.join(header.select("post", "header"), "post", "left")
    else:
        slices = slices.withColumn("header", F.lit(header))
    heads = slices.select(
        "post", F.lit(-1).cast("bigint").alias("record_no"), F.lit(0).cast("bigint").alias("part"), F.col("header").alias("value"), "first_record"
    )
    (
        rows.unionByName(heads)
        .repartition("post", "first_record")
        .sortWithinPartitions("post", "first_record", "record_no", "part")
        .drop("record_no", "part")
        .write.partitionBy("post", "first_record")
        .text(path)
    )


def write_raw(
    masked: DataFrame, header: str | DataFrame, path: str, per_file: int = 5_000_000
) -> None:
    """Masked records in record order, in the shape and (read_headers) under the header they came in."""
    write_lines(raw_lines(masked), header, path, per_file)


def mention_graph(comments: DataFrame, salt: bytes) -> DataFrame:
    """Edges author -> mentioned account, for accounts that also wrote comments.

    Mentions are counted per edge first; the link test runs once per mentioned account and
    is brought back to the edges with hot accounts kept out of the shuffle.
    """
    authors = comments.select(pv.pseudonym(F.col("username"), salt).alias("mentioned")).distinct()
    edges = (
        comments.where(F.col("text").contains("@"))
        .select(
            pv.pseudonym(F.col("username"), salt).alias("author"),
            F.explode(pv.mentions(F.col("text"), salt)).alias("mentioned"),
        )
        .groupBy("author", "mentioned")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    linked = (
        edges.groupBy("mentioned")
        .agg(F.count(F.lit(1)).alias("edges"))
        .join(authors, "mentioned", "left_semi")
    )
    return (
        dedup.attach_per_key(edges, linked, "mentioned", "edges", "author")
        .where(F.col("edges").isNotNull())
        .select("author", "mentioned", "n")
    )


def write_table(df: DataFrame, path: str, csv: bool = True, partition_by=()) -> None:
    """Parquet, and CSV with a header next to it."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}.parquet")
    if csv:
        df.write.mode("overwrite").csv(
            f"{path}.csv", header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )


def manifest(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows per layer of a release."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("layer"), "n_rows")
        for name, df in layers.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def write_manifest(spark: SparkSession, layers: DataFrame, path: str, **about: str) -> None:
    """One-document JSON: what the release is and how many rows each layer has."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n_rows"))))
    doc = layers.agg(entries.alias("rows")).select(
        F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in about.items()], "rows")).alias("value")
    )
    doc.coalesce(1).write.mode("overwrite").text(path)
