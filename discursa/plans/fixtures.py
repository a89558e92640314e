"""Adapters from the generic test tables to comment data, in Spark and as SQL prefixes.

Expressions that both dialects read alike are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discursa import config
from discursa.operators import dedup, findings, sampling
from discursa.sources.tables import read_table

SALT = b"demo-salt"

EMOJI_OF_ROW = (
    "CASE doc_id % 7 WHEN 0 THEN '😭😭' WHEN 1 THEN '😂' WHEN 2 THEN '😡' WHEN 3 THEN '🙏🏻' "
    "WHEN 4 THEN '👀 ❤️' WHEN 5 THEN '😭 … 😭' ELSE '' END"
)
EXTRA_WORDS = (
    "CASE WHEN doc_id % 17 = 0 THEN ' main slot gacor' WHEN doc_id % 19 = 0 THEN ' Gaji hakim 280%' "
    "WHEN doc_id % 23 = 0 THEN ' kurikulum GURU ojol' ELSE '' END"
)
MENTIONS = "CASE WHEN doc_id % 13 = 0 THEN ' @User' || (doc_id * 7) % 97 || '.' ELSE '' END"
COMMENT_TEXT = (
    f"CASE WHEN doc_id % 11 = 0 THEN {EMOJI_OF_ROW} "
    f"ELSE text || ' ' || {EMOJI_OF_ROW} || {EXTRA_WORDS} || {MENTIONS} END"
)
STANCE_OF_ROW = (
    "CASE lang WHEN 'en' THEN 'supports_subject' WHEN 'fr' THEN 'criticises_judiciary' "
    "WHEN 'de' THEN 'criticises_government' ELSE 'opposes_subject' END"
)
EMOTION_OF_ROW = (
    "CASE doc_id % 5 WHEN 0 THEN 'anger' WHEN 1 THEN 'grief' WHEN 2 THEN 'cynicism' "
    "WHEN 3 THEN 'hope' ELSE 'neutral' END"
)
COMMENT_EXPRS = {
    "id": "source || '#' || doc_id",
    "post": "source",
    "row_no": "doc_id",
    "username": "'user' || doc_id % 97",
    "likes": "n_chars % 250",
    "is_reply": "doc_id % 5 = 0",
    "text": COMMENT_TEXT,
    "stance": STANCE_OF_ROW,
    "emotion": EMOTION_OF_ROW,
    "stance_conf": "CAST(doc_id * 37 % 101 AS DOUBLE) / 100",
    "emotion_conf": "CAST(doc_id * 53 % 97 AS DOUBLE) / 100",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread=name in ("documents", "events"))


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as comments, with the columns of a later model run still attached."""
    docs = table(spark, sf_dir, "documents")
    ts = "TIMESTAMP_NTZ '2025-09-05 00:00:00' + make_dt_interval(CAST(doc_id % 310 AS INT), CAST(doc_id % 24 AS INT))"
    return docs.select(
        "doc_id", "lang", *[F.expr(e).alias(c) for c, e in COMMENT_EXPRS.items()], F.expr(ts).alias("ts")
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_comments(spark, sf_dir).select(
        "id", "post", "row_no", "username", "ts", "likes", "is_reply", "text"
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.enrich(comments(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched comments with labels: spam from the toxicity label, the rest from the row."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    rows = findings.enrich(raw_comments(spark, sf_dir)).join(labels, "doc_id", "left")
    return rows.withColumn("spam", F.coalesce(F.col("toxic"), F.lit(0)) == 1).withColumn(
        "stance_abstain", F.col("stance_conf") < 0.3
    )


def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.candidates(enriched(spark, sf_dir))


def with_sizes(df: DataFrame) -> DataFrame:
    return dedup.with_cluster_size(df)


# ---- SQL prefixes ------------------------------------------------------------

EMOJI = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in config.EMOJI_RANGES)
EMOJI_ALL = EMOJI + "".join(f"\\x{{{c:X}}}" for c in config.EMOJI_COMPANIONS)

_COLUMNS = ", ".join(f"{e} AS {c}" for c, e in COMMENT_EXPRS.items() if c != "text")
C = f"""c AS (SELECT doc_id, lang, {_COLUMNS}, {COMMENT_TEXT} AS text,
  TIMESTAMP '2025-09-05 00:00:00' + to_days(CAST(doc_id % 310 AS INTEGER))
    + to_hours(CAST(doc_id % 24 AS BIGINT)) AS ts
  FROM documents)"""

PHASE_SQL = (
    "CASE "
    + " ".join(f"WHEN CAST(ts AS DATE) <= DATE '{b}' THEN '{p}'" for b, p in config.PHASES if b)
    + f" ELSE '{config.PHASES[-1][1]}' END"
)
CLEAN_SQL = r"trim(regexp_replace(replace(text, '…', '...'), '\s+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def emoji_list_sql(x: str) -> str:
    return f"regexp_extract_all({x}, '([{EMOJI}])', 1)"


_PACKED = r"regexp_replace(text, '\s+', '', 'g')"
EMOJI_ONLY_SQL = (
    f"(regexp_matches({_PACKED}, '^[{EMOJI_ALL}\\p{{P}}]+$') AND "
    f"regexp_matches({_PACKED}, '[{EMOJI_ALL}]'))"
)

K = (
    C
    + f""",
k0 AS (SELECT *, {CLEAN_SQL} AS clean, {fold_sql('text')} AS folded FROM c),
k1 AS (SELECT *, CAST(length(clean) AS INTEGER) AS n_chars, {PHASE_SQL} AS phase,
  {EMOJI_ONLY_SQL} AS emoji_only, array_to_string({emoji_list_sql('text')}, '') AS emoji,
  regexp_replace(folded, '[^\\p{{L}}]+', '', 'g') AS letters,
  array_to_string(list_sort(list_distinct({emoji_list_sql('folded')})), '') AS emoji_set
  FROM k0),
k AS (SELECT *, CASE WHEN letters <> '' THEN letters ELSE emoji_set END AS dup_key,
  md5(CASE WHEN letters <> '' THEN letters ELSE emoji_set END) AS cluster FROM k1)"""
)

SPAM_RX = "|".join(config.SPAM_TERMS)
SPAM_SQL = f"regexp_matches({fold_sql('clean')}, '{SPAM_RX}')"
R = (
    K
    + f""",
sized AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS cluster_size,
  row_number() OVER (PARTITION BY cluster ORDER BY likes DESC, post, row_no) AS rn FROM k),
reps AS (SELECT id, post, row_no, cluster, phase, likes, n_chars, emoji_only, clean, cluster_size,
  {SPAM_SQL} AS spam_ind,
  CASE WHEN emoji_only THEN 'emoji' WHEN n_chars <= 25 THEN 'short' WHEN n_chars <= 200 THEN 'normal'
    ELSE 'long' END AS text_type,
  CASE WHEN likes = 0 THEN '0' WHEN likes < 100 THEN '1-99' ELSE '100+' END AS tier
  FROM sized WHERE rn = 1 AND n_chars > 0)"""
)
S = (
    K
    + """,
s AS (SELECT k.*, toxic, quality, coalesce(toxic, 0) = 1 AS spam, stance_conf < 0.3 AS stance_abstain
  FROM k LEFT JOIN labels USING (doc_id)),
ns AS (SELECT * FROM s WHERE NOT spam)"""
)


def pseudonym_sql(x: str) -> str:
    key = f"lower(trim({x}))"
    return (
        f"CASE WHEN {key} IN ('', 'none', 'null', '-') THEN {x} "
        f"ELSE substr(sha256('{SALT.decode()}' || {key}), 1, 12) END"
    )


def mask_sql(x: str) -> str:
    """Mentions masked by weaving split pieces with hashed handles."""
    rx = config.MENTION_PATTERN
    return (
        f"CASE WHEN contains({x}, '@') THEN array_to_string(list_transform("
        f"range(1, len(regexp_split_to_array({x}, '{rx}')) + 1), lambda i: "
        f"regexp_split_to_array({x}, '{rx}')[i] || coalesce('@' || "
        + pseudonym_sql(f"rtrim(regexp_extract_all({x}, '{rx}', 1)[i], '.')")
        + f", '')), '') ELSE {x} END"
    )


def topics_sql(x: str) -> str:
    tags = ", ".join(
        f"CASE WHEN regexp_matches({x}, '(?i){'|'.join(p)}') THEN '{t}' END"
        for t, p in config.TOPIC_TERMS.items()
    )
    return f"list_filter([{tags}], lambda t: t IS NOT NULL)"


def tokens_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in config.STOP_WORDS)
    return (
        f"list_filter(list_distinct(regexp_extract_all(lower({x}), '([a-zA-Z]{{3,}})', 1)), "
        f"lambda w: NOT list_contains([{stop}], w) AND NOT regexp_matches(w, '^[0-9a-f]{{12}}$'))"
    )


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)
