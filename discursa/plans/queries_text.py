"""Queries over sources and per-row expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from discursa import config
from discursa.functions import annotation as an
from discursa.functions import fields as fx
from discursa.functions import lexicon as lx
from discursa.functions import privacy as pv
from discursa.functions import scores as sc
from discursa.functions import text as tx
from discursa.operators import annotate, dedup, filters, findings, ranking, release, split
from discursa.plans import fixtures as fs
from discursa.plans.registry import query
from discursa.session import scratch_path, stage
from discursa.sources import ragged_csv as rc

# ---- raw records synthesised from events --------------------------------------

_DAY = "day(ts) || '/' || month(ts) || '/' || year(ts)"
_CLOCK = (
    "lpad(CAST(hour(ts) AS STRING), 2, '0') || '.' || lpad(CAST(minute(ts) AS STRING), 2, '0') || '.' "
    "|| lpad(CAST(second(ts) AS STRING), 2, '0')"
)
_LIKES = "event_id % 50"
_BODY = "event_type || ', \"quoted\" @user' || user_id || '.'"
_BODY_CSV = "'\"' || replace(" + _BODY + ", '\"', '\"\"') || '\"'"
_USER = "' user' || user_id"
LINE = f"""CASE event_id % 10
  WHEN 0 THEN {_USER} || ',"' || {_DAY} || ', ' || {_CLOCK} || '",' || {_LIKES} || ',' || {_BODY_CSV}
  WHEN 1 THEN {_USER} || ',not-a-date,' || {_LIKES} || ',' || {_BODY_CSV}
  WHEN 2 THEN {_USER} || ',' || {_DAY} || ', ' || {_CLOCK} || ',x1,' || {_BODY_CSV}
  WHEN 3 THEN {_USER} || ',' || {_DAY} || ', ' || {_CLOCK} || ',' || {_LIKES} || ','
  WHEN 4 THEN {_USER} || ',' || {_DAY} || ', ' || {_CLOCK} || ',' || {_LIKES}
  WHEN 5 THEN '  '
  WHEN 6 THEN {_USER} || ',31/2/2026, 11.00.00,1,' || {_BODY_CSV}
  ELSE {_USER} || ',' || {_DAY} || ', ' || {_CLOCK} || ', ' || {_LIKES} || ' ,' || {_BODY_CSV} END"""
HEADER = "username,timestamp,likes,text"


def _records(spark, sf):
    """One raw record per event; record numbers follow the event id."""
    events = fs.table(spark, sf, "events")
    return rc.with_header(
        events.select(
            F.concat(F.col("event_type"), F.lit(".csv")).alias("file"),
            F.col("event_type").alias("post"),
            (F.col("event_id") + 2).alias("record_no"),
            fx.split_record(F.expr(LINE)).alias("fields"),
            F.lit(HEADER).alias("header"),
        )
    )


def _ts_text(column: str = "ts"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


_GOOD = "event_id % 10 IN (0, 3, 7, 8, 9)"


@query(
    "ingest_ragged",
    f"""SELECT event_type || '#' || (event_id + 2) AS id, event_type AS post, 'user' || user_id AS username,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, event_id % 50 AS likes, FALSE AS is_reply,
  CASE WHEN event_id % 10 = 3 THEN '' ELSE {_BODY} END AS text FROM events WHERE {_GOOD}""",
)
def ingest_ragged(spark, sf):
    c = rc.comments(rc.parse_records(_records(spark, sf)))
    return c.withColumn("ts", _ts_text())


@query(
    "ingest_quarantine",
    f"""SELECT event_type || '.csv' AS file, event_id + 2 AS record_no,
  CAST(CASE event_id % 10 WHEN 1 THEN 4 WHEN 4 THEN 4 ELSE 5 END AS INTEGER) AS n_fields
  FROM events WHERE event_id % 10 IN (1, 2, 4, 6)""",
)
def ingest_quarantine(spark, sf):
    q = rc.quarantine(rc.parse_records(_records(spark, sf)))
    return q.select("file", "record_no", F.size("fields").alias("n_fields"))


@query(
    "quality_gate",
    f"""SELECT event_type || '.csv' AS file, count(*) FILTER (WHERE {_GOOD}) AS n_ok,
  count(*) FILTER (WHERE event_id % 10 IN (1, 2, 4, 6)) AS n_rejected FROM events GROUP BY ALL""",
)
def quality_gate(spark, sf):
    parsed = rc.parse_records(_records(spark, sf))
    return parsed.groupBy("file").agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_rejected")
    )


@query(
    "gate_trips",
    f"""SELECT event_type || '.csv' AS file, count(*) FILTER (WHERE event_id % 10 IN (1, 2, 4, 6)) AS n_rejected,
  count(*) FILTER (WHERE event_id % 10 IN (1, 2, 4, 6)) > 0 AS tripped, FALSE AS tripped_by_good_records FROM events GROUP BY ALL""",
)
def gate_trips(spark, sf):
    """The gate called on every file's rejected records, and on those of its good records, of which there
    are none. What it raises tells how many there were."""
    parsed = stage(rc.parse_records(_records(spark, sf)), "parsed")
    every = parsed.select("file").distinct()
    held = rc.gate_by_file(every, rc.quarantine(parsed))
    good = rc.gate_by_file(every, rc.quarantine(parsed.where("ok"))).select("file", F.col("tripped").alias("tripped_by_good_records"))
    try:
        rc.quality_gate(rc.quarantine(parsed))
        raised = 0
    except rc.QualityGateError as error:
        raised = error.rejected
    total = held.agg(F.sum("n_rejected")).scalar()
    return held.join(good, "file").where(F.lit(raised) == total)


@query(
    "ingest_folder",
    f"""SELECT event_type AS post, 'user' || user_id AS username,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, event_id % 50 AS likes,
  CASE WHEN event_id % 10 = 3 THEN '' WHEN event_id % 10 = 9 THEN 'two' || chr(10) || 'lines, ' || event_id
  ELSE {_BODY} END AS text FROM events WHERE {_GOOD}""",
)
def ingest_folder(spark, sf):
    """Writes the events as raw export files (some comments span lines) and scans the folder."""
    line = (
        f"CASE WHEN event_id % 10 = 9 THEN {_USER} || ',' || {_DAY} || ', ' || {_CLOCK} || ',' || {_LIKES} "
        f"|| ',\"two\n' || 'lines, ' || event_id || '\"' ELSE {LINE} END"
    )
    rows = fs.table(spark, sf, "events").select(
        F.col("event_type").alias("post"), F.col("event_id").alias("record_no"), F.expr(line).alias("value")
    )
    path = scratch_path(spark, "exports")
    release.write_lines(rows, HEADER, path)
    good, _ = rc.read_comments(spark, f"{path}/*/*/*.txt", r"post=([^/]+)/")
    return good.select("post", "username", _ts_text(), "likes", "text")


@query(
    "ingest_stray_quotes",
    f"""SELECT event_type AS post, 'user' || user_id AS username,
  strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts, event_id % 50 AS likes,
  CASE WHEN event_id % 100 IN (40, 43) THEN 'cut off, ' || event_id WHEN event_id % 30 = 7 THEN 'quoted, ' || event_id
  ELSE 'plain ' || event_id END AS text FROM events""",
)
def ingest_stray_quotes(spark, sf):
    """Files with many quotes that are never closed: quoted rows, or other stray quotes, close them. Every row is found."""
    line = (
        f"{_USER} || ',' || {_DAY} || ', ' || {_CLOCK} || ',' || {_LIKES} || ',' || "
        "CASE WHEN event_id % 100 IN (40, 43) THEN '\"cut off, ' || event_id WHEN event_id % 30 = 7 THEN '\"quoted, ' || event_id || '\"' "
        "ELSE 'plain ' || event_id END"
    )
    rows = fs.table(spark, sf, "events").select(
        F.col("event_type").alias("post"), F.col("event_id").alias("record_no"), F.expr(line).alias("value")
    )
    path = scratch_path(spark, "stray-exports")
    release.write_lines(rows, HEADER, path)
    good, _ = rc.read_comments(spark, f"{path}/*/*/*.txt", r"post=([^/]+)/")
    return good.select("post", "username", _ts_text(), "likes", "text")


@query(
    "record_id",
    """SELECT event_type || '#' || (row_number() OVER (PARTITION BY event_type ORDER BY event_id) + 1) AS id,
  event_id FROM events""",
)
def record_id(spark, sf):
    events = fs.table(spark, sf, "events").select("event_type", "event_id")
    ranked = ranking.bucketed_rank(
        events, ["event_type"], F.floor(F.col("event_id") / 65_536), [F.col("event_id")]
    )
    return ranked.select(F.concat_ws("#", "event_type", F.col("rank") + 1).alias("id"), "event_id")


@query("roundtrip_parquet", f"WITH {fs.C} SELECT id, post, likes, md5(text) AS text_md5, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM c")
def roundtrip_parquet(spark, sf):
    path = scratch_path(spark, "roundtrip")
    release.write_table(fs.comments(spark, sf), path, csv=False, partition_by=["post"])
    back = spark.read.parquet(f"{path}.parquet")
    return back.select("id", "post", "likes", F.md5("text").alias("text_md5"), _ts_text())


@query("roundtrip_csv", f"WITH {fs.C} SELECT id, post, likes, md5({fs.CLEAN_SQL}) AS text_md5, is_reply FROM c")
def roundtrip_csv(spark, sf):
    path = scratch_path(spark, "roundtrip")
    df = fs.comments(spark, sf).select("id", "post", "likes", "is_reply", tx.clean_text(F.col("text")).alias("clean"))
    release.write_table(df, path)
    back = spark.read.schema(df.schema).csv(f"{path}.csv", header=True, escape='"', nullValue="\u0000")
    return back.select("id", "post", "likes", F.md5(F.coalesce("clean", F.lit(""))).alias("text_md5"), "is_reply")


@query(
    "label_batches",
    f"""WITH {fs.K} SELECT k.id, cluster, phase, likes, quality AS spam, toxic AS flag,
  'batch' || (doc_id % 10) AS batch FROM k JOIN labels USING (doc_id)""",
)
def label_batches(spark, sf):
    """Label batches written as ten CSV files, read back with a glob and joined to the work-list."""
    labels = fs.table(spark, sf, "labels").join(
        fs.raw_comments(spark, sf).select("doc_id", "id"), "doc_id"
    )
    path = scratch_path(spark, "batches")
    labels.select("id", F.col("quality").alias("spam"), F.col("toxic").alias("flag"),
                  F.concat(F.lit("batch"), F.col("doc_id") % 10).alias("batch")).write.partitionBy("batch").csv(path, header=True)
    batches = spark.read.option("basePath", path).csv(
        f"{path}/batch=*", header=True, schema="id string, spam int, flag int, batch string"
    )
    work = fs.enriched(spark, sf).select("id", "cluster", "phase", "likes")
    return annotate.join_batches(work, batches).select("id", "cluster", "phase", "likes", "spam", "flag", "batch")


@query(
    "report_json",
    f"""WITH {fs.K}, z AS (SELECT cluster, count(*) AS n FROM k GROUP BY 1)
SELECT count(*) AS total, count(DISTINCT username) AS users,
  (SELECT count(*) FROM z) AS clusters, count(*) FILTER (WHERE phase = 'f2') AS per_phase_f2,
  count(*) FILTER (WHERE post = 'src3') AS per_post_src3 FROM k""",
)
def report_json(spark, sf):
    doc = findings.profile_json(fs.enriched(spark, sf))

    def number(path: str, name: str):
        return F.get_json_object("json", path).cast("bigint").alias(name)

    return doc.select(
        number("$.total", "total"), number("$.users", "users"), number("$.clusters", "clusters"),
        number("$.per_phase.f2", "per_phase_f2"), number("$.per_post.src3", "per_post_src3"),
    )


@query("file_checksums")
def file_checksums(spark, sf):
    return rc.file_checksums(spark, f"{sf}/*.parquet", root=sf)


@query(
    "dataset_fingerprint",
    """WITH h AS (SELECT md5(source || '#' || doc_id) AS h FROM documents),
x AS (SELECT count(*) AS n, sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS s1,
  sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT)) AS s2 FROM h)
SELECT substr(sha256(n || ':' || s1 || ':' || s2), 1, 16) AS fingerprint FROM x""",
)
def dataset_fingerprint(spark, sf):
    return split.dataset_fingerprint(fs.comments(spark, sf))


_MASKED_USER = fs.pseudonym_sql(_USER)


@query(
    "mask_raw",
    f"""WITH e AS (SELECT *, {_BODY} AS body, {_MASKED_USER} AS who FROM events), m AS (
  SELECT *, {fs.mask_sql('body')} AS masked FROM e)
SELECT event_type AS post, event_id + 2 AS record_no,
  CASE WHEN event_id % 10 = 5 THEN '  '
  ELSE who || ',' || CASE event_id % 10
    WHEN 0 THEN '"' || {_DAY} || ', ' || {_CLOCK} || '",' || {_LIKES} || ','
    WHEN 1 THEN 'not-a-date,' || {_LIKES} || ','
    WHEN 2 THEN {_DAY} || ', ' || {_CLOCK} || ',x1,'
    WHEN 3 THEN {_DAY} || ', ' || {_CLOCK} || ',' || {_LIKES} || ','
    WHEN 4 THEN {_DAY} || ', ' || {_CLOCK} || ',' || {_LIKES}
    WHEN 6 THEN '31/2/2026, 11.00.00,1,'
    ELSE {_DAY} || ', ' || {_CLOCK} || ', ' || {_LIKES} || ' ,' END
    || CASE WHEN event_id % 10 IN (3, 4) THEN '' ELSE '"' || replace(masked, '"', '""') || '"' END
  END AS value FROM m""",
)
def mask_raw(spark, sf):
    return release.raw_lines(release.mask_records(_records(spark, sf), fs.SALT))


@query(
    "release_clean",
    f"""WITH {fs.K}, z AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM k)
SELECT id, post, {fs.pseudonym_sql('username')} AS author_hash, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, likes, phase,
  md5({fs.mask_sql('text')}) AS text, md5({fs.mask_sql('clean')}) AS clean, n_chars, emoji_only, emoji, cluster,
  cluster_size FROM z""",
)
def release_clean(spark, sf):
    out = release.release_clean(fs.with_sizes(fs.enriched(spark, sf)), fs.SALT)
    return out.withColumns({"ts": _ts_text(), "text": F.md5("text"), "clean": F.md5("clean")})


@query(
    "release_labels",
    f"""WITH {fs.K} SELECT id, post, md5({fs.mask_sql('clean')}) AS clean, stance,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'see @' || substr(sha256('demo-salt' || 'user' || doc_id % 97), 1, 12) END AS note
  FROM k JOIN labels USING (doc_id)""",
)
def release_labels(spark, sf):
    note = F.expr("CASE WHEN doc_id % 2 = 0 THEN NULL ELSE 'see @USER' || doc_id % 97 || '..' END")
    rows = findings.enrich(fs.raw_comments(spark, sf)).join(
        fs.table(spark, sf, "labels").select("doc_id"), "doc_id"
    )
    labels = rows.select("id", "clean", "stance", note.alias("note"))
    out = release.release_labels(labels, fs.SALT)
    return out.select("id", "post", F.md5("clean").alias("clean"), "stance", "note")


@query(
    "release_scores",
    f"""WITH {fs.S} SELECT id, is_reply, md5({fs.mask_sql('clean')}) AS clean, spam, stance,
  round(stance_conf, 6) AS stance_conf FROM s""",
)
def release_scores(spark, sf):
    out = release.release_scores(fs.scored(spark, sf), fs.SALT)
    assert "username" not in out.columns
    return out.select("id", "is_reply", F.md5("clean").alias("clean"), "spam", "stance", F.round("stance_conf", 6).alias("stance_conf"))


@query(
    "public_view",
    f"""WITH {fs.S} SELECT id, post, phase, likes, n_chars, spam, stance, emotion, stance_abstain,
  strftime(ts, '%Y-%m-%d') AS date FROM s""",
)
def public_view(spark, sf):
    v = filters.public_view(fs.scored(spark, sf))
    assert "username" not in v.columns
    return v.select("id", "post", "phase", "likes", "n_chars", "spam", "stance", "emotion", "stance_abstain",
                    F.date_format("date", "yyyy-MM-dd").alias("date"))


@query(
    "release_manifest",
    """SELECT 'clean' AS layer, count(*) AS n_rows FROM documents UNION ALL
SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'raw', count(*) FROM events""",
)
def release_manifest(spark, sf):
    return release.manifest(
        {"clean": fs.comments(spark, sf), "labels": fs.table(spark, sf, "labels"), "raw": fs.table(spark, sf, "events")}
    )


# ---- per-row expressions --------------------------------------------------------


@query("parse_ts", f"SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def parse_ts(spark, sf):
    e = fs.table(spark, sf, "events")
    return e.select("event_id", fx.comment_time(F.expr(_DAY), F.expr("' ' || " + _CLOCK)).alias("ts")).withColumn("ts", _ts_text())


@query("reply_flag", "SELECT conv_id, turn, turn > 0 AS is_reply FROM conversations")
def reply_flag(spark, sf):
    kind = F.when(F.col("turn") == 0, " Parent ").otherwise("REPLY")
    return fs.table(spark, sf, "conversations").select("conv_id", "turn", fx.is_reply(F.lit(True), kind).alias("is_reply"))


@query("clean_text", f"WITH {fs.K} SELECT id, md5(clean) AS clean_md5 FROM k")
def clean_text(spark, sf):
    return fs.comments(spark, sf).select("id", F.md5(tx.clean_text(F.col("text"))).alias("clean_md5"))


@query("text_length", f"WITH {fs.K} SELECT id, n_chars FROM k")
def text_length(spark, sf):
    return fs.enriched(spark, sf).select("id", "n_chars")


@query("emoji_list", f"WITH {fs.K} SELECT id, array_to_string({fs.emoji_list_sql('text')}, ',') AS emojis, emoji FROM k")
def emoji_list(spark, sf):
    text = F.col("text")
    return fs.comments(spark, sf).select("id", F.array_join(tx.emoji_list(text), ",").alias("emojis"), tx.emoji_string(text).alias("emoji"))


@query("emoji_only", f"WITH {fs.K} SELECT id, emoji_only FROM k")
def emoji_only(spark, sf):
    return fs.enriched(spark, sf).select("id", "emoji_only")


@query("dup_key", f"WITH {fs.K} SELECT id, md5(dup_key) AS key_md5, CAST(length(dup_key) AS INTEGER) AS key_chars FROM k")
def dup_key(spark, sf):
    k = fs.comments(spark, sf).select("id", tx.dup_key(F.col("text")).alias("k"))
    return k.select("id", F.md5("k").alias("key_md5"), F.length("k").alias("key_chars"))


@query("event_phase", f"WITH {fs.C} SELECT id, {fs.PHASE_SQL} AS phase FROM c")
def event_phase(spark, sf):
    return fs.comments(spark, sf).select("id", lx.event_phase(F.col("ts")).alias("phase"))


@query("split_id", "SELECT doc_id, source AS post, doc_id AS record_no FROM documents")
def split_id(spark, sf):
    return fs.raw_comments(spark, sf).select(
        "doc_id", fx.record_post(F.col("id")).alias("post"), fx.record_number(F.col("id")).alias("record_no")
    )


@query("spam_flag", f"WITH {fs.K} SELECT id, {fs.SPAM_SQL} AS spam FROM k")
def spam_flag(spark, sf):
    return fs.comments(spark, sf).select("id", lx.spam_flag(F.col("text")).alias("spam"))


_EMOJI_MAP = "MAP {" + ", ".join(f"'{c}': '{e}'" for e, cs in config.EMOJI_EMOTION.items() for c in cs) + "}"


@query(
    "emoji_emotion",
    f"""WITH {fs.K} SELECT id, coalesce(list_filter(list_transform({fs.emoji_list_sql('text')},
  lambda e: {_EMOJI_MAP}[e]), lambda x: x IS NOT NULL)[1], 'neutral') AS emotion FROM k""",
)
def emoji_emotion(spark, sf):
    return fs.comments(spark, sf).select("id", lx.emotion_of_emoji(tx.emoji_list(F.col("text"))).alias("emotion"))


@query("topic_tags", f"WITH {fs.K} SELECT id, array_to_string({fs.topics_sql('clean')}, ',') AS topics FROM k")
def topic_tags(spark, sf):
    return fs.enriched(spark, sf).select("id", F.array_join(lx.topics(F.col("clean")), ",").alias("topics"))


@query(
    "strata",
    f"""WITH {fs.K} SELECT id, CASE WHEN emoji_only THEN 'emoji' WHEN n_chars <= 25 THEN 'short'
  WHEN n_chars <= 200 THEN 'normal' ELSE 'long' END AS text_type,
  CASE WHEN likes = 0 THEN '0' WHEN likes < 100 THEN '1-99' ELSE '100+' END AS tier FROM k""",
)
def strata(spark, sf):
    return fs.enriched(spark, sf).select(
        "id", lx.text_type(F.col("emoji_only"), F.col("n_chars")).alias("text_type"), lx.like_tier(F.col("likes")).alias("tier")
    )


@query("tokens", f"WITH {fs.K} SELECT id, md5(array_to_string(list_sort({fs.tokens_sql('clean')}), ' ')) AS tokens_md5 FROM k")
def tokens(spark, sf):
    t = F.array_join(F.array_sort(tx.tokens(F.col("clean"))), " ")
    return fs.enriched(spark, sf).select("id", F.md5(t).alias("tokens_md5"))


@query("pseudonymise", f"WITH {fs.C}, n AS (SELECT id, CASE WHEN row_no % 31 = 0 THEN ' NONE ' ELSE ' ' || upper(username) END AS name FROM c) SELECT id, {fs.pseudonym_sql('name')} AS author_hash FROM n")
def pseudonymise(spark, sf):
    name = F.expr("CASE WHEN row_no % 31 = 0 THEN ' NONE ' ELSE ' ' || upper(username) END")
    return fs.comments(spark, sf).select("id", pv.pseudonym(name, fs.SALT).alias("author_hash"))


@query("mask_mentions", f"WITH {fs.C} SELECT id, md5({fs.mask_sql('text')}) AS masked_md5 FROM c")
def mask_mentions(spark, sf):
    return fs.comments(spark, sf).select("id", F.md5(pv.mask_mentions(F.col("text"), fs.SALT)).alias("masked_md5"))


_EXAMPLES = [("an example", {"spam": False, "stance": "unclear", "emotion": "neutral"})]


@query(
    "prompt_column",
    f"""WITH {fs.K} SELECT id, CAST(4 AS INTEGER) AS n_messages, 'system' AS first_role, 'user' AS last_role,
  md5(clean) AS content_md5 FROM k""",
)
def prompt_column(spark, sf):
    p = fs.enriched(spark, sf).select("id", an.prompt(F.col("clean"), examples=_EXAMPLES).alias("p"))
    last = F.element_at("p", -1)
    return p.select("id", F.size("p").alias("n_messages"), F.element_at("p", 1)["role"].alias("first_role"),
                    last["role"].alias("last_role"), F.md5(last["content"]).alias("content_md5"))


_FENCE = "'```json' || chr(10) || props || chr(10) || '```'"
_RESPONSE = f"CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN {_FENCE} WHEN 2 THEN 'answer: ' || props || ' ok' ELSE 'no json' END"


@query("json_salvage", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE -1 END AS k FROM events")
def json_salvage(spark, sf):
    v = an.salvage_json(F.expr(_RESPONSE))
    return fs.table(spark, sf, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.k", "bigint"), F.lit(-1)).alias("k"))


_NEAR = """CASE event_id % 8 WHEN 0 THEN 'Unclear' WHEN 1 THEN 'supports' WHEN 2 THEN 'criticises'
 WHEN 3 THEN 'criticises_ judiciary ' WHEN 4 THEN '' WHEN 5 THEN 'informational_note' WHEN 6 THEN 'anger'
 ELSE 'OPPOSES_SUBJECT' END"""
_NEAR_TRUE = """CASE event_id % 8 WHEN 0 THEN 'unclear' WHEN 1 THEN 'supports_subject'
 WHEN 3 THEN 'criticises_judiciary' WHEN 5 THEN 'informational' WHEN 7 THEN 'opposes_subject' END"""


@query(
    "label_match",
    f"""WITH v AS (SELECT event_id, replace(lower(trim({_NEAR})), ' ', '') AS n FROM events),
m AS (SELECT event_id, n, list_filter([{fs.sql_list(config.STANCES)}], lambda k: starts_with(k, n) OR starts_with(n, k)) AS c FROM v)
SELECT event_id, CASE WHEN list_contains([{fs.sql_list(config.STANCES)}], n) THEN n WHEN len(c) = 1 THEN c[1] END AS stance FROM m""",
)
def label_match(spark, sf):
    return fs.table(spark, sf, "events").select("event_id", an.match_label(F.expr(_NEAR), config.STANCES).alias("stance"))


_SPAM_JSON = "CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '\"false\"' WHEN 3 THEN '0' ELSE 'null' END"
_SPAM_TRUE = "event_id % 5 IN (0, 2)"


@query(
    "label_validate",
    f"""WITH v AS (SELECT event_id, {_SPAM_TRUE} AS spam, {_NEAR_TRUE} AS stance FROM events WHERE event_id % 9 <> 0)
SELECT event_id, spam, CASE WHEN spam THEN 'unclear' ELSE stance END AS stance,
  CASE WHEN spam THEN 'neutral' ELSE 'grief' END AS emotion FROM v WHERE stance IS NOT NULL""",
)
def label_validate(spark, sf):
    body = F.expr(
        "CASE WHEN event_id % 9 = 0 THEN '{\"stance\": \"unclear\"}' ELSE '{\"spam\": ' || " + _SPAM_JSON
        + " || ', \"stance\": \"' || " + _NEAR + " || '\", \"emotion\": \"grief_x\"}' END"
    )
    rec = an.label_record(an.salvage_json(body))
    return fs.table(spark, sf, "events").select("event_id", rec.alias("r")).where("r IS NOT NULL").select("event_id", "r.*")


# ---- scores -----------------------------------------------------------------------


def _logits(k: int, salt: int):
    return F.array(*[((F.col("row_no") * (i + salt)) % 17 / 4.0) for i in range(k)])


def _logits_sql(k: int, salt: int) -> str:
    return "[" + ", ".join(f"CAST((row_no * {i + salt}) % 17 AS DOUBLE) / 4" for i in range(k)) + "]"


def _softmax_sql(z: str, t: float) -> str:
    e = f"list_transform({z}, lambda x: exp((x - list_max({z})) / CAST({t} AS DOUBLE)))"
    return f"list_transform({e}, lambda w: w / list_sum({e}))"


@query(
    "calibrated_softmax",
    f"""WITH {fs.C}, p AS (SELECT id, {_softmax_sql(_logits_sql(3, 3), 1.5)} AS p FROM c)
SELECT id, round(p[1], 6) AS p1, round(p[2], 6) AS p2, round(p[3], 6) AS p3 FROM p""",
)
def calibrated_softmax(spark, sf):
    p = fs.comments(spark, sf).select("id", sc.softmax(_logits(3, 3), 1.5).alias("p"))
    return p.select("id", *[F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(3)])


_TEMPS = {"spam": 0.5, "stance": 1.5, "emotion": 1.2}
_CUTS = {"spam": 0.5, "stance": 0.45, "emotion": 0.4}
_SIZES = {"spam": (2, 5), "stance": (6, 3), "emotion": (5, 4)}


def _predicted_sql() -> str:
    cols = []
    for t, (k, salt) in _SIZES.items():
        cols.append(f"{_softmax_sql(_logits_sql(k, salt), _TEMPS[t])} AS p_{t}")
    top = ", ".join(
        f"[{fs.sql_list(config.TASKS[t])}][list_position(p_{t}, list_max(p_{t}))] AS raw_{t}, list_max(p_{t}) AS conf_{t}"
        for t in _SIZES
    )
    return f"pr0 AS (SELECT *, {', '.join(cols)} FROM k), pr AS (SELECT *, {top} FROM pr0)"


def _probs(df):
    return df.withColumns({f"p_{t}": sc.softmax(_logits(k, s), _TEMPS[t]) for t, (k, s) in _SIZES.items()})


@query(
    "predict_record",
    f"""WITH {fs.K}, {_predicted_sql()} SELECT id, raw_stance AS stance, round(conf_stance, 6) AS stance_conf,
  conf_stance < CAST(0.45 AS DOUBLE) AS stance_abstain, round(p_stance[6], 6) AS p_unclear, raw_emotion AS emotion FROM pr""",
)
def predict_record(spark, sf):
    rows = _probs(fs.comments(spark, sf))
    p = sc.prediction({t: F.col(f"p_{t}") for t in _SIZES}, _CUTS)
    return rows.select("id", p["stance"].alias("stance"), F.round(p["stance_conf"], 6).alias("stance_conf"),
                       p["stance_abstain"].alias("stance_abstain"),
                       F.round(F.element_at(p["stance_prob"], "unclear"), 6).alias("p_unclear"), p["emotion"].alias("emotion"))


@query(
    "decision_rules",
    f"""WITH {fs.K}, {_predicted_sql()}, d AS (SELECT *, raw_spam = 'spam' AS spam FROM pr)
SELECT id, spam, CASE WHEN spam OR emoji_only THEN 'unclear' ELSE raw_stance END AS stance,
  CASE WHEN NOT spam AND emoji_only THEN coalesce(list_filter(list_transform({fs.emoji_list_sql('text')},
    lambda e: {_EMOJI_MAP}[e]), lambda x: x IS NOT NULL)[1], 'neutral') ELSE raw_emotion END AS emotion,
  CASE WHEN NOT spam AND emoji_only THEN FALSE ELSE conf_emotion < CAST(0.4 AS DOUBLE) END AS emotion_abstain FROM d""",
)
def decision_rules(spark, sf):
    rows = _probs(fs.enriched(spark, sf))
    p = sc.prediction({t: F.col(f"p_{t}") for t in _SIZES}, _CUTS)
    spam = p["spam"] == "spam"
    ruled = sc.apply_rules(spam, p["stance"], p["emotion"], p["emotion_abstain"], F.col("emoji_only"), tx.emoji_list(F.col("text")))
    return rows.select("id", spam.alias("spam"), *[v.alias(k) for k, v in ruled.items()])


@query(
    "explode_lines",
    r"""WITH x AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT doc_id, md5(line) AS line_md5, count(*) AS n FROM x WHERE length(line) > 0 GROUP BY ALL""",
)
def explode_lines(spark, sf):
    d = fs.table(spark, sf, "documents").select("doc_id", F.explode(tx.lines(F.col("text"))).alias("line"))
    return d.groupBy("doc_id", F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_pack",
    f"""WITH {fs.S} SELECT id, post, phase, stance FROM s WHERE NOT spam AND post = 'src3' AND phase IN ('f1', 'f3')
  AND stance IN ('supports_subject', 'opposes_subject')""",
)
def filter_pack(spark, sf):
    d = filters.filter_pack(fs.scored(spark, sf), "src3", ["f1", "f3"], ["supports_subject", "opposes_subject"])
    return d.select("id", "post", "phase", "stance")


@query("text_search", f"WITH {fs.K} SELECT id FROM k WHERE regexp_matches(clean, '(?i)slot|THE .{{1,3}}a')")
def text_search(spark, sf):
    return filters.text_search(fs.enriched(spark, sf), "slot|THE .{1,3}a").select("id")


def _case(col: str, labels: dict) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + f" ELSE {col} END"


@query(
    "decode_labels",
    f"""WITH {fs.S} SELECT id, {_case('stance', config.STANCE_LABELS)} AS stance, {_case('phase', config.PHASE_LABELS)} AS phase,
  {_case('post', {'src1': 'First source'})} AS post FROM s""",
)
def decode_labels(spark, sf):
    return fs.scored(spark, sf).select(
        "id", lx.display_label(F.col("stance"), config.STANCE_LABELS).alias("stance"),
        lx.display_label(F.col("phase"), config.PHASE_LABELS).alias("phase"),
        lx.display_label(F.col("post"), {"src1": "First source"}).alias("post"),
    )


@query(
    "encode_labels",
    f"""WITH {fs.C} SELECT id, CAST(list_position([{fs.sql_list(config.STANCES)}], stance) - 1 AS INTEGER) AS stance_idx,
  CAST(CASE WHEN row_no % 3 = 0 THEN 1.0 ELSE 0.4 END AS DOUBLE) AS weight FROM c""",
)
def encode_labels(spark, sf):
    source = F.when(F.col("row_no") % 3 == 0, "gold").otherwise("silver")
    return fs.raw_comments(spark, sf).select("id", sc.class_index(F.col("stance"), config.STANCES).alias("stance_idx"), sc.source_weight(source).alias("weight"))


@query("dup_cluster", f"""WITH {fs.K}, f AS (SELECT cluster, min(struct_pack(post := post, row_no := row_no)) AS first FROM k GROUP BY 1)
SELECT id, k.cluster, r - 1 AS dense_id FROM k JOIN (SELECT cluster, row_number() OVER (ORDER BY first) AS r FROM f) USING (cluster)""")
def dup_cluster(spark, sf):
    k = fs.enriched(spark, sf).select("id", "post", "row_no", "cluster")
    dense = dedup.dense_cluster_ids(k)
    return dedup.attach_per_key(k, dense, "cluster", "cluster_size", "id").select("id", "cluster", "dense_id")


@query("cluster_size", f"WITH {fs.K} SELECT id, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size FROM k")
def cluster_size(spark, sf):
    return fs.with_sizes(fs.enriched(spark, sf).select("id", "cluster"))
