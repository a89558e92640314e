"""Queries over aggregates, samples, splits, evaluation, findings, models and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa import config
from discursa.functions import fields as fx
from discursa.functions import lexicon as lx
from discursa.functions import scores as sc
from discursa.operators import (
    annotate, calibration, dedup, documents, features, filters, findings, heads, linear, metrics, ranking, release,
    sampling, scoring, split, terms,
)
from discursa.operators.annotate import offline_completion
from discursa.plans import fixtures as fs
from discursa.plans.queries_text import _EMOJI_MAP, _logits, _logits_sql, _softmax_sql, _ts_text
from discursa.plans.registry import query
from discursa.session import scratch_path, stage
from discursa.streaming import progress

SEED = config.SEED
H = f"md5('{SEED}:' || id)"
STANCE_4 = ["supports_subject", "opposes_subject", "criticises_judiciary", "criticises_government"]


def ns(spark, sf) -> DataFrame:
    return findings.non_spam(fs.scored(spark, sf))


def pct(a: str, b: str) -> str:
    return f"round_even(100.0 * CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE), 1)"


# ---- frequency tables and findings -----------------------------------------------


@query(
    "value_counts",
    f"""WITH {fs.S} SELECT 'post' AS dimension, post AS value, count(*) AS n FROM s GROUP BY ALL
UNION ALL SELECT 'phase', phase, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'stance', stance, count(*) FROM s GROUP BY ALL
UNION ALL SELECT 'emotion', emotion, count(*) FROM s GROUP BY ALL""",
)
def value_counts(spark, sf):
    return findings.value_counts(fs.scored(spark, sf), ["post", "phase", "stance", "emotion"])


@query(
    "profile",
    f"""WITH {fs.K}, z AS (SELECT cluster, count(*) AS n FROM k GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (WHERE emoji_only) AS emoji_only, count(*) FILTER (WHERE n_chars = 0) AS empty_text,
  count(DISTINCT username) AS users, (SELECT count(*) FROM z) AS clusters,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM z WHERE n > 1) AS rows_in_multi FROM k""",
)
def profile(spark, sf):
    return findings.profile(fs.enriched(spark, sf))


@query("composition", f"WITH {fs.S} SELECT stance, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM ns)')} AS pct FROM ns GROUP BY 1")
def composition(spark, sf):
    return findings.composition(ns(spark, sf), "stance")


@query("spam_share", f"WITH {fs.S} SELECT count(*) AS total, count(*) FILTER (WHERE spam) AS n_spam, {pct('count(*) FILTER (WHERE spam)', 'count(*)')} AS pct_spam FROM s")
def spam_share(spark, sf):
    return findings.spam_share(fs.scored(spark, sf))


@query(
    "spam_effect",
    f"""WITH {fs.S} SELECT stance, count(*) AS n_all, {pct('count(*)', '(SELECT count(*) FROM s)')} AS pct_all,
  count(*) FILTER (WHERE NOT spam) AS n_clean, {pct('count(*) FILTER (WHERE NOT spam)', '(SELECT count(*) FROM ns)')} AS pct_clean
FROM s GROUP BY 1""",
)
def spam_effect(spark, sf):
    return findings.spam_effect(fs.scored(spark, sf))


def _cells(row: str, source: str) -> str:
    cells = ", ".join(f"{pct(f'''count(*) FILTER (WHERE stance = '{v}')''', 'count(*)')} AS {v}" for v in config.STANCES)
    return f"SELECT {row}, count(*) AS n, {cells} FROM {source} GROUP BY 1"


@query("crosstab_phase", f"WITH {fs.S} {_cells('phase', 'ns')}")
def crosstab_phase(spark, sf):
    return findings.crosstab(ns(spark, sf), "phase", "stance", config.STANCES)


_TOPIC = f"{fs.S}, tp AS (SELECT *, unnest({fs.topics_sql('clean')}) AS topic FROM ns)"


@query("crosstab_topic", f"WITH {_TOPIC} {_cells('topic', 'tp')}")
def crosstab_topic(spark, sf):
    return findings.crosstab(findings.by_topic(ns(spark, sf)), "topic", "stance", config.STANCES)


@query(
    "target_counts",
    f"WITH {fs.S} SELECT " + ", ".join(f"count(*) FILTER (WHERE stance = '{t}') AS {t}" for t in STANCE_4) + " FROM ns",
)
def target_counts(spark, sf):
    return findings.target_counts(ns(spark, sf), STANCE_4)


@query(
    "headline_target",
    f"""WITH {fs.S} SELECT stance AS target, count(*) AS n FROM ns
WHERE stance IN ('criticises_judiciary', 'criticises_government', 'opposes_subject') GROUP BY 1
ORDER BY n DESC, list_position(['criticises_judiciary', 'criticises_government', 'opposes_subject'], stance) LIMIT 1""",
)
def headline_target(spark, sf):
    return findings.headline_target(ns(spark, sf), ["criticises_judiciary", "criticises_government", "opposes_subject"])


@query(
    "phase_pair",
    f"""WITH {fs.S} SELECT {pct("count(*) FILTER (WHERE phase = 'f3' AND stance = 'supports_subject')", "count(*) FILTER (WHERE phase = 'f3')")} AS early_pct,
  {pct("count(*) FILTER (WHERE phase = 'f4' AND stance = 'criticises_judiciary')", "count(*) FILTER (WHERE phase = 'f4')")} AS late_pct FROM ns""",
)
def phase_pair(spark, sf):
    return findings.phase_pair(ns(spark, sf), ("f3", "supports_subject"), ("f4", "criticises_judiciary"))


@query(
    "engagement_bias",
    f"""WITH {fs.S}, t AS (SELECT stance FROM ns ORDER BY likes DESC, post, row_no LIMIT 100)
SELECT stance, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM t)')} AS pct FROM t GROUP BY 1""",
)
def engagement_bias(spark, sf):
    return findings.engagement_bias(ns(spark, sf), 100)


@query(
    "topic_summary",
    f"""WITH {_TOPIC}, n AS (SELECT topic, stance, count(*) AS n FROM tp GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, stance) AS rn, sum(n) OVER (PARTITION BY topic) AS tot FROM n)
SELECT topic, CAST(tot AS BIGINT) AS n, stance AS dominant,
  CASE topic {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in config.TOPIC_LABELS.items())} END AS label FROM r WHERE rn = 1""",
)
def topic_summary(spark, sf):
    return findings.topic_summary(ns(spark, sf))


@query("daily_volume", f"WITH {fs.S} SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM ns GROUP BY 1")
def daily_volume(spark, sf):
    return findings.daily_volume(ns(spark, sf)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(
    "kpi",
    f"""WITH {fs.S}, a AS (SELECT stance, count(*) AS n FROM ns GROUP BY 1 ORDER BY n DESC, stance LIMIT 1),
e AS (SELECT emotion, count(*) AS n FROM ns GROUP BY 1 ORDER BY n DESC, emotion LIMIT 1),
t AS (SELECT count(*) FILTER (WHERE NOT spam) AS n, count(*) FILTER (WHERE spam) AS n_spam FROM s)
SELECT t.n, t.n_spam, a.stance AS top_stance, {pct('a.n', 't.n')} AS pct_stance, e.emotion AS top_emotion,
  {pct('e.n', 't.n')} AS pct_emotion FROM t, a, e""",
)
def kpi(spark, sf):
    return findings.kpi(fs.scored(spark, sf))


@query("stable_sort", "SELECT source || '#' || doc_id AS id, row_number() OVER (ORDER BY source, doc_id) AS position FROM documents")
def stable_sort(spark, sf):
    """Total order as a position."""
    rows = fs.comments(spark, sf).select("id", "post", "row_no")
    ranked = ranking.global_rank(rows, [F.col("post"), F.col("row_no")], "position")
    return ranked.select("id", "position")


@query("topk_liked", f"WITH {fs.C} SELECT id, likes FROM c ORDER BY likes DESC, post, row_no LIMIT 30")
def topk_liked(spark, sf):
    return findings.most_liked(fs.comments(spark, sf).select("id", "likes", "post", "row_no"), 30).select("id", "likes")


@query(
    "examples_per_class",
    f"""WITH {fs.S}, r AS (SELECT stance, likes, post, row_no, md5(substr(clean, 1, 140)) AS text_md5,
  row_number() OVER (PARTITION BY stance ORDER BY likes DESC, post, row_no) AS rank FROM ns
  WHERE stance IN ('supports_subject', 'criticises_judiciary', 'criticises_government'))
SELECT stance, likes, post, row_no, text_md5, rank FROM r WHERE rank <= 3""",
)
def examples_per_class(spark, sf):
    e = findings.examples_per_class(ns(spark, sf), ["supports_subject", "criticises_judiciary", "criticises_government"])
    return e.select("stance", "likes", "post", "row_no", F.md5("text").alias("text_md5"), F.col("rank").cast("bigint").alias("rank"))


@query("seeded_shuffle", f"WITH {fs.C} SELECT id, row_number() OVER (ORDER BY {H}, id) AS position FROM c")
def seeded_shuffle(spark, sf):
    rows = fs.comments(spark, sf).select("id", ranking.shuffle_key(F.col("id")).alias("h"))
    ranked = ranking.global_rank(rows, [F.col("h"), F.col("id")], "position")
    return ranked.select("id", "position")


@query(
    "ordered_domain",
    f"""WITH {fs.S} SELECT stance, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM ns)')} AS pct,
  CAST(list_position([{fs.sql_list(config.STANCES)}], stance) AS BIGINT) AS ordinal FROM ns GROUP BY stance""",
)
def ordered_domain(spark, sf):
    return findings.ordered_domain(findings.composition(ns(spark, sf), "stance"), "stance", config.STANCES)


@query(
    "top_composition",
    f"WITH {fs.S} SELECT stance, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM ns)')} AS pct FROM ns GROUP BY 1 ORDER BY n DESC, stance LIMIT 3",
)
def top_composition(spark, sf):
    return findings.top_rows(findings.composition(ns(spark, sf), "stance"), "n", "stance")


@query("distinct_posts", "SELECT DISTINCT source AS post FROM documents")
def distinct_posts(spark, sf):
    return filters.distinct_posts(fs.comments(spark, sf))


@query("union_parts", "SELECT doc_id, 'labelled' AS part FROM labels UNION ALL SELECT doc_id, 'all' FROM documents")
def union_parts(spark, sf):
    parts = [fs.table(spark, sf, t).select("doc_id", F.lit(p).alias("part")) for t, p in (("labels", "labelled"), ("documents", "all"))]
    return reduce(DataFrame.unionByName, parts)


@query(
    "dedupe_id",
    """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS part FROM documents""",
)
def dedupe_id(spark, sf):
    parts = [fs.table(spark, sf, t).select("doc_id", F.lit(p).alias("part")) for p, t in ((1, "labels"), (2, "documents"))]
    return dedup.dedupe_by_priority(reduce(DataFrame.unionByName, parts), "doc_id")


# ---- vocabulary ----------------------------------------------------------------------

_TERMS = f"{fs.S}, w AS (SELECT stance, unnest({fs.tokens_sql('clean')}) AS term FROM ns)"


@query("term_df", f"WITH {_TERMS} SELECT term, count(*) AS n FROM w GROUP BY 1")
def term_df(spark, sf):
    return terms.document_frequency(ns(spark, sf))


@query("term_top", f"WITH {_TERMS} SELECT term, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, term LIMIT 60")
def term_top(spark, sf):
    return terms.top_terms(terms.document_frequency(ns(spark, sf)), 60)


_CLASS = f"""{_TERMS}, sz AS (SELECT stance, count(*) AS size FROM ns GROUP BY 1),
tc AS (SELECT term, stance, count(*) AS n FROM w GROUP BY ALL),
rk AS (SELECT term, stance, sum(n) OVER (PARTITION BY term) AS tot,
  row_number() OVER (PARTITION BY term ORDER BY CAST(n AS DOUBLE) / size DESC, stance) AS rn FROM tc JOIN sz USING (stance)),
top AS (SELECT term, CAST(tot AS BIGINT) AS n, stance FROM rk WHERE rn = 1 ORDER BY n DESC, term LIMIT 60)"""


@query("term_class", f"WITH {_CLASS} SELECT * FROM top")
def term_class(spark, sf):
    return terms.characteristic_class(ns(spark, sf), 60)


@query(
    "term_scale",
    f"""WITH {_CLASS}, b AS (SELECT min(n) AS lo, max(n) AS hi FROM top)
SELECT term, n, round_even(13.0::DOUBLE + sqrt(CAST(n - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE)) * 35.0::DOUBLE, 1) AS size,
  round_even(0.6::DOUBLE + 0.4::DOUBLE * (CAST(n - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE)), 2) AS opacity FROM top, b""",
)
def term_scale(spark, sf):
    return terms.display_scale(terms.characteristic_class(ns(spark, sf), 60)).select("term", "n", "size", "opacity")


# ---- clusters, samples, splits --------------------------------------------------------


@query("cluster_representative", f"WITH {fs.R} SELECT id, cluster, likes, cluster_size, text_type, tier, spam_ind FROM reps")
def cluster_representative(spark, sf):
    return fs.reps(spark, sf).select("id", "cluster", "likes", "cluster_size", "text_type", "tier", "spam_ind")


@query("stratum_mass", f"WITH {fs.R} SELECT phase, text_type, tier, CAST(sum(cluster_size) AS BIGINT) AS mass, count(*) AS available FROM reps GROUP BY ALL")
def stratum_mass(spark, sf):
    return sampling.strata_mass(fs.reps(spark, sf))


def _alloc_sql(source: str, total: str, within: str, by: str, extra: str = "") -> str:
    part = f"PARTITION BY {within}" if within else ""
    return f"""al0 AS (SELECT *, CAST(mass AS DOUBLE) / CAST(sum(mass) OVER ({part}) AS DOUBLE) * {total} AS share FROM {source}),
al1 AS (SELECT *, greatest(CAST(floor(share) AS BIGINT), 1) AS base FROM al0),
al2 AS (SELECT *, {total} - sum(base) OVER ({part}) AS lft, row_number() OVER ({part} ORDER BY share - floor(share) DESC, {by}) AS rk FROM al1),
quotas AS (SELECT *, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM al2 WHERE {total} > 0)"""


_MASS = "sm AS (SELECT phase, text_type, tier, sum(cluster_size) AS mass, count(*) AS available FROM {0} GROUP BY ALL)"


@query("quota_allocation", f"WITH {fs.R}, {_MASS.format('reps')}, {_alloc_sql('sm', '150', '', 'phase, text_type, tier')} SELECT phase, text_type, tier, CAST(mass AS BIGINT) AS mass, quota FROM quotas")
def quota_allocation(spark, sf):
    q = sampling.allocate(sampling.strata_mass(fs.reps(spark, sf)), 150, [], sampling.STRATA)
    return q.select("phase", "text_type", "tier", "mass", "quota")


@query(
    "stratified_sample",
    f"""WITH {fs.R}, r AS (SELECT *, row_number() OVER (PARTITION BY phase, text_type, tier ORDER BY {H}, id) AS rn FROM reps)
SELECT id, phase, text_type, tier FROM r WHERE rn <= 5""",
)
def stratified_sample(spark, sf):
    reps = fs.reps(spark, sf)
    quotas = sampling.strata_mass(reps).withColumn("quota", F.lit(5))
    return ranking.sample_per_group(reps, sampling.STRATA, quotas).select("id", *sampling.STRATA)


_GOLD = f"""{fs.R}, topn AS (SELECT id FROM reps ORDER BY likes DESC, post, row_no LIMIT 30),
spm AS (SELECT id FROM reps WHERE spam_ind AND id NOT IN (SELECT id FROM topn) ORDER BY {H}, id LIMIT 40),
emo AS (SELECT id FROM reps WHERE text_type = 'emoji' AND id NOT IN (SELECT id FROM topn UNION ALL SELECT id FROM spm) ORDER BY {H}, id LIMIT 60),
tk AS (SELECT id, 'top' AS part FROM topn UNION ALL SELECT id, 'spam' FROM spm UNION ALL SELECT id, 'emoji' FROM emo),
rest AS (SELECT * FROM reps WHERE id NOT IN (SELECT id FROM tk) AND text_type <> 'emoji'), {_MASS.format('rest')},
ph AS (SELECT *, greatest(CASE phase WHEN 'f1' THEN 30 WHEN 'f2' THEN 60 WHEN 'f3' THEN 120 ELSE 200 END,
  CAST(floor(CAST((300 - (SELECT count(*) FROM tk)) * sum(mass) OVER (PARTITION BY phase) AS DOUBLE) / CAST(sum(mass) OVER () AS DOUBLE)) AS BIGINT)) AS pq FROM sm),
{_alloc_sql('ph', 'pq', 'phase', 'text_type, tier')},
dr AS (SELECT rest.*, quota, row_number() OVER (PARTITION BY rest.phase, rest.text_type, rest.tier ORDER BY {H}, id) AS rn
  FROM rest JOIN quotas USING (phase, text_type, tier)),
gold AS (SELECT reps.id, cluster, phase, likes, cluster_size, text_type, tier, part FROM reps JOIN tk USING (id)
  UNION ALL SELECT id, cluster, phase, likes, cluster_size, text_type, tier, 'quota' FROM dr WHERE rn <= quota)"""
_PLAN = config.SamplingPlan(gold_target=300, silver_target=200)


@query("gold_sample", f"WITH {_GOLD} SELECT * FROM gold")
def gold_sample(spark, sf):
    return sampling.gold_sample(fs.reps(spark, sf), _PLAN)


@query("work_list", f"WITH {_GOLD} SELECT gold.id, gold.cluster, gold.phase, gold.likes, gold.cluster_size, md5(k.clean) AS clean_md5 FROM gold JOIN k USING (id)")
def work_list(spark, sf):
    rows = sampling.work_list(sampling.gold_sample(fs.reps(spark, sf), _PLAN), fs.enriched(spark, sf))
    return rows.withColumn("clean_md5", F.md5("clean")).drop("clean")


_GOLD_BY_ID = "abs(CAST(('0x' || substr(cluster, 1, 6)) AS BIGINT)) % 3 = 0"


def _is_gold():
    return F.conv(F.substring("cluster", 1, 6), 16, 10).cast("bigint") % 3 == 0


@query("anti_leak", f"WITH {fs.K} SELECT id, cluster FROM k WHERE cluster NOT IN (SELECT cluster FROM k WHERE is_reply)")
def anti_leak(spark, sf):
    k = fs.enriched(spark, sf).select("id", "cluster", "is_reply")
    return split.without_clusters_of(k, F.col("is_reply")).select("id", "cluster")


@query("leak_check", f"WITH {fs.K} SELECT DISTINCT cluster FROM k WHERE is_reply AND cluster IN (SELECT cluster FROM k WHERE NOT is_reply)")
def leak_check(spark, sf):
    k = fs.enriched(spark, sf).select("cluster", "is_reply")
    return split.clusters_on_both_sides(k, F.col("is_reply"))


@query("residual_sample", f"WITH {fs.C}, t AS (SELECT id FROM c ORDER BY likes DESC, post, row_no LIMIT 30) SELECT id FROM c WHERE id NOT IN (SELECT id FROM t)")
def residual_sample(spark, sf):
    rows = fs.comments(spark, sf).select("id", "likes", "post", "row_no")
    return rows.join(F.broadcast(findings.most_liked(rows, 30).select("id")), "id", "left_anti").select("id")


@query(
    "silver_sample",
    f"""WITH {fs.R}, gold AS (SELECT DISTINCT cluster FROM reps WHERE {_GOLD_BY_ID}),
pool AS (SELECT * FROM reps WHERE text_type <> 'emoji' AND cluster NOT IN (SELECT cluster FROM gold)), {_MASS.format('pool')},
{_alloc_sql('sm', '200', '', 'phase, text_type, tier')},
dr AS (SELECT pool.*, quota, row_number() OVER (PARTITION BY pool.phase, pool.text_type, pool.tier ORDER BY {H}, id) AS rn
  FROM pool JOIN quotas USING (phase, text_type, tier)) SELECT id, cluster, phase, text_type, tier FROM dr WHERE rn <= quota""",
)
def silver_sample(spark, sf):
    reps = fs.reps(spark, sf)
    out = sampling.silver_sample(reps, reps.where(_is_gold()), _PLAN)
    return out.select("id", "cluster", "phase", "text_type", "tier")


_SPLIT = f"""{fs.S}, g AS (SELECT * FROM s),
f AS (SELECT cluster, arg_min(stance, struct_pack(post := post, row_no := row_no)) AS stance0 FROM g GROUP BY 1),
rk AS (SELECT cluster, row_number() OVER (PARTITION BY stance0 ORDER BY md5('{SEED}:' || cluster), cluster) AS r,
  count(*) OVER (PARTITION BY stance0) AS n FROM f),
sp AS (SELECT cluster, CASE WHEN r <= round_even(n * 0.40::DOUBLE, 0) THEN 'test'
  WHEN r <= round_even(n * 0.40::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM rk)"""


@query("group_split", f"WITH {_SPLIT} SELECT id, cluster, stance, split FROM g JOIN sp USING (cluster)")
def group_split(spark, sf):
    g = fs.scored(spark, sf).select("id", "post", "row_no", "cluster", "stance")
    return split.group_split(g).select("id", "cluster", "stance", "split")


@query(
    "assemble_sets",
    f"""WITH {_SPLIT.replace('FROM s),', f'FROM s WHERE {_GOLD_BY_ID}),', 1)}
SELECT id, cluster, phase, stance, CAST(spam AS INTEGER) AS spam, 'gold' AS source, split FROM g JOIN sp USING (cluster)
UNION ALL SELECT id, cluster, phase, stance, CAST(spam AS INTEGER), 'silver', 'train' FROM s WHERE NOT ({_GOLD_BY_ID})""",
)
def assemble_sets(spark, sf):
    rows = fs.scored(spark, sf).select("id", "cluster", "post", "row_no", "phase", "stance", F.col("spam").cast("int").alias("spam"))
    out = split.assemble(rows, _is_gold())
    return out.select("id", "cluster", "phase", "stance", "spam", "source", "split")


# ---- evaluation -------------------------------------------------------------------------

# Long prediction frame of two models and two tasks over the labelled documents.
_PRED = """p AS (
SELECT doc_id, 'length' AS model, 'quality' AS task, CAST(quality AS VARCHAR) AS y_true,
  CASE WHEN doc_id % 37 = 0 THEN NULL WHEN n_chars >= 300 THEN '1' ELSE '0' END AS y_pred FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'parity', 'quality', CAST(quality AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '0' END
  FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'length', 'lang', lang, CASE WHEN n_chars % 3 = 0 THEN 'en' WHEN text LIKE '%ß%' THEN 'de'
  WHEN text LIKE '%è%' THEN 'fr' ELSE 'xx' END FROM documents
UNION ALL SELECT doc_id, 'parity', 'lang', lang, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'es' END FROM documents)"""
CLASSES = {"quality": ["0", "1"], "lang": ["de", "en", "es", "fr", "it"]}


def predictions(spark, sf) -> DataFrame:
    d = fs.table(spark, sf, "documents")
    l = d.join(fs.table(spark, sf, "labels"), "doc_id")
    q = F.col("quality").cast("string")

    def part(df, model, task, y, p):
        return df.select("doc_id", F.lit(model).alias("model"), F.lit(task).alias("task"), y.alias("y_true"), F.expr(p).alias("y_pred"))

    return reduce(DataFrame.unionByName, [
        part(l, "length", "quality", q, "CASE WHEN doc_id % 37 = 0 THEN NULL WHEN n_chars >= 300 THEN '1' ELSE '0' END"),
        part(l, "parity", "quality", q, "CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '0' END"),
        part(d, "length", "lang", F.col("lang"), "CASE WHEN n_chars % 3 = 0 THEN 'en' WHEN text LIKE '%ß%' THEN 'de' WHEN text LIKE '%è%' THEN 'fr' ELSE 'xx' END"),
        part(d, "parity", "lang", F.col("lang"), "CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'es' END"),
    ])


_DOMAIN = "cl AS (SELECT 'quality' AS task, unnest(['0', '1']) AS class UNION ALL SELECT 'lang', unnest(['de', 'en', 'es', 'fr', 'it']))"
_CELLS = f"{_PRED}, {_DOMAIN}, ok AS (SELECT * FROM p WHERE y_pred IS NOT NULL), cc AS (SELECT model, task, y_true, y_pred, count(*) AS n FROM ok GROUP BY ALL)"
_F1 = f"""{_CELLS}, mt AS (SELECT DISTINCT model, task FROM ok),
fc AS (SELECT mt.model, mt.task, class, (SELECT count(*) FROM ok WHERE ok.model = mt.model AND ok.task = mt.task AND y_true = class AND y_pred = class) AS tp,
  (SELECT count(*) FROM ok WHERE ok.model = mt.model AND ok.task = mt.task AND y_true <> class AND y_pred = class) AS fp,
  (SELECT count(*) FROM ok WHERE ok.model = mt.model AND ok.task = mt.task AND y_true = class AND y_pred <> class) AS fn
  FROM mt JOIN cl USING (task)),
f1 AS (SELECT model, task, class, CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0::DOUBLE END AS f1, tp + fn AS support FROM fc)"""
_EVAL = f"""{_F1}, mf AS (SELECT model, task, avg(f1) AS macro_f1 FROM f1 GROUP BY ALL),
ac AS (SELECT model, task, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM ok GROUP BY ALL),
cv AS (SELECT model, task, CAST(count(y_pred) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS coverage FROM p GROUP BY ALL),
ev AS (SELECT model, task, macro_f1, n, accuracy, coverage FROM mf JOIN ac USING (model, task) JOIN cv USING (model, task))"""


@query(
    "confusion",
    f"""WITH {_CELLS}, mt AS (SELECT DISTINCT model, task FROM ok WHERE task = 'lang')
SELECT mt.model, mt.task, a.class AS y_true, b.class AS y_pred, coalesce(n, 0) AS n FROM mt
JOIN cl a ON a.task = mt.task JOIN cl b ON b.task = mt.task
LEFT JOIN cc ON cc.model = mt.model AND cc.task = mt.task AND y_true = a.class AND y_pred = b.class""",
)
def confusion(spark, sf):
    counts = metrics.confusion_counts(predictions(spark, sf).where("task = 'lang'"))
    return metrics.confusion_matrix(counts, CLASSES["lang"]).select("model", "task", "y_true", "y_pred", "n")


@query("observed_classes", f"WITH {_CELLS} SELECT DISTINCT y_true AS class FROM ok UNION SELECT DISTINCT y_pred FROM ok")
def observed_classes(spark, sf):
    return metrics.observed_classes(metrics.confusion_counts(predictions(spark, sf)))


@query("f1_report", f"WITH {_F1} SELECT model, task, class, round(f1, 6) AS f1, support, support < 20 AS small_support FROM f1")
def f1_report(spark, sf):
    counts = metrics.confusion_counts(predictions(spark, sf))
    parts = [metrics.class_scores(counts.where(F.col("task") == t), c) for t, c in CLASSES.items()]
    out = reduce(DataFrame.unionByName, parts)
    return out.select("model", "task", "class", F.round("f1", 6).alias("f1"), "support", "small_support")


@query("model_compare", f"WITH {_EVAL} SELECT model, task, round(macro_f1, 6) AS macro_f1, n, round(accuracy, 6) AS accuracy, round(coverage, 6) AS coverage FROM ev")
def model_compare(spark, sf):
    e = metrics.evaluation(predictions(spark, sf), CLASSES)
    return e.select("model", "task", "n", *[F.round(c, 6).alias(c) for c in ("macro_f1", "accuracy", "coverage")])


@query(
    "leaderboard",
    f"""WITH {_EVAL} SELECT model, CAST(CASE model WHEN 'parity' THEN 1 ELSE 2 END AS BIGINT) AS ordinal,
  round(max(macro_f1) FILTER (WHERE task = 'quality'), 6) AS quality_macro_f1, round(max(accuracy) FILTER (WHERE task = 'quality'), 6) AS quality_accuracy,
  round(max(macro_f1) FILTER (WHERE task = 'lang'), 6) AS lang_macro_f1, round(max(accuracy) FILTER (WHERE task = 'lang'), 6) AS lang_accuracy
  FROM ev GROUP BY model""",
)
def leaderboard(spark, sf):
    board = metrics.leaderboard(metrics.evaluation(predictions(spark, sf), CLASSES), ["parity", "absent"], list(CLASSES))
    return board.select("model", F.when(F.col("model") == "parity", 1).otherwise(2).cast("bigint").alias("ordinal"),
                        *[F.round(c, 6).alias(c) for c in board.columns if c not in ("model", "ordinal")])


@query("model_select", f"WITH {_EVAL} SELECT model AS candidate, round(macro_f1, 6) AS macro_f1 FROM ev WHERE task = 'lang' ORDER BY ev.macro_f1 DESC, model LIMIT 1")
def model_select(spark, sf):
    e = metrics.evaluation(predictions(spark, sf).where("task = 'lang'"), {"lang": CLASSES["lang"]})
    scores = e.select(F.col("model").alias("candidate"), F.when(F.col("model") == "length", 0).otherwise(1).alias("ordinal"), "macro_f1")
    return metrics.select_model(scores).withColumn("macro_f1", F.round("macro_f1", 6))


@query(
    "pair_predictions",
    f"""WITH {_PRED} SELECT labels.doc_id AS id, quality, y_pred FROM labels JOIN p USING (doc_id)
WHERE model = 'length' AND task = 'quality' AND y_pred IS NOT NULL""",
)
def pair_predictions(spark, sf):
    preds = predictions(spark, sf).where("model = 'length' AND task = 'quality'").select(F.col("doc_id").alias("id"), "y_pred")
    truth = fs.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return metrics.pair_predictions(truth, preds)


@query(
    "majority_baseline",
    f"""WITH {fs.C}, m AS (SELECT stance AS majority, count(*) AS n FROM c WHERE row_no % 4 > 0 GROUP BY 1 ORDER BY n DESC, stance LIMIT 1)
SELECT id, stance AS y_true, majority AS y_pred FROM c, m WHERE row_no % 4 = 0""",
)
def majority_baseline(spark, sf):
    rows = fs.raw_comments(spark, sf).select("id", "row_no", "stance")
    return metrics.majority_predictions(rows.where("row_no % 4 > 0"), rows.where("row_no % 4 = 0"), "stance", "stance").select("id", "y_true", "y_pred")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    counts = metrics.confusion_counts(predictions(spark, sf).where("task = 'lang'"))
    return metrics.bootstrap_ci(counts, CLASSES["lang"])


_REPS = 2000


@query(
    "bootstrap_ci_hash",
    f"""WITH {_PRED}, {_DOMAIN}, ok AS (SELECT doc_id, model, p.task, CASE WHEN y_true IN (SELECT class FROM cl WHERE cl.task = p.task) THEN y_true ELSE '(other)' END AS y_true,
  CASE WHEN y_pred IN (SELECT class FROM cl WHERE cl.task = p.task) THEN y_pred ELSE '(other)' END AS y_pred FROM p WHERE y_pred IS NOT NULL),
cc AS (SELECT model, task, y_true, y_pred, count(*) AS n FROM ok GROUP BY ALL),
cu AS (SELECT *, CAST(sum(n) OVER (PARTITION BY model, task ORDER BY y_true, y_pred) AS BIGINT) AS hi, CAST(sum(n) OVER (PARTITION BY model, task) AS BIGINT) AS tot FROM cc),
ar AS (SELECT model, task, list(hi ORDER BY y_true, y_pred) AS his, list(y_true || '|' || y_pred ORDER BY y_true, y_pred) AS names, max(tot) AS tot FROM cu GROUP BY ALL),
dr AS (SELECT model, task, rep, CAST(('0x' || substr(md5('{SEED}:' || rep || ':' || doc_id), 1, 15)) AS BIGINT) AS u FROM ok, (SELECT unnest(range(1, {_REPS + 1})) AS rep)),
dc AS (SELECT model, task, rep, len(list_filter(his, lambda h: h <= u % tot)) + 1 AS c, count(*) AS n FROM dr JOIN ar USING (model, task) GROUP BY ALL),
dn AS (SELECT model, task, rep, split_part(names[c], '|', 1) AS y_true, split_part(names[c], '|', 2) AS y_pred, n FROM dc JOIN ar USING (model, task)),
fc AS (SELECT model, dn.task, rep, class, coalesce(sum(n) FILTER (WHERE y_true = class AND y_pred = class), 0) AS tp,
  coalesce(sum(n) FILTER (WHERE y_true <> class AND y_pred = class), 0) AS fp,
  coalesce(sum(n) FILTER (WHERE y_true = class AND y_pred <> class), 0) AS fn FROM dn JOIN cl ON cl.task = dn.task GROUP BY ALL),
sc AS (SELECT model, task, rep, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0::DOUBLE END) AS m FROM fc GROUP BY ALL)
SELECT model, task, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM sc GROUP BY ALL""",
)
def bootstrap_ci_hash(spark, sf):
    """Every model and task, 2,000 resamples."""
    preds = stage(predictions(spark, sf), "predictions")
    parts = [
        metrics.percentile_interval(
            metrics.bootstrap_scores_by_hash(preds.where(F.col("task") == t), c, _REPS, "doc_id", keys=["model", "task"]), ["model", "task"]
        )
        for t, c in CLASSES.items()
    ]
    return reduce(DataFrame.unionByName, parts).select("model", "task", *[F.round(c, 6).alias(c) for c in ("ci_low", "ci_high")])


_CONF = "CAST(CAST(abs(doc_id * 37) % 101 AS DOUBLE) / 100 AS DOUBLE)"
_ERR = f"""{fs.S}, e AS (SELECT *, CASE WHEN n_chars % 3 = 0 THEN 'supports_subject' ELSE 'unclear' END AS y_pred FROM s)"""


def _errors(spark, sf) -> DataFrame:
    pred = F.when(F.col("n_chars") % 3 == 0, "supports_subject").otherwise("unclear")
    return fs.scored(spark, sf).withColumns({"y_true": F.col("stance"), "y_pred": pred, "confidence": F.col("stance_conf")})


@query(
    "error_sample",
    f"""WITH {_ERR} SELECT id, md5(substr(clean, 1, 120)) AS text_md5, stance AS gold, y_pred AS predicted, round_even(stance_conf, 2) AS confidence
FROM e WHERE stance <> y_pred ORDER BY post, row_no LIMIT 12""",
)
def error_sample(spark, sf):
    rows = metrics.error_sample(_errors(spark, sf))
    return rows.select("id", F.md5("text").alias("text_md5"), "gold", "predicted", "confidence")


_SEG = "CASE WHEN emoji_only THEN 'emoji' WHEN n_chars <= 200 THEN 'short' ELSE phase END"


@query("error_by_segment", f"WITH {_ERR} SELECT {_SEG} AS segment, count(*) AS n, count(*) FILTER (WHERE stance <> y_pred) AS errors, round(CAST(count(*) FILTER (WHERE stance <> y_pred) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS error_rate FROM e GROUP BY 1")
def error_by_segment(spark, sf):
    return metrics.error_rate_by(_errors(spark, sf), F.expr(_SEG)).withColumn("error_rate", F.round("error_rate", 6))


@query(
    "class_weights",
    f"""WITH {fs.C}, g AS (SELECT unnest([{fs.sql_list(config.STANCES)}]) AS class), n AS (SELECT stance AS class, count(*) AS n FROM c GROUP BY 1),
j AS (SELECT class, coalesce(n, 0) AS n0, n, greatest(coalesce(n, 0), 1) AS c FROM g LEFT JOIN n USING (class))
SELECT class, n0 AS n, round(least(greatest(CAST(sum(c) OVER () AS DOUBLE) / CAST(6 * c AS DOUBLE), 0.3::DOUBLE), 4.0::DOUBLE), 6) AS weight,
  coalesce(round(CAST(sum(n) OVER () AS DOUBLE) / CAST(count(n) OVER () * n AS DOUBLE), 6), -1.0::DOUBLE) AS balanced FROM j""",
)
def class_weights(spark, sf):
    w = metrics.class_weights(fs.raw_comments(spark, sf), "stance", config.STANCES)
    return w.select("class", "n", F.round("weight", 6).alias("weight"), F.coalesce(F.round("balanced", 6), F.lit(-1.0)).alias("balanced"))


@query(
    "agreement_kappa",
    f"""WITH {_PRED}, z AS (SELECT task, a.y_pred AS f, b.y_pred AS s FROM p a JOIN p b USING (doc_id, task) WHERE a.model = 'length' AND b.model = 'parity' AND a.y_pred IS NOT NULL),
cl AS (SELECT DISTINCT task, f AS class FROM z UNION SELECT DISTINCT task, s FROM z),
m AS (SELECT task, class, (SELECT count(*) FROM z WHERE z.task = cl.task AND f = class) AS na, (SELECT count(*) FROM z WHERE z.task = cl.task AND s = class) AS nb,
  (SELECT count(*) FROM z WHERE z.task = cl.task AND f = class AND s = class) AS same FROM cl),
q AS (SELECT task, sum(na) AS n, CAST(sum(same) AS DOUBLE) / CAST(sum(na) AS DOUBLE) AS a,
  sum(CAST(na AS DOUBLE) * CAST(nb AS DOUBLE)) / (CAST(sum(na) AS DOUBLE) * CAST(sum(na) AS DOUBLE)) AS e FROM m GROUP BY 1)
SELECT task, CAST(n AS BIGINT) AS n, round(a, 6) AS agreement, round((a - e) / (1 - e), 6) AS kappa FROM q""",
)
def agreement_kappa(spark, sf):
    p = predictions(spark, sf)
    pairs = p.where("model = 'length' AND y_pred IS NOT NULL").select("doc_id", "task", F.col("y_pred").alias("first")).join(
        p.where("model = 'parity'").select("doc_id", "task", F.col("y_pred").alias("second")), ["doc_id", "task"])
    return metrics.kappa(pairs, ["task"]).withColumns({c: F.round(c, 6) for c in ("agreement", "kappa")})


@query(
    "duplicate_consistency",
    f"""WITH {fs.S}, i AS (SELECT post AS batch, cluster AS item, count(*) AS n, min(stance) = max(stance) AS same FROM s GROUP BY ALL)
SELECT batch, count(*) AS items, round(avg(CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS consistency,
  avg(CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.9::DOUBLE AS accepted FROM i WHERE n > 1 GROUP BY 1""",
)
def duplicate_consistency(spark, sf):
    labels = fs.scored(spark, sf).select(F.col("post").alias("batch"), F.col("cluster").alias("item"), F.col("stance").alias("label"))
    return annotate.hidden_duplicate_consistency(labels).withColumn("consistency", F.round("consistency", 6))


# ---- calibration ---------------------------------------------------------------------------

_GRID = [0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0]


def _calibration_rows(spark, sf) -> DataFrame:
    return fs.comments(spark, sf).select(
        "id", F.lit("stance").alias("task"), _logits(3, 3).alias("logits"), (F.col("row_no") * 5 % 3).cast("int").alias("target")
    )


_NLL = f"""{fs.C}, z AS (SELECT {_logits_sql(3, 3)} AS z, row_no * 5 % 3 AS y FROM c), g AS (SELECT unnest({_GRID}) AS t),
l AS (SELECT CAST(t AS DOUBLE) AS t, ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) + (list_max(z) - z[y + 1]) / t AS nll FROM z, g)"""


@query("temperature_losses", f"WITH {_NLL} SELECT 'stance' AS task, t AS temperature, round(avg(nll), 6) AS loss FROM l GROUP BY t")
def temperature_losses(spark, sf):
    rows = _calibration_rows(spark, sf)
    return calibration.temperature_losses(rows, _GRID, ["task"]).withColumn("loss", F.round("loss", 6))


# Three tasks; most targets are the class of the largest logit, how many of them differs by task.
_FIT = {"spam": (2, 5, 8), "stance": (6, 3, 7), "emotion": (5, 4, 6)}
_FIT_ROWS = " UNION ALL ".join(
    f"SELECT '{t}' AS task, {_logits_sql(k, salt)} AS z, CASE WHEN row_no % 10 < {m} THEN list_position({_logits_sql(k, salt)}, list_max({_logits_sql(k, salt)})) ELSE row_no % {k} + 1 END AS y FROM c"
    for t, (k, salt, m) in _FIT.items()
)


@query(
    "fit_temperature",
    f"""WITH {fs.C}, r AS ({_FIT_ROWS}), d AS (SELECT task, list_transform(z, lambda x: x - list_max(z)) AS z, z[y] - list_max(z) AS zy, count(*) AS n FROM r GROUP BY ALL),
g AS (SELECT CAST(k AS DOUBLE) / 1000 AS t FROM (SELECT unnest(range(500, 5001)) AS k)),
l AS (SELECT task, t, sum(n * (ln(list_sum(list_transform(z, lambda x: exp(x / t)))) - zy / t)) / sum(n) AS loss FROM d, g GROUP BY ALL)
SELECT task, round(arg_min(t, loss), 3) AS temperature, round(min(loss), 6) AS loss FROM l GROUP BY task""",
)
def fit_temperature(spark, sf):
    """Fitted by Newton's steps, then compared at the multiples of 0.001 on either side."""
    c = fs.raw_comments(spark, sf)
    parts = []
    for t, (k, salt, m) in _FIT.items():
        z = _logits(k, salt)
        y = F.when(F.col("row_no") % 10 < m, F.array_position(z, F.array_max(z)) - 1).otherwise(F.col("row_no") % k)
        parts.append(c.select(F.lit(t).alias("task"), z.alias("logits"), y.cast("int").alias("target")))
    rows = stage(reduce(DataFrame.unionByName, parts), "calibration")
    best = calibration.snap_temperature(rows, calibration.fit_temperature(rows))
    return best.select("task", F.round("temperature", 3).alias("temperature"), F.round("loss", 6).alias("loss"))


_PTS = f"{fs.C}, b AS (SELECT lang AS task, round(stance_conf, 2) AS confidence, CASE WHEN row_no % 5 < 4 AND stance_conf > 0.3 THEN 1 ELSE 0 END AS correct FROM c)"
_CURVE = f"""{_PTS}, d AS (SELECT task, confidence, count(*) AS k, sum(correct) AS c FROM b GROUP BY ALL),
cv AS (SELECT task, confidence, sum(k) OVER w AS answered, sum(c) OVER w AS n_correct, sum(k) OVER (PARTITION BY task) AS n FROM d
  WINDOW w AS (PARTITION BY task ORDER BY confidence DESC))"""


def _points(spark, sf) -> DataFrame:
    return fs.raw_comments(spark, sf).select(
        F.col("lang").alias("task"), F.round("stance_conf", 2).alias("confidence"),
        ((F.col("row_no") % 5 < 4) & (F.col("stance_conf") > 0.3)).cast("bigint").alias("correct"),
    )


@query("coverage_curve", f"WITH {_CURVE} SELECT task, confidence, CAST(answered AS BIGINT) AS answered, round(CAST(n_correct AS DOUBLE) / CAST(answered AS DOUBLE), 6) AS accuracy, round(CAST(answered AS DOUBLE) / CAST(n AS DOUBLE), 6) AS coverage FROM cv")
def coverage_curve(spark, sf):
    c = calibration.coverage_curve(_points(spark, sf), ["task"])
    return c.select("task", "confidence", "answered", F.round("accuracy", 6).alias("accuracy"), F.round("coverage", 6).alias("coverage"))


@query(
    "abstain_threshold",
    f"""WITH {_CURVE}, m AS (SELECT task, quantile_disc(confidence, 0.5) AS median FROM b GROUP BY 1),
r AS (SELECT task, min(confidence) AS reached FROM cv WHERE CAST(n_correct AS DOUBLE) / CAST(answered AS DOUBLE) >= 0.8::DOUBLE GROUP BY 1)
SELECT task, least(coalesce(reached, median), median) AS threshold, median FROM m LEFT JOIN r USING (task)""",
)
def abstain_threshold(spark, sf):
    return calibration.abstain_threshold(_points(spark, sf), ["task"])


@query("reliability", f"WITH {_PTS} SELECT task, CAST(least(floor(confidence * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct), 6) AS accuracy FROM b GROUP BY ALL")
def reliability(spark, sf):
    r = calibration.reliability(_points(spark, sf), ["task"])
    return r.withColumns({"bin": F.col("bin").cast("bigint"), "confidence": F.round("confidence", 6), "accuracy": F.round("accuracy", 6)})


@query(
    "calibration_error",
    f"""WITH {_PTS}, r AS (SELECT task, least(floor(confidence * 10), 9) AS bin, count(*) AS n, avg(confidence) AS cf, avg(correct) AS ac FROM b GROUP BY ALL)
SELECT task, round(sum(abs(cf - ac) * n) / sum(n), 6) AS ece FROM r GROUP BY 1""",
)
def calibration_error(spark, sf):
    r = calibration.reliability(_points(spark, sf), ["task"])
    return calibration.expected_calibration_error(r, ["task"]).withColumn("ece", F.round("ece", 6))


# ---- documents -----------------------------------------------------------------------------


def _read_back(spark, entries: DataFrame, name: str) -> DataFrame:
    """The document as written: a row for every line that holds an entry (section, key, value)."""
    path = scratch_path(spark, name)
    documents.write_document(entries, path)
    text = spark.read.text(path, wholetext=True)
    sections = F.from_json("value", "map<string,map<string,variant>>")
    each = text.select(F.explode(sections).alias("section", "entries")).select("section", F.explode("entries").alias("key", "v"))
    return each.select("section", "key", F.to_json("v").alias("value"))


def _number(path: str, kind: str, name: str):
    return F.get_json_object("value", path).cast(kind).alias(name)


@query(
    "findings_document",
    f"""WITH {_TOPIC}, sp AS (SELECT count(*) AS total, count(*) FILTER (WHERE spam) AS n FROM s), tn AS (SELECT count(*) AS t FROM ns),
tc AS (SELECT topic, stance, count(*) AS n FROM tp GROUP BY ALL), ml AS (SELECT stance FROM ns ORDER BY likes DESC, post, row_no LIMIT 1000)
SELECT 'spam' AS section, 'all' AS key, n, {pct('n', 'total')} AS pct, NULL AS dominant FROM sp
UNION ALL SELECT 'stance', stance, count(*), {pct('count(*)', '(SELECT t FROM tn)')}, NULL FROM ns GROUP BY stance
UNION ALL SELECT 'emotion', emotion, count(*), {pct('count(*)', '(SELECT t FROM tn)')}, NULL FROM ns GROUP BY emotion
UNION ALL SELECT 'phase', phase, count(*), NULL, NULL FROM ns GROUP BY phase
UNION ALL SELECT 'targets', t, (SELECT count(*) FROM ns WHERE stance = t), NULL, NULL FROM (SELECT unnest([{fs.sql_list(STANCE_4)}]) AS t)
UNION ALL SELECT 'most_liked', stance, count(*), {pct('count(*)', '(SELECT count(*) FROM ml)')}, NULL FROM ml GROUP BY stance
UNION ALL SELECT 'topics', topic, CAST(sum(n) AS BIGINT), NULL, arg_min(stance, struct_pack(m := -n, s := stance)) FROM tc GROUP BY topic
UNION ALL SELECT 'examples', stance, NULL, NULL, NULL FROM ns WHERE stance IN ({fs.sql_list(STANCE_4[:2])}) GROUP BY stance""",
)
def findings_document(spark, sf):
    rows = fs.scored(spark, sf).select("id", "post", "row_no", "phase", "likes", "clean", "stance", "emotion", "spam")
    doc = documents.findings_document(stage(rows, "scored"), STANCE_4, STANCE_4[:2])
    return _read_back(spark, doc, "findings").select(
        "section", "key", _number("$.n", "bigint", "n"), _number("$.pct", "double", "pct"), _number("$.dominant", "string", "dominant")
    )


@query(
    "evaluation_document",
    f"""WITH {_EVAL} SELECT 'scores' AS section, model || '/' || task AS key, round(macro_f1, 6) AS score, n FROM ev
UNION ALL SELECT 'classes', model || '/' || task || '/' || class, round(f1, 6), support FROM f1
UNION ALL SELECT 'confusion', mt.model || '/' || mt.task || '/' || class, NULL, NULL FROM mt JOIN cl USING (task)""",
)
def evaluation_document(spark, sf):
    doc = documents.evaluation_document(stage(predictions(spark, sf), "predictions"), CLASSES)
    back = _read_back(spark, doc, "evaluation")
    score = F.coalesce(*[F.get_json_object("value", p).cast("double") for p in ("$.macro_f1", "$.f1")])
    n = F.coalesce(*[F.get_json_object("value", p).cast("bigint") for p in ("$.n", "$.support")])
    return back.select("section", "key", F.round(score, 6).alias("score"), n.alias("n"))


@query(
    "manifest_document",
    """SELECT 'about' AS section, 'licence' AS key, NULL AS n_rows UNION ALL SELECT 'layers', 'comments_clean', count(*) FROM documents
UNION ALL SELECT 'layers', 'labels', count(*) FROM labels UNION ALL SELECT 'raw', event_type || '.csv', count(*) FROM events GROUP BY event_type""",
)
def manifest_document(spark, sf):
    layers = {"comments_clean": fs.comments(spark, sf), "labels": fs.table(spark, sf, "labels")}
    raw = fs.table(spark, sf, "events").select(F.concat("event_type", F.lit(".csv")).alias("file"))
    doc = documents.manifest_document({"licence": "CC BY 4.0"}, layers, raw)
    return _read_back(spark, doc, "manifest").select("section", "key", _number("$.rows", "bigint", "n_rows"))


@query(
    "profile_document",
    f"""WITH {fs.K}, z AS (SELECT cluster, count(*) AS n FROM k GROUP BY 1)
SELECT 'per_post' AS section, post AS key, count(*) AS n FROM k GROUP BY post UNION ALL SELECT 'per_phase', phase, count(*) FROM k GROUP BY phase
UNION ALL SELECT 'totals', 'total', count(*) FROM k UNION ALL SELECT 'totals', 'emoji_only', count(*) FILTER (WHERE emoji_only) FROM k
UNION ALL SELECT 'totals', 'empty_text', count(*) FILTER (WHERE n_chars = 0) FROM k UNION ALL SELECT 'totals', 'users', count(DISTINCT username) FROM k
UNION ALL SELECT 'totals', 'clusters', count(*) FROM z UNION ALL SELECT 'totals', 'rows_in_multi', CAST(coalesce(sum(n), 0) AS BIGINT) FROM z WHERE n > 1""",
)
def profile_document(spark, sf):
    doc = documents.profile_document(fs.enriched(spark, sf))
    return _read_back(spark, doc, "profile").select("section", "key", F.col("value").cast("bigint").alias("n"))


# ---- privacy graph ---------------------------------------------------------------------------


@query(
    "mention_graph",
    f"""WITH {fs.C}, m AS (SELECT username AS u, unnest(regexp_extract_all(text, '{config.MENTION_PATTERN}', 1)) AS h FROM c),
a AS (SELECT {fs.pseudonym_sql('u')} AS author, {fs.pseudonym_sql("rtrim(h, '.')")} AS mentioned FROM m)
SELECT author, mentioned, count(*) AS n FROM a WHERE mentioned IN (SELECT {fs.pseudonym_sql('username')} FROM c) GROUP BY ALL""",
)
def mention_graph(spark, sf):
    return release.mention_graph(fs.comments(spark, sf), fs.SALT)


# ---- models -----------------------------------------------------------------------------------


_TFIDF = r"""d AS (SELECT doc_id AS id, lower(text) AS t FROM documents),
wd AS (SELECT id, ' ' || word || ' ' AS w, count(*) AS n FROM (SELECT id, unnest(regexp_split_to_array(t, '\s+')) AS word FROM d) WHERE word <> '' GROUP BY ALL),
gr AS (SELECT id, unnest(flatten(list_transform(range(2, least(5, length(w)) + 1), lambda k: list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))))) AS gram, n FROM wd),
tf AS (SELECT id, gram, sum(n) AS n FROM gr GROUP BY ALL),
vo AS (SELECT gram, count(*) AS df, sum(n) AS tf FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY tf DESC, gram LIMIT 50000),
iv AS (SELECT gram, ln(CAST(1 + (SELECT count(*) FROM d) AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM vo),
rw AS (SELECT id, gram, (1 + ln(CAST(n AS DOUBLE))) * idf AS w FROM tf JOIN iv USING (gram)),
nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM rw GROUP BY 1)"""


@query(
    "char_tfidf",
    f"""WITH {_TFIDF} SELECT id, count(*) AS n_grams, round(sum(w / norm), 4) AS mass, round(max(w / norm), 6) AS top FROM rw JOIN nm USING (id) GROUP BY 1""",
)
def char_tfidf(spark, sf):
    """All weights are computed; the comparison sums them up per document."""
    docs = fs.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    w = features.char_tfidf(docs, "id", "text", max_features=linear.MAX_FEATURES)
    return w.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_grams"), F.round(F.sum("weight"), 4).alias("mass"), F.round(F.max("weight"), 6).alias("top")
    )


@query(
    "char_tfidf_full",
    f"""WITH {_TFIDF.replace(' ORDER BY tf DESC, gram LIMIT 50000', '')} SELECT id, count(*) AS n_grams, round(sum(w / norm), 4) AS mass, round(max(w / norm), 6) AS top FROM rw JOIN nm USING (id) GROUP BY 1""",
)
def char_tfidf_full(spark, sf):
    """All n-grams of at least two documents."""
    docs = fs.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    w = features.char_tfidf(docs, "id", "text")
    return w.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_grams"), F.round(F.sum("weight"), 4).alias("mass"), F.round(F.max("weight"), 6).alias("top")
    )


@query("linear_baseline")
def linear_baseline(spark, sf):
    """Language classifier trained on half of the documents; evaluation of both halves."""
    docs = fs.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    model = linear.fit(docs.where("id % 2 = 0"), "lang", ["en", "fr", "de", "es"], text="text")
    preds = model.predict(docs, text="text").join(docs.select("id", "lang"), "id")
    rows = preds.select(
        F.lit("linear").alias("model"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("task"),
        F.col("lang").alias("y_true"), "y_pred",
    )
    counts = metrics.confusion_counts(rows)
    return metrics.summary(counts, ["en", "fr", "de", "es"])


def _keyword_model():
    """Loader of a tiny text model; stands in for whatever the user plugs in."""

    def model(texts):
        return {
            "spam": [[1.0, 3.0 if "slot" in t else 0.0] for t in texts],
            "stance": [[len(t) % 7 / 2.0, 1.0, 0.5, 0.25, 0.0, 2.0] for t in texts],
            "emotion": [[t.count("a") % 5 / 2.0, 1.0, 0.0, 0.0, 0.5] for t in texts],
        }

    return model


_KW_LOGITS = {
    "spam": "[1.0::DOUBLE, CASE WHEN contains(clean, 'slot') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END]",
    "stance": "[CAST(nz % 7 AS DOUBLE) / 2, 1.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE]",
    "emotion": "[CAST((length(clean) - length(replace(clean, 'a', ''))) % 5 AS DOUBLE) / 2, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE]",
}
_KW_TEMPS = {"spam": 0.5, "stance": 1.5, "emotion": 1.0}
_KW = f"""{fs.K}, lg AS (SELECT *, CASE WHEN clean = '' THEN 1 ELSE length(clean) END AS nz FROM k),
pz AS (SELECT *, {', '.join(f"{_softmax_sql(z, _KW_TEMPS[t])} AS p_{t}" for t, z in _KW_LOGITS.items())} FROM lg),
pl AS (SELECT *, {', '.join(f"[{fs.sql_list(config.TASKS[t])}][list_position(p_{t}, list_max(p_{t}))] AS raw_{t}" for t in _KW_LOGITS)} FROM pz)"""
_EMOJI_FELT = f"coalesce(list_filter(list_transform(string_split(emoji, ''), lambda e: {_EMOJI_MAP}[e]), lambda x: x IS NOT NULL)[1], 'neutral')"


@query(
    "score_corpus",
    f"""WITH {_KW} SELECT id, raw_spam = 'spam' AS spam, CASE WHEN raw_spam = 'spam' OR emoji_only THEN 'unclear' ELSE raw_stance END AS stance,
CASE WHEN raw_spam <> 'spam' AND emoji_only THEN {_EMOJI_FELT} ELSE raw_emotion END AS emotion,
round(list_max(p_stance), 6) AS stance_conf, round(list_max(p_emotion), 6) AS emotion_conf, list_max(p_stance) < 0.4::DOUBLE AS stance_abstain FROM pl""",
)
def score_corpus(spark, sf):
    """All six result columns of a plugged-in model."""
    out = scoring.score_corpus(fs.enriched(spark, sf), _keyword_model, _KW_TEMPS, {"spam": 0.5, "stance": 0.4, "emotion": 0.4})
    return out.select("id", "spam", "stance", "emotion", F.round("stance_conf", 6).alias("stance_conf"), F.round("emotion_conf", 6).alias("emotion_conf"), "stance_abstain")


# Three tasks over the documents, for the heads: the language, and the two labels where they are known.
_HEAD_TASKS = {"lang": ["de", "en", "es", "fr"], "quality": ["0", "1"], "toxic": ["0", "1"]}


def _head_rows(spark, sf) -> DataFrame:
    labels = fs.table(spark, sf, "labels").select("doc_id", *[F.col(c).cast("string").alias(c) for c in ("quality", "toxic")])
    docs = fs.table(spark, sf, "documents").join(labels, "doc_id", "left")
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("clean"), "lang", "quality", "toxic")


@query(
    "linear_heads",
    """WITH d AS (SELECT doc_id, lang, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 2 = 0)
SELECT 'lang' AS task, count(lang) FILTER (WHERE lang IN ('de', 'en', 'es', 'fr')) AS rows, TRUE AS optimal FROM d
UNION ALL SELECT 'quality', count(quality), TRUE FROM d UNION ALL SELECT 'toxic', count(toxic), TRUE FROM d""",
)
def linear_heads(spark, sf):
    """Three heads fitted together on half of the documents, saved and loaded. The gradient of each
    objective at the stored coefficients, summed anew by joins, tells whether the optimum was found."""
    rows = stage(_head_rows(spark, sf).where("id % 2 = 0"), "head-rows")
    path = scratch_path(spark, "heads")
    heads.fit_heads(rows, _HEAD_TASKS).save(path)
    bound = heads.gradient_bound(heads.load(spark, path), rows)
    return bound.select("task", F.col("rows").cast("bigint").alias("rows"), (F.col("gradient") < 1e-4).alias("optimal"))


@query("linear_select")
def linear_select(spark, sf):
    """A grid of regularisation strengths for every task, fitted together; the best by macro-F1 on the
    documents that were held out is marked."""
    rows = stage(_head_rows(spark, sf), "head-rows")
    model = heads.fit_heads(rows.where("id % 2 = 0"), _HEAD_TASKS, cs=[0.25, 4.0])
    best, scores = heads.choose(model, rows.where("id % 2 = 1"))
    chosen = F.lit(False)
    for task, fitted in best.heads.items():
        chosen = chosen | ((F.col("task") == task) & (F.col("c") == fitted.head.c))
    return scores.withColumn("chosen", chosen)


@query("score_linear")
def score_linear(spark, sf):
    """The default model: linear heads for spam, stance and emotion, calibrated on rows that were held out,
    saved and loaded with what belongs to them, score every comment."""
    rows = stage(fs.scored(spark, sf).withColumn("spam", F.when(F.col("spam"), "spam").otherwise("not_spam")), "scored")
    fit, held = rows.where("row_no % 3 = 0"), rows.where("row_no % 3 = 1")
    model = heads.fit_heads(fit, config.TASKS, cs=[1.0]).only({t: f"{t}@1" for t in config.TASKS})
    logits = model.logits(held).join(held.select("id", *[F.col(t).alias(f"y_{t}") for t in config.TASKS]), "id")
    parts = [
        logits.select(F.lit(t).alias("task"), F.col(t).alias("logits"), sc.class_index(F.col(f"y_{t}"), c).alias("target"))
        for t, c in config.TASKS.items()
    ]
    held_rows = stage(reduce(DataFrame.unionByName, parts), "held")
    temperatures = calibration.fit_temperature(held_rows)
    by_task = F.lit(1.0)
    for task, value in temperatures.items():
        by_task = F.when(F.col("task") == task, F.lit(value)).otherwise(by_task)
    cuts = calibration.abstain_threshold(calibration.calibrated(held_rows, by_task), ["task"])
    thresholds = {r.task: r.threshold for r in cuts.collect()}
    fingerprint = split.dataset_fingerprint(fit).first()[0]
    model.meta = {"temperature": temperatures, "threshold": thresholds, "fingerprint": fingerprint}
    path = scratch_path(spark, "model")
    model.save(path)
    out = scoring.score_with_heads(rows.drop("spam", "stance", "emotion", "stance_conf", "emotion_conf", "stance_abstain"), heads.load(spark, path))
    return out.select("id", "spam", "stance", "emotion", "stance_conf", "emotion_conf", "stance_abstain")


@query(
    "annotate_corpus",
    f"""WITH {fs.K}, a AS (SELECT *, regexp_matches(lower(clean), '{fs.SPAM_RX}') AS spam FROM k)
SELECT id, CAST(spam AS INTEGER) AS spam, 'unclear' AS stance, CASE WHEN spam THEN 'neutral' ELSE
  coalesce(list_filter(list_transform(string_split(clean, ''), lambda e: {_EMOJI_MAP}[e]), lambda x: x IS NOT NULL)[1], 'neutral') END AS emotion FROM a""",
)
def annotate_corpus(spark, sf):
    work = fs.enriched(spark, sf).select("id", "cluster", "phase", "likes", "clean")
    return annotate.labelled(annotate.annotate(work)).select("id", "spam", "stance", "emotion")


def _flaky_completion():
    ask = offline_completion()

    def flaky(messages):
        text = messages[-1]["content"]
        if len(text) % 10 == 0:
            raise TimeoutError
        return "no json" if len(text) % 10 == 1 else ask(messages)

    return flaky


@query(
    "label_yield",
    f"""WITH {fs.K}, y AS (SELECT post, length(clean) % 10 IN (0, 1) AS bad FROM k)
SELECT post, count(*) FILTER (WHERE NOT bad) AS labelled, count(*) FILTER (WHERE bad) AS failed,
  round(CAST(count(*) FILTER (WHERE bad) AS DOUBLE) / CAST(count(*) AS DOUBLE), 6) AS failure_rate FROM y GROUP BY 1""",
)
def label_yield(spark, sf):
    work = fs.enriched(spark, sf).select("id", "post", "clean")
    y = annotate.label_yield(annotate.annotate(work, _flaky_completion), ["post"])
    return y.withColumn("failure_rate", F.round("failure_rate", 6))


# ---- streaming -----------------------------------------------------------------------------------


def _event_stream(spark, sf) -> DataFrame:
    schema = fs.table(spark, sf, "events").schema
    return progress.stream_parquet(spark, f"{sf}/events*.parquet", schema)


_LOG = "'[log] ' || date_format(ts, 'yyyy/MM/dd - HH:mm:ss') || ' | 200 | POST \"/' || event_type || '\"'"


@query("stream_parse_log", "SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS t, count(*) AS n FROM events WHERE event_id % 7 > 1 GROUP BY 1")
def stream_parse_log(spark, sf):
    """Log lines written from the events; some are not requests, some stamps are unreadable.

    Counted per micro-batch, so no state is held between batches.
    """
    line = (
        f"CASE event_id % 7 WHEN 0 THEN '[log] GET ' || event_id WHEN 1 THEN '[log] 2024/99/99 - 10:00:00 POST x' ELSE {_LOG} END"
    )
    lines = _event_stream(spark, sf).select(F.expr(line).alias("value"))
    t = progress.parse_requests(lines).select(F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("t"))
    return progress.run_counting(t, lambda b: b.groupBy("t").agg(F.count(F.lit(1)).alias("n")), ["t"], "parse-log")


@query("stream_throughput", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM events GROUP BY 1")
def stream_throughput(spark, sf):
    events = _event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("t"))
    out = progress.run_counting(
        events, lambda b: progress.window_counts(b, width="1 hour"), ["start"], "throughput"
    )
    return out.select(F.date_format(F.col("start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "stream_live",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, 0::BIGINT AS n_late FROM
(SELECT unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS w FROM events WHERE ts IS NOT NULL) GROUP BY 1""",
)
def stream_live(spark, sf):
    """Sliding windows of an hour, counted live; the table comes in one micro-batch, so nothing is late."""
    events = _event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("t"))
    windows, late = progress.run_live(events, "live", width="1 hour", slide="30 minutes", lateness="1 hour")
    both = windows.withColumn("l", F.lit(0)).unionByName(late.select("start", "end", F.lit(0).alias("n"), F.col("n").alias("l")))
    total = both.groupBy("start").agg(F.sum("n").alias("n"), F.sum("l").alias("n_late"))
    return total.select(F.date_format(F.col("start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "n_late")


@query(
    "throughput_recent",
    """WITH m AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS now)
SELECT count(*) FILTER (WHERE ts <= now AND ts >= now - INTERVAL 6 HOURS) AS recent, count(*) AS total FROM events, m""",
)
def throughput_recent(spark, sf):
    events = fs.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("t"))
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz").cast("timestamp")
    return progress.recent(events, now, 6 * 3600)


@query(
    "stream_progress",
    """WITH l AS (SELECT event_type AS job, arg_max(event_id, ts) AS d, arg_max(event_id % 11, ts) AS f, arg_max(1 + event_id % 3, ts) AS r FROM events GROUP BY 1)
SELECT job, d AS done, round(CAST(d AS DOUBLE) / 1000000, 6) AS share, 1000000 - d AS remaining,
  round(CAST(1000000 - d AS DOUBLE) / (CAST(r AS DOUBLE) + 0.5), 6) AS eta_seconds, round(CAST(f AS DOUBLE) / CAST(d AS DOUBLE), 6) AS failure_share FROM l""",
)
def stream_progress(spark, sf):
    line = "'  ' || event_id || '/1000000  (' || (1 + event_id % 3) || '.5/s, failed=' || (event_id % 11) || ')'"
    lines = _event_stream(spark, sf).select(F.col("event_type").alias("job"), "ts", F.expr(line).alias("value"))
    latest = progress.latest_progress(progress.parse_counters(lines), ["job"], "ts")
    out = progress.run_available(latest, ["job"], "progress")
    return out.withColumns({c: F.round(c, 6) for c in ("share", "eta_seconds", "failure_share")})
