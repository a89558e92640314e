"""One query per operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from discursa.llm import bpe, decontaminate, language, merkle, minhash, mixing, negatives, packing, pii, substrings, toxicity, variants, warc
from discursa.llm.registry import query
from discursa.llm.tables import documents, remainder


@query("op2_minhash_dedup")
def op2(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir))


@query("op4_pii")
def op4(spark, sf_dir):
    return pii.find(documents(spark, sf_dir))


@query("op6_substring_dedup")
def op6(spark, sf_dir):
    return substrings.remove_repeats(documents(spark, sf_dir))


@query("op8_packing")
def op8(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), str(public_tokenizers.path("word_bpe_49k.json")))


@query("op3_language_id")
def op3(spark, sf_dir):
    model = language.train(documents(spark, sf_dir))
    return language.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)


@query("op5_merkle_fingerprints")
def op5(spark, sf_dir):
    return merkle.compare_with_edits(documents(spark, sf_dir))


@query("op9_decontamination")
def op9(spark, sf_dir):
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs.where(~held), labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM r
"""


@query("op7_warc", OP7_SQL)
def op7(spark, sf_dir):
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op1_context_mixing")
def op1(spark, sf_dir):
    return mixing.score(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)


@query("op11_byte_bpe")
def op11(spark, sf_dir):
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


OP12_SQL = """
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v
    FROM range(256) AS r(i))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
    translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), counted AS (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run
), hashed AS (
  SELECT run, n, xor(list_reduce(
    flatten(list_transform(string_split(id || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM counted, steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n
    FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.a || x.b = y.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
    CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain AS (
  SELECT word, word AS root, form AS up FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.up = f.word
)
SELECT f.*, root FROM formed f JOIN chain c ON f.word = c.word AND c.up IS NULL
"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark, sf_dir):
    return variants.group_variants(variants.count_words(variants.with_slips(variants.runs(documents(spark, sf_dir)))))


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, list_dot_product(a.vec, v.vec)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
    id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT * FROM n WHERE rank <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return negatives.mine(negatives.integer_rows(vectors, "vec_id", label, "embedding"), F.col("id") % 50 == 0)
