"""Corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from discursa.llm import decontaminate, language, minhash, packing, pii
from discursa.llm.tables import documents, staged


def small_batches(spark):
    """Rows that reach a Python worker at once: with whole texts of any length, fewer than Spark's
    default, so that executors hold several stages' workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def identify_language(spark, docs, sf_dir):
    """Drops documents of no identifiable language; the model is fitted on the stage's own input."""
    small_batches(spark)
    keyed = docs.withColumn("_row", F.xxhash64("text"))
    found = language.identify_documents(keyed, language.train(docs), ["doc_id", "_row"])
    und = staged(found.where(F.col("language") == language.UND).select("doc_id", "_row").distinct(), "und")
    same = F.col("d.doc_id").eqNullSafe(F.col("u.doc_id")) & (F.col("d._row") == F.col("u._row"))
    return keyed.alias("d").join(und.alias("u"), same, "left_anti").select(*docs.columns)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps one of each group of near-duplicate texts (five words, 0.8), that of the smallest id, once. Rows
    are told apart by id and text; rows without id stay."""
    small_batches(spark)
    return minhash.keep_one(docs, words=5)


def decontaminate_benchmark(spark, docs, sf_dir):
    """Drops documents that hold a benchmark item."""
    small_batches(spark)
    return decontaminate.without_leaking_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark, docs, sf_dir):
    """Replaces personal data in the texts by its kind."""
    small_batches(spark)
    return pii.mask(docs)


def pack_sequences(spark, docs, sf_dir):
    """Packs the tokens of all texts."""
    small_batches(spark)
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
