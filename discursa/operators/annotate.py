"""Bulk annotation through a pluggable completion function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from discursa import config
from discursa.functions import annotation as an
from discursa.functions import fields as fx

# A completion gets chat messages and returns the raw answer; it may raise.
Completion = Callable[[list[dict]], str]


# What a completion may raise when no answer comes: time-outs and connections (OSError has both), and an
# answer without the parts that were asked for. Anything else is a fault of the program and ends the job.
FAILURES = (TimeoutError, ConnectionError, OSError, KeyError)
ASKED = 256  # prompts turned into messages at once
CONCURRENCY = 8  # calls under way at once in a task


def complete(
    prompt: Column, make: Callable[[], Completion], failures: tuple = FAILURES, concurrency: int = CONCURRENCY
) -> Column:
    """Raw answers, NULL where the completion failed; `make` runs once per task.

    A task has at most `concurrency` calls under way, so a completion must allow calls from several
    threads, unless concurrency is 1. Exceptions outside `failures` end the job.
    """

    @F.arrow_udf(StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ask = make()

        def safe(messages):
            try:
                return ask([dict(m) for m in messages])
            except failures:  # a failed answer is counted, never guessed
                return None

        with ThreadPoolExecutor(concurrency) as pool:
            for prompts in batches:
                answers: list[str | None] = []
                for a in range(0, len(prompts), ASKED):  # only these are Python objects, the rest stays in Arrow
                    answers += pool.map(safe, prompts.slice(a, ASKED).to_pylist())
                yield pa.array(answers, pa.string())

    return run(prompt)


def offline_completion(
    spam_terms=tuple(config.SPAM_TERMS), emoji_emotion=tuple(config.EMOJI_EMOTION.items()),
    stance: str = config.UNCLEAR, neutral: str = config.NEUTRAL,
) -> Completion:
    """Rule-based stand-in for a model: spam vocabulary and emoji only."""
    spam = re.compile("|".join(spam_terms))
    emotion = {c: e for e, chars in emoji_emotion for c in chars}

    def ask(messages: list[dict]) -> str:
        text = messages[-1]["content"]
        felt = next((emotion[c] for c in text if c in emotion), neutral)
        return json.dumps(
            {"spam": bool(spam.search(text.casefold())), "stance": stance, "emotion": felt}
        )

    return ask


def annotate(
    work: DataFrame, make: Callable[[], Completion] = offline_completion, system: str | None = None,
    examples=(), failures: tuple = FAILURES, concurrency: int = CONCURRENCY,
) -> DataFrame:
    """work plus label struct<spam, stance, emotion>, NULL when the answer was unusable."""
    answer = complete(an.prompt(F.col("clean"), system, examples), make, failures, concurrency)
    asked = work.withColumn("response", answer)
    return asked.withColumn("label", an.label_record(an.salvage_json(F.col("response"))))


def labelled(annotated: DataFrame) -> DataFrame:
    """Usable rows in the shape of the label sets."""
    return annotated.where(F.col("label").isNotNull()).select(
        "id", "cluster", fx.record_post(F.col("id")).alias("post"), "phase", "likes", "clean",
        F.col("label.spam").cast("int").alias("spam"), "label.stance", "label.emotion",
    )


def label_yield(annotated: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Labelled and rejected rows and the failure rate."""
    failed = F.count_if(F.col("label").isNull())
    return annotated.groupBy(*keys).agg(
        F.count("label").alias("labelled"),
        failed.alias("failed"),
        (failed / F.count(F.lit(1))).alias("failure_rate"),
    )


def join_batches(work: DataFrame, batches: DataFrame) -> DataFrame:
    """Label batches joined to the work-list they answer."""
    return work.join(batches, "id")


def hidden_duplicate_consistency(labels: DataFrame, minimum: float = 0.9) -> DataFrame:
    """Agreement inside repeated items per batch; batches below the minimum are rejected.

    labels: batch, item, label. Every item with several labels counts once, as consistent
    when all its labels are equal.
    """
    items = labels.groupBy("batch", "item").agg(
        F.count(F.lit(1)).alias("n"), (F.min("label") == F.max("label")).alias("same")
    )
    return (
        items.where("n > 1")
        .groupBy("batch")
        .agg(F.count(F.lit(1)).alias("items"), F.avg(F.col("same").cast("int")).alias("consistency"))
        .withColumn("accepted", F.col("consistency") >= minimum)
    )
