"""Prompts for an external annotator and strict reading of what it returns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from discursa import config
from discursa.functions.binding import let
from discursa.functions.text import strip


def prompt(text: Column, system: str | None = None, examples=(), max_chars: int | None = None) -> Column:
    """Chat messages for one comment: system, optional example pairs, the comment (its first max_chars
    characters, if given)."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = [message("system", F.lit(system or config.DEFAULT_PROMPT))]
    for shown, answer in examples:
        messages.append(message("user", F.lit(shown)))
        messages.append(message("assistant", F.lit(json.dumps(answer, ensure_ascii=False))))
    messages.append(message("user", text if max_chars is None else F.substring(text, 1, max_chars)))
    return F.array(*messages)


def salvage_json(response: Column) -> Column:
    """Response as VARIANT: the whole string, else its first brace pair without nesting."""
    first = F.regexp_extract(response, r"(?s)\{[^{}]*\}", 0)
    return F.coalesce(F.try_parse_json(response), F.try_parse_json(F.nullif(first, F.lit(""))))


def match_label(value: Column, classes: list[str]) -> Column:
    """Exact class, else the only class that is a prefix of the value or has it as prefix."""
    domain = F.array(*[F.lit(c) for c in classes])

    def match(needle: Column) -> Column:
        near = F.filter(domain, lambda k: k.startswith(needle) | needle.startswith(k))
        return F.when(F.array_contains(domain, needle), needle).otherwise(
            let(near, lambda n: F.when(F.size(n) == 1, F.element_at(n, 1)))
        )

    return let(F.lower(F.replace(strip(value), F.lit(" "), F.lit(""))), match)


def truthy(value: Column) -> Column:
    """Truth of a JSON value: empty strings, zero, null and empty containers are false."""
    kind = F.schema_of_variant(value)
    as_text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull(), None)
        .when(kind == "VOID", False)
        .when(kind == "BOOLEAN", as_text == "true")
        .when(kind == "STRING", as_text != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~as_text.isin("[]", "{}"))
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def label_record(parsed: Column, stances=None, emotions=None) -> Column:
    """Validated struct<spam, stance, emotion>, or NULL when a key or class is missing.

    Spam is always stored as unclear + neutral, whatever else the annotator said.
    """
    found = F.struct(
        let(F.try_variant_get(parsed, "$.spam", "variant"), truthy).alias("spam"),
        match_label(
            F.try_variant_get(parsed, "$.stance", "string"), stances or config.STANCES
        ).alias("stance"),
        match_label(
            F.try_variant_get(parsed, "$.emotion", "string"), emotions or config.EMOTIONS
        ).alias("emotion"),
    )

    def record(r: Column) -> Column:
        spam = r["spam"]
        whole = spam.isNotNull() & r["stance"].isNotNull() & r["emotion"].isNotNull()
        return F.when(
            whole,
            F.struct(
                spam.alias("spam"),
                F.when(spam, config.UNCLEAR).otherwise(r["stance"]).alias("stance"),
                F.when(spam, config.NEUTRAL).otherwise(r["emotion"]).alias("emotion"),
            ),
        )

    return let(found, record)
