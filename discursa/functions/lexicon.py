"""Rule-based labels: event phase, spam vocabulary, emoji emotion, topics, size classes."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from discursa import config
from discursa.functions import text as tx
from discursa.functions.binding import let


def event_phase(ts: Column, phases=None) -> Column:
    """Phase code of a date: the first phase whose inclusive upper bound is not passed."""
    out, day = None, F.to_date(ts)
    *bounded, (_, last) = phases or config.PHASES
    for bound, code in bounded:
        hit = day <= F.lit(bound).cast("date")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return F.lit(last) if out is None else F.when(day.isNotNull(), out.otherwise(last))


def any_term(text: Column, terms: list[str]) -> Column:
    """Does any term occur? Terms are regular expressions; plain words among them are substring
    searches, the others run as one expression. No terms never occur. `text` should be bound."""
    plain = [t for t in terms if re.fullmatch(r"[\w ]+", t)]
    rules = [t for t in terms if t not in plain]
    hits = [text.contains(t) for t in plain]
    if rules:
        hits.append(text.rlike("(?U)" + "|".join(f"(?:{r})" for r in rules)))
    return reduce(Column.__or__, hits) if hits else F.lit(False)


def spam_flag(text: Column, terms: list[str] | None = None) -> Column:
    return any_term(tx.nfkc_casefold(text), terms or config.SPAM_TERMS)


def spam_flag_of_clean(clean: Column, terms: list[str] | None = None) -> Column:
    """Spam flag of a text that already is NFKC, without another trip to Python.

    Same result as spam_flag for ASCII vocabularies; only letters that fold to an ASCII
    letter plus a combining mark (such as j with caron) are not folded here.
    """
    folded = F.replace(F.lower(clean), F.lit("ß"), F.lit("ss"))
    return let(folded, lambda t: any_term(t, terms or config.SPAM_TERMS))


def emotion_of_emoji(emoji: Column, mapping=None, default: str = config.NEUTRAL) -> Column:
    """Emotion of the first emoji that is in the map."""
    mapping = mapping or config.EMOJI_EMOTION
    table = F.create_map(
        *chain.from_iterable(
            (F.lit(e), F.lit(emotion)) for emotion, chars in mapping.items() for e in chars
        )
    )
    hits = F.filter(
        F.transform(emoji, lambda e: F.try_element_at(table, e)), lambda x: x.isNotNull()
    )
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(default))


def topics(text: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """All topics whose vocabulary (lower case) occurs in the text, in vocabulary order."""
    vocab = terms or config.TOPIC_TERMS

    def tags(low: Column) -> Column:
        return F.array(*[F.when(any_term(low, words), F.lit(t)) for t, words in vocab.items()])

    return F.array_compact(let(F.replace(F.lower(text), F.lit("ı"), F.lit("i")), tags))


def text_type(emoji_only: Column, n_chars: Column) -> Column:
    return (
        F.when(emoji_only, "emoji")
        .when(n_chars <= config.SHORT_TEXT, "short")
        .when(n_chars <= config.NORMAL_TEXT, "normal")
        .otherwise("long")
    )


def like_tier(likes: Column) -> Column:
    return F.when(likes == 0, "0").when(likes < 100, "1-99").otherwise("100+")


def display_label(code: Column, labels: dict) -> Column:
    """Display name of a code; unknown codes are kept."""
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in labels.items()))
    return F.coalesce(F.try_element_at(table, code), code)
