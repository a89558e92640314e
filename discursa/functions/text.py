"""Text normalisation as column expressions (clean text, emoji, near-duplicate key, tokens).

Unicode NFKC and case folding are the only steps Spark SQL lacks. Texts built solely
from characters that NFKC leaves alone never leave the JVM: the Arrow UDF receives NULL
for them, so the Python worker only sees the texts that need it.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from discursa import config
from discursa.functions.binding import direct, let


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _cls(ranges) -> str:
    return "".join(
        f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges
    )


# Code points unchanged by NFKC in any context, whose case folding equals lower-casing
# (sharp s excepted, handled below). Proven code point by code point in tests/test_text.py.
NFKC_STABLE = [
    (0x0, 0x9F),
    (0xA1, 0xA7),
    (0xA9, 0xA9),
    (0xAB, 0xAE),
    (0xB0, 0xB1),
    (0xB6, 0xB7),
    (0xBB, 0xBB),
    (0xBF, 0xFF),
    (0x200B, 0x2010),
    (0x2012, 0x2016),
    (0x2018, 0x2022),
    (0x20E3, 0x20E3),
    (0x2190, 0x21FF),
    (0x2300, 0x2328),
    (0x232B, 0x23FF),
    (0x25A0, 0x27BF),
    (0x2B00, 0x2BFF),
    (0xFE0E, 0xFE0F),
    (0x1F300, 0x1FAFF),
]
# Intersections start with one cheap range test that settles nearly every character.
_UNSTABLE = rf"[\x{{A0}}-\x{{10FFFF}}&&[^{_cls(NFKC_STABLE)}]]"
_EMOJI = _cls(config.EMOJI_RANGES)
_EMOJI_OR_COMPANION = _EMOJI + _cls((c, c) for c in config.EMOJI_COMPANIONS)
_EMOJI_CHAR = rf"[\x{{2190}}-\x{{1FAFF}}&&[{_EMOJI}]]"


def _each(fn, texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.string())


# Arrow's own utf8_normalize leaves letters decomposed, hence unicodedata.
@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return _each(lambda t: unicodedata.normalize("NFKC", t), texts)


@F.arrow_udf(StringType())
def _nfkc_casefold(texts: pa.Array) -> pa.Array:
    return _each(lambda t: unicodedata.normalize("NFKC", t).casefold(), texts)


# Both forms from one normalisation.
@F.arrow_udf(StructType().add("nfkc", StringType()).add("fold", StringType()))
def _nfkc_forms(texts: pa.Array) -> pa.Array:
    normal = _each(lambda t: unicodedata.normalize("NFKC", t), texts)
    return pa.StructArray.from_arrays([normal, _each(str.casefold, normal)], names=["nfkc", "fold"])


def nfkc_forms(text: Column) -> Column:
    """(nfkc, fold): what nfkc and nfkc_casefold give, texts normalised once. Bind it to a column before
    its fields are used."""
    made = _nfkc_forms(F.when(text.rlike(_UNSTABLE), text))
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.struct(F.coalesce(made["nfkc"], text).alias("nfkc"), F.coalesce(made["fold"], folded).alias("fold"))


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(text.rlike(_UNSTABLE), text)), text)


def nfkc_casefold(text: Column) -> Column:
    folded = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.coalesce(_nfkc_casefold(F.when(text.rlike(_UNSTABLE), text)), folded)


def clean_text(text: Column) -> Column:
    """NFKC, control characters out (newline and tab count as space), spaces collapsed."""
    return clean_of_nfkc(nfkc(text))


def clean_of_nfkc(normal: Column) -> Column:
    visible = F.regexp_replace(normal, r"[\p{Cc}&&[^\n\t]]+", "")
    return F.trim(F.regexp_replace(visible, r"(?U)\s+", " "))


def emoji_list(text: Column) -> Column:
    """Emoji in order of appearance; skin tones stay, joiners and selectors do not."""
    return F.regexp_extract_all(text, F.lit(f"({_EMOJI_CHAR})"), F.lit(1))


def emoji_string(text: Column) -> Column:
    return F.array_join(emoji_list(text), "")


def emoji_only(text: Column) -> Column:
    """At least one emoji, and nothing but emoji, punctuation and white space."""
    return emoji_only_of_nfkc(nfkc(text), direct)


def emoji_only_of_nfkc(normal: Column, bind=let) -> Column:
    packed = F.regexp_replace(normal, r"(?U)[\s\x1c-\x1f]+", "")
    return bind(
        packed,
        lambda p: p.rlike(rf"^[{_EMOJI_OR_COMPANION}\p{{P}}]+$")
        & p.rlike(f"[{_EMOJI_OR_COMPANION}]"),
    )


def dup_key(text: Column) -> Column:
    """Letters of the folded text, or its set of emoji when it has no letters."""
    return dup_key_of_folded(nfkc_casefold(text), direct)


def dup_key_of_folded(folded: Column, bind=let) -> Column:
    letters = F.regexp_replace(folded, r"[^\p{L}]+", "")
    emoji = F.array_join(F.sort_array(F.array_distinct(emoji_list(folded))), "")
    return bind(letters, lambda x: F.when(x != "", x).otherwise(emoji))


def cluster_id(key: Column) -> Column:
    """128-bit id of a near-duplicate key: 32 bytes to shuffle instead of a whole text."""
    return F.md5(key)


def tokens(text: Column, stop_words=None) -> Column:
    """Distinct lower-case words of three or more Latin letters, minus stop-words and hashes."""
    words = F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z]{3,})"), F.lit(1))
    )
    stop = config.STOP_WORDS if stop_words is None else stop_words
    if stop:
        words = F.array_except(words, F.array(*[F.lit(w) for w in stop]))
    return F.filter(words, lambda w: ~w.rlike("^[0-9a-f]{12}$"))


def lines(text: Column) -> Column:
    """Non-blank lines of a multi-line input, trimmed."""
    return F.filter(
        F.transform(F.split(text, r"\R"), strip), lambda s: F.length(s) > 0
    )
