import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from discursa import config
from discursa.functions import lexicon as lx
from discursa.functions import text as tx


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, text string")
    return [r[0] for r in df.select(fn(F.col("text")).alias("v"), "i").orderBy("i").select("v").collect()]


def test_stable_ranges_really_are_stable():
    stable = {c for lo, hi in tx.NFKC_STABLE for c in range(lo, hi + 1)}
    for c in stable:
        ch = chr(c)
        assert unicodedata.normalize("NFKC", ch) == ch and unicodedata.combining(ch) == 0, hex(c)
        assert ch.casefold() == ch.lower().replace("ß", "ss"), hex(c)
    # no stable character is the second half of a composition
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            assert int(parts[1], 16) not in stable


def test_no_letter_is_an_emoji():
    for lo, hi in config.EMOJI_RANGES:
        assert not any(unicodedata.category(chr(c)).startswith("L") for c in range(lo, hi + 1))


FANCY = "menang di #\U0001d5de\U0001d5e2\U0001d5df\U0001d5d8"


def test_clean_text(spark):
    rows = [FANCY, "  a \n\n b\t ", "I AM 😭😭", "a\rb", "x  y", "été", "", None]
    assert values(spark, rows, tx.clean_text) == [
        "menang di #KOLE", "a b", "I AM 😭😭", "ab", "x y", "été", "", None,
    ]


def test_emoji(spark):
    rows = ["😭😭😭", "🥺💔", "🤲🏻", "😭 … 😭", "ok 😭", "...", "", "❤️"]
    assert values(spark, rows, tx.emoji_only) == [True, True, True, True, False, False, False, True]
    assert values(spark, ["so 😭💔 x", "🙏🏻", "❤️"], tx.emoji_list) == [["😭", "💔"], ["🙏", "🏻"], ["❤"]]


def test_dup_key(spark):
    same = ["Win 7,2m at KOLE 💸", "win 12,6m AT  \U0001d5de\U0001d5e2\U0001d5df\U0001d5d8!!"]
    a, b = values(spark, same, tx.dup_key)
    assert a == b == "winmatkole"
    keys = values(spark, ["😭😭😭", "😭😭", "💔", "123", "...", "", "Straße", "STRASSE", "ΣΑΣ", "σας"], tx.dup_key)
    assert keys[0] == keys[1] != keys[2]
    assert keys[3] == keys[4] == keys[5] == ""
    assert keys[6] == keys[7] and keys[8] == keys[9]


def test_key_matches_plain_python(spark):
    def plain(t):
        t = unicodedata.normalize("NFKC", t).casefold()
        letters = "".join(c for c in t if c.isalpha())
        emoji = {c for c in t if any(lo <= ord(c) <= hi for lo, hi in config.EMOJI_RANGES)}
        return letters or "".join(sorted(emoji))

    rows = ["ﬁne Ⅷ 12", "Ǆ ŉ ß ẞ", "日本語 テスト", "①②", "İstanbul", "áé", "⏱️⭐", "مرحبا"]
    assert values(spark, rows, tx.dup_key) == [plain(r) for r in rows]


@pytest.mark.parametrize("day,phase", [
    ("2025-12-31", "f1"), ("2026-01-01", "f2"), ("2026-04-30", "f2"), ("2026-05-01", "f3"),
    ("2026-06-28", "f3"), ("2026-06-29", "f4"), ("2031-01-01", "f4"),
])
def test_phase_bounds(spark, day, phase):
    assert values(spark, [day], lambda c: lx.event_phase(c.cast("timestamp_ntz"))) == [phase]


def test_lexicons(spark):
    rows = ["win at #\U0001d5de\U0001d5e2\U0001d5df\U0001d5d8\U0001d5e0\U0001d5d4\U0001d5eb", "slot GACOR", "jpeg 4r r.",
            "modal 50", "modal", "pay wd now", "depositor", "deposit"]
    expected = [True, True, False, True, False, True, False, True]
    assert values(spark, rows, lx.spam_flag) == expected
    assert values(spark, rows[1:], lx.spam_flag_of_clean) == expected[1:]
    topics = values(spark, ["Naik gaji sampai 280% Vonis", "9.3 Trili mark up", "hakimi", "😭"], lx.topics)
    assert topics == [["judge_pay", "judiciary"], ["devices"], [], []]
    felt = values(spark, ["👀", "👀😡", "🙏🏻", "x"], lambda c: lx.emotion_of_emoji(tx.emoji_list(c)))
    assert felt == ["neutral", "anger", "hope", "neutral"]


def test_terms_with_alternations_and_groups(spark):
    rows = ["grab aja", "naik gojek", "abde", "cde", "foo bar", "barbaz", "foobarbaz", "plain words", ""]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    for terms in (["grab|gojek"], ["((ab|c)de)"], [r"\bfoo\b|\bbarbaz\b"], ["plain", "x?cde"], []):
        want = [any(re.search(p, r) for p in terms) for r in rows]
        assert [r.hit for r in df.select(lx.any_term(F.col("t"), terms).alias("hit")).collect()] == want, terms


def test_strip_all_white_space(spark):
    df = spark.createDataFrame([("\t a\u00a0b\u00a0\n", "\u2003\x1c", None)], "t string, u string, v string")
    row = df.select(*[tx.strip(F.col(c)).alias(c) for c in "tuv"]).first()
    assert tuple(row) == ("a\u00a0b", "", None)

def test_tokens(spark):
    got = values(spark, ["Kata kata yang ABC ab 0123456789ab deadbeefdead café"], tx.tokens)
    assert got == [["kata", "abc", "caf"]]
