import base64
import random
from hashlib import sha256

import public_tokenizers as P
import pytest
import regex
import tiktoken
from discursa.llm import bpe
from discursa.llm.tables import documents
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = regex.compile(P.PATTERN)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary(PATH))


def test_pairs_by_merging(encoder):
    rng = random.Random(3)
    tokens = encoder.v.tokens
    short = [r for r, t in enumerate(tokens) if len(t) <= 3]
    pairs = [(rng.randrange(len(tokens)), rng.randrange(len(tokens))) for _ in range(4000)]
    pairs += [(rng.choice(short), rng.choice(short)) for _ in range(8000)] + [(t, t) for t in short]
    kept = 0
    for a, b in pairs:
        want = bpe.merge(tokens[a] + tokens[b], encoder.v.ranks) == [tokens[a], tokens[b]]
        assert encoder.compatible(a, b) == want, (tokens[a], tokens[b])
        kept += want
    assert 1000 < kept < len(pairs) - 1000


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("aab e'slt \n\t 12é漢🙂", max_size=80) | st.text("ab", max_size=90))
def test_text_as_the_library(text):
    enc = test_text_as_the_library.__dict__.setdefault("enc", bpe.Encoder(bpe.vocabulary(PATH)))
    assert bpe.encode_text(enc, WORDS, text).tolist() == TIKTOKEN.encode_ordinary(text)
    parts = [w for s in bpe.segments(text, 5) for w in WORDS.findall(s)]
    assert parts == WORDS.findall(text)


def test_appends_and_edits(encoder):
    rng = random.Random(5)
    data = bytes(rng.choice(b"internationalization of thethethe \xc3\xa9") for _ in range(3000))
    grown = bpe.Prefixes(encoder)
    for a in range(0, len(data), 7):
        grown.append(data[a : a + 7])
    assert grown.tokens() == bpe.Prefixes(encoder, data).tokens() == encoder.word(data)
    for _ in range(30):
        a = rng.randrange(len(grown.data))
        b, by = min(len(grown.data), a + rng.randrange(6)), bytes(rng.choice(b"theion ") for _ in range(rng.randrange(6)))
        want = grown.data[:a] + by + grown.data[b:]
        computed = grown.replace(a, b, by)
        assert grown.data == want and grown.last == bpe.Prefixes(encoder, want).last
        assert computed <= len(by) + 6 * encoder.v.longest or computed == len(want) - a


def test_long_word(encoder):
    word = "ab" * 40_000 + "c" * 30_000
    assert b"".join(encoder.v.tokens[t] for t in encoder.word(word.encode())) == word.encode()


def test_tables(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    got = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == TIKTOKEN.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
    rows = [(1, None, "x"), (1, "", "x"), (None, "  a  b\n", "y"), (2, "é" * 300_000 + " tail", "z"), (2, "same", "z"), (2, "same", "z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(odd, PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids"] and out.count() == 6
    for r in out.collect():
        assert r.ids == TIKTOKEN.encode_ordinary(r.text or "")
    assert bpe.encode(odd.where("false"), PATH, P.PATTERN).count() == 0


def test_reencode(spark):
    rng = random.Random(9)
    texts = ["", "one", "  lead and  trail  ", "no_blank_here" * 9, "line\n\n next\tline 'tis John's " * 20]
    rows = []
    for i in range(120):
        t = rng.choice(texts)
        at = rng.randrange(len(t) + 3)
        rows.append((i, t, at, rng.randrange(5), rng.choice(["", " ", "new", " new\n", "ß "])))
    rows += [(200, "text", 4, 0, " more"), (201, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int, length int, replacement string")
    new = {r.doc_id: r for r in bpe.reencode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()}
    for i, t, at, n, by in rows:
        t, at, n = t or "", at or 0, n or 0
        want = t[:at] + (by or "") + t[at + n :]
        assert new[i].text == want and new[i].ids == TIKTOKEN.encode_ordinary(want)


def test_query(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    rows = entry.queries()["op11_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = TIKTOKEN.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(text[r.doc_id].encode()).hexdigest()
