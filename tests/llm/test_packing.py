import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from discursa.llm.packing import WordTokenizer, pack
from discursa.llm.tables import documents
from tokenizers import Tokenizer

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def check(spark, docs, **limits):
    length = limits.get("length", 4096)
    tok = Tokenizer.from_file(PATH)
    rows = pack(docs, PATH, keep_ids=True, **limits).collect()
    want = sorted(tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.select("text").collect())
    by_seq, by_doc = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        used = 0
        for r in seq:
            assert r.offset == used
            used += r.length
        assert used == length or used < length and used & (used - 1) == 0
        assert len(seq) <= limits.get("segments", 512) and sum(r.loss_tokens for r in seq) <= limits.get("loss", length)
    if len(by_doc) == len(want):
        got = []
        for pieces in by_doc.values():
            pieces.sort(key=lambda r: r.start)
            assert pieces[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(pieces, pieces[1:]))
            got.append([i for r in pieces for i in r.ids])
        assert sorted(got) == want
    assert sum(r.length for r in rows) == sum(map(len, want))


def test_documents(spark):
    check(spark, documents(spark, "/root/testdata/sf0.001"))


def test_limits_and_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "It's  <|endoftext|>x 12"), (None, "é\x1cb c"), *[(10 + i, "a b c") for i in range(90)]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int")
    check(spark, docs, length=64, segments=3, loss=40)
    check(spark, docs.union(docs), length=128, segments=4, loss=128)
    assert pack(docs.limit(0), PATH).count() == 0


def test_words_give_the_ids_of_the_text():
    tok = WordTokenizer(PATH)
    for text in ("á é", "I'm don't\tIT'S <|endoftext|> x", "a\x1cb c d", "12 345", "", "x́ y", "H\u0331 h\u0331 İx ΑΣ Σ", "<|ENDOFTEXT|> A", "ǅ ª ﬁ ẞ e\u0301A",
                 " ".join(f"İ{chr(97 + i % 26)}{chr(97 + i // 26)} Ab{chr(97 + i % 26)}É" for i in range(120))):
        assert list(next(tok.ids([text]))) == tok.tok.encode(text, add_special_tokens=False).ids


def test_words_with_punctuation_need_no_ids_of_their_own():
    tok = WordTokenizer(PATH)
    text = "zzqx. Zzqx, zzqx### zzqé; zzqx7| zzq× zzqx:zzqx"
    assert list(next(tok.ids([text]))) == tok.tok.encode(text, add_special_tokens=False).ids
    learned = set().union(*tok.caches)
    assert {b"zzqx", "zzqé".encode()} <= learned and not {b"zzqx.", b"zzqx,", b"zzqx###", "zzqé;".encode(), b"zzqx7|"} & learned


def test_runs_of_texts_keep_apart():
    tok = WordTokenizer(PATH)
    rng = random.Random(5)
    signs = [*"aZ9é×÷Àÿ.,;:!?|*#$%&'- \t\x0b\x0c\x1c\x85\u0331\u0301ßIﬁΣς—中٣²<>", "<|endoftext|>", "<|END", "oftext|>", "'s", "'LL"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += ["", None, ".", "é.", "a.", "<|end", "oftext|> a", "\u0331 A", "A"]
    for given in (texts, pa.array(["cut", *texts], pa.string())[1:], pa.array(texts, pa.large_string())):
        for text, ids in zip(texts, tok.ids(given), strict=True):
            assert list(ids) == tok.tok.encode(text or "", add_special_tokens=False).ids, text
    assert list(tok.ids([])) == []
