import math
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

sys.path.insert(0, __file__.rpartition("/")[0])
import brute  # noqa: E402
from discursa.llm import history, mixing  # noqa: E402
from discursa.llm.tables import documents, remainder  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def base_scores(rows):
    """rows of (id, text) to [(id, held, tokens, known, N, base)]."""
    texts = [(i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, [*brute.WORD.findall(brute.fold(t)), ""]) for i, t in rows]
    c = Counter(w for _, held, ws in texts if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, h, ws in texts]


def test_base_and_held_out(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = mixing.score(docs, remainder(F.col("doc_id"), 7) == 2, hot_words=500).collect()
    want = base_scores([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_better_than_unigrams_on_held_out_texts(spark):
    got = mixing.score(documents(spark, "/root/testdata/sf0.1"), remainder(F.col("doc_id"), 7) == 2)
    score, base = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.95 * base  # both negative


def test_speller_is_a_distribution():
    words = [b"ab", b"abc", b"b", "é".encode(), b"aab"]
    mixer = mixing.Mixer(mixing.count_tables(words, np.array([5, 3, 9, 1, 1])))
    mixer.learn(words * 20, np.ones(100, np.int64))
    data, _, hashes = mixing._contexts([b"ab"])
    for i, node, _ in mixing._bits(data):
        x, gate = mixer.inputs(hashes, node, i, None)
        _, p = mixer.predict(x, gate, i)
        assert ((p > 0) & (p < 1)).all()
    # One byte more or less: the probabilities of all one-byte words and of longer ones sum to one.
    single = 2 ** mixer.spell([bytes([b]) for b in range(256) if b not in (0x20, *range(9, 14))])
    assert single.sum() < 1


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "A a É"), (3, "A a É"), (None, "x y"), (6, "w " * 30_000), (7, "only-here unseen")]
    docs = spark.createDataFrame([(*r, "en" if r[0] == 3 else None, 1) for r in rows], "doc_id long, text string, lang string, n int")
    held = remainder(F.col("doc_id"), 7) == 2
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in mixing.score(docs, held).collect()), key=repr)
    assert got == sorted(base_scores(rows), key=repr)
    assert mixing.score(docs.limit(0), held).count() == 0
    assert mixing.score(docs, F.lit(True)).where("n_known = 0").count() == len(rows)


def test_long_unseen_words_cost_all_their_bytes(spark):
    rng = np.random.default_rng(1)
    word = "".join(chr(x) for x in rng.integers(0x4E00, 0x9FA5, 10_000))[:3333] + "x"  # 10,000 bytes
    assert len(word.encode()) == 10_000
    rows = [(1, "some words to learn from and some more words"), (2, word), (9, word[:333]), (16, "some " + word)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in mixing.score(docs, F.col("doc_id") > 1).collect()}
    # Random characters take 14 bits of 24 at least, in the long word as in its first 999 bytes.
    assert all(got[i].bits_per_byte > 3 for i in (2, 9, 16))
    assert got[2].score < 9 * got[9].score
    assert math.isfinite(got[2].score) and got[16].score < got[2].score


def plain_spell(mixer, words, counts, word):
    """log2 probability of a word: counts by context in a dict, bits mixed one at a time."""
    seen = Counter()

    def bits(data):
        for place, byte in enumerate(data):
            for i in range(8):
                node = (1 << i) | (byte >> (8 - i))
                contexts = [(k, data[max(place - k, 0) : place]) for k in range(5)] + [(5, data[:place])]
                yield i, [(*c, node) for c in contexts], (byte >> (7 - i)) & 1

    for w, n in zip(words, counts):
        for _, contexts, bit in bits(w + b" "):
            for c in contexts:
                seen[c, bit] += n
    total = 0.0
    for i, contexts, bit in bits(word + b" "):
        pairs = [(seen[c, 0], seen[c, 1]) for c in contexts]
        level = [sum(sum(pairs[k]) > x for x in (0.5, 8, 200)) for k in (5, 4)]
        w = mixer.weights[i * 16 + level[0] * 4 + level[1]]
        odds = [math.log((n1 + 0.3) / (n0 + 0.3)) for n0, n1 in pairs] + [1.0]
        z = sum(a * b for a, b in zip(odds, w))
        at = (min(max(z, -7.999), 7.999) + 8) * 2
        lo = int(at)
        refined = mixer.apm[i][lo] * (1 - at + lo) + mixer.apm[i][lo + 1] * (at - lo)
        p = min(max((1 / (1 + math.exp(-min(max(z, -20), 20))) + refined) / 2, 1e-6), 1 - 1e-6)
        total += math.log2(p if bit else 1 - p)
    return total


def test_spelling_equals_plain_bits():
    words, counts = [b"abba", b"bab", "é".encode()], np.array([5, 2, 1])
    mixer = mixing.Mixer(mixing.count_tables(words, counts))
    mixer.learn(words * 10, np.tile(counts, 10))
    for word in (*words, b"", b"ab", b"zq", b"abbab"):
        assert mixer.spell([word])[0] == pytest.approx(plain_spell(mixer, words, counts, word), rel=1e-6)


def plain_guesses(words):
    """(place, inputs, gate, longest context, did it follow) of every token with an expected word, by
    dicts that are updated one token after the other."""
    after, record, out = {}, Counter(), []
    tries = good = run = 0
    for t, w in enumerate(words):
        seen = [(k, (k, *words[t - k : t])) for k in (1, 2, 3) if t >= k]
        met = [(k, c) for k, c in seen if c in after]
        bit = 0
        if met:
            order, best = met[-1]
            expected, bit = after[best], int(after[best] == w)
            odds = lambda a, b: math.log(a / (b - a))
            x = [0.0, 0.0, 0.0, odds(good + 0.2, tries + 1.0), 1.0]
            for k, c in met:
                x[k - 1] = odds(record[c, 1] + 0.4, record[c, 0] + record[c, 1] + 0.8) if after[c] == expected else -1.0
            out.append((t, x, (order - 1) * 4 + sum(run >= r for r in (1, 4, 16)), order, bit))
            tries, good = tries + 1, good + bit
        run = run + 1 if bit else 0
        for _, c in seen:
            if c in after:
                record[c, int(after[c] == w)] += 1
            after[c] = w
    return out


def test_guesses_equal_plain_loops():
    rng = np.random.default_rng(3)
    texts = [None, "", "a", "A b a b A B a b c", " ".join("xyz"[i] for i in rng.integers(0, 3, 400)), "one two three four five\n" * 30, "p q " + "r " * 50]
    for size in (1, 60, 1 << 20):
        checked = 0
        for first, low, ids, start, end, off in history.tokens(pa.array(texts, pa.string()), size):
            at, x, gate, longest, bit = history.guesses(ids, off)
            want = []
            for i in range(len(off) - 1):
                tokens = [*brute.WORD.findall(brute.fold(texts[first + i])), ""]
                assert [low[a:b].tobytes().decode() for a, b in zip(start[off[i] : off[i + 1]], end[off[i] : off[i + 1]])] == tokens
                want += [(t + off[i], *rest) for t, *rest in plain_guesses(tokens)]
                checked += 1
            assert [r[0] for r in want] == at.tolist() and [r[2] for r in want] == gate.tolist()
            assert [r[3] for r in want] == longest.tolist() and [r[4] for r in want] == bit.tolist()
            if want:
                np.testing.assert_allclose(np.array([r[1] for r in want]), x, rtol=1e-12)
        assert checked == len(texts)


def test_order_of_words_and_repeated_lines_count(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(300)]
    rows = []
    for i in range(60):
        lines = [" ".join(vocabulary[k] for k in rng.integers(0, 300, 12)) for _ in range(10)]
        lines += lines[: 5 * (i % 2)]  # half of the texts repeat lines
        rows.append((i, "\n".join(lines), "en"))
    shuffled = rows[-1][1].split()
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([*rows, (100, " ".join(shuffled), "en"), (101, rows[-2][1], "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in mixing.score(docs, F.col("doc_id") >= 58).collect()}
    assert got[59].score > got[100].score + 100  # the same words in order
    assert got[59].bits_per_byte < 0.8 * got[58].bits_per_byte
    assert got[101].score == pytest.approx(got[58].score, rel=1e-12)


@pytest.mark.parametrize("classes, names", [(3, ["en"]), (4, ["en", "de"])])
def test_score_equals_plain_sums(spark, classes, names):
    """Good-Turing shares, spelling and the sum over classes, by loops over tokens."""
    rows = [(1, "the cat sat on the mat", "en"), (2, "the dog", "en"), (3, "le chat et le chien", "fr"), (4, "", None), (5, "der hund", "de"),
            (6, "the chat unheard sat sat", "en"), (7, "le dog", "fr"), (8, None, "de"), (9, "the dog the dog le hund sat le hund sat the dog", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.score for r in mixing.score(docs, F.col("doc_id") > 5, classes=classes, hot_words=4).collect()}
    tokens = {i: [*brute.WORD.findall(brute.fold(t)), ""] for i, t, _ in rows}
    # Of the training rows en has two, null, de and fr one each: null takes a place and goes to the rest.
    K = len(names) + 1
    k_of = {i: names.index(c) if c in names else K - 1 for i, _, c in rows}
    train = [i for i, _, _ in rows if i <= 5]
    by = [Counter(w for i in train if k_of[i] == k for w in tokens[i]) for k in range(K)]
    c = sum(by, Counter())
    n, share = sum(c.values()), lambda x: sum(v == 1 for v in x.values()) / sum(x.values())
    novel = min(max(share(c), 1e-4), 0.5)
    fresh = [min(max(share(x) - novel, 0.01), 0.9 - novel) for x in by]
    known = sorted((w for w in c if w), key=lambda w: (xxhash.xxh64_intdigest(w.encode(), 42) + 2**63) % 2**64)
    counts = np.array([c[w] for w in known])
    mixer = mixing.Mixer(mixing.count_tables([w.encode() for w in known], counts))
    mixer.learn([w.encode() for w in known], counts)
    hot = sorted(c, key=lambda w: (-c[w], w))[:4]
    lesson = [plain_guesses(tokens[i]) for i in train]
    assert sum(x[4] for rows in lesson for x in rows) == 0 and sum(len(rows) for rows in lesson) > 0
    past = history.train(docs.where("doc_id <= 5").select("text"))
    for i, ws in tokens.items():
        total = 0.0
        guess = {t: (float(past.predict(np.array([x]), np.array([gate]), np.array([order]))[0]), bit) for t, x, gate, order, bit in plain_guesses(ws)}
        if i == 9:
            assert sum(bit for _, bit in guess.values()) >= 4
        for k in range(K):
            p = (sum(k_of[j] == k for j in train) + 0.5) / (len(train) + 0.5 * K)
            for t, w in enumerate(ws):
                spelled = 2 ** float(mixer.spell([w.encode()])[0])
                own = (1 - novel - fresh[k]) * by[k][w] / sum(by[k].values()) + fresh[k] * c[w] / n + novel * spelled
                q, right = guess.get(t, (0.0, 0))
                p *= (q + (1 - q) * own if w in hot else q) if right else (1 - q) * own
            total += p
        assert got[i] == pytest.approx(math.log10(total), rel=1e-9), i


def test_speller_learns_from_every_word_of_every_partition(spark):
    rng = np.random.default_rng(8)
    words = sorted({bytes(rng.integers(97, 107, rng.integers(1, 9)).astype(np.uint8)) for _ in range(3000)})
    counts = rng.integers(1, 9, len(words))
    tables = mixing.count_tables(words, counts)
    rows = [(w.decode(), int(c)) for w, c in zip(words, counts)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "word string, c long")
    parts = [([r.word.encode() for r in part], np.array([r.c for r in part])) for part in df.rdd.glom().collect()]
    assert len(parts) == 2 and sum(len(w) for w, _ in parts) == len(words)
    got = mixing.trained(df, tables)
    value, bits = 0.0, 0.0
    for w, c in parts:
        mixer = mixing.Mixer(tables)
        mixer.learn(w, c)
        n = mixer.gates[:, None]
        assert n.sum() == 8 * sum(len(x) + 1 for x in w)
        value, bits = value + mixer.weights * n, bits + n
    some = bits[:, 0] > 0
    np.testing.assert_allclose(got.weights[some], (value / np.maximum(bits, 1))[some], rtol=1e-9)
    assert (got.weights[~some] == mixing.Mixer(tables).weights[~some]).all()


def test_spelling_takes_the_log_of_a_slot_once(monkeypatch):
    words, counts = [b"alpha", b"beta", b"gamma", b"delta"], np.array([4, 2, 1, 7])
    mixer = mixing.Mixer(mixing.count_tables(words, counts))
    mixer.learn(words * 10, np.tile(counts, 10))
    first = mixer.spell([b"alphabet", b"zeta"])
    monkeypatch.setattr(mixing, "_stretch", None)
    assert (mixer.spell([b"alphabet", b"zeta"]) == first).all()


def test_vocabulary_counts_words_and_ends():
    texts = pa.RecordBatch.from_arrays([pa.array([0, 1, 0, -1, 0], pa.int32()), pa.array(["A b a", "a", None, "new\u00a0x b", ""])], names=["k", "text"])
    got = sorted((r["k"], r["word"], r["n"]) for out in mixing._vocabulary(2)([texts]) for r in out.to_pylist())
    assert got == [(-1, "", 0), (-1, "b", 0), (-1, "new\u00a0x", 0), (0, "", 3), (0, "a", 2), (0, "b", 1), (1, "", 1), (1, "a", 1)]
