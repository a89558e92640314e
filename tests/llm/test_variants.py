import random
import re
import zlib

from discursa.llm import variants
from discursa.llm.tables import documents


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if edits(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= 2 * n else None
        out[w] = [n, len(near), form, counts[form] if form else None, w]
    for w in out:
        while out[out[w][4]][2]:
            out[w][4] = out[out[w][4]][2]
    return {w: tuple(v) for w, v in out.items()}


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def vocabulary(seed, letters="abé", size=400):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.randint(3, 60) for _ in range(size)}


def test_against_all_pairs(spark):
    for letters, symbols in (("abé", 2), ("abcdefß", 4), ("aÿ", 3)):
        counts = vocabulary(len(letters), letters)
        df = spark.createDataFrame(list(counts.items()), "word string, n long")
        assert got(variants.group_variants(df, symbols=symbols)) == brute(counts)


def test_large_groups_are_split(spark):
    counts = {"sameprefix" + w: n for w, n in vocabulary(7, "abc", 300).items() if len(w) > 4}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got(variants.group_variants(df, group=20)) == brute(counts)


def test_edges(spark):
    schema = "word string, n long, root string"
    rows = [(None, 4, "x"), ("words", None, "x"), ("words", 4, "x"), ("words", 2, "y"), ("word", 30, "z"), ("wörds", 30, None), ("k" * 40_000, 3, ""), ("k" * 39_999 + "j", 9, "")]
    out = got(variants.group_variants(spark.createDataFrame(rows, schema)))
    assert out == brute({"words": 6, "word": 30, "wörds": 30, "k" * 40_000: 3, "k" * 39_999 + "j": 9})
    assert out["words"][2] == "word"
    assert got(variants.group_variants(spark.createDataFrame([], schema))) == {}


def test_slips_and_counts(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([(None, "Ünïcode ÄRGER Kelvin Kelvin don't"), (None, None), (5, "")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd)
    want = {}
    for r in docs.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                want[w] = want.get(w, 0) + 1
    found = {r.word: r.n for r in variants.count_words(variants.with_slips(variants.runs(docs)), least=1).collect()}
    assert found == want
