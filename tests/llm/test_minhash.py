import random
import sys

import pandas as pd

sys.path.insert(0, __file__.rpartition("/")[0])
import brute  # noqa: E402
from discursa.llm.components import components  # noqa: E402
from discursa.llm.minhash import keep_one, near_duplicates  # noqa: E402
from discursa.llm.tables import documents  # noqa: E402


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_all_pairs(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute.near_duplicates(rows)


def test_chains_and_edges(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows, n = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "long " * 50_000)], 0
    for family in range(6):
        words = [rng.choice(vocab) for _ in range(60)]
        for _ in range(25):  # each a step from the one before: the ends are far apart
            rows.append((n, " ".join(words)))
            n += 1
            words[rng.randrange(60)] = rng.choice(vocab)
    rows += [(500 + i, rows[10][1].upper()) for i in range(4)]
    schema = "doc_id long, text string, component_id int, n_shingles string"
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], schema)
    assert result(near_duplicates(docs)) == brute.near_duplicates(rows)


def test_repeated_and_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = [tuple(r) for r in near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, 2, 1, True)] * 2 + [(2, 2, 1, False), (None, 2, 1, False)], key=repr)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = pd.DataFrame({"a": [*range(1, 40), *[100] * 30, 7, None], "b": [*range(2, 41), *range(101, 131), 7, 3]})
    got = components(spark.createDataFrame(edges.astype("Int64").astype(object).where(edges.notna(), None), "a long, b long"))
    assert {tuple(r) for r in got.collect()} == {(i, 1) for i in range(1, 41)} | {(i, 100) for i in range(100, 131)}


def texts_of(seed, families=5):
    """Families of texts that are near copies (similarity over 0.9) of one another, none across families."""
    rng = random.Random(seed)
    out = []
    for f in range(families):
        words = [f"f{f}w{rng.randrange(10**6)}" for _ in range(120)]
        out.append([" ".join(words), " ".join(words[:-1]), " ".join([*words, "end"]), " ".join(words).upper()])
    return out


def test_ids_with_several_texts(spark):
    a, b, c, d, e = texts_of(1)
    cases = [
        [(3, a[0]), (5, a[0]), (5, b[0]), (7, b[1])],
        [(9, a[0]), (9, b[0]), (8, b[1]), (7, c[0]), (7, a[2]), (6, c[1]), (5, d[0]), (4, e[0]), (4, ""), (2, None)],
        [(9, ""), (9, a[0]), (3, a[1]), (9, None), (1, d[0]), (2, d[3]), (2, e[0]), (30, e[1]), (0, "")],
    ]
    for rows in cases:
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        want = brute.near_duplicates(rows)
        assert len(got) == len(rows)
        assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(i, c, k) for i, (_, c, k) in want.items()}
        assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(brute.shingles(t, 2))) for i, t in rows)


def test_keep_one_loses_no_text(spark):
    a, b, c, d, e = texts_of(2)
    schema = "doc_id long, text string, lang string"
    rows = [(1, a[0], "x"), (1, b[0], "x"), (2, a[0], "x"), (2, c[0], "x"), (3, c[1], "x"), (3, c[1], "a"), (4, None, "x"), (4, None, "x"), (None, a[0], "x"), (5, "", "x"), (6, d[0], "x"), (6, d[1], "x")]
    got = sorted([tuple(r) for r in keep_one(spark.createDataFrame(rows, schema)).collect()], key=repr)
    want = [(1, a[0], "x"), (1, b[0], "x"), (2, c[0], "x"), (4, None, "x"), (None, a[0], "x"), (5, "", "x")]
    six = [r for r in got if r[0] == 6]
    assert len(six) == 1 and six[0][1] in d
    assert sorted(want + six, key=repr) == got
    unique = [(i, t, "x") for i, t in enumerate([*a, *b, "", None, e[0]])]
    assert sorted(r.doc_id for r in keep_one(spark.createDataFrame(unique, schema)).collect()) == [0, 4, 8, 9, 10]
    assert keep_one(spark.createDataFrame([], schema)).count() == 0
