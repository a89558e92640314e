import random
import sys

sys.path.insert(0, __file__.rpartition("/")[0])
import brute  # noqa: E402
from discursa.llm.substrings import remove_repeats  # noqa: E402
from discursa.llm.tables import documents  # noqa: E402


def rows_of(df):
    return sorted(((r[0], r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def test_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(remove_repeats(docs, keep_text=True)) == sorted(brute.kept_words(rows, 35), key=repr)


def test_small_windows_and_edges(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "x " * 3000), (103, "p q r s t u v"), (104, "p  q\nr s t u v"), (None, "p q r s t u v")]
    rows += [rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, key int, copies string")
    for window in (5, 7):
        assert rows_of(remove_repeats(docs, window, keep_text=True)) == sorted(brute.kept_words(rows, window), key=repr)
    assert remove_repeats(docs.limit(0)).count() == 0
