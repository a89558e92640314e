import random
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
import brute  # noqa: E402
from discursa.llm import decontaminate  # noqa: E402
from discursa.llm.tables import documents  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def test_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng = random.Random(1)
    extra = []
    for i, t in items:  # leaks with edits, other case and punctuation
        w = t.split()
        w[rng.randrange(len(w))] = "edited"
        extra.append((10_000 + i, "before this " + " -- ".join(w).upper() + " and after"))
        extra.append((20_000 + i, " ".join(t.split()[: len(t.split()) - 2])))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(both, bench).collect()}
    want = brute.leaks([(r.doc_id, r.text) for r in both.collect()], items)
    assert got == pytest.approx(want) and len(want) >= 20


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "one two"), (4, "zero ONE, two three"), (5, "Été à l'École 東京 Ж о"), (None, "one two"), (3, "one two")]
    items = [(7, None), (8, ""), (9, "one two"), (9, "one two"), (10, "été à l école"), (11, "..."), (12, "ж О")]
    docs = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start_word) for r in decontaminate.find_leaks(docs, bench).collect()), key=repr)
    assert sorted(set(got), key=repr) == sorted([(3, 9, 0), (4, 9, 1), (5, 10, 0), (5, 12, 5), (None, 9, 0)], key=repr)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0 == decontaminate.find_leaks(docs, bench.limit(0)).count()
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2, None}


def short_leaks(docs, items, k=5, least=0.8):
    """{(doc, item): similarity} of documents of fewer words than the item, each one window."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for i, t in docs:
        w = words(t)
        for j, u in items:
            v = words(u)
            size = min(k, len(v))
            if size <= len(w) < len(v):
                have, want = (Counter(tuple(x[a : a + size]) for a in range(len(x) - size + 1)) for x in (w, v))
                both = (have & want).total()
                if both / (have.total() + want.total() - both) >= least:
                    out[i, j] = both / (have.total() + want.total() - both)
    return out


def test_documents_shorter_than_an_item(spark):
    docs = documents(spark, "/root/testdata/sf0.001").where("doc_id < 60 and length(text) < 3000").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    cut = [(20_000 + i, " ".join(t.split()[:-2])) for i, t in items] + [(30_000, "one two"), (30_001, items[0][1].split()[0])]
    both = docs.union(spark.createDataFrame(cut, docs.schema))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    want = brute.leaks(rows, items) | short_leaks(rows, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(both, bench, short=True).collect()}
    assert got == pytest.approx(want) and all((20_000 + i, i) in got for i, t in items)
    # The registered stage drops them, rows without id included, but no other text under the same id.
    name, text = items[0]
    more = spark.createDataFrame([(None, text), (None, "a clean text"), (None, None), (40_000, text), (40_000, "another clean text")], docs.schema)
    left = decontaminate.without_leaking_rows(both.union(more).withColumn("lang", F.lit("en")), bench)
    kept = {(r.doc_id, r.text) for r in left.collect()}
    leaky = {i for i, _ in want}
    clean = [(None, "a clean text"), (None, None), (40_000, "another clean text")]
    assert left.columns == ["doc_id", "text", "lang"] and kept == {*[r for r in rows if r[0] not in leaky], *clean}
