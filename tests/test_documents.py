import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from discursa.operators import documents, findings, split


def written(entries, path):
    documents.write_document(entries, str(path))
    files = [p for p in Path(path).glob("part-*") if p.stat().st_size]
    assert len(files) <= 1
    return json.loads(files[0].read_text()) if files else None


def test_document_is_json_in_order(spark, tmp_path):
    rows = [('quo"te', 1), ("a,b", 2), ("line\nbreak", 3), (None, 4), ("z", None)]
    df = spark.createDataFrame(rows, "k string, n int").repartition(3)
    parts = [
        documents.section(df, "second", F.col("k"), F.struct("n", F.array(F.lit("x")).alias("l"))),
        documents.section(df.where("n = 1"), "first", F.lit("only"), F.col("k")),
    ]
    got = written(documents.document(parts), tmp_path / "d")
    assert list(got) == ["second", "first"]
    assert list(got["second"]) == sorted(["null" if k is None else k for k, _ in rows])
    assert got["second"]['quo"te'] == {"n": 1, "l": ["x"]} and got["second"]["z"] == {"l": ["x"]}
    assert got["first"] == {"only": 'quo"te'}
    assert written(documents.document([parts[0].where("false")]), tmp_path / "e") is None


def test_manifest_names_every_raw_file(spark, tmp_path):
    raw = spark.createDataFrame([("a.csv",), ("a.csv",), ("b.csv",)], "file string")
    doc = documents.manifest_document({"licence": "open"}, {"clean": raw.limit(1)}, raw)
    assert written(doc, tmp_path / "m") == {
        "about": {"licence": "open"}, "layers": {"clean": {"rows": 1}}, "raw": {"a.csv": {"rows": 2}, "b.csv": {"rows": 1}},
    }


ROWS = [("p#1", "c1", 1, "x", True), ("p#2", "c1", 2, "y", True), ("p#3", "c2", 3, "x", False), ("p#4", "c3", 4, "x", True)]
SCHEMA = "id string, cluster string, row_no int, stance string, gold boolean"


def test_one_frame_of_gold_and_silver(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = {r.id: (r.source, r.split, r.post) for r in split.assemble(df, F.col("gold")).collect()}
    assert {k: v[0] for k, v in out.items()} == {"p#1": "gold", "p#2": "gold", "p#3": "silver", "p#4": "gold"}
    assert out["p#1"][1] == out["p#2"][1] and out["p#3"] == ("silver", "train", "p")
    both = df.union(spark.createDataFrame([("p#9", "c1", 9, "x", False)], SCHEMA))
    assert [r.cluster for r in split.clusters_on_both_sides(both, F.col("gold")).collect()] == ["c1"]
    with pytest.raises(split.LeakError, match="c1"):
        split.assemble(both, F.col("gold"))
    null = both.withColumn("gold", F.when(F.col("id") != "p#9", F.col("gold")))
    assert split.clusters_on_both_sides(null, F.col("gold")).count() == 0


def test_clusters_of_flagged_rows_go(spark):
    df = spark.createDataFrame([*ROWS, ("p#5", None, 5, "x", True), ("p#6", None, 6, "x", False)], SCHEMA)
    got = split.without_clusters_of(df, F.col("stance") == "y")
    assert got.columns == df.columns and {r.id for r in got.collect()} == {"p#3", "p#4", "p#5", "p#6"}


def test_profile_reads_texts_once(spark):
    texts = spark.createDataFrame([("u", "A ﬁne day", 1), ("v", "a ﬁne day!", 2), (None, "😀", 3), ("u", "", 4)], "username string, text string, row_no int")
    rows = texts.select(
        F.lit("p#").alias("id"), F.lit("p").alias("post"), "row_no", "username", F.lit(0).alias("likes"), F.lit(False).alias("is_reply"),
        "text", F.lit("2026-01-01").cast("timestamp_ntz").alias("ts"),
    )
    enriched = findings.enrich(rows)
    row = findings.profile(enriched).first()
    assert tuple(row) == (4, 1, 1, 2, 3, 2)
    plan = findings.profile(enriched)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "nfkc" not in plan.lower()
