import sys

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, __file__.rpartition("/")[0])
import brute  # noqa: E402
from discursa.llm.tables import documents  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = documents(spark, SF)
    rows = {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "near_dedup", "decontamination", "pii", "packing"]

    extra = spark.createDataFrame([(9001, "12345 67890 !!!", "en", "src0", 15), (9002, None, None, None, None), (9003, "", "en", "src1", 0)], docs.schema)
    kept = stage["language"](spark, docs.union(extra), SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(rows)

    kept = stage["near_dedup"](spark, docs.union(docs.limit(3)), SF)
    want = {i for i, (_, _, keep) in brute.near_duplicates([(i, r.text) for i, r in rows.items()], k=5).items() if keep}
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(ids) == sorted(want)

    kept = stage["decontamination"](spark, docs, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute.leaks([(i, r.text) for i, r in rows.items()], items)}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(rows) - bad

    masked = stage["pii"](spark, docs, SF)
    assert masked.schema == docs.schema
    for r in masked.collect():
        old = rows[r.doc_id]
        assert r.n_chars == len(r.text) and ("@" not in r.text) and (r.lang, r.source) == (old.lang, old.source)
        if "@" not in old.text and not any(c.isdigit() for c in old.text) and " dot " not in old.text.lower():
            assert r.text == old.text


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    full = got.groupBy("doc_id").sum("length").collect()
    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    for r in full:
        if "@" not in texts[r.doc_id] and not any(c.isdigit() for c in texts[r.doc_id]):
            assert r["sum(length)"] == len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids) + 1
    assert 100 < len(full) < 200
