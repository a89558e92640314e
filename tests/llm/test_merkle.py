import hashlib

from discursa.llm import merkle
from discursa.llm.tables import documents


def check(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    want = []
    for n, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(n + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        fps = [merkle.fingerprint(x) for x in (t, edited, nxt)]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fps[0], fps[1], merkle.likeness(fps[0], fps[1]), merkle.likeness(fps[0], fps[2])))
    got = [tuple(r)[:7] for r in merkle.compare_with_edits(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_documents(spark):
    got = check(spark, documents(spark, "/root/testdata/sf0.01"))
    assert sum(r[5] > r[6] for r in got) > 0.97 * len(got)


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, "x" * 5000), (3, "a b"), (3, "a b"), (None, "q"), (None, None), (-7, "word " * 9000), (9, "\n\n a\n")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    check(spark, docs)
    check(spark, docs.where("doc_id = 9"))
    assert merkle.compare_with_edits(docs.limit(0)).count() == 0


def test_tree():
    text = "\n".join(f"paragraph {i} has a few words and ends here" for i in range(60))
    a, b = merkle.fingerprint(text), merkle.fingerprint(text.replace("paragraph 30 has", "paragraph 30 had"))
    assert a == merkle.fingerprint(text) and a.split("|")[0] != b.split("|")[0]
    assert len(merkle.differing(a, b)) == 1 and merkle.likeness(a, b) > 0.98 and merkle.likeness(a, merkle.fingerprint("z")) == 0
    assert merkle.differing(a, a) == [] and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1
    assert merkle.fingerprint("a b") != merkle.fingerprint("a  b")


def test_nodes_hold_whole_digests(monkeypatch):
    """Texts whose leaves agree in all printed digits still differ in sections and root."""
    plain = merkle._digest
    same_front = lambda data: b"\0" * (merkle.LEAF // 2) + plain(data)[merkle.LEAF // 2 :]
    monkeypatch.setattr(merkle, "_digest", same_front)
    a, b = merkle.fingerprint("one line"), merkle.fingerprint("another line")
    assert merkle.branches(a)[0][1] == merkle.branches(b)[0][1]
    assert a.split("|")[0] != b.split("|")[0] and merkle.branches(a)[0][0] != merkle.branches(b)[0][0]
    assert len(a.split("|")[0]) == len(merkle.branches(a)[0][0]) == 32
