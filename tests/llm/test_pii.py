import hashlib
import re

from discursa.llm import pii
from discursa.llm.tables import documents

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
            if (
                kind == "email" or kind == "ip" and all(int(p) < 256 for p in m[0].split("."))
                or kind == "card" and 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0
                or kind == "phone" and 8 <= len(digits) <= 15
            ):
                out.append((kind, *m.span()))
    return out


EDGES = [
    None, "", "a@b@c.de x@y z@w.com a.@b.c@d.e.f @@a@b.c", "1.2.3.4.5.6.7.8.9 256.1.1.1 001.02.3.4", "+1 (988) 555-2485 4111111111111111",
    "4111-1111 1111-1111, 4111 1111 1111 1112", "+12345678901234567890", "9" * 3000, "x" * 40000 + "@a.b", "é 4111111111111111 ÿ@é.com",
]


def test_patterns(spark):
    texts = [r.text for r in documents(spark, "/root/testdata/sf0.01").select("text").collect()]
    for t in [t or "" for t in EDGES if len(t or "") < 5000] + texts:
        assert pii.base_spans(t) == plain(t), t


def test_query_columns_and_added_spans(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    weights = pii.train(docs)
    got = {r.doc_id: r for r in pii.find(docs, weights).collect()}
    for r in docs.collect():
        base = plain(r.text)
        g = got[r.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(b[0] == k for b in base) for k in KINDS)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert g.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(g.spans.split(","))
    text = "call (415) 555-0199 now, card 4111.1111.1111.1111 then joe [at] mail [dot] example [dot] org"
    found = {(k, text[s:e]) for k, s, e in pii.spans(text, weights)[1]}
    assert {("phone", "(415) 555-0199"), ("card", "4111.1111.1111.1111")} <= found
    clean = "on 2024-01-31 at 10:15 it cost 12,500.00, order 123456789, look at this 3.14159265"
    assert pii.spans(clean, weights) == ([], [])


def test_mask_and_edges(spark):
    docs = spark.createDataFrame([(n, t, 5, "k") for n, t in enumerate(EDGES)], "doc_id long, text string, n_chars int, spans string")
    weights = pii.train(documents(spark, "/root/testdata/sf0.01"))
    out = pii.mask(docs, weights)
    assert out.schema == docs.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text is None and rows[1].text == "" and rows[4].text == "<phone> <card>" and rows[4].n_chars == 14
    assert pii.find(docs, weights).count() == len(EDGES) and pii.find(docs.limit(0)).count() == 0
