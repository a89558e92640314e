import hashlib

from discursa.llm import warc
from discursa.llm.tables import scratch


def test_round_trip_and_edges(spark):
    big = "é" * 700
    rows = [(1, "http://a/", None), (2, None, ""), (3, "u\r\nv", "x\r\n\r\nWARC/1.0\r\n"), (4, "a", big), (5, "b", big), (9, "c", big), (6, "d", "s"), (7, "e", "s"), (None, "f", big), (8, "g", "q" * 3_000_000), (8, "g", "q" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, digest int, uid string")
    path = scratch(spark, "warc")
    index = warc.write(pages, path, archive_bytes=1500)
    got = sorted(((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.payload) for r in warc.read(spark, path, index).collect()), key=repr)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 9
        want.append((page, "revisit" if revisit else "response", len(data), hashlib.sha1(data).hexdigest(), 9 if revisit else None, None if revisit else data))
    assert [(*g[:5], bytes(g[5]) if g[5] is not None else None) for g in got] == sorted(want, key=repr)
    some = warc.read(spark, path, index.where("page_id = 3")).collect()
    assert [r.page_id for r in some] == [3] and index.count() == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0
