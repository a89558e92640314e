import math

from discursa.llm import language
from discursa.llm.tables import documents
from pyspark.sql import functions as F


def test_accuracy_and_plain_fusion(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = language.train(docs.where("doc_id % 2 = 0"))
    assert model[0] == ["de", "en", "es", "fr", "und"]
    blind = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.lit(None).cast("string"))
    got = language.identify_documents(blind, model, ["doc_id", "truth"]).collect()
    assert sum(r.language == r.truth for r in got) > 0.97 * len(got) and len(got) == 1000

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    ev = language.text_evidence(
        pages.select("page_id", "html", language.markup_language(F.col("html")).alias("declared"), language.host(F.col("url")).alias("host")),
        model, ["page_id", "declared", "host"], "html",
    )
    ev = ev.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    want = plain(ev.collect(), model[0])
    for r in language.fuse(ev, model[0], ["page_id"]).collect():
        k, p = want[r.page_id]
        assert model[0][k] == r.language and math.isclose(p, r.probability, rel_tol=1e-6)


def plain(rows, langs, weight=20.0):
    n = len(langs)

    def own(r):
        e = [math.exp(x - max(r.loglik)) for x in r.loglik]
        return [x / sum(e) * (r.n_grams > 0) for x in e]

    def sums(key):
        out = {}
        for r in rows:
            k = key(r)
            if None not in k:
                out[k] = [a + b for a, b in zip(out.get(k, [0] * n), own(r))]
        return out

    total = [x + 1 for x in sums(lambda r: ())[()]]
    base = [x / sum(total) for x in total]
    lean = lambda v, p: [(x + weight * q) / (sum(v) + weight) for x, q in zip(v, p)]
    s = {k[0]: lean(v, base) for k, v in sums(lambda r: (r.suffix,)).items()}
    d = {k[1]: lean(v, s[k[0]]) for k, v in sums(lambda r: (r.suffix, r.domain)).items()}
    h = {k[1]: lean(v, d[k[0]]) for k, v in sums(lambda r: (r.domain, r.host)).items()}
    agree = lambda d: [0.8 if x == d else 0.2 / n for x in langs]
    t = {k[0]: [math.log((x + 5 * g) / (a + 5)) for x, a, g in zip(v, total, agree(k[0]))] for k, v in sums(lambda r: (r.declared,)).items()}
    out = {}
    for r in rows:
        prior = h.get(r.host, s.get(r.suffix, base))
        z = [x + math.log(p) + y for x, p, y in zip(r.loglik, prior, t.get(r.declared, [0] * n))]
        k = z.index(max(z))
        out[r.page_id] = (k, 1 / sum(math.exp(x - z[k]) for x in z))
    return out


def test_edges(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    model = language.train(docs)
    rows = [(1, None, None), (2, "odd url", "12345"), (3, "http://a.de/x", "<html lang=de>"), (3, "http://a.de/x", "<html lang=de>"), (None, "http://user@h.fr:80/", "<p>le la des les que est</p>"), (5, "http://b/", "<b>" * 50_000)]
    pages = spark.createDataFrame([(*r, 1.0) for r in rows], "page_id long, url string, html string, language double")
    got = {r.page_id: r for r in language.identify_pages(pages, model).collect()}
    assert len(got) == 5 and got[1].language == "und" and got[1].probability == 0 and got[3].language == "de" and got[None].language == "fr"
    assert (got[None].host, got[None].suffix, got[3].declared) == ("h.fr", "fr", "de")
    assert language.identify_pages(pages.limit(0), model).count() == 0
    assert language.train(docs.limit(0))[0] == ["und"]


def test_copies_count_once(spark):
    docs = documents(spark, "/root/testdata/sf0.001").select("text", "lang")
    once = docs.distinct()
    for seed in range(4):  # some of these come early by hash
        hot = spark.range(3_000).select(F.lit(f"zzyq {seed} xqj wvk").alias("text"), F.lit("en").alias("lang"))
        want = language.train(once.union(hot.limit(1)), sample=20)
        got = language.train(docs.union(hot), sample=20)
        assert got[0] == want[0] and (got[1] == want[1]).all()


def test_every_language_has_a_model(spark):
    rows, codes = [], [f"q{chr(97 + k)}" for k in range(26)] + [f"x{chr(97 + k)}" for k in range(14)]
    for k, code in enumerate(codes):  # each has its own letters; the last has fewest rows
        letters = [chr(0x4E00 + 40 * k + x) for x in range(40)]
        rows += [(" ".join("".join(letters[(n * i + j) % 40] for j in range(3)) for i in range(1, 30)), code) for n in range(1, 45 - k)]
    rows += [("one tag written in three ways", x) for x in ("en", "en-US", "EN")] + [("no tag at all", "Klingonic"), ("not known", "und")]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumn("doc_id", F.monotonically_increasing_id()).withColumn("source", F.lit(None).cast("string"))
    model = language.train(docs)
    assert model[0] == sorted([*codes, "en", "klingonic"]) + ["und"]
    got = language.identify_documents(docs.where(F.col("lang").isin(codes)).withColumn("truth", F.col("lang")), model, ["doc_id", "truth"]).collect()
    assert len(got) == sum(44 - k for k in range(40)) and all(r.language == r.truth for r in got)
