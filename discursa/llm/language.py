"""Language of pages and documents by fusing evidence.

The posterior of each language is the product of the text's likelihood under a character n-gram
model, the likelihoods of the declared markup language and of the address suffix, and the host's
prior. Declarations and suffixes are taken for what they are worth: their likelihoods come from how
often they agree with the text over the whole table. Host priors are smoothed hierarchically: a host's
counts lean on those of its domain, these on those of its suffix, these on the whole table, all found
by grouped aggregation. "und" stands for texts of no known language: its n-grams are uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discursa.llm.tables import staged
from discursa.llm.textbatch import text_slices, tidy

DIMS = 1 << 15
UND = "und"
#: Training texts a language, the first by hash; languages counted or scored at once.
SAMPLE, AT_ONCE = 2_000, 30
#: Natural log units the text evidence is worth at most for each n-gram of 1,000: neighbouring
#: n-grams repeat each other, so the whole text counts as if it had fewer.
EVIDENCE_GRAMS = 200
SMOOTH = 20.0
#: Prior belief in declarations, and the texts it is worth.
AGREE, DECLARED_WEIGHT = 0.8, 5.0


def _grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each byte 3-gram that holds a letter, offsets by text), ASCII lower-cased."""
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += 32
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    x = np.where(letter, low, 32).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ok = letter[1:-1] | (letter[:-2] & letter[2:])
    inner = np.zeros(len(x) + 1, bool)
    inner[off] = True
    ok &= ~(inner[1:-2] | inner[2:-1])
    g = (((x[:-2] * 257 + x[1:-1]) * 263 + x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)
    at = np.flatnonzero(ok)
    return g[at].astype(np.int64), np.searchsorted(at, off)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood table) from docs (text, lang): every language of a row or more, each
    from `sample` different texts at most, drawn by hash; copies of a text count once. Languages are
    the primary subtags of lang, or where it is no tag its value in lower case. The last row is "und".
    Rows without text or language are left out; no rows leave "und" alone."""
    label = F.coalesce(primary(F.col("lang")), F.trim(F.lower("lang")))
    known = docs.where("text is not null").select(F.xxhash64("text").alias("h"), label.alias("lang"), "text").where(F.col("lang").isNotNull() & ~F.col("lang").isin("", UND))
    hashes = staged(known.select("lang", "h").distinct(), "language-hashes").withColumn("p", F.shiftright("h", 54))
    # The prefix of the hash at which each language's sample is full, then the hash itself.
    sizes = hashes.groupBy("lang", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("sizes"))
    full = {}
    for r in sizes.toLocalIterator():
        seen = np.cumsum([x.n for x in r.sizes])
        full[r.lang] = r.sizes[min(int(np.searchsorted(seen, sample)), len(seen) - 1)].p
    langs = sorted(full)
    table = np.full((len(langs) + 1, DIMS), 0.5)
    if langs:
        cuts = docs.sparkSession.createDataFrame([(x, k, full[x]) for k, x in enumerate(langs)], "lang string, k int, full long")
        first = hashes.join(F.broadcast(cuts), "lang").where("p <= full").groupBy("lang", "k").agg(F.sort_array(F.collect_list("h")).alias("hs"))
        last = staged(first.select("lang", "k", F.element_at("hs", F.least(F.size("hs"), F.lit(sample))).alias("last")), "language-cuts")
        near = known.join(F.broadcast(last), "lang").where("h <= last").groupBy("k", "h").agg(F.first("text").alias("text")).select("k", "text")

        def flush(total):
            for k, v in total.items():
                at = np.flatnonzero(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], names=["k", "g", "n"]
                )

        def count(batches):
            total = {}
            for batch in batches:
                ks = batch.column(0).to_pylist()
                for a, b, raw, off in text_slices(batch.column(1), 1 << 20):
                    g, goff = _grams(raw, off)
                    for i, k in enumerate(ks[a:b]):
                        if k not in total and len(total) == AT_ONCE:
                            yield from flush(total)
                            total = {}
                        total[k] = total.get(k, 0) + np.bincount(g[goff[i] : goff[i + 1]], minlength=DIMS)
            yield from flush(total)

        for r in near.mapInArrow(tidy(count), "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toLocalIterator():
            table[r.k, r.g] += r.n
    table = np.log(table / table.sum(axis=1, keepdims=True))
    table[-1] = -np.log(DIMS)
    return [*langs, UND], table


def text_evidence(df: DataFrame, model, id_cols: list[str], text_col: str) -> DataFrame:
    """id columns, n_grams, and loglik: each language's log likelihood of the text, scaled to the
    evidence of at most EVIDENCE_GRAMS n-grams."""
    langs, table = model
    flat = [table[k : k + AT_ONCE].T.astype(np.float32).copy() for k in range(0, len(langs), AT_ONCE)]

    def run(batches):
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column(len(id_cols)), 1 << 20):
                g, goff = _grams(raw, off)
                out = np.zeros((b - a, len(langs)))
                for i in range(b - a):
                    n = goff[i + 1] - goff[i]
                    if n:
                        out[i] = np.concatenate([x[g[goff[i] : goff[i + 1]]].mean(axis=0, dtype=np.float64) for x in flat]) * min(n, EVIDENCE_GRAMS)
                cols = [batch.column(c).slice(a, b - a) for c in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(np.diff(goff)), pa.array(list(out), pa.list_(pa.float64()))], names=[*id_cols, "n_grams", "loglik"]
                )

    src = df.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(tidy(run), f"{kinds}, n_grams long, loglik array<double>")


def primary(code: Column) -> Column:
    """Primary subtag of a language tag, lower case, or null."""
    got = F.regexp_extract(F.lower(code), "^\\s*([a-z]{2,3})(?![a-z])", 1)
    return F.when(got != "", got)


def markup_language(html: Column) -> Column:
    return primary(F.regexp_extract(html, "(?is)<html\\b[^>]*?\\blang\\s*=\\s*[\"']?([a-zA-Z-]+)", 1))


def host(url: Column) -> Column:
    got = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(got != "", got)


def fuse(evidence: DataFrame, langs: list[str], key: list[str], weight: float = SMOOTH) -> DataFrame:
    """key, language, probability, declared, suffix from evidence (key, loglik, n_grams, declared,
    suffix, domain, host); null declared, suffix, domain or host give no evidence.

    Host, domain and suffix counts are sums of the texts' own posteriors, combined map-side, so a host
    with a third of all rows costs one row a task. They join back as tables of one row a host.
    """
    n = len(langs)
    at = F.array(*map(F.lit, range(n)))
    top = F.array_max("loglik")
    own = F.transform("loglik", lambda x: F.exp(x - top))
    norm = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    ev = staged(evidence.withColumn("own", own).withColumn("own", F.transform("own", lambda x: x / norm * (F.col("n_grams") > 0).cast("double"))), "language-evidence")

    def sums(by: list[str]) -> DataFrame:
        agg = [F.sum(F.element_at("own", k + 1)).alias(f"p{k}") for k in range(n)]
        grouped = ev.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by) if by else ev.groupBy()
        return grouped.agg(*agg).select(*by, F.array(*[F.coalesce(f"p{k}", F.lit(0.0)) for k in range(n)]).alias("v"))

    total = np.array(sums([]).first()["v"]) + 1.0
    base = F.array(*[F.lit(float(x)) for x in total / total.sum()])

    def lean(v: Column, prior: Column) -> Column:
        """(counts + weight * prior) / (total + weight)."""
        mass = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) + weight
        return F.zip_with(v, prior, lambda x, p: (x + weight * p) / mass)

    s = sums(["suffix"]).select("suffix", lean(F.col("v"), base).alias("ps"))
    d = sums(["suffix", "domain"]).join(s, "suffix").select("domain", lean(F.col("v"), F.col("ps")).alias("pd"))
    h = sums(["domain", "host"]).join(d, "domain", "left").select("host", lean(F.col("v"), F.coalesce("pd", base)).alias("ph"))
    h, s = staged(h, "host-priors"), staged(s, "suffix-priors")
    # A declaration's likelihood under each language: how often it goes with it, leaning on the belief
    # that it is right in AGREE of all cases.
    agree = F.array(*[F.when(F.col("declared") == x, AGREE).otherwise((1 - AGREE) / n) for x in langs])
    t = sums(["declared"]).withColumn("all", F.array(*[F.lit(float(x)) for x in total]))
    t = t.withColumn("x", F.zip_with("v", agree, lambda x, g: x + DECLARED_WEIGHT * g))
    t = staged(t.select("declared", F.zip_with("x", "all", lambda x, a: F.log(x / (a + DECLARED_WEIGHT))).alias("ld")), "declared")
    flat = F.array(*[F.lit(0.0)] * n)
    scored = (
        ev.join(h, "host", "left").join(s, "suffix", "left").join(t, "declared", "left")
        .withColumn("prior", F.coalesce("ph", "ps", base))
        .withColumn("score", F.transform(at, lambda k: F.get("loglik", k) + F.log(F.get("prior", k)) + F.get(F.coalesce("ld", flat), k)))
    )
    best = F.array_max("score")
    z = F.aggregate(F.transform("score", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    names = F.array(*map(F.lit, langs))
    known = (F.col("n_grams") > 0) | F.col("ld").isNotNull() | F.col("ph").isNotNull()
    return scored.select(
        *key, F.when(known, F.get(names, (F.array_position("score", best) - 1).cast("int"))).otherwise(UND).alias("language"),
        F.when(known, 1 / z).otherwise(0.0).alias("probability"), "declared", "suffix", "host",
    )


def identify_pages(pages: DataFrame, model) -> DataFrame:
    """page_id, url, language, probability, declared, suffix, host of every row of pages.

    The text is the html without tags, scripts, styles and comments. Null html is an empty text; null or
    odd urls have no host; with no evidence at all the language is "und" at probability 0. Ties go to
    the first language in alphabetical order. Repeated rows each come back, an empty table gives no
    rows, other columns are not looked at.
    """
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_replace(html, "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1\\s*>|<[^>]*>", " ")
    src = pages.select("page_id", "url", plain.alias("_plain"), markup_language(html).alias("declared"), host(F.col("url")).alias("host"))
    ev = text_evidence(src, model, ["page_id", "url", "declared", "host"], "_plain")
    ev = ev.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    return fuse(ev, model[0], ["page_id", "url"])


def identify_documents(docs: DataFrame, model, key: list[str]) -> DataFrame:
    """As identify_pages for documents (text, lang, source): the declared language is lang, the host is
    the source; a source without a dot has the suffix "-". A text without letters is "und", whatever
    is declared."""
    src = docs.select(*key, "text", primary(F.col("lang")).alias("declared"), F.col("source").alias("host"))
    ev = text_evidence(src, model, [*key, "declared", "host"], "text")
    ev = ev.withColumns({c: F.when(F.col("n_grams") > 0, F.col(c)) for c in ("declared", "host")})
    ev = ev.withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise("-"))
    ev = ev.withColumn("domain", F.when(F.col("host").contains("."), F.substring_index("host", ".", -2)).otherwise(F.col("host")))
    return fuse(ev, model[0], key)
