"""JSON documents of any length, written row by row.

A document is a frame of entries: section, ordinal (the place of the section), key, value (JSON). An
entry is one row, such as a post or a file, so no map over all posts is ever built. write_document
puts the entries in order and streams them into one file; its one task sorts with spilling and holds a
row at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discursa import config
from discursa.operators import findings, metrics


def section(df: DataFrame, name: str, key: Column, value: Column, ordinal: int = 0) -> DataFrame:
    """Entries of one section; value is a struct, an array or a number and is turned into JSON. A null key
    is written as the word null."""
    return df.select(
        F.lit(name).alias("section"), F.lit(ordinal).alias("ordinal"), F.coalesce(key.cast("string"), F.lit("null")).alias("key"),
        F.to_json(F.struct(value.alias("v"))).alias("value"),
    ).withColumn("value", F.expr("substr(value, 6, length(value) - 6)"))  # what stands after {"v": and before }


def document(sections: list[DataFrame]) -> DataFrame:
    """Sections in the order given."""
    placed = [df.withColumn("ordinal", F.lit(i)) for i, df in enumerate(sections)]
    return reduce(DataFrame.unionByName, placed)


def _quoted(text: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def lines(entries: DataFrame) -> DataFrame:
    """(ordinal, part, key, line): the text of the document, a line an entry, with its braces and commas."""
    heads = entries.groupBy("ordinal", "section").agg(F.min("key").alias("first"))
    numbered = entries.join(heads.select("ordinal", "first"), "ordinal")
    comma = F.when(F.col("key") == F.col("first"), "").otherwise(",")
    body = numbered.select("ordinal", F.lit(1).alias("part"), "key", F.concat(comma, _quoted(F.col("key")), F.lit(":"), "value").alias("line"))
    lead = F.when(F.col("ordinal") == F.min("ordinal").over(W.partitionBy(F.lit(1))), "{").otherwise(",")
    tail = F.when(F.col("ordinal") == F.max("ordinal").over(W.partitionBy(F.lit(1))), "}}").otherwise("}")
    edges = heads.select("ordinal", lead.alias("lead"), tail.alias("tail"), "section")
    opening = edges.select("ordinal", F.lit(0).alias("part"), F.lit("").alias("key"), F.concat("lead", _quoted(F.col("section")), F.lit(":{")).alias("line"))
    closing = edges.select("ordinal", F.lit(2).alias("part"), F.lit("").alias("key"), F.col("tail").alias("line"))
    return opening.unionByName(body).unionByName(closing)


def write_document(entries: DataFrame, path: str) -> None:
    """One JSON object of sections, each an object of its entries in key order, as a single text file in
    the folder `path`. Keys must be unique within a section; no entries make an empty file."""
    ordered = lines(entries).repartition(1).sortWithinPartitions("ordinal", "part", "key")
    ordered.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def profile_document(enriched: DataFrame, checksums: DataFrame | None = None) -> DataFrame:
    """Totals, and rows per post, per phase and, with checksums (file, sha256), per file."""
    narrow = findings.profile_columns(enriched)
    totals = findings.profile_of(narrow)
    each = totals.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in totals.columns]), F.array(*totals.columns))).alias("k", "n"))
    counts = findings.value_counts(narrow, ["post", "phase"])
    out = [section(each, "totals", F.col("k"), F.col("n"))]
    out += [section(counts.where(F.col("dimension") == d), f"per_{d}", F.col("value"), F.col("n")) for d in ("post", "phase")]
    if checksums is not None:
        out.append(section(checksums, "sha256", F.col("file"), F.col("sha256")))
    return document(out)


def findings_document(scored: DataFrame, targets: list[str], examples: list[str], stances: list[str] | None = None) -> DataFrame:
    """What a scored corpus shows: spam, composition by stance and emotion, stances by phase, targets, the
    stances of the most liked, topics with their dominant stance, and examples."""
    non = findings.non_spam(scored)
    stances = stances or config.STANCES
    share = F.struct("n", "pct")
    spam = findings.spam_share(scored).select(F.col("n_spam").alias("n"), F.col("pct_spam").alias("pct"), "total")
    by_phase = findings.crosstab(non, "phase", "stance", stances)
    counted = findings.target_counts(non, targets)
    each = counted.select(F.explode(F.array(*[F.struct(F.lit(t).alias("k"), F.col(t).alias("n")) for t in targets])).alias("x")).select("x.*")
    shown = findings.examples_per_class(non, examples).groupBy("stance").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return document([
        section(spam, "spam", F.lit("all"), F.struct("total", "n", "pct")),
        section(findings.composition(non, "stance"), "stance", F.col("stance"), share),
        section(findings.composition(non, "emotion"), "emotion", F.col("emotion"), share),
        section(by_phase, "phase", F.col("phase"), F.struct("n", *stances)),
        section(each, "targets", F.col("k"), F.struct("n")),
        section(findings.engagement_bias(non), "most_liked", F.col("stance"), share),
        section(findings.topic_summary(non), "topics", F.col("topic"), F.struct("n", "label", "dominant")),
        section(shown, "examples", F.col("stance"), F.transform("x", lambda e: e["text"])),
    ])


def evaluation_document(preds: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """Per model and task: scores with a bootstrap interval, F1 and support by class, confusions."""
    counts = metrics.confusion_counts(preds)
    out = []
    per = lambda *c: F.concat_ws("/", "model", "task", *c)
    for task, names in classes.items():
        own = counts.where(F.col("task") == task)
        ci = metrics.bootstrap_ci(own, names)
        scores = metrics.summary(own, names).join(ci, ["model", "task"])
        cells = metrics.confusion_matrix(own, names).groupBy("model", "task", "y_true").agg(F.array_sort(F.collect_list(F.struct("j", "n"))).alias("x"))
        out.append((
            section(scores, "scores", per(), F.struct("macro_f1", "accuracy", "n", F.array("ci_low", "ci_high").alias("ci95"))),
            section(metrics.class_scores(own, names), "classes", per("class"), F.struct("f1", "support")),
            section(cells, "confusion", per("y_true"), F.transform("x", lambda e: e["n"])),
        ))
    return document([reduce(DataFrame.unionByName, s) for s in zip(*out)])


def manifest_document(about: dict[str, str], layers: dict[str, DataFrame], raw: DataFrame) -> DataFrame:
    """What a release is, rows per layer, and rows per raw file: raw has a row (file) for every record."""
    spark = raw.sparkSession
    told = spark.createDataFrame(sorted(about.items()), "k string, v string")
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("k"), "rows") for n, df in layers.items()]
    files = raw.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    out = [section(told, "about", F.col("k"), F.col("v"))] if about else []
    if counts:
        out.append(section(reduce(DataFrame.unionByName, counts), "layers", F.col("k"), F.struct("rows")))
    return document([*out, section(files, "raw", F.col("file"), F.struct("rows"))])
