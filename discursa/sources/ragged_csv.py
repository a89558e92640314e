"""Scan of comment exports whose timestamp holds an unquoted comma.

A quoted comment may span lines, so a split of a file cannot tell on its own whether
its first line starts a record. Each line is therefore summarised by what it does to
the quote state (two states: outside or inside a quoted field). Such summaries compose,
so the state at every line follows from a running composition within each file split
and one over the splits of a file. Files of any size are read by many tasks and no task
sees more than one split; records keep exact numbers, blank ones included.

A record that is still open at the end of its file (a stray quote) is not a record: each of its
lines is read on its own, so that rows behind the quote are kept and the rest is quarantined.

A stray quote that a later quote happens to close swallows the rows between. Such a stretch can be one record
or rows of their own; `swallowed` weighs both by what lines tell, without putting the stretch together.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discursa.functions import fields as fx
from discursa.functions.binding import let
from discursa.functions.text import strip

_QUOTED_TAIL = r'"[^"]*+(?:""[^"]*+)*+'
_CLOSED = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),'
# Lines that leave a quoted field open, when entered outside / inside one.
_OPENS = rf"^(?:{_CLOSED})*+{_QUOTED_TAIL}$"
_STAYS = r'^[^"]*+(?:""[^"]*+)*+$'
_REOPENS = rf'^[^"]*+(?:""[^"]*+)*+"[^",][^,]*+,(?:{_CLOSED})*+{_QUOTED_TAIL}$'
_REOPENS_AT_COMMA = rf'^[^"]*+(?:""[^"]*+)*+",(?:{_CLOSED})*+{_QUOTED_TAIL}$'

# A line entered inside a quoted field that closes it by a quote no writer puts there: text goes on behind it.
_BAD_CLOSE = r'^[^"]*+(?:""[^"]*+)*+"[^",\r]'

POST_FROM_STEM = r"([^/]+?)(?:\.csv)?$"
SLICE = r"/post=([^/]*)/first_record=(\d+)/[^/]*$"
HEADER_FACTS = ["n_header", "threaded"]


def _lines(spark: SparkSession, path) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("lineSep", "\n").text(paths)
    line = F.col("value")
    from_out = line.rlike(_OPENS)
    from_in = line.rlike(_STAYS) | line.rlike(_REOPENS) | line.rlike(_REOPENS_AT_COMMA)
    return df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        line.alias("line"),
        # const: the state after the line is the same however it was entered
        F.when(from_out == from_in, from_out).alias("const"),
        (from_out & ~from_in).cast("int").alias("swap"),
    )


def _state_before(const: Column, swaps: Column, entry: Column) -> Column:
    """Quote state from the last fixed state (value, swaps seen then) and the swaps since."""
    flips = F.when(const.isNull(), swaps).otherwise(swaps - const["swaps"])
    return F.coalesce(const["value"], entry) != (flips % 2 == 1)


def _with_state(lines: DataFrame) -> DataFrame:
    """Add rec_no (1-based record number in the file) and header facts to every line."""
    within = W.partitionBy("file", "block").orderBy("pos")
    before = within.rowsBetween(W.unboundedPreceding, -1)
    local = (
        lines.withColumn("n_swaps", F.coalesce(F.sum("swap").over(before), F.lit(0)))
        .withColumn(
            "fixed",
            F.when(
                F.col("const").isNotNull(),
                F.struct(F.col("const").alias("value"), F.col("n_swaps").alias("swaps")),
            ),
        )
        .withColumn("last_fixed", F.last("fixed", ignorenulls=True).over(before))
        .withColumn("row", F.row_number().over(within))
    )
    outside_if = {
        e: ~_state_before(F.col("last_fixed"), F.col("n_swaps"), F.lit(e)) for e in (False, True)
    }
    starts_if = {e: F.sum(o.cast("bigint")) for e, o in outside_if.items()}
    last_if = {e: F.max(F.when(o, F.col("row"))) for e, o in outside_if.items()}
    blocks = local.groupBy("file", "block").agg(
        F.sum("swap").alias("swaps"),
        F.max_by("fixed", F.when(F.col("fixed").isNotNull(), F.col("pos"))).alias("fixed"),
        starts_if[False].alias("starts_out"),
        starts_if[True].alias("starts_in"),
        last_if[False].alias("last_out"),
        last_if[True].alias("last_in"),
        F.count(F.lit(1)).alias("n_lines"),
        F.min_by("line", "pos").alias("first_line"),
    )
    order = W.partitionBy("file").orderBy("block")
    prior = order.rowsBetween(W.unboundedPreceding, -1)
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = (
        blocks.withColumn("seen", F.coalesce(F.sum("swaps").over(prior), F.lit(0)))
        .withColumn(
            "mark",
            F.when(
                F.col("fixed").isNotNull(),
                F.struct(
                    F.col("fixed.value").alias("value"),
                    (F.col("seen") + F.col("fixed.swaps")).alias("swaps"),
                ),
            ),
        )
        .withColumn("last_mark", F.last("mark", ignorenulls=True).over(prior))
        .withColumn("entry", _state_before(F.col("last_mark"), F.col("seen"), F.lit(False)))
        .withColumn("starts", F.when(F.col("entry"), F.col("starts_in")).otherwise(F.col("starts_out")))
        .withColumn("line_offset", F.coalesce(F.sum("n_lines").over(prior), F.lit(0)))
        .withColumn(
            "last_start",
            F.col("line_offset") + F.when(F.col("entry"), F.col("last_in")).otherwise(F.col("last_out")),
        )
        .withColumn(
            "left_open",
            _state_before(
                F.last("mark", ignorenulls=True).over(so_far), F.col("seen") + F.col("swaps"), F.lit(False)
            ),
        )
        .select(
            "file",
            "block",
            "entry",
            F.coalesce(F.sum("starts").over(prior), F.lit(0)).alias("rec_offset"),
            "line_offset",
            # first line and number of a record that never ends
            F.when(F.last("left_open").over(whole), F.max("last_start").over(whole)).alias("tail_from"),
            F.sum("starts").over(whole).alias("tail_rec"),
            F.rtrim(F.first("first_line").over(order), F.lit("\r")).alias("header"),
        )
    )
    blocks = with_header(blocks)
    joined = local.join(blocks, ["file", "block"])
    outside = ~_state_before(F.col("last_fixed"), F.col("n_swaps"), F.col("entry"))
    return (
        joined.withColumn("outside", outside)
        .withColumn(
            "open_after",
            F.coalesce(F.col("const"), (F.col("swap") == 1) != ~F.col("outside")),
        )
        .withColumn(
            "rec_no",
            F.col("rec_offset")
            + F.sum(F.col("outside").cast("bigint")).over(
                within.rowsBetween(W.unboundedPreceding, 0)
            ),
        )
        .withColumn("past", F.col("line_offset") + F.col("row") - F.col("tail_from"))
        .withColumn("in_tail", F.coalesce(F.col("past") >= 0, F.lit(False)))
        .select(
            "file", "block", "pos", "line", (F.col("line_offset") + F.col("row")).alias("line_no"),
            (F.col("outside") | F.col("in_tail")).alias("outside"),
            (F.col("open_after") & ~F.col("in_tail")).alias("open_after"),
            F.when(F.col("in_tail"), F.col("tail_rec") + F.col("past")).otherwise(F.col("rec_no")).alias("rec_no"),
            *HEADER_FACTS,
        )
    )


def _plain_path(path: Column) -> Column:
    """File path without the percent escapes of file metadata."""
    kept_plus = F.replace(path, F.lit("+"), F.lit("%2B"))
    return F.when(path.contains("%"), F.url_decode(kept_plus)).otherwise(path)


def _post(path: Column, pattern: str) -> Column:
    named = _plain_path(F.regexp_extract(path, SLICE, 1))  # partition values are escaped once more
    return F.when(path.rlike(SLICE), named).otherwise(F.regexp_extract(path, pattern, 1))


def record_shape(f: Column) -> Column:
    """1: the time stamp is split in two fields; 2: it is one field with a comma; NULL: neither.

    Reads the header facts of the row."""
    off = F.when(F.col("threaded"), 2).otherwise(0)

    def at(i: int) -> Column:
        return F.try_element_at(f, (off + F.lit(i + 1)).cast("int"))

    split_ts = (F.size(f) == F.col("n_header") + 1) & strip(at(1)).rlike(fx.DATE_SHAPE) & at(2).rlike(fx.CLOCK_SHAPE)
    quoted_ts = (F.size(f) == F.col("n_header")) & at(1).contains(",")
    return F.when(split_ts, 1).when(quoted_ts, 2)


def swallowed(multi: DataFrame) -> DataFrame:
    """(file, rec_no, first_line) of records of several lines that are rows of their own behind a stray quote.

    Two signs must agree: a field is closed by a quote with text behind it, and a line after the first is
    by itself a record with a split time stamp. A comment that quotes such a row but is closed as it should be stays
    one comment. Both are combined before the shuffle, so a stretch may be as long as its file.
    """
    alone = record_shape(fx.split_record(F.rtrim("line", F.lit("\r")))) == 1
    signs = multi.groupBy("file", "rec_no").agg(
        F.bool_or(~F.col("outside") & F.col("line").rlike(_BAD_CLOSE)).alias("bad_close"),
        F.bool_or(~F.col("outside") & alone).alias("rows"),
        F.min("line_no").alias("first_line"),
    )
    return signs.where(F.col("bad_close") & F.col("rows")).select("file", "rec_no", "first_line")


def read_records(spark: SparkSession, path, post_pattern: str = POST_FROM_STEM, resync: bool = False) -> DataFrame:
    """Records of a file, folder or glob: file, post, record_no, part, fields, n_header, threaded.

    Files under post=.../first_record=N/ (see operators.release.write_lines) belong to that post, and
    their first record has number N.

    With resync the lines of a swallowed stretch are records, numbered by part within the number of the stretch;
    part is 0 for its first line and for all other records, whose numbers stay as they are. A comment that begins
    in the last line of a stretch and spans lines keeps its first one.
    """
    lines = _with_state(_lines(spark, path))
    whole = F.col("outside") & ~F.col("open_after")
    no_part = F.lit(0).cast("bigint").alias("part")
    record = F.rtrim("line", F.lit("\r")).alias("record")
    records = lines.where(whole).select("file", "rec_no", no_part, *HEADER_FACTS, record)
    multi = lines.where(~whole)
    if resync:
        marked = multi.join(swallowed(multi), ["file", "rec_no"], "left")
        part = (F.col("line_no") - F.col("first_line")).alias("part")
        records = records.unionByName(
            marked.where(F.col("first_line").isNotNull()).select("file", "rec_no", part, *HEADER_FACTS, record)
        )
        multi = marked.where(F.col("first_line").isNull())
    joined = (
        multi.groupBy("file", "rec_no")
        .agg(
            *[F.first(c).alias(c) for c in HEADER_FACTS],
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("block", "pos", "line"))),
                    lambda x: x["line"],
                ),
                "\n",
            ).alias("record"),
        )
        .select("file", "rec_no", no_part, *HEADER_FACTS, F.rtrim("record", F.lit("\r")).alias("record"))
    )
    records = records.unionByName(joined).where((F.col("rec_no") > 1) | (F.col("part") > 0))
    path = _plain_path(F.col("file"))
    first = F.regexp_extract(path, SLICE, 2).try_cast("bigint")
    return records.select(
        F.element_at(F.split(path, "/"), -1).alias("file"),
        _post(path, post_pattern).alias("post"),
        (F.col("rec_no") + F.coalesce(first - 2, F.lit(0))).alias("record_no"),
        "part",
        fx.split_record(F.col("record")).alias("fields"),
        *HEADER_FACTS,
    )


def read_headers(spark: SparkSession, path, post_pattern: str = POST_FROM_STEM) -> DataFrame:
    """(post, header): the first line of every post's file."""
    first = (
        _lines(spark, path)
        .where(F.col("block") == 0)
        .groupBy("file")
        .agg(F.rtrim(F.min_by("line", "pos"), F.lit("\r")).alias("header"))
    )
    post = _post(_plain_path(F.col("file")), post_pattern)
    return first.groupBy(post.alias("post")).agg(F.min("header").alias("header"))


def with_header(records: DataFrame) -> DataFrame:
    """Replace the header line of a record by what parsing needs of it."""
    head = fx.split_record(F.col("header"))
    return records.select(
        *[c for c in records.columns if c != "header"],
        F.size(head).alias("n_header"),
        (F.lower(strip(F.element_at(head, 1))) == "type").alias("threaded"),
    )


def parse_records(records: DataFrame) -> DataFrame:
    """Typed columns plus ok; rows that fit neither shape, or hold bad values, are not ok.

    Blank records are dropped (they keep their number, so ids stay stable). A record with a part (see
    read_records) has the id post#number.part.
    """
    off = F.when(F.col("threaded"), 2).otherwise(0)

    def typed(f: Column) -> Column:
        def at(i: int) -> Column:
            return F.try_element_at(f, (off + F.lit(i + 1)).cast("int"))

        comma = F.instr(at(1), ",")
        return let(
            record_shape(f),
            lambda s: F.struct(
                F.exists(f, lambda x: strip(x) != "").alias("filled"),
                strip(at(0)).alias("username"),
                F.when(s == 1, fx.comment_time(at(1), at(2)))
                .when(
                    s == 2,
                    fx.comment_time(
                        F.substr(at(1), F.lit(1), comma - 1), F.substr(at(1), comma + 1)
                    ),
                )
                .alias("ts"),
                fx.whole_number(F.when(s == 1, at(3)).when(s == 2, at(2))).alias("likes"),
                fx.is_reply(F.col("threaded"), F.try_element_at(f, F.lit(1))).alias("is_reply"),
                F.when(s == 1, at(4)).when(s == 2, at(3)).alias("text"),
            ),
        )

    # a generator is a barrier for filters: every record is parsed once
    rows = records.select(*records.columns, F.inline(F.transform(F.array("fields"), typed)))
    whole = F.col("ts").isNotNull() & F.col("likes").isNotNull() & F.col("text").isNotNull()
    number = F.col("record_no").cast("string")
    if "part" in records.columns:
        number = F.when(F.col("part") > 0, F.concat_ws(".", "record_no", "part")).otherwise(number)
    return (
        rows.where("filled")
        .drop("filled")
        .withColumn("id", F.concat_ws("#", F.col("post"), number))
        .withColumn("ok", whole)
    )


COMMENT_COLUMNS = ["id", "post", "username", "ts", "likes", "is_reply", "text"]


def comments(parsed: DataFrame) -> DataFrame:
    return parsed.where("ok").select(*COMMENT_COLUMNS)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rejected records as they were read, for diagnosis."""
    return parsed.where(~F.col("ok")).select("file", "record_no", "fields")


def read_comments(spark: SparkSession, path, post_pattern: str = POST_FROM_STEM):
    """(comments, quarantine) of a folder of exports. Rows swallowed by a stray quote are read (see read_records)."""
    parsed = parse_records(read_records(spark, path, post_pattern, resync=True))
    return comments(parsed), quarantine(parsed)


class QualityGateError(ValueError):
    """rejected: how many records were not understood."""

    def __init__(self, message: str, rejected: int = 0):
        super().__init__(message)
        self.rejected = rejected


def quality_gate(rejected: DataFrame, examples: int = 5) -> None:
    """Fail fast when any record was quarantined, showing a few of them."""
    shown = rejected.limit(examples).collect()
    if shown:
        n = rejected.count()
        raise QualityGateError(f"{n} records not understood, e.g. {[tuple(r) for r in shown]}", n)


def gate_by_file(files: DataFrame, rejected: DataFrame) -> DataFrame:
    """(file, n_rejected, tripped) of every file: which of them the gate holds back, without ending the job."""
    counts = rejected.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return files.join(counts, "file", "left").select("file", n.alias("n_rejected"), (n > 0).alias("tripped"))


# Schemes that tasks read themselves, in pieces; files of others come whole through Spark's reader.
PIECEWISE = ("file", "hdfs", "s3", "s3a", "gs")
PIECE = 8 << 20


def _hashed(batches):
    """(path) to (path, sha256): each file is read in pieces and hashed on the way."""
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            scheme, _, rest = path.partition(":")
            uri = f"{'s3' if scheme == 's3a' else scheme}:{rest if rest.startswith('//') else '//' + rest}"
            system, name = fs.FileSystem.from_uri(urllib.parse.quote(uri, safe=":/@"))
            digest = hashlib.sha256()
            with system.open_input_stream(name) as source:
                while piece := source.read(PIECE):
                    digest.update(piece)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "sha256"])


def _piecewise(spark: SparkSession, path: str) -> bool:
    """Whether tasks read the files of path themselves; a path that names no scheme has that of the default file system."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme:
        return scheme[1] in PIECEWISE
    files = spark.read.format("binaryFile").load(path).inputFiles()
    return not files or files[0].partition(":")[0] in PIECEWISE


def file_checksums(spark: SparkSession, paths, root: str | None = None) -> DataFrame:
    """(file, sha256) per input file. file is the path below `root`, without it the file's own name.

    Tasks read files in pieces of constant size, whatever their length; a task has one file at a time. Spark lists
    these files and does not open them. On file systems that only Spark reads a file comes whole in one row, of 2 GB
    at most.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    pieces = [p for p in paths if _piecewise(spark, p)]
    whole = [p for p in paths if p not in pieces]
    source = spark.read.format("binaryFile")
    parts = []
    if pieces or not whole:
        parts.append(source.load(pieces).select("path").mapInArrow(_hashed, "path string, sha256 string"))
    if whole:
        parts.append(source.load(whole).select("path", F.sha2("content", 256).alias("sha256")))
    name = F.element_at(F.split("path", "/"), -1)
    if root is not None:
        inside = root.partition(":")[2].lstrip("/") if ":" in root else root.strip("/")
        name = F.substring_index("path", f"{inside.rstrip('/')}/", -1)
    return reduce(DataFrame.union, parts).select(name.alias("file"), "sha256")
