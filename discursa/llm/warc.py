"""WARC archives: records written with their index, read back by coalesced byte ranges.

Each record's place is known before it is written: records are dealt to archives of bounded size, put
in order of page, and offsets are running sums of record lengths. The index has a row per record:
archive, offset, length, URL, digest. Archives are text files whose line separator is the end of a
record, so any store that Spark can write to will do. Reading sorts the wanted index rows by archive
and offset, joins neighbouring ranges, and fetches each joined range with one read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from discursa.llm.tables import parts, scratch, staged

#: Bytes of an archive on average; ranges closer than GAP are fetched together, up to MOST bytes.
ARCHIVE_BYTES, GAP, MOST = 32 << 20, 4 << 10, 8 << 20
LEAST_PAYLOAD = 1000
END = "\r\n\r\n"


def _squeeze(batches):
    """Payloads compressed for the way to their archive."""
    for batch in batches:
        packed = [zlib.compress((x or "").encode(), 1) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["uid", "packed"])


def _expand(batches):
    """Whole records without their end, about MOST bytes a batch."""
    for batch in batches:
        archives, heads, bare, packed = (batch.column(c).to_pylist() for c in range(4))
        out, size, a = [], 0, 0
        for i, head in enumerate(heads):
            out.append(head + ("" if bare[i] else zlib.decompress(packed[i]).decode()))
            size += len(out[-1])
            if size > MOST or i + 1 == len(heads):
                yield pa.RecordBatch.from_arrays([pa.array(archives[a : i + 1], pa.int32()), pa.array(out, pa.string())], names=["archive", "value"])
                out, size, a = [], 0, i + 1


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\r\n]+", " ")


def _identified(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    raw = pages.select("page_id", _one_line(F.col("url")).alias("url"), F.length(payload).cast("long").alias("n"), F.sha1(payload).alias("digest"), "html")
    h = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "digest"))
    uid = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return raw.withColumn("uid", uid)


def records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Narrow facts of each row: uid, page_id, url, n (payload bytes), digest, refers_to, refers_uid.

    Of rows with equal payloads of at least `least` bytes the one with the largest page_id (then uid)
    is the response, the others revisit it. uid is a UUID from page_id, url and payload digest.
    """
    facts = staged(_identified(pages).drop("html"), "pages")
    many = facts.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max(F.struct("page_id", "uid")).alias("to"), F.count("*").alias("k"))
    many = staged(many.where("k > 1").select("digest", "n", "to"), "payload-groups")
    joined = facts.join(many, ["digest", "n"], "left")
    # Rows that repeat the response in all columns are responses too.
    revisit = F.col("to").isNotNull() & (F.col("to.uid") != F.col("uid"))
    return joined.select(
        "uid", "page_id", "url", "n", "digest", F.when(revisit, F.col("to.page_id")).alias("refers_to"), F.when(revisit, F.col("to.uid")).alias("refers_uid")
    )


def _head(c=F.col) -> Column:
    """Header block of a record, without the empty line after it."""
    revisit = c("refers_uid").isNotNull()
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), c("uid"), F.lit(">"))),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")), _line("WARC-Target-URI", c("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), c("digest"))),
        _line("X-Payload-Length", c("n").cast("string")), _line("X-Page-ID", F.coalesce(c("page_id").cast("string"), F.lit(""))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
                _line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), c("refers_uid"), F.lit(">"))),
                _line("X-Refers-To-Page", F.coalesce(c("refers_to").cast("string"), F.lit(""))),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(c("n").cast("string")),
    )


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives below path and returns their index: archive, seq, offset, length, page_id, url,
    digest, record_type. Null html is an empty payload, a null url an empty one, a null page_id stays
    null; line breaks in a url become spaces; repeated rows are repeated records; an empty table writes
    no record; other columns are not looked at."""
    facts = staged(records(pages), "records")
    body = F.when(F.col("refers_uid").isNotNull(), F.lit(0)).otherwise(F.col("n"))
    total = facts.agg(F.coalesce(F.sum(body + 600), F.lit(0))).first()[0]
    archives = max(parts(pages.sparkSession), -(-total // archive_bytes))
    # The archive of a record is the partition that holds it when rows are partitioned by uid.
    number = F.pmod(F.hash("uid"), F.lit(archives)).cast("int")
    facts = facts.withColumns({"archive": number, "record_type": F.when(F.col("refers_uid").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))})
    facts = facts.withColumn("length", F.octet_length(_head()) + 4 + body + len(END))
    w = Window.partitionBy("archive").orderBy("uid", "page_id")
    index = facts.select(
        "archive", F.row_number().over(w).cast("long").alias("seq"),
        (F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).cast("long").alias("offset"),
        F.col("length").cast("long").alias("length"), "page_id", "url", "digest", "record_type",
    )
    html = _identified(pages).select("uid", "html").mapInArrow(_squeeze, "uid string, packed binary").repartition(archives, "uid")
    heads = facts.dropDuplicates(["uid"]).select(
        "uid", "archive", F.concat(_head(), F.lit(END)).alias("head"), F.col("refers_uid").isNotNull().alias("bare")
    )
    full = html.join(heads.repartition(archives, "uid").hint("merge"), "uid").sortWithinPartitions("archive", "uid")
    (
        full.select("archive", "head", "bare", "packed").mapInArrow(_expand, "archive int, value string")
        .write.partitionBy("archive").option("lineSep", END).option("compression", "none").text(path)
    )
    index = staged(index, "warc-index")
    return index


def _ranges(rows: list[tuple]) -> list[tuple[int, int, list[tuple]]]:
    """Joined (from, to, rows) of index rows (offset, length, ...) sorted by offset."""
    out: list = []
    for row in rows:
        lo, hi = row[0], row[0] + row[1]
        if out and lo <= out[-1][1] + GAP and hi - out[-1][0] <= MOST:
            out[-1][1] = max(out[-1][1], hi)
            out[-1][2].append(row)
        else:
            out.append([lo, hi, [row]])
    return [tuple(x) for x in out]


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record's bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length and content length differ")
    return fields, rest[:n]


def read(spark, path: str, index: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of the records that
    index names. payload_bytes and payload_digest are those of the full payload: measured for
    responses, whose digest must be the one in the header, and taken from the header for revisits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    files = files.select("path", F.regexp_extract("path", "archive=([0-9]+)", 1).cast("int").alias("archive"))
    files = staged(files, "archives")
    placed = index.join(files, "archive").select("path", "offset", "length", "seq")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyarrow import fs

        def fetch(name, rows):
            store, place = fs.FileSystem.from_uri(name.replace(" ", "%20"))
            with store.open_input_file(place) as f:
                for lo, hi, inside in _ranges(rows):
                    data = f.read_at(hi - lo, lo)
                    for offset, length, _ in inside:
                        fields, payload = parse(data[offset - lo : offset - lo + length])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError("payload and digest differ")
                        number = lambda k: int(fields[k]) if fields.get(k) else None
                        yield (
                            number("X-Page-ID"), fields["WARC-Target-URI"], fields["WARC-Type"], number("X-Payload-Length") if revisit else len(payload),
                            digest, number("X-Refers-To-Page"), None if revisit else payload,
                        )

        def packed(rows):
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=FIELDS)

        for batch in batches:
            by_file: dict[str, list] = {}
            for name, *row in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length", "seq"))):
                by_file.setdefault(name, []).append(tuple(row))
            for name, rows in by_file.items():
                out, size = [], 0
                for got in fetch(name, sorted(rows)):
                    out.append(got)
                    size += len(got[-1] or b"")
                    if size > MOST:
                        yield packed(out)
                        out, size = [], 0
                if out:
                    yield packed(out)

    # Neighbouring ranges of an archive go to one task, different stretches of it to different ones.
    stretch = F.floor(F.col("offset") / MOST)
    return (
        placed.repartition(n, "path", stretch).sortWithinPartitions("path", "offset")
        .mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    )


FIELDS = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages to archives in the shared folder and reads every record back."""
    path = scratch(pages.sparkSession, "warc")
    return read(pages.sparkSession, path, write(pages, path, archive_bytes))
