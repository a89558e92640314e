"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Leaves are runs of up to PIECE_WORDS words of a paragraph (a line), nodes above are paragraphs, then
sections, which end after a paragraph whose digest is a multiple of SECTION, so an edit moves no
boundary behind it. The root digests the section digests. Leaves cover every code point and every node
is built from whole 128-bit digests of the nodes below it, so equal roots or sections mean equal texts or
sections. A fingerprint prints as

    root|section:leaves,leaves;section:leaves

with roots and sections whole and the leaves of a paragraph joined, cut to LEAF hex digits each: they only
tell which pieces of two differing sections are alike.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.tables import parts

PIECE_WORDS = 8
SECTION = 4
DIGEST = 16  # bytes
LEAF = 10
PIECES = re.compile(r"\s+|(?:\S+[^\S\n]*){1,%d}\n*" % PIECE_WORDS)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def fingerprint(text: str) -> str:
    """The tree of a text. Memory and time follow its length."""
    sections, leaves, paragraphs, nodes = [], [], [], []

    def end_paragraph():
        if leaves:
            nodes.append(_digest(b"".join(leaves)))
            paragraphs.append("".join([x[: LEAF // 2].hex() for x in leaves]))
            leaves.clear()

    def end_section():
        if nodes:
            node = _digest(b"".join(nodes))
            sections.append((node, ",".join(paragraphs)))
            nodes.clear()
            paragraphs.clear()

    for m in PIECES.finditer(text):
        piece = m[0]
        leaves.append(_digest(piece.encode()))
        if piece[-1] == "\n":
            end_paragraph()
            if nodes and nodes[-1][0] % SECTION == 0:
                end_section()
    end_paragraph()
    end_section()
    root = _digest(b"".join(n for n, _ in sections)).hex()
    return root + "|" + ";".join(f"{n.hex()}:{p}" for n, p in sections)


def branches(fp: str) -> list[tuple[str, list[list[str]]]]:
    """Sections as (digest, leaves of each paragraph)."""
    body = fp.partition("|")[2]
    out = []
    for section in body.split(";") if body else []:
        node, _, rest = section.partition(":")
        out.append((node, [[p[i : i + LEAF] for i in range(0, len(p), LEAF)] for p in rest.split(",")]))
    return out


def differing(a: str, b: str) -> list[tuple[int, int, int]]:
    """Where b differs from a: (section, paragraph, leaf) of b's leaves that a has nowhere. Equal roots
    and equal sections are not entered."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    known = {n for n, _ in branches(a)}
    leaves = {x for _, ps in branches(a) for p in ps for x in p}
    return [
        (i, j, k) for i, (n, ps) in enumerate(branches(b)) if n not in known
        for j, p in enumerate(ps) for k, x in enumerate(p) if x not in leaves
    ]


def likeness(a: str, b: str) -> float:
    """Share of leaves in common, 0 to 1. Equal sections are matched whole."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    x, y = branches(a), branches(b)
    same = Counter(n for n, _ in x) & Counter(n for n, _ in y)
    total, both, loose = [0, 0], 0, []
    for side, tree in enumerate((x, y)):
        left, rest = same.copy(), Counter()
        for n, ps in tree:
            size = sum(map(len, ps))
            total[side] += size
            if left[n]:
                left[n] -= 1
                both += size if side == 0 else 0
            else:
                for p in ps:
                    rest.update(p)
        loose.append(rest)
    both += sum((loose[0] & loose[1]).values())
    return both / max(total) if max(total) else 1.0


def _place(bounds: np.ndarray, carry_to: dict[int, int] | None):
    """(id, text) to (bucket, carry, id, order, text). Rows with the largest id of a bucket go a second
    time, as carry, to the bucket whose last row they follow."""

    def run(batches):
        for batch in batches:
            order = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(bounds, order, "right").astype(np.int32)
            again = np.array([i for i, o in enumerate(order.tolist()) if o in carry_to], np.int64)
            for at, carry in ((np.arange(len(order)), 0), (again, 1)):
                if len(at):
                    to = np.array([carry_to[o] for o in order[at].tolist()], np.int32) if carry else bucket
                    rows = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to), pa.array(np.full(len(at), carry, np.int32)), pa.array(order[at]), rows.column(0), rows.column(1)],
                        names=["bucket", "carry", "order", "id", "text"],
                    )

    return run


NAMES = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_changed"]


def _walk(batches):
    """Rows in descending order within each bucket; each one is finished when the next is seen."""
    last, closed = None, None  # (bucket, id, text, fingerprint); the bucket whose carry was seen
    for batch in batches:
        rows = []
        for bucket, carry, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "carry", "id", "text"))):
            if carry and closed == bucket:
                continue
            text = text or ""
            now = (bucket, doc_id, text, fingerprint(text))
            if last and last[0] == bucket:
                _, was_id, was, fp = last
                half = len(was) // 2
                edited = was[: len(was) - half] + text[:half]
                efp = fingerprint(edited)
                rows.append((was_id, len(was), hashlib.sha256(edited.encode()).hexdigest(), fp, efp, likeness(fp, efp), likeness(fp, now[3]), len(differing(fp, efp))))
            last, closed = (None, bucket) if carry else (now, closed)
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=NAMES)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    The edited form has the last floor(n / 2) code points replaced by as many first ones (or all) of
    the next document in descending id; after the last document comes the first. n_changed counts the
    edited form's leaves that the text has nowhere. A null text is empty. Among equal ids texts follow
    in ascending order, null ids come last; a lone document follows itself. An empty table gives no
    rows; columns besides id and text are not looked at.

    Texts are shuffled once, to buckets of consecutive ids that one task walks row by row; a bucket
    also gets the one row that follows its last.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = parts(spark)
    order = src.select(F.coalesce("id", F.lit(-(1 << 63))).alias("order"))
    cuts = order.approxQuantile("order", [i / (4 * n) for i in range(1, 4 * n)], 0.1 / n) if n > 1 else []
    bounds = np.unique(np.array(cuts, np.float64).astype(np.int64))

    def tops(batches):
        for batch in batches:
            o = batch.column(0).to_numpy(zero_copy_only=False)
            b = np.searchsorted(bounds, o, "right")
            for k in np.unique(b):
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([int(o[b == k].max())], pa.int64())], names=["bucket", "top"])

    found = order.mapInArrow(tops, "bucket int, top long").groupBy("bucket").agg(F.max("top").alias("top"))
    found = sorted((r.bucket, r.top) for r in found.collect())  # one row a bucket
    carry_to = {top: found[(k + 1) % len(found)][0] for k, (_, top) in enumerate(found)}
    placed = src.mapInArrow(_place(bounds, carry_to), "bucket int, carry int, order long, id long, text string")
    walked = (
        placed.repartition(n, "bucket").sortWithinPartitions("bucket", "carry", F.desc("order"), "text")
        .mapInArrow(_walk, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_changed long")
    )
    return walked.withColumnRenamed("id", id_col)
