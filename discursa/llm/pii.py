"""Personal data: patterns, and a semi-Markov conditional random field that adds spans to them.

The field labels runs of tokens as whole segments (email, ip, card, phone) or single tokens as other.
Features look at a whole candidate segment and the words before it; forward and Viterbi recursions
run over segment ends with at most MAX_TOKENS tokens a segment, so boundaries and types are chosen
together. Tokens outside candidate segments can only be "other" and score 0, so the recursion runs
over the stretches of text that hold candidates. Weights are fitted by gradient ascent on the
conditional likelihood of a bounded sample, whose labels are the pattern matches, also in rewritten
forms that the patterns themselves miss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.textbatch import tidy

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
#: Texts the field is fitted on at most; they are those with the least md5 of the text.
SAMPLE_TEXTS = 300
MARGIN = 2.0

IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs of letters cost one pass."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            out.append((start, tail.end()))
            done = tail.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches as (kind, start, end) in code points, by kind and start."""
    found = [("email", *m) for m in emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        found += [("ip", *m.span()) for m in IP.finditer(text) if max(map(lambda p: int(p[-20:]) if len(p.lstrip("0")) < 20 else 256, m[0].split("."))) < 256]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
SEED = re.compile(r"[0-9@]|\b(?:at|dot)\b", re.I)
CUES = {  # fixed words that announce a kind
    "email": {"mail", "email", "e", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "host", "address", "server", "addr"},
    "card": {"card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "telefono"},
}
SEPARATORS = {" ", "-", ".", "(", ")", "+", "/"}


def _shape(text: str, toks: list, i: int, j: int) -> dict | None:
    """What a segment of tokens i..j-1 looks like, or None if it can't be personal data."""
    s, e = toks[i].start(), toks[j - 1].end()
    seg = text[s:e]
    if "\n" in seg or e - s > 80:
        return None
    groups = re.findall("[0-9]+", seg)
    n = sum(map(len, groups))
    low = seg.lower()
    glued = re.sub(r"\s*[\[({]?\s*(?:@|\bat\b)\s*[\])}]?\s*", "@", low)
    glued = re.sub(r"\s*[\[({]?\s*\bdot\b\s*[\])}]?\s*", ".", glued)
    written = "@" in low or re.search(r"[\[({]\s*at\s*[\])}]|\bdot\b", low)
    if written and emails(glued) == [(0, len(glued))] and re.fullmatch(r".*\.[a-z]{2,6}", glued):
        return {"mailish": 1, "plain at": "@" in low, "dots": glued.rpartition("@")[2].count(".")}
    rest = set(re.sub("[0-9]", "", seg))
    if not groups or rest - SEPARATORS or seg[-1] not in "0123456789" or seg[0] not in "0123456789+(" or n < 7 or n > 19:
        return None
    if re.search(r"[-./ ]{3,}", seg):
        return None
    inner = seg[1:] if seg[0] == "+" else seg
    bare = re.sub("[()+]", "", seg)
    seps = set(re.sub("[0-9]", "", bare))
    return {
        "n": n, "groups": len(groups), "plus": seg[0] == "+", "inner plus": "+" in inner, "paren": "(" in seg,
        "one sep": len(seps) <= 1, "no sep": len(groups) == 1, "dots": seps == {"."},
        "luhn": 16 <= n <= 19 and luhn("".join(groups)), "fours": all(len(g) == 4 for g in groups[:-1]) and len(groups) > 1,
        "octets": len(groups) == 4 and all(int(g) < 256 for g in groups),
        "phone groups": len(groups) in (3, 4) and len(groups[-1]) == 4 and len(groups[-2]) == 3 and len(groups[-3]) == 3,
    }


def features(text: str, toks: list, i: int, j: int) -> np.ndarray | None:
    """Whole-span features of a candidate, the same for all kinds; weights differ by kind."""
    x = _shape(text, toks, i, j)
    if x is None:
        return None
    left = {t[0].lower() for t in toks[max(0, i - 3) : i]}
    joined = i > 0 and toks[i - 1].end() == toks[i].start() and toks[i - 1][0] not in ",;:\"'([<"
    tight = j < len(toks) and toks[j].start() == toks[j - 1].end() and toks[j][0] not in ".,;:!?\"')]>"
    digits = x.get("n", 0)
    flags = [
        1, "mailish" in x, x.get("plain at"), digits and 7 <= digits <= 9, 10 <= digits <= 11, 12 <= digits <= 15,
        16 <= digits, x.get("plus"), x.get("inner plus"), x.get("paren"), x.get("one sep"), x.get("no sep"),
        x.get("dots") and digits, x.get("luhn"), x.get("fours"), x.get("octets") and x.get("dots"),
        x.get("octets") and not x.get("dots"), x.get("phone groups"), x.get("phone groups") and x.get("one sep"),
        joined, tight, *(bool(left & CUES[k]) for k in KINDS),
    ]
    return np.array(flags, bool).astype(float)


def lattice(text: str):
    """Stretches that hold candidates: (tokens, [(i, j, features)]) each."""
    if not SEED.search(text):
        return
    toks = list(TOKEN.finditer(text))
    seeds = [k for k, t in enumerate(toks) if t[0] == "@" or t[0][0].isdigit() or t[0].lower() in ("at", "dot")]
    a = 0
    while a < len(seeds):
        b = a
        while b + 1 < len(seeds) and seeds[b + 1] - seeds[b] < MAX_TOKENS:
            b += 1
        first, last = max(0, seeds[a] - MAX_TOKENS), min(len(toks), seeds[b] + MAX_TOKENS + 1)
        part = toks[first:last]
        marks = np.zeros(len(part) + 1, int)
        marks[np.array(seeds[a : b + 1]) - first + 1] = 1
        marks = marks.cumsum()
        strong = any(t[0] == "@" or t[0][0].isdigit() for t in part) or "dot" in {t[0].lower() for t in part}
        cands = []
        for i in range(len(part) if strong else 0):
            if part[i][0] in "+(" or part[i][0][0].isdigit() or part[i][0][0].isalpha():
                for j in range(i + 1, min(i + MAX_TOKENS, len(part)) + 1):
                    if part[j - 1].end() - part[i].start() > 80:
                        break
                    if marks[j] > marks[i]:
                        f = features(text, part, i, j)
                        if f is not None:
                            cands.append((i, j, f))
        if cands:
            yield part, cands
        a = b + 1


def viterbi(n: int, cands: list, weights: np.ndarray, margin: float) -> list[tuple[int, int, int]]:
    """Best segmentation as (i, j, kind); tokens between are other, at score 0."""
    best, back = np.zeros(n + 1), [None] * (n + 1)
    ends: dict[int, list] = {}
    for i, j, f in cands:
        ends.setdefault(j, []).append((i, f @ weights - margin))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, s in ends.get(j, ()):
            if best[i] + s.max() > best[j]:
                best[j], back[j] = best[i] + s.max(), (i, int(s.argmax()))
    out, j = [], n
    while j:
        if back[j]:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def fit(examples: list, dims: int, rounds: int = 150, rate: float = 0.5, l2: float = 0.002) -> np.ndarray:
    """Weights (feature, kind) by gradient ascent; examples are (n, candidates, gold {(i, j): kind})."""
    w, step = np.zeros((dims, len(KINDS))), np.zeros((dims, len(KINDS)))
    for _ in range(rounds):
        grad = -l2 * len(examples) * w
        for n, cands, gold in examples:
            s = np.array([c[2] for c in cands]) @ w
            z = np.logaddexp.reduce(s, axis=1)
            by_end: dict[int, list] = {}
            by_start: dict[int, list] = {}
            for k, (i, j, _f) in enumerate(cands):
                by_end.setdefault(j, []).append((i, k))
                by_start.setdefault(i, []).append((j, k))
            alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
            for j in range(1, n + 1):
                alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[i] + z[k] for i, k in by_end.get(j, ()))])
            for i in range(n - 1, -1, -1):
                beta[i] = np.logaddexp.reduce([beta[i + 1], *(beta[j] + z[k] for j, k in by_start.get(i, ()))])
            for k, (i, j, f) in enumerate(cands):
                p = np.exp(np.minimum(alpha[i] + s[k] + beta[j] - alpha[n], 0))
                if (i, j) in gold:
                    p[gold[i, j]] -= 1
                grad -= np.outer(f, p)
        step = 0.7 * step + rate / len(examples) * grad
        w = w + step
    return w


def _rewritten(kind: str, found: str, n: int) -> str:
    """A form of a match that the pattern misses, one of a few by number."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "email":
        user, _, host = found.partition("@")
        return (found, f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user}(at){host}")[n % 4]
    if kind == "phone":
        area = digits[-10:]
        if len(area) < 10:
            return found
        return (found, f"({area[:3]}) {area[3:6]}-{area[6:]}", f"{area[:3]}-{area[3:6]}-{area[6:]}", f"{area[:3]}.{area[3:6]}.{area[6:]}")[n % 4]
    if kind == "card":
        return (found, ".".join(re.findall("....", digits[:16])), "/".join(re.findall("....", digits[:16])), found)[n % 4]
    return found


NEGATIVES = (  # numbers that are nobody's: dates, amounts, versions, counts, serial numbers
    "2024-01-31", "12/31/2023 10:15:00", "1234567", "3.14159265", "1.2.3.4.5", "100 200 300 400", "20240131", "555-12",
    "2019 2020 2021 2022", "1234-5678", "look at this dot", "1024 768 1280 720", "1234567890123456", "8.500.000.000",
)


def examples(texts: list[str]) -> list:
    """Training stretches from pattern matches and their rewritten forms, and from negatives."""
    out = []
    for n, text in enumerate(sorted(texts)):
        for m, (kind, s, e) in enumerate(base_spans(text)):
            left, right = text[max(0, s - 60) : s], text[e : e + 60]
            left, right = left[left.find(" ") + 1 :], right[: right.rfind(" ") + 1]
            if base_spans(left) or base_spans(right) or SEED.search(left + " " + right):
                left, right = "and so the ", " was there"
            put = _rewritten(kind, text[s:e], n + m)
            whole = left + put + right
            for part, cands in lattice(whole):
                gold = {
                    (i, j): KINDS.index(kind) for i, j, _ in cands
                    if part[i].start() == len(left) and part[j - 1].end() == len(left) + len(put)
                }
                if gold:
                    out.append((len(part), cands, gold))
    for bad in NEGATIVES * max(1, len(out) // 100):
        out += [(len(part), cands, {}) for part, cands in lattice(f"the value was {bad} in all")]
    return out


def train(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_TEXTS) -> np.ndarray:
    """Field fitted on at most `most` texts that hold matches. No texts: weights that add nothing."""
    text = F.col(text_col)
    likely = docs.where(text.rlike("[0-9]{8}|[0-9]-[0-9]{4}|@|[0-9]\\.[0-9]{1,3}\\.[0-9]") & (F.length(text) < 20_000))
    likely = likely.select(F.md5(text).alias("h"), text.alias("t"))
    first = likely.select("h").distinct().orderBy("h").limit(most)
    got = examples([r.t for r in likely.join(F.broadcast(first), "h").groupBy("h").agg(F.first("t").alias("t")).collect()])
    dims = len(features("1234567", list(TOKEN.finditer("1234567")), 0, 1))
    return fit(got, dims) if got else np.zeros((dims, len(KINDS)))


def spans(text: str, weights: np.ndarray, margin: float = MARGIN) -> tuple[list, list]:
    """(pattern spans, all spans): what the field finds is added where it overlaps no pattern span."""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    extra = []
    for part, cands in lattice(text):
        for i, j, k in viterbi(len(part), cands, weights, margin):
            s, e = part[i].start(), part[j - 1].end()
            if all(e <= a or b <= s for a, b in taken):
                extra.append((KINDS[k], s, e))
    extra = sorted(set(extra))
    return base, sorted(base + extra, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def _join(found: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans (all), n_added.

    Offsets count code points, ends are exclusive. A null or empty text has no spans (the digest of the
    empty string). A null id stays null, repeated rows each come back, an empty table gives no rows,
    other columns are not looked at. Texts are searched whole, in time linear in their length.
    """
    weights = train(docs, text_col) if weights is None else weights

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = spans(text or "", weights)
                n = [sum(k == b[0] for b in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(every) - len(base)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def mask(docs: DataFrame, weights: np.ndarray | None = None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; other columns as they are, the
    length column (if there) set to the new length. Overlapping spans are replaced together."""
    weights = train(docs, text_col) if weights is None else weights
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, text in enumerate(texts):
                found = sorted((s, e, kind) for kind, s, e in spans(text or "", weights)[1])
                out, done = [], 0
                for s, e, kind in found:
                    if s >= done:
                        out += [text[done:s], f"<{kind}>"]
                    done = max(done, e)
                if found:
                    texts[k] = "".join(out) + text[done:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    done = docs.mapInArrow(tidy(run), docs.schema)
    if length_col in docs.columns:
        done = done.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return done
