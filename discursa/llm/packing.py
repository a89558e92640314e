"""Packing tokenised documents into sequences by vector bin packing.

A bin has three capacities: tokens, segments and loss-bearing tokens (a segment's first id at the
start of a document has nothing to be predicted from and bears no loss). Each task packs the
documents it reads, with a bounded number of open bins: a piece goes to the bin where the dot
product of its demand and the bin's free room, both relative to the capacities, is largest. What
would be padding is avoided by cutting: the last piece of a bin fills it, and bins still open at the
end are emptied into sequences of powers of two.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discursa.llm.textbatch import text_slices, tidy

END_ID = 2
LENGTH = 4096
SEGMENTS = 512
OPEN_BINS = 16
CACHE_WORDS = 100_000
MARKS = b".,;:!?|*#$%&"
JOINED = 200  # new words encoded in one call


def _apart(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of folded texts with a space between a letter or digit (ASCII, or of the first two
    blocks of Unicode) and the punctuation after it, where the tokenizer parts them anyway."""
    plain, mark = np.zeros(256, bool), np.zeros(256, bool)
    plain[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    mark[list(MARKS)] = True
    at = np.flatnonzero(mark[data[1:]]) + 1
    before, lead = data[at - 1], data[at - 2]  # at 1, lead is some other byte, and before none that needs one
    at = at[plain[before] | (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]
    return np.insert(data, at, 0x20), off + np.searchsorted(at, off)


class WordTokenizer:
    """Ids of a text from the ids of its white-space separated words, each encoded once.

    The tokenizer drops white space and never joins across it, nor a letter or digit and the
    punctuation after it, so the ids are those of the whole text. ASCII letters are folded first, as the
    tokenizer folds them, unless a combining mark could join a capital. The cache only saves time: it
    has two generations, of which the older goes when the younger is full, and stays with the worker
    process (on the tokenizers module, as code shipped by value has no module of its own there).
    """

    def __init__(self, path: str):
        import tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = tokenizers.__dict__.setdefault("_word_caches", {})
        if path not in kept:
            tok = tokenizers.Tokenizer.from_file(path)
            ends = np.zeros(tok.get_vocab_size(), bool)
            ends[[i for w, i in tok.get_vocab().items() if w.endswith("</w>")]] = True
            kept[path] = (tok, [{}, {}], ends)
        self.tok, self.caches, self.ends = kept[path]
        self.special = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]

    def _recall(self, words: set[bytes]) -> set[bytes]:
        """The words that neither cache holds; those of the older one go to the younger."""
        young, old = self.caches
        words = words.difference(young)
        kept = old.keys() & words
        young.update(zip(kept, map(old.__getitem__, kept)))
        return words - kept

    def _learn(self, words: set[bytes]) -> None:
        """Afterwards the younger cache holds all the words."""
        if len(self.caches[0]) > CACHE_WORDS:
            self.caches[:] = [{}, self.caches[0]]
        young = self.caches[0]
        split, new, parts = [], [], set()
        for w in self._recall(words):
            core = w.rstrip(MARKS)
            if len(core) != len(w) and core and core.decode()[-1].isalnum():
                tail = w[len(core) :]
                split.append((w, core, tail))
                parts.add(core)
                parts.add(tail)
            else:
                new.append(w)
        self._encode([*new, *self._recall(parts.difference(new))], young)
        for w, core, tail in split:
            young[w] = young[core] + young[tail]

    def _encode(self, words: list[bytes], into: dict) -> None:
        """Ids of words; words of letters go together in one text and are told apart by their word ends."""
        letters, rest = [], []
        for w, text in zip(words, b" ".join(words).decode().split(" ")):
            (letters if text.isalpha() else rest).append(w)
        groups = [letters[a : a + JOINED] for a in range(0, len(letters), JOINED)]
        joined = [b" ".join(g).decode() for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            to = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(to) != len(g):  # folding left a mark that is no letter: more pieces than words
                rest += g
                continue
            raw = ids.tobytes()
            into.update(zip(g, [raw[a:b] for a, b in zip([0, *to], to)]))
        for w, e in zip(rest, self.tok.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            into[w] = array("I", e.ids).tobytes()

    def ids(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """One array a text. Only the distinct words of a run of texts become Python objects."""
        for _, _, raw, off in text_slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())):
            yield from self._run(raw.tobytes(), off)

    def _run(self, raw: bytes, off: np.ndarray) -> Iterator[np.ndarray]:
        low = bytearray(raw.lower())  # ASCII letters only
        owner = lambda at: int(np.searchsorted(off, at, "right")) - 1
        alone = set()  # texts with a special token, which may end inside a word
        for s in self.special:
            at = low.find(s)
            while at >= 0:
                k = owner(at)
                inside = at + len(s) <= off[k + 1]
                if inside:
                    alone.add(k)
                at = low.find(s, int(off[k + 1]) if inside else at + 1)
        at = raw.find(b"\xcc")  # U+0300 to U+033F
        while at >= 0:
            k = owner(at)
            low[off[k] : off[k + 1]] = raw[off[k] : off[k + 1]]
            at = raw.find(b"\xcc", int(off[k + 1]))
        for k in alone:
            low[off[k] : off[k + 1]] = b" " * int(off[k + 1] - off[k])
        data, to = _apart(np.frombuffer(low, np.uint8), off)
        words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(to) - 1, pa.py_buffer(to), pa.py_buffer(data)))
        to = words.offsets.to_numpy()
        words = words.flatten().dictionary_encode()
        word = words.indices.to_numpy()
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        self._learn(set(distinct))
        got = list(map(self.caches[0].__getitem__, distinct))
        flat = np.frombuffer(b"".join(got), np.uint32)
        n = np.fromiter(map(len, got), np.int64, len(got)) // 4
        first = np.cumsum(n) - n
        ends = np.concatenate([[0], np.cumsum(n[word])])
        at = np.repeat(first[word] - ends[:-1], n[word])
        at += np.arange(len(at))
        ids = flat[at]
        cut = ends[to - to[0]]
        for k in range(len(off) - 1):
            if k in alone:
                yield np.array(self.tok.encode(raw[off[k] : off[k + 1]].decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[cut[k] : cut[k + 1]]


class Packer:
    """Open bins of one task. put() and finish() give rows (document, start, length, sequence, offset)."""

    def __init__(self, first: int, length: int, segments: int, loss: int, open_bins: int):
        self.limits = np.array([length, segments, loss], float)
        self.room = np.tile(self.limits, (open_bins, 1))
        self.pieces: list[list] = [[] for _ in range(open_bins)]
        self.next = first

    def _close(self, k: int) -> Iterator[tuple]:
        """Emits bin k as one sequence, or as sequences of powers of two where it is not full."""
        used, full = int(self.limits[0] - self.room[k, 0]), int(self.limits[0])
        size = full if used == full else 1 << max(used.bit_length() - 1, 0)
        at = 0
        for doc, start, n in self.pieces[k]:
            while n:
                take = min(n, size - at)
                yield doc, start, take, self.next, at
                start, n, at, used = start + take, n - take, at + take, used - take
                if at == size:
                    self.next, at = self.next + 1, 0
                    size = 1 << max(used.bit_length() - 1, 0)
        self.pieces[k], self.room[k] = [], self.limits

    def put(self, doc: int, n: int) -> Iterator[tuple]:
        start = 0
        while n:
            want = np.array([n, 1, n - (start == 0)], float)
            take = np.minimum(want[0], np.minimum(self.room[:, 0], self.room[:, 2] + (start == 0)))
            gain = (np.minimum(want, self.room) / self.limits * self.room / self.limits).sum(axis=1)
            gain[take >= n] += 3  # whole, if it fits anywhere
            k = int(gain.argmax())
            m = int(take[k])
            self.pieces[k].append((doc, start, m))
            self.room[k] -= (m, 1, m - (start == 0))
            start, n = start + m, n - m
            if self.room[k, 0] < 1 or self.room[k, 1] < 1 or self.room[k, 2] < 1:
                yield from self._close(k)

    def finish(self) -> Iterator[tuple]:
        for k in range(len(self.pieces)):
            if self.pieces[k]:
                yield from self._close(k)


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "loss_tokens long"
)


def _pack(path: str, length: int, segments: int, loss: int, open_bins: int, keep_ids: bool) -> Callable:
    def run(batches):
        tokenizer = WordTokenizer(path)
        packer = Packer(TaskContext.get().partitionId() << 36, length, segments, loss, open_bins)
        waiting: dict[int, list] = {}  # document number: [id, ids, tokens not yet emitted]
        number = 0

        def rows(placed) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for doc, start, n, seq, offset in placed:
                doc_id, ids, left = waiting[doc]
                part = ids[start : start + n]
                out.append(
                    (doc_id, start, n, zlib.crc32(part.tobytes()), len(ids), seq, offset, n - (start == 0))
                    + ((part.tolist(),) if keep_ids else ())
                )
                if left == n:
                    del waiting[doc]
                else:
                    waiting[doc][2] = left - n
            if out:
                cols = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(c, pa.list_(pa.int32())) for c in cols[8:]]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * keep_ids)

        for batch in batches:
            placed = []
            for k, (doc_id, ids) in enumerate(zip(batch.column(0).to_pylist(), tokenizer.ids(batch.column(1)))):
                ids = np.append(ids, np.uint32(END_ID))
                waiting[number] = [doc_id, ids, len(ids)]
                placed += packer.put(number, len(ids))
                number += 1
                if k % 256 == 255:
                    yield from rows(placed)
                    placed = []
            yield from rows(placed)
        yield from rows(packer.finish())

    return tidy(run)


def pack(
    docs: DataFrame, tokenizer: str, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None,
    open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens
    (and ids with keep_ids).

    A document is the ids of its text and END_ID, so an empty or null text is that id alone. No
    sequence exceeds `length` tokens, `segments` pieces or `loss` loss-bearing tokens (default:
    length, which binds only when set lower). A sequence shorter than `length` has a power of two of
    tokens. Documents longer than a sequence are cut as often as needed. Repeated rows are packed each
    on its own; a null id stays null; an empty table gives no rows; other columns are not looked at.
    Each task packs its own rows: nothing is shuffled, memory is its open bins and their documents.
    Sequence numbers are unique and repeat when a task is repeated over the same files.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _pack(tokenizer, length, segments, loss or length, open_bins, keep_ids), SCHEMA + ", ids array<int>" * keep_ids
    )
