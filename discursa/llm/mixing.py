"""Language model by logistic context mixing.

Words are spelled bit by bit. Several hashed contexts (none, the last 1 to 4 bytes, the word so far)
each predict the next bit from counts; their log odds are combined by weights that a gate selects (the
bit's place in its byte and how much the longest contexts have seen), and the result is refined by an
adaptive table over quantised log odds. Weights and table learn online, bit after bit in small
batches, from words whose own counts are taken out of the predictors, so they learn to spell words
that are new. Contexts end at word starts, so one spelling is scored once however often it occurs.

A token's probability mixes that spelling with the word's share of all training tokens and its share
in one class of documents. The class is gated too: it starts from the share of training documents and
every token updates it by Bayes' rule, so a text's probability is a sum over the classes. Before that
share is asked, the text's own past is (history.py): hashed contexts of the words before say which word
is expected, and mixed, gated and refined predictions say how surely, learning along the text. Word counts
and their sums are Spark aggregates over the whole corpus; only tables of fixed size are broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discursa.llm import history
from discursa.llm.tables import staged
from discursa.llm.textbatch import mix, text_slices, tidy

SLOTS = 1 << 18
ORDERS = 6
#: Classes of documents (the most frequent values, and the rest), words broadcast.
CLASSES, HOT_WORDS = 8, 1 << 15
CHUNK = 1 << 14
END = 0x20


def _contexts(words: list[bytes]):
    """(next byte, word number, context hash of each order) for every byte of the words and the end
    of each."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    end = np.flatnonzero(data == END) if words else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([[-1], end])) if words else np.zeros(0, np.int64)
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
    x = data.astype(np.uint64)
    hashes = [np.zeros(len(data), np.uint64)]
    h = np.zeros(len(data), np.uint64)
    for k in range(1, 5):
        before = np.concatenate([np.zeros(k, np.uint64), x[:-k]]) if len(x) > k else np.zeros(len(x), np.uint64)
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(place >= k, before + np.uint64(1), np.uint64(0))
        hashes.append(h * np.uint64(2) + np.uint64(1))
    # The word so far: running hashes restart at each word.
    p = np.uint64(0xD6E8FEB86659FD93)
    prefix, longest = np.zeros(len(data), np.uint64), int(n.max()) if len(n) else 0
    order = np.argsort(place, kind="stable")
    cut = np.searchsorted(place[order], np.arange(longest + 1))
    for d in range(1, longest):
        at = order[cut[d] : cut[d + 1]]
        prefix[at] = (prefix[at - 1] + x[at - 1] + np.uint64(1)) * p
    hashes.append(prefix + np.uint64(7))
    return data, word, hashes


def _slots(h: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    z = (h + node.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return (z >> np.uint64(64 - 18)).astype(np.int64)


def _bits(data: np.ndarray):
    """(bit number, node before it, the bit) of each byte."""
    b = data.astype(np.int64)
    for i in range(8):
        yield i, (1 << i) | (b >> (8 - i)), (b >> (7 - i)) & 1


def count_tables(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """(orders, 2, slots) counts of zeros and ones."""
    out = np.zeros((ORDERS, 2, SLOTS), np.float32)
    data, word, hashes = _contexts(words)
    c = counts[word].astype(np.float64)
    for i, node, bit in _bits(data):
        for k, h in enumerate(hashes):
            s = _slots(h, node, k) + bit * SLOTS
            out[k] += np.bincount(s, weights=c, minlength=2 * SLOTS).reshape(2, SLOTS).astype(np.float32)
    return out


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


STEPS = 33


class Mixer:
    """Gated weights and the adaptive table behind them."""

    def __init__(self, tables: np.ndarray):
        self.tables = tables
        self.odds: np.ndarray | None = None
        self.weights = np.full((8 * 16, ORDERS + 1), 0.3)
        self.weights[:, -1] = 0
        self.apm = np.tile(_squash(np.linspace(-8, 8, STEPS)), (8, 1))
        self.gates, self.tops = np.zeros(len(self.weights)), np.zeros(8 * STEPS)

    def inputs(self, hashes, node, bit_no: int, less: np.ndarray | None, bit=None):
        """(log odds of each predictor, gate). less: counts to take out, as the word's own."""
        x = np.empty((ORDERS + 1, len(node)))
        x[-1] = 1
        seen = []
        if less is None:
            if self.odds is None:  # of whole counts, once a slot
                n0, n1 = self.tables[:, 0].astype(np.float64), self.tables[:, 1].astype(np.float64)
                self.odds = _stretch((n1 + 0.3) / (n0 + n1 + 0.6))
        else:
            less0, less1 = less * (bit == 0), less * (bit == 1)
        for k, h in enumerate(hashes):
            s = _slots(h, node, k)
            if less is None:
                x[k] = self.odds[k][s]
                if k < 4:
                    continue
            n0, n1 = self.tables[k, 0][s].astype(np.float64), self.tables[k, 1][s].astype(np.float64)
            if less is not None:
                n0, n1 = np.maximum(n0 - less0, 0), np.maximum(n1 - less1, 0)
                x[k] = _stretch((n1 + 0.3) / (n0 + n1 + 0.6))
            seen.append(n0 + n1)
        level = lambda n: (n > 0.5).astype(np.int64) + (n > 8) + (n > 200)
        return x.T, bit_no * 16 + level(seen[-1]) * 4 + level(seen[-2])

    def _refine(self, z: np.ndarray, bit_no: int):
        at = (np.clip(z, -7.999, 7.999) + 8) * (STEPS - 1) / 16
        lo = at.astype(np.int64)
        return lo, at - lo

    def _mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Log odds of the predictors by the gate's weights."""
        z = x[:, 0] * self.weights[gate, 0]
        for k in range(1, ORDERS + 1):
            z += x[:, k] * self.weights[gate, k]
        return z

    def predict(self, x, gate, bit_no: int):
        z = self._mixed(x, gate)
        lo, f = self._refine(z, bit_no)
        refined = self.apm[bit_no][lo] * (1 - f) + self.apm[bit_no][lo + 1] * f
        return z, np.clip((_squash(z) + refined) / 2, 1e-6, 1 - 1e-6)

    def learn(self, words: list[bytes], counts: np.ndarray, batch: int = 1024, rate: float = 0.02) -> None:
        """One pass over the words, a batch of words at a time. Counts how many bits chose each gate, and each
        entry of the table (self.gates, self.tops)."""
        for a in range(0, len(words), batch):
            data, word, hashes = _contexts(words[a : a + batch])
            own = counts[a : a + batch][word].astype(np.float64)
            for i, node, bit in _bits(data):
                x, gate = self.inputs(hashes, node, i, own, bit)
                z = self._mixed(x, gate)
                error = bit - _squash(z)
                n = np.bincount(gate, minlength=len(self.weights))
                total = np.stack([np.bincount(gate, weights=error * x[:, k], minlength=len(self.weights)) for k in range(ORDERS + 1)], axis=1)
                self.weights += rate * total / np.maximum(np.sqrt(n), 1)[:, None]
                self.gates += n
                lo, f = self._refine(z, i)
                near = lo + (f > 0.5)
                n = np.bincount(near, minlength=STEPS)
                self.tops[i * STEPS : (i + 1) * STEPS] += n
                ones = np.bincount(near, weights=bit, minlength=STEPS)
                self.apm[i] += np.minimum(0.02 * n, 0.5) * (ones / np.maximum(n, 1) - self.apm[i])

    def spell(self, words: list[bytes]) -> np.ndarray:
        """log2 probability of each word with its end."""
        out = np.zeros(len(words))
        for a in range(0, len(words), 20_000):
            data, word, hashes = _contexts(words[a : a + 20_000])
            total = np.zeros(len(data))
            for i, node, bit in _bits(data):
                _, p = self.predict(*self.inputs(hashes, node, i, None), i)
                total += np.log2(np.where(bit == 1, p, 1 - p))
            out[a : a + 20_000] = np.bincount(word, weights=total, minlength=len(words[a : a + 20_000]))
        return out


def _vocabulary(n_classes: int):
    """(class or -1, text) to (word, counts by class); class -1 adds words without counts."""

    def run(batches):
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            for a, b, raw, off in text_slices(batch.column(1), 1 << 24):
                kind = kinds[a:b].astype(np.int64) + 1
                low = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(off), pa.py_buffer(raw.tobytes().lower()))
                words = pc.ascii_split_whitespace(low)  # both ASCII only
                n_words = np.diff(words.offsets.to_numpy())
                words = words.flatten().dictionary_encode()
                place = words.indices.to_numpy() * np.int64(n_classes + 1) + np.repeat(kind, n_words)
                n = np.bincount(place, minlength=len(words.dictionary) * (n_classes + 1))
                at = np.flatnonzero(n)
                word, k, n = words.dictionary.take(pa.array(at // (n_classes + 1))), at % (n_classes + 1), n[at]
                kept = np.flatnonzero(pc.binary_length(word).to_numpy(zero_copy_only=False))  # around a text's white space is the empty word
                ends = np.bincount(kind)
                of = np.flatnonzero(ends)  # each text has one end
                word = pa.concat_arrays([word.take(pa.array(kept)).cast(pa.string()), pa.array([""] * len(of), pa.string())])
                k, n = np.concatenate([k[kept], of]) - 1, np.concatenate([n[kept], ends[of]])
                yield pa.RecordBatch.from_arrays([word, pa.array(k.astype(np.int32)), pa.array(np.where(k >= 0, n, 0).astype(np.int64))], names=["word", "k", "n"])

    return run


def _count_task(batches):
    """(word, count) to packed counter tables by chunk of slots: one set a task."""
    tables, any_ = np.zeros((ORDERS, 2, SLOTS), np.float32), False
    for batch in batches:
        words, n = [w.encode() for w in batch.column(0).to_pylist()], batch.column(1).to_numpy()
        for a in range(0, len(words), 50_000):
            tables += count_tables(words[a : a + 50_000], n[a : a + 50_000])
            any_ = True
    if any_:
        for k in range(ORDERS):
            for c in range(0, SLOTS, CHUNK):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k * SLOTS + c], pa.int32()), pa.array([tables[k, :, c : c + CHUNK].tobytes()], pa.binary())], names=["chunk", "counts"]
                )


def _sum_chunk(table: pa.Table) -> pa.Table:
    total = np.zeros(2 * CHUNK, np.float64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.float32)
    return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _lesson(shared):
    """(word, count) to the weights and table entries learned from a task's words, with the number of bits
    behind each."""

    def run(batches):
        mixer = Mixer(shared.value)
        for batch in batches:
            mixer.learn([w.encode() for w in batch.column(0).to_pylist()], batch.column(1).to_numpy())
        value, bits = np.concatenate([mixer.weights.ravel(), mixer.apm.ravel()]), np.concatenate([np.repeat(mixer.gates, ORDERS + 1), mixer.tops])
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(value[at]), pa.array(bits[at])], names=["place", "value", "bits"])

    return tidy(run)


def trained(words: DataFrame, tables: np.ndarray) -> Mixer:
    """A Mixer that learned from all rows (word, count) of `words`: each partition learns by itself, and entries
    are averaged by the bits they were learned from. What comes to the driver is one number an entry."""
    mixer = Mixer(tables)
    lessons = words.mapInArrow(_lesson(words.sparkSession.sparkContext.broadcast(tables)), "place int, value double, bits double")
    flat = np.concatenate([mixer.weights.ravel(), mixer.apm.ravel()])
    for r in lessons.groupBy("place").agg((F.sum(F.col("value") * F.col("bits")) / F.sum("bits")).alias("v")).collect():
        flat[r.place] = r.v
    mixer.weights = flat[: mixer.weights.size].reshape(mixer.weights.shape)
    mixer.apm = flat[mixer.weights.size :].reshape(mixer.apm.shape)
    return mixer


def _spelled(mixer: Mixer):
    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 100_000):
                part = batch.slice(a, 100_000)
                bits = mixer.spell([w.encode() for w in part.column("word").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bits)], names=[*part.schema.names, "bits"])

    return run


def _split_tokens(hot: dict[bytes, int], table: np.ndarray, past: history.History):
    """(id, held, text) to a head row with what the hot words and the text's own past give, and a row
    for each other word: its count, and in how many places it was not the word expected there."""
    K = table.shape[1] - 2
    plain = 10.0 ** table[:, :K]
    # Hot words by their hashes; the end of a text is the empty word, of hash 0.
    each = history.tokens(pa.array([w.decode() for w in hot], pa.string()))
    hashes = np.concatenate([np.zeros(0, np.uint64), *(h[off[:-1]] for _, _, h, _, _, off in each)])
    by_hash = np.argsort(hashes)
    hashes, number = hashes[by_hash], np.fromiter(hot.values(), np.int64, len(hot))[by_hash]

    def find(h):
        """Number of each hot word, else -1."""
        if not len(hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, number[at], -1)

    def rows_of(texts):
        for first, low, ids, start, end, off in history.tokens(texts):
            n_tokens = np.diff(off)
            n_texts = len(n_tokens)
            text = np.repeat(np.arange(n_texts), n_tokens)
            order, same = history.groups(mix(ids ^ mix(text.astype(np.uint64) + np.uint64(1))))
            head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            lead = np.empty_like(order)  # the first token of the same text and word
            lead[order] = head
            n = np.bincount(lead, minlength=len(ids))
            at, x, gate, longest, bit = history.guesses(ids, off)
            p = past.predict(x, gate, longest)
            right, wrong = at[bit == 1], at[bit == 0]
            free = n - np.bincount(lead[right], minlength=len(ids))  # tokens left to the words' own shares
            place = np.flatnonzero(n)
            h = np.full(len(ids), -1)
            h[place] = find(ids[place])
            common, rest = place[h[place] >= 0], place[h[place] < 0]
            sums = np.zeros((n_texts, K + 2))
            missed = np.bincount(text[wrong], weights=np.log10(1 - p[bit == 0]), minlength=n_texts)
            # Expected and right: the guess or, where it is wrong, the word's own share.
            q, share = p[bit == 1], h[lead[right]]
            for j in range(K):
                own = np.where(share >= 0, plain[share, j], 0.0) if len(plain) else 0.0
                sums[:, j] = missed + np.bincount(text[right], weights=np.log10(q + (1 - q) * own), minlength=n_texts)
            for j in range(K + 2):
                sums[:, j] += np.bincount(text[common], weights=(free if j < K else n)[common] * table[h[common], j], minlength=n_texts)
            n_bytes = n_tokens + np.bincount(text, weights=end - start, minlength=n_texts).astype(np.int64)
            yield first, n_tokens, n_bytes, sums, low, start[rest], end[rest], text[rest], n[rest], free[rest]

    def run(batches):
        for batch in batches:
            for first, n_tokens, n_bytes, sums, low, start, end, owner, n, free in rows_of(batch.column("text")):
                part = batch.slice(first, len(n_tokens))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"), part.column("doc_id"), part.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_bytes, pa.int64()),
                        pa.array(list(sums), pa.list_(pa.float64())), *(pa.nulls(len(part), t) for t in (pa.string(), pa.int64(), pa.int64())),
                    ], names=NAMES,
                )
                keys = part.column("key").to_numpy()[owner]
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
                for a in range(0, len(owner), 200_000):
                    cut = slice(a, a + 200_000)
                    words = _strings(low, start[cut], end[cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[cut]), *(pa.nulls(len(words), t) for t in kinds), words, pa.array(n[cut], pa.int64()), pa.array(free[cut], pa.int64())], names=NAMES,
                    )

    return tidy(run)


def _strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The stretches of raw as strings."""
    to = np.concatenate([[0], np.cumsum(end - start)])
    data = raw[np.arange(to[-1]) + np.repeat(start - to[:-1], end - start)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _log_sum(p: Column, log_q: Column) -> Column:
    """log10 of p + q, where q is given by its logarithm and may be smaller than any double."""
    log_p = F.log10(p)
    top = F.greatest(log_p, log_q)
    return F.when(p > 0, top + F.log10(F.pow(F.lit(10.0), log_p - top) + F.pow(F.lit(10.0), log_q - top))).otherwise(log_q)


NAMES = ["key", "doc_id", "held_out", "n_tokens", "n_bytes", "sums", "word", "n", "free"]


def score(docs: DataFrame, held: Column, class_col: str = "lang", classes: int = CLASSES, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    docs has doc_id, text and the class column; held marks the rows that nothing is learned from. The
    class column is read in training rows only, never for a score. Tokens are words of lower-cased
    (A-Z) text between ASCII white space, then one end. score is log10 of the model's probability of
    the text's tokens, base_score that of add-one unigrams; bits_per_byte is the score in bits over the
    bytes of the words and one byte for each token's end. A rare word that is expected and follows is
    charged its prediction alone, without the share it would have had otherwise, so probabilities add up
    to a little under one. Weights that partitions learn are averaged, so other splits of the table move
    scores slightly. Null and empty texts are one end. Repeated
    rows count each; null ids and classes are allowed; other columns are not looked at. An empty table
    gives no rows. Without training rows every token is unknown and only the untrained speller scores.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col(class_col).cast("string").alias("c"), held.alias("held_out"))
    train = src.where("not held_out")
    sizes = train.groupBy("c").count().orderBy(F.desc("count"), "c").limit(classes - 1).collect()
    names = [r.c for r in sizes if r.c is not None]
    K = len(names) + 1
    k_of = F.lit(K - 1)
    for k, name in enumerate(names):
        k_of = F.when(F.col("c") == name, k).otherwise(k_of)
    k_of = F.when(F.col("held_out"), F.lit(-1)).otherwise(k_of).cast("int")
    n_docs = {r.k: r["count"] for r in train.select(k_of.alias("k")).groupBy("k").count().collect()}
    vocab = src.select(k_of.alias("k"), "text").mapInArrow(_vocabulary(K), "word string, k int, n long").groupBy("word").agg(
        *[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(K)]
    )
    vocab = staged(vocab.withColumn("c", sum((F.col(f"n{k}") for k in range(K)), F.lit(0))), "vocabulary")
    facts = vocab.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count(F.when(F.col("c") > 0, 1)).alias("V"), F.count(F.when(F.col("c") == 1, 1)).alias("once"),
        *[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"N{k}") for k in range(K)], *[F.count(F.when(F.col(f"n{k}") == 1, 1)).alias(f"once{k}") for k in range(K)],
    ).first()
    N, V = facts["N"], facts["V"]
    # Shares by Good and Turing: tokens seen once estimate the mass of unseen ones.
    novel = min(max(facts["once"] / N, 1e-4), 0.5) if N else 1.0
    fresh = [min(max(facts[f"once{k}"] / facts[f"N{k}"] - novel, 0.01), 0.9 - novel) if facts[f"N{k}"] else 1 - novel for k in range(K)]

    known = vocab.where("c > 0 and word <> ''").select("word", "c")
    chunks = known.mapInArrow(_count_task, "chunk int, counts binary")
    # Summed in two steps, so no group grows with the number of tasks.
    chunks = chunks.groupBy("chunk", F.pmod(F.xxhash64(F.substring(F.base64("counts"), 1, 400)), F.lit(16))).applyInArrow(lambda t: _sum_chunk(t), "chunk int, counts binary")
    tables = np.zeros((ORDERS, 2, SLOTS), np.float32)
    for r in chunks.groupBy("chunk").applyInArrow(lambda t: _sum_chunk(t), "chunk int, counts binary").toLocalIterator():
        k, c = divmod(r.chunk, SLOTS)
        tables[k, :, c : c + CHUNK] = np.frombuffer(r.counts, np.float32).reshape(2, CHUNK)
    mixer = trained(known.orderBy(F.xxhash64("word"), "word"), tables)

    spelled = vocab.mapInArrow(_spelled(mixer), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vocab.schema.fields) + ", bits double")
    share = lambda n, total: F.col(n) / F.lit(float(max(total, 1)))
    unseen = F.lit(float(np.log10(novel))) + F.col("bits") * F.lit(float(np.log10(2)))
    model = staged(
        spelled.select(
            "word", "c",
            F.array(
                *[
                    _log_sum(F.lit(float(1 - novel - fresh[k])) * share(f"n{k}", facts[f"N{k}"]) + F.lit(float(fresh[k])) * share("c", N), unseen)
                    for k in range(K)
                ],
                F.log10((F.col("c") + 1) / F.lit(float(N + V + 1))), F.when(F.col("c") > 0, 1.0).otherwise(0.0),
            ).alias("s"),
        ),
        "word-scores",
    )
    top = model.orderBy(F.desc("c"), "word").limit(hot_words).select("word", "s").collect()
    hot = {r.word.encode(): i for i, r in enumerate(top)}
    table = np.array([r.s for r in top], float).reshape(len(top), K + 2)
    past = history.train(train.select("text"))
    rows = src.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "held_out", "text")
    rows = staged(rows.mapInArrow(_split_tokens(hot, table, past), "key long, doc_id long, held_out boolean, n_tokens long, n_bytes long, sums array<double>, word string, n long, free long"), "tokens")
    rest = rows.where("word is not null").select("key", "word", "n", "free").join(model.select("word", "s"), "word")
    rest = rest.groupBy("key").agg(*[F.sum(F.col("free" if j < K else "n") * F.get("s", j)).alias(f"r{j}") for j in range(K + 2)])
    heads = rows.where("word is null").drop("word", "n", "free").join(rest, "key", "left")
    total = [F.get("sums", j) + F.coalesce(f"r{j}", F.lit(0.0)) for j in range(K + 2)]
    priors = [np.log10((n_docs.get(k, 0) + 0.5) / (sum(n_docs.values()) + 0.5 * K)) for k in range(K)]
    each = F.array(*[total[k] + F.lit(float(priors[k])) for k in range(K)])
    best = F.array_max("each")
    mixed = best + F.log10(F.aggregate(F.transform("each", lambda x: F.pow(F.lit(10.0), x - best)), F.lit(0.0), lambda a, x: a + x))
    return heads.withColumn("each", each).select(
        "doc_id", "held_out", "n_tokens", F.round(total[K + 1]).cast("long").alias("n_known"), F.lit(N).cast("long").alias("train_tokens"),
        total[K].alias("base_score"), mixed.alias("score"), (-mixed * F.lit(float(np.log2(10))) / F.col("n_bytes")).alias("bits_per_byte"),
    )
