"""LM scoring with a log-frequency Bloom filter.

All n-grams of words (lower-cased) up to ORDER 2 of all documents are counted. A count c is quantised to the level
q = 1 + floor(log2 c), and the filter holds the items (n-gram, level) for every level from 1 up to q, so it is the model of
all counts. A document's own counts are part of the model. A count is read back by probing level after level until one
is missing: an n-gram is never taken for rarer than it is, and taken for more frequent by a level with a chance of
2 ** -PROBES. The count of level q is (2 ** (q - 1) + 2 ** q - 1) / 2. A word's probability is interpolated,
p(w | v) = WEIGHT * c(vw) / c(v) + (1 - WEIGHT) * p(w), with p(w) = (c(w) + 1/2) / (N + V/2 + 1/2).

Counting moves column blocks by n-gram hash; the task that has summed a block's counts makes that block of the filter, so no
table of n-grams is ever collected. The filter grows with the corpus. Up to MOST_BYTES it is broadcast in one piece; beyond,
it is cut into shards of that size which are broadcast one after another, each pass adding to a byte of level for each n-gram
of each document, written to the shared folder between passes. Both ways give the same scores.

Defined cases: a document without words (null or empty text) has 0 words, log_prob 0.0 and perplexity null; the first word
of a text has no history; rows with null doc_id and repeated rows are counted and scored as any other; texts count whole; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, buckets, mix, slices, stored, unpack

PROBES = 8
BITS = 12  # for each item, of which PROBES / ln 2 are needed
WEIGHT = 0.7
MOST_BYTES = 256 << 20
LEVELS = 48
FLUSH = 3 << 20
PAIR = np.uint64(0x5851F42D4C957F2D)
STEP = np.uint64(0xD1342543DE82EF95)


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, whose last bit is 0, and of the pairs, whose last bit is 1, and the position of each pair's second word."""
    one = np.uint64(1)
    h = w.hash & ~one
    second = np.flatnonzero(w.row[1:] == w.row[:-1]) + 1
    return h, mix(h[second - 1] * PAIR + h[second]) | one, second


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def level(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], LEVELS)


def count_of(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, (np.exp2(q - 1.0) + np.exp2(q.astype(np.float64)) - 1) / 2, 0.0)


def _item(h: np.ndarray, q) -> tuple[np.ndarray, np.ndarray]:
    g = mix(h + np.asarray(q, np.uint64) * STEP)
    return g, mix(g) | np.uint64(1)


def filter_blocks(docs: DataFrame) -> DataFrame:
    """(bucket, bits, data, words, distinct): the blocks of the filter; words and distinct words counted in each."""
    n = buckets(docs)

    def count(batches):
        held, rows = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            found = list(zip(*blocks(h, n, h, c.astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.binary()), pa.array(found[2], pa.binary())], ["bucket", "hash", "count"])

        for s in slices(batches):
            words, pairs, _ = _grams(Words(s.column("text")))
            held += [words, pairs]
            rows += len(words) + len(pairs)
            if rows >= FLUSH:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    def build(key, table):
        h, c = unpack(table["hash"], np.uint64), unpack(table["count"], np.uint32)
        order = np.argsort(h)
        h, c = h[order], c[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, c = h[at], np.add.reduceat(c, at)
        word = (h & np.uint64(1)) == 0
        q = level(c)
        bits = max(64, int(q.sum()) * BITS)
        data = np.zeros(bits, bool)
        for j in range(1, int(q.max()) + 1):
            g, step = _item(h[q >= j], j)
            for _ in range(PROBES):
                data[(g % np.uint64(bits)).astype(np.int64)] = True
                g = g + step
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.int64()), "data": pa.array([np.packbits(data).tobytes()], pa.binary()), "words": pa.array([int(c[word].sum())], pa.int64()), "distinct": pa.array([int(word.sum())], pa.int64())})

    counted = docs.select("text").mapInArrow(count, "bucket int, hash binary, count binary")
    return counted.groupBy("bucket").applyInArrow(build, "bucket int, bits long, data binary, words long, distinct long")


class Filter:
    """The blocks of some buckets, ready for probing."""

    def __init__(self, n: int, table: pa.Table):
        self.n, self.bits, self.start = n, np.zeros(n, np.uint64), np.zeros(n, np.int64)
        b, data = table["bucket"].to_numpy(), table["data"].to_pylist()
        self.bits[b] = table["bits"].to_numpy()
        size = np.array([len(x) for x in data], np.int64)
        self.start[b] = (np.cumsum(size) - size) * 8
        self.data = np.frombuffer(b"".join(data), np.uint8)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The level of each hash; 0 of what isn't there or is in a bucket of another shard."""
        h, back = np.unique(h, return_inverse=True)
        q = np.zeros(len(h), np.uint8)
        bits, start = self.bits[b := _bucket(h, self.n)], self.start[b]
        left = np.flatnonzero(bits > 0)
        for j in range(1, LEVELS + 1):
            g, step = _item(h[left], j)
            ok = np.arange(len(left))
            for _ in range(PROBES):
                at = (g[ok] % bits[left[ok]]).astype(np.int64) + start[left[ok]]
                ok = ok[(self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
                g = g + step
                if not len(ok):
                    break
            left = left[ok]
            q[left] = j
            if not len(left):
                break
        return q[back]


def _log_probs(q1: np.ndarray, q2: np.ndarray, second: np.ndarray, words: int, distinct: int) -> np.ndarray:
    c1, c2 = count_of(q1), count_of(q2)
    p = (c1 + 0.5) / (words + distinct / 2 + 0.5)
    history = c1[second - 1]
    out = p.copy()
    some = history > 0
    out[second[some]] = WEIGHT * np.minimum(c2[some] / history[some], 1.0) + (1 - WEIGHT) * p[second[some]]
    return np.log(out)


def scores(docs: DataFrame, corpus: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row of ``docs`` under the model of ``corpus`` (``docs`` itself by default)."""
    corpus = docs if corpus is None else corpus
    spark, n = docs.sparkSession, buckets(corpus)
    built = stored(filter_blocks(corpus))
    about = built.select("bucket", "words", "distinct", F.octet_length("data").alias("bytes")).orderBy("bucket").collect()  # a row a block
    words, distinct = sum(r["words"] for r in about), sum(r["distinct"] for r in about)
    shards, held = [[]], 0
    for r in about:
        if shards[-1] and held + r["bytes"] > most_bytes:
            shards.append([])
            held = 0
        shards[-1].append(r["bucket"])
        held += r["bytes"]

    def shard(part):
        low, high = (part[0], part[-1]) if part else (0, -1)
        return spark.sparkContext.broadcast(Filter(n, built.select("bucket", "bits", "data").where(F.col("bucket").between(low, high)).toArrow()))

    def result(s, w, q1, q2, second):
        lp = _log_probs(q1, q2, second, words, distinct)
        total = np.bincount(w.row, lp, minlength=s.num_rows).astype(np.float64)  # of no words it is whole numbers
        many = np.diff(w.first)
        with np.errstate(invalid="ignore", divide="ignore"):
            each = np.exp(np.minimum(-total / many, 700))
        return pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(many.astype(np.int64)), pa.array(total), pa.array(each, mask=many == 0)], ["doc_id", "n_words", "log_prob", "perplexity"])

    out = "doc_id long, n_words long, log_prob double, perplexity double"
    if len(shards) == 1:
        model = shard(shards[0])

        def score(batches):
            for s in slices(batches):
                w = Words(s.column("text"))
                h, pairs, second = _grams(w)
                yield result(s, w, model.value.levels(h), model.value.levels(pairs), second)

        return docs.select("doc_id", "text").mapInArrow(score, out)

    state = docs.select("doc_id", "text", F.lit(b"").alias("levels"))
    for part in shards:
        model = shard(part)

        def fill(batches, model=model):
            for s in slices(batches):
                w = Words(s.column("text"))
                h, pairs, second = _grams(w)
                q1, q2 = model.value.levels(h), model.value.levels(pairs)
                e1, e2, rows = w.first, np.searchsorted(w.row[second], np.arange(s.num_rows + 1)), []
                for r, old in enumerate(s.column("levels").to_pylist()):
                    q = np.concatenate([q1[e1[r] : e1[r + 1]], q2[e2[r] : e2[r + 1]]])
                    rows.append((q | np.frombuffer(old, np.uint8) if old else q).tobytes())
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), s.column("text"), pa.array(rows, pa.binary())], ["doc_id", "text", "levels"])

        state = stored(state.mapInArrow(fill, "doc_id long, text string, levels binary"))
        model.destroy()

    def finish(batches):
        for s in slices(batches):
            w = Words(s.column("text"))
            _, _, second = _grams(w)
            q1, q2 = np.zeros(len(w.hash), np.uint8), np.zeros(len(second), np.uint8)
            e1, e2 = w.first, np.searchsorted(w.row[second], np.arange(s.num_rows + 1))
            for r, q in enumerate(s.column("levels").to_pylist()):
                q, k = np.frombuffer(q, np.uint8), e1[r + 1] - e1[r]
                q1[e1[r] : e1[r + 1]], q2[e2[r] : e2[r + 1]] = q[:k], q[k:]
            yield result(s, w, q1, q2, second)

    return state.mapInArrow(finish, out)
