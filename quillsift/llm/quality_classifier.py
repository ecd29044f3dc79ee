"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE tokens (words and punctuation runs), of which only the document is labelled. Every
passage of the whole text is encoded as FEATURES numbers: mean, least and negative part of hashed token log-odds, shares of
punctuation and of repeated tokens, token length, and signs of the token hashes summed in PLANES planes. Gated attention,
a_k ~ exp(w . (tanh(V h_k) * sigmoid(U h_k))), weighs the passages of a document; a logistic layer scores the weighted
representation. Encoder log-odds are fitted on one part of the labelled sample, attention and scorer on the other.

The target is 1 for ``quality`` 1 and ``toxic`` 0. At most MOST_LABELLED labelled documents, those of the least hash of
doc_id, and of these so many that their whole texts have MOST_BYTES, are fitted on the driver, so fitting costs the same at any
size; scoring is one pass over all documents. ``keep`` is score >= the KEEP_CLEAN quantile of the scores of good documents in the second part, or 1/2 if that is less.

Defined cases: a document without tokens (null or empty text) has no passage, score 0.0 and isn't kept; rows whose labels are
null train nothing, a doc_id labelled twice is good if every label says so; labels of one kind only, or fewer than 8 of
a kind, give every document with tokens score 1.0; rows with null doc_id and repeated rows are scored as any other; texts
count whole; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, slices, stored

PASSAGE = 32
BUCKETS = 1 << 18
PLANES = 16
FEATURES = 7 + PLANES
HIDDEN = 16
MOST_LABELLED = 6000
MOST_BYTES = 128 << 20
STEPS = 200
KEEP_CLEAN = 0.015
CLIP = 4.0


def encoded(w: Words, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages and the document row of each."""
    if not len(w.hash):
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64)
    pos = np.arange(len(w.hash)) - w.first[w.row]
    at = np.flatnonzero(pos % PASSAGE == 0)
    n = np.diff(np.append(at, len(pos))).astype(np.float32)
    o = odds[(w.hash % np.uint64(len(odds))).astype(np.int64)]
    again = np.zeros(len(pos), np.float32)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (pos[1:] > 0)
    x = np.empty((len(at), FEATURES), np.float32)
    x[:, 0] = np.add.reduceat(o, at) / n
    x[:, 1] = np.minimum.reduceat(o, at)
    x[:, 2] = np.add.reduceat(np.minimum(o + 1, 0), at) / np.sqrt(n)
    x[:, 3] = np.add.reduceat((w.kind == 2).astype(np.float32), at) / n
    x[:, 4] = np.add.reduceat(again, at) / n
    x[:, 5] = np.log1p(np.add.reduceat((w.end - w.start).astype(np.float32), at) / n)
    x[:, 6] = np.log1p(n)
    for k in range(PLANES):
        x[:, 7 + k] = np.add.reduceat(((w.hash >> np.uint64(k + 20)) & np.uint64(1)).astype(np.float32) - 0.5, at) / np.sqrt(n)
    return x, w.row[at]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Gated attention over bags and a logistic scorer, fitted by Adam on all bags at once."""

    def __init__(self, features: int, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"V": r.normal(0, 0.2, (features, hidden)), "U": r.normal(0, 0.2, (features, hidden)), "w": r.normal(0, 0.2, hidden), "c": np.zeros(features), "b": np.zeros(1)}
        self.mean, self.sd = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray, first: np.ndarray):
        """``first`` are the offsets at which bags, none of them empty, start."""
        p = self.p
        x = (x - self.mean) / self.sd
        t, g = np.tanh(x @ p["V"]), _sigmoid(x @ p["U"])
        e = (t * g) @ p["w"]
        size = np.diff(np.append(first, len(x)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a /= np.repeat(np.add.reduceat(a, first), size)
        z = np.add.reduceat(x * a[:, None], first)
        return x, t, g, a, size, z, _sigmoid(z @ p["c"] + p["b"][0])

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradient of the log loss, weighted by ``share``, and the scores."""
        h, t, g, a, size, z, out = self.forward(x, first)
        d = share * (out - y)
        dz = np.repeat(d[:, None] * self.p["c"], size, 0)
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), size))
        dt, dg = de[:, None] * self.p["w"] * g * (1 - t * t), de[:, None] * self.p["w"] * t * g * (1 - g)
        return {"V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "b": d.sum()[None]}, out

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = 0.03, decay: float = 1e-3):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for s in range(1, steps + 1):
            grad, _ = self.gradient(x, first, y, share)
            for k in self.p:
                gr = grad[k] + decay * self.p[k] * (k != "b")
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.999 * v[k] + 0.001 * gr * gr
                self.p[k] -= rate * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.999**s)) + 1e-8)
        return self


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> pa.Table:
    """(doc_id, text, y) of at most ``most`` labelled documents of at most ``most_bytes`` in all, in a fixed order; of a repeated doc_id the least text."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    y = known.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("k", F.xxhash64("doc_id"))
    texts = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "k").agg(F.min("text").alias("text")))
    size, take = 0, []
    for r in texts.select("doc_id", F.octet_length("text").alias("n")).orderBy("k", "doc_id").collect():  # ``most`` rows
        size += r["n"] or 0
        if size > most_bytes:
            break
        take.append((r["doc_id"],))
    ids = docs.sparkSession.createDataFrame(take, "doc_id long")
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def fit(table: pa.Table) -> dict | None:
    """Token log-odds, attention model and threshold from labelled texts; None where there are too few of a kind."""
    y = table["y"].to_numpy().astype(np.float64)
    if min(y.sum(), (1 - y).sum()) < 8:
        return None
    part = np.arange(len(y)) % 5 < 3
    bags, at, good, bad = [], 0, np.zeros(BUCKETS), np.zeros(BUCKETS)
    for s in slices(table.combine_chunks().to_batches()):
        w = Words(s.column("text"), punct=True)
        k, mine = (w.hash % np.uint64(BUCKETS)).astype(np.int64), at + w.row
        k = np.unique(mine * BUCKETS + k)  # a document counts once for a token
        k, mine = k % BUCKETS, k // BUCKETS
        good += np.bincount(k[part[mine] & (y[mine] > 0)], minlength=BUCKETS)
        bad += np.bincount(k[part[mine] & (y[mine] == 0)], minlength=BUCKETS)
        bags.append((s, at))
        at += s.num_rows
    share = max((part & (y > 0)).sum(), 1) / max((part & (y == 0)).sum(), 1)
    odds = np.clip(np.log((good + 2 * share) / (bad + 2) / share), -CLIP, CLIP).astype(np.float32)
    xs, rows = [], []
    for s, at in bags:
        x, row = encoded(Words(s.column("text"), punct=True), odds)
        other = ~part[row + at]
        xs.append(x[other])
        rows.append(row[other] + at)
    x, row = np.concatenate(xs).astype(np.float64), np.concatenate(rows)
    if not len(x):
        return None
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    target = y[row[first]]
    model = Attention(FEATURES).fit(x, first, target)
    out = model.forward(x, first)[-1]
    clean = out[target > 0]
    return {"odds": odds, "model": model, "threshold": min(0.5, float(np.quantile(clean, KEEP_CLEAN))) if len(clean) else 0.5}


def scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, score, n_passages, keep) for every row of ``docs``."""
    fitted = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, most)))

    def score(batches):
        f = fitted.value
        for s in slices(batches):
            w = Words(s.column("text"), punct=True)
            n = -(-np.diff(w.first) // PASSAGE)
            out, some = np.zeros(s.num_rows), np.flatnonzero(n)
            if f is None:
                out[some] = 1.0
            elif len(some):
                x, row = encoded(w, f["odds"])
                out[some] = f["model"].forward(x.astype(np.float64), np.flatnonzero(np.append(True, row[1:] != row[:-1])))[-1]
            keep = (out >= (f["threshold"] if f else 0.5)) & (n > 0)
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(np.round(out, 9)), pa.array(n.astype(np.int64)), pa.array(keep)], ["doc_id", "score", "n_passages", "keep"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, n_passages long, keep boolean")
