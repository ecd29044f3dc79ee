"""Quality rules: hashed n-gram log-likelihood ratio of trusted target text against the raw corpus.

Words and punctuation runs, and pairs of them, are hashed with the document's language into the lower and the upper half of
BUCKETS. Two multinomials are counted over whole texts: over every document, and over the trusted ones (``quality`` 1 and
``toxic`` 0 in ``labels``), whose counts are scaled by language, in units of 1 / UNIT, to the size of the raw corpus; all sums are of
whole numbers, so they are the same in any order. A document's score is the mean
over its tokens of log(p_target / p_raw) and PAIRS times the mean over its pairs, length-normalised both. Its own counts are
taken out of both multinomials first, so a trusted document is judged like any other, and a word of no other document is
neutral. Both are smoothed by the same prior mass.

Trusted documents are scored first. The threshold of a language is the LOWEST quantile of their scores, to four decimals;
every document under its language's threshold is rejected.

Defined cases: a null or empty text, or one without any token, scores 0.0 and is rejected, as nothing speaks for it; a null
doc_id is scored like any other and joins no label; a null language, or a table without that column, is a language of its own;
documents with a token in a language without trusted text score 0.0 and are kept, as nothing speaks against them, and so are
all if nothing is trusted; repeated rows are each counted and each scored; a document labelled more than once is trusted if no
label of it is bad (a null label is bad); an empty table gives an empty result. Other columns are ignored by ``scores`` and
passed on by ``keep_good``. A tie with the threshold is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fresh, mix, plain_names, slices, small

BUCKETS = 1 << 20
LOWEST = 0.02
PRIOR = 3.0
PAIRS = 0.1
UNIT = 1 << 16
MOST_IDS = 2_000_000


def _buckets(w: Words, salt: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of tokens and pairs; ``salt`` is the hash of each row's language."""
    half = np.uint64(n // 2)
    (u, ur), (b, br) = w.grams(1), w.grams(2)
    u, b = (mix(h + salt[r]) % half for h, r in ((u, ur), (b, br)))
    return np.concatenate([u, half + b]).astype(np.int64), np.concatenate([ur, br])


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(good).alias("g")).where("g").select("doc_id")


class Rule:
    """The counts of a corpus and of what is trusted in it, and the decisions that follow."""

    def __init__(self, docs: DataFrame, labels: DataFrame, lowest: float = LOWEST, n: int = BUCKETS, most_ids: int = MOST_IDS):
        self.docs, self.n = docs, n
        self.language, self.scale = fresh(docs, "language"), fresh(docs, "scale")
        self.ids = small(trusted_ids(labels), "doc_id", most_ids).withColumn(self.scale, F.lit(1.0))
        marked = self._marked(docs.select("doc_id", "text", *[c for c in docs.columns if c.lower() == "lang"]))
        size = F.octet_length("text")
        sums = marked.groupBy(self.language).agg(F.sum(size).alias("raw"), F.sum(F.when(F.col(self.scale) > 0, size)).alias("good"))
        scales = {r[0]: round(r["raw"] / r["good"] * UNIT) / UNIT for r in sums.collect() if r["good"]}  # a row a language
        self.scales = scales
        t = self._counted(marked, scales).toArrow()  # n rows at most
        at = t["bucket"].to_numpy()
        raw, target = np.zeros(n, np.float32), np.zeros(n, np.float32)
        raw[at], target[at] = t["raw"].to_numpy(), t["target"].to_numpy() / UNIT
        one = sum(scales.values()) / len(scales) if scales else 1.0
        self.prior = PRIOR * one
        self.table = docs.sparkSession.sparkContext.broadcast((raw, target))
        self.thresholds = self._thresholds(marked, lowest)

    def _marked(self, docs: DataFrame) -> DataFrame:
        lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in [c.lower() for c in docs.columns] else F.lit("")
        return docs.join(self.ids, "doc_id", "left").select(*[F.col(f"`{c}`") for c in docs.columns], lang.alias(self.language), F.coalesce(self.scale, F.lit(0.0)).alias(self.scale))

    def _rows(self, s: pa.RecordBatch, scales: dict):
        """Hash of the language of each row, and the scale of what is trusted, 0 of what isn't."""
        names = s.column(self.language).to_pylist()
        salt = {x: np.uint64(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(names)}
        scale = s.column(self.scale).to_numpy(zero_copy_only=False) * np.array([scales.get(x, 0.0) for x in names])
        return np.array([salt[x] for x in names], np.uint64), scale, np.array([x in scales for x in names], bool)

    def _counted(self, marked: DataFrame, scales: dict) -> DataFrame:
        n = self.n

        def count(batches):
            total, target = np.zeros(n, np.int64), np.zeros(n)  # both of whole numbers
            for s in slices(batches):
                salt, scale, _ = self._rows(s, scales)
                k, row = _buckets(Words(s.column("text"), punct=True), salt, n)
                total += np.bincount(k, minlength=n)
                mine = np.flatnonzero(scale[row] > 0)
                target += np.bincount(k[mine], np.round(scale[row[mine]] * UNIT), minlength=n)
            at = np.flatnonzero(total)
            for i in range(0, len(at), 1 << 16):
                j = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(total[j]), pa.array(target[j].astype(np.int64))], ["bucket", "raw", "target"])

        counted = marked.select("text", self.language, self.scale).mapInArrow(count, "bucket int, raw long, target long")
        return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))

    def _thresholds(self, marked: DataFrame, lowest: float) -> dict[str, float]:
        def score(batches):
            for s in slices(batches):
                x, many = self.scored(s)
                yield pa.RecordBatch.from_arrays([s.column(self.language), pa.array(np.round(x * 1e4).astype(np.int64)), pa.array(many)], ["language", "score", "tokens"])

        mine = marked.where(F.col(self.scale) > 0).select("text", self.language, self.scale).mapInArrow(score, "language string, score long, tokens long")
        found: dict[str, list] = {}
        for r in mine.where("tokens > 0").groupBy("language", "score").count().orderBy("score").collect():  # rounded scores: some thousands at most
            found.setdefault(r["language"], []).append((r["score"], r["count"]))
        out = {}
        for language, some in found.items():
            value, n = (np.array(c) for c in zip(*some))
            out[language] = float(value[np.searchsorted(np.cumsum(n), lowest * n.sum(), "right")]) / 1e4
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("docs", "ids")}

    def scored(self, s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of tokens of each row."""
        raw, target = self.table.value
        n, rows = self.n, s.num_rows
        salt, scale, known = self._rows(s, self.scales)
        w = Words(s.column("text"), punct=True)
        k, row = _buckets(w, salt, n)
        key, own = np.unique(row * n + k, return_counts=True)
        row, k = np.divmod(key, n)
        llr = np.log((np.maximum(target[k] - own * scale[row], 0) + self.prior) / (np.maximum(raw[k] - own, 0) + self.prior)) * own
        pair = k >= n // 2
        many = np.diff(w.first)
        x = np.bincount(row[~pair], llr[~pair], minlength=rows) / np.maximum(many, 1) + PAIRS * np.bincount(row[pair], llr[pair], minlength=rows) / np.maximum(many - 1, 1)
        return np.where(known, np.round(x, 4), 0.0), many.astype(np.int64)

    def judged(self, s: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, number of tokens and decision of each row."""
        x, many = self.scored(s)
        least = np.array([self.thresholds.get(y, -np.inf) for y in s.column(self.language).to_pylist()], float)
        return x, many, (many > 0) & (x >= least - 1e-9)

    def scores(self) -> DataFrame:
        def score(batches):
            for s in slices(batches):
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), *(pa.array(x) for x in self.judged(s))], ["doc_id", "score", "n_tokens", "keep"])

        docs = self.docs.select("doc_id", "text", *[c for c in self.docs.columns if c.lower() == "lang"])
        return self._marked(docs).mapInArrow(score, "doc_id long, score double, n_tokens long, keep boolean")

    def kept(self) -> DataFrame:
        names, own = plain_names(self.docs), self.docs.columns

        def keep(batches):
            for s in slices(batches):
                ok = pa.array(self.judged(s)[2])
                yield pa.RecordBatch.from_arrays([s.column(c) for c in names], own).filter(ok)

        return self._marked(self.docs.toDF(*names)).mapInArrow(keep, self.docs.schema)


def scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score, n_tokens, keep) for every row of ``docs``."""
    return Rule(docs, labels, **options).scores()


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rule keeps, with all their columns."""
    return Rule(docs, labels, **options).kept()
