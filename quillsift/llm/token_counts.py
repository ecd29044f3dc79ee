"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens by the rules of the published byte-level pattern (contractions, letters, digits, other signs,
each with one blank before it, and white space), worked out on arrays of character classes. The distinct pre-tokens that a
worker hasn't met lie end to end in one ragged array of symbols; in a round every sequence merges its own lowest-rank pair,
wherever that pair stands, and sequences without a pair of known rank leave with the number of symbols that survive. A
pre-token that is in the vocabulary as a whole counts 1. Counts equal those of the vocabulary's own encoder.

The vocabulary is a file of "base64 rank" lines whose path is a parameter; it is read once, by the driver, and its pair
table, of fixed size, is broadcast.

Defined cases: a null text has a null count, an empty one 0; special-token strings are ordinary text; texts count whole,
however long; repeated rows are each counted; null ids pass; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import mix, powers, raw, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_KNOWN = 2_000_000
NONE = np.int32(2**31 - 1)
OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
_state: dict = {}


def classes() -> np.ndarray:
    if "classes" not in _state:
        points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
        every, table = points.tobytes().decode("utf-32-le"), np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start() : m.end()]] = kind
        _state["classes"] = table
    return _state["classes"]


def pretokens(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; ``rows`` are the n + 1 offsets of the texts."""
    n, c = len(points), classes()[points]
    new = np.zeros(n + 1, bool)
    new[rows] = True
    start = new.copy()
    start[1:n] |= c[1:] != c[:-1]
    start, new = start[:n], np.append(new[:n], True)
    # the last sign of white space before something else: a blank joins what follows, another stands alone
    last = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & ~new[1:n]) if n > 1 else np.zeros(0, np.int64)
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # contractions, where an apostrophe is the first sign of a pre-token
    q = np.flatnonzero((points == 0x27) & start)
    q = q[(q + 1 < n)]
    q = q[~new[q + 1]]
    one = q[np.isin(points[q + 1], [ord(x) for x in "stmd"])]
    two = q[q + 2 < n]
    two = two[~new[two + 2]]
    pair = points[two + 1].astype(np.int64) * 0x110000 + points[two + 2]
    two = two[np.isin(pair, [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])]
    start[one + 1] = False
    start[two + 1] = False
    for at in (one + 2, two + 3):
        start[at[at < n]] = True
    return start


def vocabulary(path: str) -> dict:
    """Ranks of single bytes, sorted keys (a * size + b) and ranks of the pairs that merge, and hashes of all entries."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    size = max(ranks.values()) + 1
    keys, to = [], []
    for token, r in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                keys.append(a * size + b)
                to.append(r)
    order = np.argsort(keys)
    tokens = list(ranks)
    lens = np.array([len(t) for t in tokens])
    ends = np.cumsum(lens)
    known = np.unique(hashed(np.frombuffer(b"".join(tokens), np.uint8), ends - lens, ends))
    return {"size": size, "byte": np.array([ranks[bytes([i])] for i in range(256)], np.int32), "keys": np.array(keys, np.int64)[order], "to": np.array(to, np.int32)[order], "known": known}


def hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * inv[start]) ^ (end - start).astype(np.uint64)


def merged(buf: np.ndarray, lens: np.ndarray, v: dict) -> np.ndarray:
    """Symbols that survive of each of the sequences (all of one byte or more) that lie end to end in ``buf``."""
    count, ids = np.ones(len(lens), np.int64), np.arange(len(lens))
    sym, lens = v["byte"][buf], lens.astype(np.int64)
    keys, to = v["keys"], v["to"]
    rank = None
    while len(sym):
        at = np.cumsum(lens) - lens
        if rank is None:
            rank = np.full(len(sym), NONE)
            todo = np.arange(len(sym) - 1)
        if len(todo):
            k = sym[todo].astype(np.int64) * v["size"] + sym[todo + 1]
            i = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            rank[todo] = np.where(keys[i] == k, to[i], NONE)
        rank[at + lens - 1] = NONE
        least = np.minimum.reduceat(rank, at)
        going = least < NONE
        count[ids[~going]] = lens[~going]
        if not going.all():
            stay = np.repeat(going, lens)
            sym, rank, lens, ids, least = sym[stay], rank[stay], lens[going], ids[going], least[going]
            if not len(sym):
                break
        hit = rank == np.repeat(least, lens)
        h = np.flatnonzero(hit)
        run = np.append(True, h[1:] != h[:-1] + 1)  # of pairs that overlap, every other one from the left
        first = np.flatnonzero(run)
        h = h[(np.arange(len(h)) - first[np.cumsum(run) - 1]) % 2 == 0]
        sym[h] = rank[h]
        keep = np.ones(len(sym), bool)
        keep[h + 1] = False
        seq = np.repeat(np.arange(len(lens)), lens)
        lens = lens - np.bincount(seq[h], minlength=len(lens))
        place = np.cumsum(keep) - 1
        sym, rank = sym[keep], rank[keep]
        m = place[h]
        todo = np.unique(np.concatenate([m, m[m > 0] - 1]))
        todo = todo[todo < len(sym) - 1]
    return count


class Counter:
    """Counts tokens of texts; remembers the pre-tokens that it has met, up to ``MOST_KNOWN`` of them."""

    def __init__(self, v: dict):
        self.v = v
        self.forget()

    def forget(self):
        self.hash, self.n = self.v["known"], np.ones(len(self.v["known"]), np.int32)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        buf, off = raw(texts)
        if not len(buf):
            return np.zeros(len(texts), np.int64)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)  # bytes at which code points start
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        rows = np.searchsorted(lead, off)
        start = np.flatnonzero(pretokens(points, rows))
        at = lead[start]
        end = np.append(at[1:], len(buf))
        h, where, back = np.unique(hashed(buf, at, end), return_index=True, return_inverse=True)
        i = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        got = self.hash[i] == h
        n = np.where(got, self.n[i], 0)
        if not got.all():
            new = where[~got]
            lens = end[new] - at[new]
            take = np.repeat(at[new] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            n[~got] = merged(buf[take], lens, self.v)
            if len(self.hash) > MOST_KNOWN:
                self.forget()
            place = np.searchsorted(self.hash, h[~got])
            self.hash, self.n = np.insert(self.hash, place, h[~got]), np.insert(self.n, place, n[~got])
        row = np.searchsorted(off, at, "right") - 1
        return np.bincount(row, n[back], minlength=len(texts)).astype(np.int64)


def counts(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def count(batches):
        counter = Counter(table.value)
        for s in slices(batches):
            text = s.column("text")
            n = pa.array(counter(text), pa.int64(), mask=pc.is_null(text).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), n], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")
