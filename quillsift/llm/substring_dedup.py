"""Substring dedup by difference-cover anchors: passages of ``LENGTH`` words or more that occur more than once.

Words are compared without regard to case (ASCII and Latin-1) and to what lies between them. COVER is a perfect difference
set modulo PERIOD: for any two positions there is an offset under PERIOD that brings both to a position in it. So a match
of LENGTH words holds one pair of equal windows of WINDOW = LENGTH - PERIOD + 1 words that start at cover positions of both
documents, and hashing those windows, 6 of 31, is enough to find it.

1. Windows at cover positions are hashed and gathered by hash; those that occur twice are anchors.
2. Around its anchors, and only there, a match is extended: the windows of LENGTH words that hold an anchor are hashed at
   every position and gathered by hash. A window that occurs twice is repeated; the least (doc_id, position) is the first.
3. Overlapping windows of a document are merged into spans.

All of it moves in column blocks (numpy arrays by hash bucket), never as pairs of documents, so a passage with
thousands of copies costs as much as its copies and no more. The rule is complete: every repeated window of LENGTH words
is found, up to 64-bit hash collisions.

Defined cases: null, empty and short texts have no spans; rows with null doc_id are not compared and stay as they are;
rows that repeat a doc_id with the same text (but for case) count as one document, those with another text as another, in the
order of a hash of the text; a passage repeated within a document is repeated too; ties are settled by
doc_id and position; texts count whole; an empty table has no spans. Other columns are not read by ``spans``, and ``cut``
passes all on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, buckets, fresh, mix, plain_names, powers, raw, slices, small, stored, unpack

LENGTH = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
MOST_IDS = 2_000_000
FLUSH = 1 << 20

BLOCK = "bucket int, hash binary, doc binary, tie binary, start binary, stop binary"
_NAMES = ["bucket", "hash", "doc", "tie", "start", "stop"]


def _ties(w: Words) -> np.ndarray:
    """A hash of 32 bits of the text of each row, which tells apart rows of one doc_id."""
    p, inv = powers(len(w.buf) + 1)
    total = np.zeros(len(w.buf) + 1, np.uint64)
    np.cumsum((w.buf.astype(np.uint64) + np.uint64(1)) * p[: len(w.buf)], out=total[1:])
    return (mix((total[w.off[1:]] - total[w.off[:-1]]) * inv[w.off[:-1]]) >> np.uint64(32)).astype(np.uint32)


def _windows(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words from the word positions ``at``."""
    p, inv = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[at + length] - total[at]) * inv[at])


class _Blocks:
    """Gathers arrays (key, columns) and hands them on as column blocks by bucket of the key."""

    def __init__(self, n: int):
        self.n, self.held, self.rows = n, [], 0

    def add(self, *columns: np.ndarray):
        self.held.append(columns)
        self.rows += len(columns[0])
        return self.flush() if self.rows >= FLUSH else ()

    def flush(self):
        if not self.rows:
            return
        columns = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.rows = [], 0
        found = list(zip(*blocks(columns[0], self.n, *columns[1:])))
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), *(pa.array(c, pa.binary()) for c in found[1:])], _NAMES[: len(found)])


def _anchors(n: int, window: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def hashed(batches):
        out = _Blocks(n)
        for s in slices(batches):
            w = Words(s.column("text"), in_place=True)
            pos = np.arange(len(w.hash)) - w.first[w.row]
            at = np.flatnonzero(cover[pos % PERIOD] & (np.arange(len(pos)) + window <= w.first[w.row + 1]))
            ids = s.column("doc_id").to_numpy(zero_copy_only=False)
            h = _windows(w.hash, at, window)
            yield from out.add(h, h, ids[w.row[at]], _ties(w)[w.row[at]], pos[at].astype(np.uint32))
        yield from out.flush()

    return hashed


def _repeated(h: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row indexes, in order of (h, *by), of the rows whose h occurs at two different ``by``; whether each is the least of its h."""
    order = np.lexsort((*by[::-1], h))
    g = h[order]
    new = np.append(True, g[1:] != g[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(g)) - 1
    group = np.cumsum(new) - 1
    first = order[new]
    same = np.ones(len(first), bool)
    for b in by:
        same &= b[first] == b[order[last]]
    keep = ~same[group]
    is_first = np.ones(len(g), bool)
    for b in by:
        is_first &= b[order] == b[first][group]
    return order[keep], is_first[keep]


def _by_doc(ids: np.ndarray) -> np.ndarray:
    return mix(ids.view(np.uint64))


def anchored(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tie, marks): for documents that have them, the word positions (uint32) of anchors."""
    n = buckets(docs)
    window = length - PERIOD + 1
    if window < 1:
        raise ValueError(f"length must be at least {PERIOD}")

    def gather(table: pa.Table) -> pa.Table:
        h, doc, tie, pos = (unpack(table[c], t) for c, t in (("hash", np.uint64), ("doc", np.int64), ("tie", np.uint32), ("start", np.uint32)))
        k, _ = _repeated(h, doc, tie, pos)
        found = list(zip(*blocks(_by_doc(doc[k]), n, doc[k], tie[k], pos[k]))) or [()] * 4
        return pa.table([pa.array(found[0], pa.int32()), *(pa.array(c, pa.binary()) for c in found[1:])], ["bucket", "doc", "tie", "start"])

    def by_doc(table: pa.Table) -> pa.Table:
        doc, tie, pos = unpack(table["doc"], np.int64), unpack(table["tie"], np.uint32), unpack(table["start"], np.uint32)
        order = np.lexsort((tie, doc))
        doc, tie, pos = doc[order], tie[order], pos[order]
        at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]))) if len(doc) else np.zeros(0, np.int64)
        return pa.table([pa.array(doc[at], pa.int64()), pa.array(tie[at].astype(np.int64)), pa.array([x.tobytes() for x in np.split(pos, at[1:])] if len(at) else [], pa.binary())], ["doc_id", "tie", "marks"])

    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_anchors(n, window), "bucket int, hash binary, doc binary, tie binary, start binary")
    return hashed.groupBy("bucket").applyInArrow(gather, "bucket int, doc binary, tie binary, start binary").groupBy("bucket").applyInArrow(by_doc, "doc_id long, tie long, marks binary")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, end, first): repeated passages as character offsets [start, end).

    ``first`` spans consist of windows that no other occurrence precedes; the others repeat something earlier.
    """
    return tied_spans(docs, length).drop("tie")


def tied_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """As ``spans``, with the hash of the text that a span is of."""
    n = buckets(docs)
    marks = stored(anchored(docs, length))
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(small(marks, "doc_id", MOST_IDS), "doc_id", "left_semi")

    def extended(batches):
        out = _Blocks(n)
        for s in slices(batches):
            w = Words(s.column("text"), in_place=True)
            edge, ties = np.zeros(len(w.hash) + 1, np.int64), _ties(w)
            for r in np.flatnonzero(ties == s.column("tie").to_numpy()).tolist():
                m = s.column("marks")[r].as_py()
                a = np.frombuffer(m, np.uint32).astype(np.int64) + w.first[r]
                a = a[a < w.first[r + 1]]
                np.add.at(edge, np.maximum(a - PERIOD + 1, w.first[r]), 1)
                np.add.at(edge, a + 1, -1)
            at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            at = at[at + length <= w.first[w.row[at] + 1]]
            buf, _ = raw(s.column("text"))
            chars = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
            base = chars[w.off[w.row[at]]]
            ids = s.column("doc_id").to_numpy(zero_copy_only=False)
            h = _windows(w.hash, at, length)
            yield from out.add(h, h, ids[w.row[at]], ties[w.row[at]], (chars[w.start[at]] - base).astype(np.uint32), (chars[w.end[at + length - 1]] - base).astype(np.uint32))
        yield from out.flush()

    def gather(table: pa.Table) -> pa.Table:
        h, doc, tie = unpack(table["hash"], np.uint64), unpack(table["doc"], np.int64), unpack(table["tie"], np.uint32)
        start, stop = unpack(table["start"], np.uint32), unpack(table["stop"], np.uint32)
        k, first = _repeated(h, doc, tie, start)
        found = list(zip(*blocks(_by_doc(doc[k]), n, doc[k], tie[k], start[k], stop[k], first))) or [()] * 6
        return pa.table([pa.array(found[0], pa.int32()), *(pa.array(c, pa.binary()) for c in found[1:])], ["bucket", "doc", "tie", "start", "stop", "first"])

    def merged(table: pa.Table) -> pa.Table:
        doc, tie, start, stop, first = (unpack(table[c], t) for c, t in (("doc", np.int64), ("tie", np.uint32), ("start", np.uint32), ("stop", np.uint32), ("first", bool)))
        order = np.lexsort((start, first, tie, doc))
        doc, tie, start, stop, first = doc[order], tie[order], start[order].astype(np.int64), stop[order].astype(np.int64), first[order]
        if not len(doc):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())], ["doc_id", "tie", "start", "end", "first"])
        group = np.append(0, np.cumsum((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (first[1:] != first[:-1])))
        reach = np.maximum.accumulate(stop + (group << 33))  # the farthest end so far within a group
        new = np.append(True, (group[1:] != group[:-1]) | (start[1:] + (group[1:] << 33) > reach[:-1]))
        at = np.flatnonzero(new)
        end = (reach - (group << 33))[np.append(at[1:], len(doc)) - 1]
        return pa.table([pa.array(doc[at]), pa.array(tie[at].astype(np.int64)), pa.array(start[at].astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(first[at])], ["doc_id", "tie", "start", "end", "first"])

    dense = known.join(marks, "doc_id").mapInArrow(extended, BLOCK).groupBy("bucket").applyInArrow(gather, "bucket int, doc binary, tie binary, start binary, stop binary, first binary")
    return dense.groupBy("bucket").applyInArrow(merged, "doc_id long, tie long, start int, end int, first boolean")


def cut(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` without the spans that repeat something earlier; a document of which no word is left goes."""
    own = fresh(docs, "spans")
    found = stored(tied_spans(docs, length).where("NOT first").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "tie"))).alias(own)))
    few = found.agg(F.sum(F.size(own))).first()[0] or 0
    names, schema = plain_names(docs), docs.schema
    joined = docs.toDF(*names).join(F.broadcast(found) if few <= MOST_IDS else found, "doc_id", "left")

    def rebuilt(batches):
        for b in batches:
            for s in slices([b]):
                texts, rows = s.column("text").to_pylist(), s.column(own).to_pylist()
                keep, ties = np.ones(s.num_rows, bool), _ties(Words(s.column("text"), in_place=True)) if any(rows) else ()
                for i, cuts in enumerate(rows):
                    if cuts := [c for c in cuts or () if c["tie"] == ties[i]]:
                        t, at, parts = texts[i], 0, []
                        for c in cuts:
                            parts.append(t[at : c["start"]])
                            at = c["end"]
                        texts[i] = "".join([*parts, t[at:]])
                        keep[i] = any(ch.isalnum() for ch in texts[i])
                columns = [pa.array(texts, s.schema.field("text").type) if c == "text" else s.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(keep))

    return joined.select(*[F.col(f"`{c}`") for c in names], own).mapInArrow(rebuilt, schema)
