"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its 2-word shingles (words lower-cased; one word alone is its own shingle). ``T`` minhash values
stand for it. A tree starts with all documents in its root; a document goes down to a child for each of its minwise
tokens (position, value) whose hash with the node is under 1 / (``LAMBDA`` * T), so two documents meet in a child with the
chance that they share such a token, about one child a level for a pair of similarity LAMBDA. Nodes of up to ``SMALL``
documents, and those DEPTH levels down, are compared exhaustively by sketch, larger ones branch again. The number of independent
trees follows from DEPTH: so many that a pair at the threshold is met in the deepest nodes, and kept by its sketch's estimate, with
a chance of RECALL (see ``recall``; pairs met higher up have more). Every candidate is confirmed on whole shingle sets.

Documents of the same shingles (exact copies above all) are linked to the least doc_id first, and one of them represents
the rest in the join. A compared node first reports ``FORESTS`` edge-disjoint maximum spanning forests of its candidate pairs
(all pairs of a node of up to 8). What these leave out comes second: documents of such pairs meet in their node again with
their whole shingle sets, and each pair whose ends are not yet joined by confirmed edges is confirmed or struck out there. So
a group of thousands costs thousands of pairs, not millions, and no candidate pair goes unverified that could join two groups.
Groups are the connected components of all confirmed pairs.

The first level, and any deeper level of nodes with more than ``LARGE`` documents, is spread over the cluster; smaller nodes
branch inside one task, many nodes at a time. All documents of a node of more than LARGE are compared with its first one and become
candidates with it as any other pair; those whose sketch is the first one's by CLOSE and more are represented by it in that node and
branch no further there, so a text with a hundred thousand near copies doesn't fill nodes at every level. Agreement of sketches obeys the
triangle inequality: what is a candidate with a represented document agrees with the first one by threshold - SLACK + CLOSE - 1
at least. Documents of that ring which no confirmed edges have joined to the first one's group are compared with all that it represents.

Defined cases: documents without any word (null or empty text) are in no group; rows with null doc_id are in none and
always stay; rows that repeat a doc_id are one document, kept or dropped together, which is near another if any of its texts
is; ties are settled by the least doc_id; long texts count as a whole; an empty table has no groups. Other columns are not read by ``groups``, and
``one_of_each`` passes all on.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, Words, buckets, mix, short_batches, slices, small, stored, unpack

T = 64
LAMBDA = 0.55
RECALL = 0.95
SMALL = 512
LARGE = 20_000
DEPTH = 6
SLACK = 0.15
CLOSE = 0.9
FORESTS = 3
MOST_PAIRS = 1 << 18
SETS = 32 << 20
MOST_IDS = 2_000_000
MOST_NODES = 50_000
FACTORS = np.random.default_rng(20180405).integers(1, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall(similarity: float, depth: int, trees: int, threshold: float = LAMBDA) -> float:
    """Chance that a pair meets in a node ``depth`` levels down in any of the trees and isn't lost by its sketches' estimate.

    Both hang on how many of the T minhash values agree, which varies about the similarity.
    """
    out = 0.0
    for k in range(math.ceil((threshold - SLACK) * T), T + 1):
        meet = 1.0
        for _ in range(depth):
            meet = 1 - math.exp(-k / T / threshold * meet)
        out += math.comb(T, k) * similarity**k * (1 - similarity) ** (T - k) * (1 - (1 - meet) ** trees)
    return out


#: The least number of trees that reaches RECALL at the threshold in nodes of any depth.
TREES = next(n for n in range(1, 1000) if recall(LAMBDA, DEPTH, n) >= RECALL)


def _shingles(w: Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    g, row = w.grams(2)
    single = np.flatnonzero(np.diff(w.first) == 1)
    if len(single):
        g, row = np.concatenate([g, w.hash[w.first[single]]]), np.concatenate([row, single])
        order = np.argsort(row, kind="stable")
        g, row = g[order], row[order]
    return g, row


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, size, same, minhash): ``same`` is equal for documents of the same shingles; minhash holds T 32-bit values."""

    def sketch(batches):
        for s in slices(batches):
            g, row = _shingles(Words(s.column("text")), s.num_rows)
            have, at = np.unique(row, return_index=True)
            if not len(have):
                continue
            low = np.empty((len(have), T), np.uint64)
            v = np.empty_like(g)
            for k in range(T):
                np.multiply(g, FACTORS[k], out=v)
                low[:, k] = np.minimum.reduceat(v, at)
            same = np.add.reduceat(mix(g), at).view(np.int64)
            size = np.diff(np.append(at, len(g)))
            low = (mix(low) >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [s.column("doc_id").take(pa.array(have)), pa.array(size), pa.array(same), pa.array([x.tobytes() for x in low], pa.binary())],
                ["doc_id", "size", "same", "minhash"],
            )

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(sketch, "doc_id long, size long, same long, minhash binary")


def _children(node: np.ndarray, low: np.ndarray):
    """(row, child) of the minwise tokens that rows of minhash values ``low`` choose in their nodes."""
    token = mix(low.astype(np.uint64) + (np.arange(T, dtype=np.uint64) << np.uint64(32)))
    draw = mix(token ^ node[:, None])
    row, k = np.nonzero(draw < np.uint64(int((1 << 64) / (LAMBDA * T))))
    return row, mix(draw[row, k] * P)


def _branch(batches, trees: int):
    """Children of rows of the sketch table: of the roots, or of the column ``node`` where there is one."""
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            s = b.slice(at, 4096)
            low = unpack(s.column("minhash"), np.uint32).reshape(-1, T)
            sketch = (low & np.uint32(255)).astype(np.uint8)
            ids = s.column("doc_id").to_numpy()
            for r in range(trees):
                node = s.column("node").to_numpy().view(np.uint64) if "node" in s.schema.names else np.full(len(low), mix(np.array([r + 1], np.uint64) * P)[0])
                row, child = _children(node, low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), pa.array(ids[row]), pa.array([x.tobytes() for x in sketch[row]], pa.binary())], ["node", "doc_id", "sketch"]
                )


NODES = "node long, doc_id long, sketch binary"


def leaves(reps: DataFrame, trees: int = TREES, large: int = LARGE, least: float = LAMBDA - SLACK) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(node, doc_id, sketch, level) of all nodes of up to ``large`` documents, or of depth DEPTH; (a, b): candidates with the first ones of larger nodes;
    (node, doc_id, sketch, first, agree): what those represent, and what may be a candidate with it."""
    level = reps.select("doc_id", "minhash").mapInArrow(lambda b: _branch(b, trees), NODES)
    found, led, ring = None, None, None
    for depth in range(1, DEPTH + 1):
        over = stored(level.groupBy("node").count().where(F.col("count") > large).select("node"))
        n = over.count()
        rest = level
        if n:
            over = F.broadcast(over) if n <= MOST_NODES else over
            rest = level.join(over, "node", "left_anti")
        rest = rest.withColumn("level", F.lit(depth))
        found = rest if found is None else found.unionByName(rest)
        if not n:
            return found, led, ring
        lead = level.join(over, "node").groupBy("node").agg(F.min(F.struct(F.col("doc_id").alias("first"), F.col("sketch").alias("lead"))).alias("l")).select("node", "l.*")
        held = stored(level.join(F.broadcast(lead) if n <= MOST_NODES else lead, "node").mapInArrow(_compared_with_first, "node long, doc_id long, sketch binary, first long, agree double"))
        met = held.where((F.col("agree") >= least) & (F.col("doc_id") != F.col("first"))).select(F.least("first", "doc_id").alias("a"), F.greatest("first", "doc_id").alias("b"))
        led = met if led is None else led.union(met)
        near = held.where(F.col("agree") >= least + CLOSE - 1 - 1e-9)
        ring = near if ring is None else ring.union(near)
        stay = held.where((F.col("agree") < CLOSE) | (F.col("doc_id") == F.col("first"))).select("node", "doc_id", "sketch")
        if depth == DEPTH:
            return found.unionByName(stay.withColumn("level", F.lit(depth))), led, ring
        level = stored(stay.select("node", "doc_id").join(reps.select("doc_id", "minhash"), "doc_id").mapInArrow(lambda b: _branch(b, 1), NODES))
    return found, led, ring


def _compared_with_first(batches):
    for s in batches:
        agree = _agreement(unpack(s.column("sketch"), np.uint8).reshape(-1, T), unpack(s.column("lead"), np.uint8).reshape(-1, T))
        yield pa.RecordBatch.from_arrays([s.column("node"), s.column("doc_id"), s.column("sketch"), s.column("first"), pa.array(agree)], ["node", "doc_id", "sketch", "first", "agree"])


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the T bytes of sketches are equal, by eights: no byte of their sum passes T."""
    same = np.equal(a, b, order="C").view(np.uint64)
    return ((same.sum(-1, dtype=np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype(np.uint8)


#: The similarity that each number of equal bytes stands for.
ESTIMATES = (np.arange(T + 1) / T - 1 / 256) / (1 - 1 / 256)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ESTIMATES[_equal(a, b)]


def _forests(a: np.ndarray, b: np.ndarray, agree: np.ndarray, n: int) -> list[np.ndarray]:
    """Indexes of the edges of each of FORESTS edge-disjoint maximum spanning forests."""
    left, forests = np.argsort(-agree.astype(np.int16), kind="stable").tolist(), []
    a, b = a.tolist(), b.tolist()
    for _ in range(FORESTS):
        root, rest, kept = list(range(n)), [], []
        for i, e in enumerate(left):
            x, y = a[e], b[e]
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            if x != y:
                root[x] = y
                kept.append(e)
                if len(kept) == n - 1:
                    rest += left[i + 1 :]
                    break
            else:
                rest.append(e)
        left = rest
        forests.append(np.array(kept, np.int64))
    return forests


def _levels(a: np.ndarray, b: np.ndarray, agree: np.ndarray, n: int) -> np.ndarray:
    """(T + 1, n): the trees of a forest without the edges that agree in less than 0 to T bytes."""
    out, root = np.empty((T + 1, n), np.int32), list(range(n))
    order = np.argsort(agree, kind="stable")
    edge = np.searchsorted(agree[order], np.arange(T + 2))
    for k in range(T, -1, -1):
        some = order[edge[k] : edge[k + 1]]
        if not len(some) and k < T:
            out[k] = out[k + 1]
            continue
        for x, y in zip(a[some].tolist(), b[some].tolist()):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            while root[y] != y:
                root[y] = root[root[y]]
                y = root[y]
            root[x] = y
        r = np.array(root, np.int32)
        while (r[r] != r).any():
            r = r[r]
        out[k] = r
    return out


def _bands(sk: np.ndarray, least: float, rows: int | None = None):
    """Candidate pairs (i, j, equal bytes), i < j, of one node, a band of rows at a time; of the first ``rows`` rows with all, if given."""
    n, low = len(sk), np.searchsorted(ESTIMATES, least)
    rows = n - 1 if rows is None else rows
    band = max(1, 4_000_000 // (n * T))
    for i in range(0, rows, band):
        k = _equal(sk[i : min(i + band, rows), None, :], sk[None, i:, :])
        x, y = np.nonzero(k >= low)
        ok = y > x
        x, y = x[ok], y[ok]
        yield x + i, y + i, k[x, y]


def _thinned(bands, n: int):
    """The pairs (i, j, equal bytes) of a node's forests, and the documents of the pairs that these leave out.

    Whenever MOST_PAIRS are held they are reduced to their forests. The outcome is that of all pairs at once: a pair whose ends are
    joined in the last forest by pairs that agree as much and come before it is in no forest, whatever comes later; so it isn't held.
    """
    held, rows, levels = [], 0, None
    out = np.zeros(n, bool)

    def reduced():
        a, b, k = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint8),)
        if n <= 8 or levels is None and len(a) <= n:
            return a, b, k, None
        forests = _forests(a, b, k, n)
        some, last = np.sort(np.concatenate(forests)), forests[-1]
        lost = np.ones(len(a), bool)
        lost[some] = False
        out[a[lost]] = out[b[lost]] = True
        return a[some], b[some], k[some], (a[last], b[last], k[last])

    for a, b, k in bands:
        if levels is not None:
            new = levels[k, a] != levels[k, b]
            out[a[~new]] = out[b[~new]] = True
            a, b, k = a[new], b[new], k[new]
        held.append((a, b, k))
        rows += len(a)
        if rows > MOST_PAIRS + 4 * n:
            *kept, last = reduced()
            held, rows = [tuple(kept)], len(kept[0])
            levels = _levels(*last, n)
    a, b, k, _ = reduced()
    return a, b, k, np.flatnonzero(out)


def _pairs(node: np.ndarray, ids: np.ndarray, sk: np.ndarray, least: float, rest: list, depth: int = 1):
    """Candidate pairs (id, id) of all nodes of a task; ``rest`` gets (node, ids, sketches) of the pairs left out."""
    order = np.lexsort((ids, node))
    node, ids, sk = node[order], ids[order], sk[order]
    at = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(at, len(node)))
    for m in range(2, 9):
        first = at[size == m]
        for i in range(m - 1) if len(first) else ():
            for j in range(i + 1, m):
                ok = _agreement(sk[first + i], sk[first + j]) >= least
                yield ids[first[ok] + i], ids[first[ok] + j]
    for f, m in zip(at[size > 8].tolist(), size[size > 8].tolist()):
        part = slice(f, f + m)
        if m <= SMALL or depth >= DEPTH:
            a, b, _, left = _thinned(_bands(sk[part], least), m)
            if len(left):
                rest.append((node[f], ids[part][left], sk[part][left]))
            yield ids[part][a], ids[part][b]
            continue
        # documents that are close to the node on average would stay together for ever: they are compared with all of it
        s = sk[part]
        close = np.zeros(m)
        for k in range(T):
            close += np.bincount(s[:, k], minlength=256)[s[:, k]]
        near = (close / T - 1) / (m - 1) >= 0.5 * LAMBDA
        if near.any():
            turn = np.argsort(~near, kind="stable")
            i, t = ids[part][turn], s[turn]
            a, b, _, left = _thinned(_bands(t, least, int(near.sum())), m)
            if len(left):
                rest.append((node[f], i[left], t[left]))
            yield i[a], i[b]
        far = np.flatnonzero(~near)
        if len(far) > 1:
            row, child = _children(np.full(len(far), node[f]), s[far].astype(np.uint32))
            yield from _pairs(child, ids[part][far][row], s[far][row], least, rest, depth + 1)


def _distinct(found: list) -> np.ndarray:
    """(n, 2): the different pairs of ``found``, the lower id first."""
    a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    both = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b]
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return both[np.append(True, (both[1:] != both[:-1]).any(1))] if len(both) else both


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a byte matrix."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.py_buffer(np.ascontiguousarray(rows))])


def candidates(nodes: DataFrame, least: float, n: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: distinct candidate pairs of all nodes' forests; (node, doc_id, sketch): the documents of the pairs left out."""

    def compare(table: pa.Table) -> pa.Table:
        sk, rest, level, found, held = unpack(table["sketch"], np.uint8).reshape(-1, T), [], table["level"].to_numpy(), [], 0
        for depth in np.unique(level).tolist():
            at = level == depth
            for a, b in _pairs(table["node"].to_numpy()[at].view(np.uint64), table["doc_id"].to_numpy()[at], sk[at], least, rest, depth):
                found.append((a, b))
                held += len(a)
                if held > MOST_PAIRS:
                    found = [tuple(_distinct(found).T)]
                    held = -len(found[0][0])  # again when as many more are there
        both = _distinct(found)
        node = np.repeat(np.array([v for v, _, _ in rest], np.uint64).view(np.int64), [len(i) for _, i, _ in rest])
        ids, left = (np.concatenate(c) for c in list(zip(*rest))[1:]) if rest else (np.zeros(0, np.int64), np.zeros((0, T), np.uint8))
        m, k = len(both), len(ids)
        return pa.table({
            "a": np.concatenate([both[:, 0], ids]),
            "b": pa.array(np.concatenate([both[:, 1], np.zeros(k, np.int64)]), mask=np.arange(m + k) >= m),
            "node": pa.array(np.concatenate([np.zeros(m, np.int64), node]), mask=np.arange(m + k) < m),
            "sketch": pa.chunked_array([pa.nulls(m, pa.binary()), _binary(left)]),
        })

    both = stored(nodes.withColumn("bucket", F.expr(f"pmod(xxhash64(node), {n})")).groupBy("bucket").applyInArrow(compare, "a long, b long, node long, sketch binary"))
    return both.where("b IS NOT NULL").select("a", "b").distinct(), both.where("b IS NULL").select("node", F.col("a").alias("doc_id"), "sketch")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles): the sorted 32-bit shingle hashes of the documents of ``ids``."""
    ids = small(ids.distinct(), "doc_id", MOST_IDS)

    def sets(batches):
        for s in slices(batches):
            g, row = _shingles(Words(s.column("text")), s.num_rows)
            g = (g >> np.uint64(32)).astype(np.uint32)
            edge = np.searchsorted(row, np.arange(s.num_rows + 1))
            yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([np.unique(g[i:j]).tobytes() for i, j in zip(edge[:-1], edge[1:])], pa.binary())], ["doc_id", "shingles"])

    return stored(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, shingles binary"))


def _jaccard(x: bytes | pa.Buffer, y: bytes | pa.Buffer) -> float:
    z = np.concatenate([np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)])
    z.sort()
    common = np.count_nonzero(z[1:] == z[:-1])
    return common / max(1, len(z) - common)


def confirmed(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, jaccard) whose whole shingle sets have at least the threshold."""
    have = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    both = pairs.select("a", "b").join(have.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(have.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")

    def jaccard(batches):
        for t in batches:
            out = np.array([_jaccard(x.as_buffer(), y.as_buffer()) for x, y in zip(t.column("x"), t.column("y"))], np.float64)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(out)], ["a", "b", "jaccard"]).filter(pa.array(out >= threshold))

    return both.mapInArrow(jaccard, "a long, b long, jaccard double").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def represented(ring: DataFrame, joined: DataFrame, large: int) -> DataFrame:
    """(node, doc_id, sketch): documents of ``ring`` (see ``leaves``) that aren't joined to their first one, with all that it represents.

    What is represented is divided into nodes of about ``large`` documents, each with all of the others.
    """
    held = ring.join(joined, "doc_id", "left").join(joined.select(F.col("doc_id").alias("first"), F.col("group_id").alias("lead")), "first", "left")
    held = held.select("node", "doc_id", "sketch", (F.coalesce("group_id", "doc_id") != F.coalesce("lead", "first")).alias("apart"), ((F.col("agree") >= CLOSE) & (F.col("doc_id") != F.col("first"))).alias("led"))
    nodes = held.groupBy("node").agg(F.max("apart").alias("any"), F.ceil(F.count_if("led") / large).alias("parts")).where("any AND parts > 0").select("node", "parts")
    held = stored(held.where("apart OR led").join(nodes, "node"))
    held = held.withColumn("part", F.explode(F.when(F.col("apart"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.expr("pmod(xxhash64(doc_id), parts)")))))
    return held.select(F.xxhash64("node", "part").alias("node"), "doc_id", "sketch")


def _apart_first(label: np.ndarray) -> tuple[np.ndarray, int]:
    """The order that puts rows of the most frequent label last, and the number of the others."""
    _, at, n = np.unique(label, return_inverse=True, return_counts=True)
    most = at == n.argmax()
    return np.argsort(most, kind="stable"), int((~most).sum())


def left_out(docs: DataFrame, rest: DataFrame, joined: DataFrame, threshold: float) -> DataFrame:
    """(a, b): confirmed pairs that join documents of different groups of ``joined`` (doc_id, group_id), of all candidate pairs of ``rest``.

    Nodes whose documents have more than SETS bytes of shingles are divided; every two parts meet in a group of their own.
    """
    n, least = buckets(docs), threshold - SLACK
    rest = rest.join(joined, "doc_id", "left").select("node", "doc_id", "sketch", F.coalesce("group_id", "doc_id").alias("label"))

    def apart(table: pa.Table) -> pa.Table:
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        sk, use = unpack(table["sketch"], np.uint8).reshape(-1, T), np.zeros(len(node), bool)
        order = np.argsort(node, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            if (label[part] != label[part[0]]).any():
                turn, others = _apart_first(label[part])
                part = part[turn]
                for x, y, _ in _bands(sk[part], least, others):
                    ok = label[part[x]] != label[part[y]]
                    use[part[x[ok]]] = use[part[y[ok]]] = True
        return table.select(["node", "doc_id", "sketch", "label"]).filter(pa.array(use))

    def verify(table: pa.Table) -> pa.Table:
        turn, others = _apart_first(table["label"].to_numpy())
        sets = [x.as_buffer() for x in table["shingles"]]  # a group may have SETS bytes of them: no copies
        sets = [sets[k] for k in turn.tolist()]
        table = table.drop_columns("shingles").take(turn)
        ids, part = table["doc_id"].to_numpy(), table["part"].to_numpy()
        own = table["i"][0].as_py() == table["j"][0].as_py()
        _, group = np.unique(table["label"].to_numpy(), return_inverse=True)
        found = []
        for x, y, est in _bands(unpack(table["sketch"], np.uint8).reshape(-1, T), least, others):
            ok = (group[x] != group[y]) & (own | (part[x] != part[y]))
            x, y, est = x[ok], y[ok], est[ok]
            for k in np.argsort(-est.astype(np.int16), kind="stable").tolist():
                i, j = x[k], y[k]
                if group[i] != group[j] and _jaccard(sets[i], sets[j]) >= threshold:
                    group[group == group[j]] = group[i]
                    found.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rest = stored(rest.withColumn("bucket", F.expr(f"pmod(xxhash64(node), {n})")).groupBy("bucket").applyInArrow(apart, "node long, doc_id long, sketch binary, label long"))
    have = shingle_sets(docs, rest.select("doc_id"))
    wide = rest.join(have.select("doc_id", F.octet_length("shingles").alias("bytes")), "doc_id").groupBy("node").agg(F.ceil(F.sum("bytes") / (SETS // 2)).alias("parts")).where("parts > 2")
    wide = stored(wide)  # few, and most often none
    split = rest.join(F.broadcast(wide) if wide.count() <= MOST_NODES else wide, "node", "left").withColumn("part", F.coalesce(F.expr("pmod(xxhash64(doc_id), parts)"), F.lit(0)))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    split = split.select("node", "doc_id", "sketch", "label", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    return split.join(have, "doc_id").groupBy("node", "i", "j").applyInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, group_id) of the connected components of (a, b); group_id is the least doc_id, whose own row is there too.

    Alternating large-star and small-star steps: the least neighbour is found by aggregation, which is partial before the shuffle,
    and joined to the edges, so the hub of a star isn't held by one task; the number of rounds grows with the logarithm of the
    component's size. Rounds are cut by checkpoint() and end when count and sum of hashes of the edges stay as they are.
    """
    with short_batches(edges.sparkSession):
        edges, before = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint(), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = star.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct().checkpoint()
        after = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct())


def links(docs: DataFrame, threshold: float = LAMBDA, trees: int = TREES, large: int = LARGE) -> DataFrame:
    """(a, b): pairs that hold the groups together."""
    table = stored(sketches(docs))
    equal = table.groupBy("same", "size").agg(F.min("doc_id").alias("rep"), F.min_by("minhash", "doc_id").alias("minhash"), F.max("doc_id").alias("last"))
    several = equal.where("rep <> last").select("same", "size", "rep")
    star = table.select("doc_id", "same", "size").join(several, ["same", "size"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    nodes, led, ring = leaves(stored(equal.select(F.col("rep").alias("doc_id"), "minhash")), trees, large, threshold - SLACK)
    pairs, rest = candidates(nodes, threshold - SLACK, buckets(docs))
    pairs = stored(pairs if led is None else pairs.union(led).distinct())
    first = star.union(confirmed(docs, pairs, threshold).select("a", "b"))
    if ring is None and rest.isEmpty():
        return first
    joined = stored(components(first))
    if ring is not None:
        rest = rest.union(represented(ring, joined, large))
    return joined.select(F.col("group_id").alias("a"), F.col("doc_id").alias("b")).union(left_out(docs, rest, joined, threshold))


def groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, group_id, keep): every document of a group of two or more; the one of the least doc_id is to stay."""
    return components(links(docs, **options)).withColumn("keep", F.col("doc_id") == F.col("group_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without all but one document of each group."""
    extra = stored(groups(docs, **options).where("NOT keep").select("doc_id"))
    return docs.join(small(extra, "doc_id", MOST_IDS), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
