"""Each operator against brute force, and on tables that hold every odd case."""

import collections
import hashlib
import itertools
import os
import pathlib
import re
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import corpus_pipeline
from quillsift.llm import common, image_copies, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, token_counts, warc
from quillsift.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("ba", "lo", "mi", "tu", "re") for b in ("n", "r", "st", "k") for c in ("a", "o", "im", "ens", "ul")]


def words(r, n):
    return [WORDS[i] for i in r.integers(0, len(WORDS), n)]


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def odd(spark):
    r = np.random.default_rng(5)
    long = " ".join(words(r, 60_000))
    rows = [(None, "some words here", "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n", "de", "a", 4), (4, long, "en", "b", 9), (5, long, "en", "b", 9)]
    rows += [(6, "one", "en", "a", 3), (6, "one", "en", "a", 3), (7, "é ß Ünï 你好 🙂!!", "fr", None, 3), (8, "...", "en", "c", 3), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    for c in ("bucket", "node", "src", "rank", "start", "keep", "spans", "scale", "language", "a.b"):
        d = d.withColumn(c, common.F.lit("x"))
    return d


LABELS = "doc_id long, quality int, toxic int"


def labels_of(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def test_odd_tables_have_defined_results(spark):
    d = odd(spark)
    labels = labels_of(spark, [(4, 1, 0), (6, None, None), (None, 1, 0), (7, 1, None), (7, 1, 0)])
    n = d.count()
    g = {r["doc_id"]: r["group_id"] for r in near_dedup.groups(d).collect()}
    assert g == {4: 4, 5: 4}
    one = near_dedup.one_of_each(d)
    assert one.columns == d.columns and one.count() == n - 1
    spans = substring_dedup.spans(d).collect()
    assert {r["doc_id"] for r in spans if not r["first"]} >= {5} and {r["doc_id"] for r in spans} == {4, 5}
    cut = substring_dedup.cut(d)
    assert cut.columns == d.columns and {r["doc_id"] for r in cut.collect()} == {None, 1, 2, 3, 4, 6, 7, 8}
    s = {r["doc_id"]: r for r in lm_scoring.scores(d).where("doc_id IS NOT NULL").collect()}
    assert s[1]["n_words"] == s[2]["n_words"] == 0 and s[1]["perplexity"] is None and s[1]["log_prob"] == 0 and s[4]["n_words"] == 60_000
    assert mixing.mixed(d).columns == d.columns
    q = quality_rules.scores(d, labels).collect()
    assert len(q) == n and not any(r["keep"] for r in q if not r["n_tokens"]) and all(r["score"] == 0 for r in q if not r["n_tokens"])
    assert quality_rules.keep_good(d, labels).columns == d.columns
    c = quality_classifier.scores(d, labels).collect()
    assert len(c) == n and all(r["score"] == (1.0 if r["n_passages"] else 0.0) for r in c)
    if os.path.exists(token_counts.VOCABULARY):
        k = token_counts.counts(d).collect()
        by = collections.defaultdict(list)
        for r in k:
            by[r["doc_id"]].append(r["n_tokens"])
        assert len(k) == n and by[1] == [None] and by[2] == [0] and len(by[6]) == 2 and by[6][0] == by[6][1] > 0 and by[4] == by[5] and None in by[None]
    p = packing.documents(d).collect()
    assert sum(r["n_tokens"] for r in p if r["doc_id"] == 4) == size_of([d.where("doc_id = 4").first()["text"]])[0] and sum(r["doc_id"] is None for r in p) == 2


def test_empty_tables(spark):
    d = odd(spark).limit(0)
    labels = labels_of(spark, [])
    for r in (near_dedup.groups(d), near_dedup.one_of_each(d), substring_dedup.spans(d), substring_dedup.cut(d), lm_scoring.scores(d), mixing.copies(d), mixing.mixed(d),
              quality_rules.scores(d, labels), quality_rules.keep_good(d, labels), quality_classifier.scores(d, labels), packing.documents(d), token_counts.counts(d), image_copies.groups(image_copies.media(spark.createDataFrame([], "vec_id long, embedding array<float>")))):
        assert r.count() == 0
    assert packing.conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert image_copies.copies(image_copies.media(spark.createDataFrame([], "vec_id long, embedding array<float>"))).count() == 0
    assert warc.pages_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def shingles(t):
    w = re.findall(r"\w+", t.lower())
    return set(zip(w, w[1:])) or set(w)


def copies_of(r, base, share):
    w = list(base)
    for i in np.flatnonzero(r.random(len(w)) < share):
        w[i] = WORDS[r.integers(len(WORDS))]
    return w


def test_near_dedup_against_brute_force(spark):
    r = np.random.default_rng(1)
    texts = []
    for _ in range(60):
        base = words(r, int(r.integers(40, 120)))
        texts += [" ".join(copies_of(r, base, x)) for x in (0, 0.02, 0.06, 0.1)[: int(r.integers(1, 5))]]
    base = words(r, 60)
    texts += [" ".join(copies_of(r, base, 0.02)) for _ in range(700)]  # a node that must branch
    sets = [shingles(t) for t in texts]
    small = [i for i in range(len(texts) - 700)]
    pairs = {(i, j) for i, j in itertools.combinations(small, 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= near_dedup.LAMBDA}
    got = {x["doc_id"]: x["group_id"] for x in near_dedup.groups(frame(spark, texts), large=400).collect()}
    found = [p for p in pairs if got.get(p[0], -1) == got.get(p[1], -2)]
    assert len(pairs) > 40 and len(found) >= 0.95 * len(pairs)
    parent = list(range(len(texts)))
    for i, j in pairs:
        a, b = (next(iter([k for k in [x]])) for x in (i, j))
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    root = lambda x: x if parent[x] == x else root(parent[x])
    assert all(root(i) == root(g) for i, g in got.items() if i < len(small))  # nothing else is joined
    assert len({got.get(i) for i in range(len(small), len(texts))}) == 1


def test_near_dedup_verifies_pairs_among_many_of_just_less(spark):
    texts = []
    for i in range(300):  # 101 words of all, 14 of two documents, 35 of one: 0.50 for most pairs, 0.62 for those of two
        texts.append(" ".join([f"all{k}" for k in range(101)] + [f"two{i // 2}x{k}" for k in range(14)] + [f"one{i}x{k}" for k in range(35)]))
    sets = [shingles(t) for t in texts]
    true = {p for p in itertools.combinations(range(300), 2) if len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= near_dedup.LAMBDA}
    assert true == {(i, i + 1) for i in range(0, 300, 2)}
    got = collections.defaultdict(set)
    for x in near_dedup.groups(frame(spark, texts)).collect():
        got[x["group_id"]].add(x["doc_id"])
    found = {tuple(sorted(g)) for g in got.values()}
    assert found <= true and len(found) >= 0.95 * len(true)


def test_near_dedup_holds_few_pairs_of_a_hot_node(monkeypatch):
    r = np.random.default_rng(33)

    def node(n, keep):
        out = np.tile(r.integers(0, 256, near_dedup.T, dtype=np.uint8), (n, 1))
        return np.where(r.random(out.shape) < keep, out, r.integers(0, 256, out.shape, dtype=np.uint8))

    tracemalloc.start()
    rest = []
    pairs = list(near_dedup._pairs(np.zeros(3000, np.uint64), np.arange(3000), node(3000, 0.9), 0.4, rest))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6, most  # its 4.5 million pairs took 700 MB
    assert len(np.unique(np.concatenate([np.concatenate(p[:2]) for p in pairs]))) == 3000 and len(rest[0][1]) == 3000
    sk = node(400, 0.8)
    whole = near_dedup._thinned(near_dedup._bands(sk, 0.4), 400)
    monkeypatch.setattr(near_dedup, "MOST_PAIRS", 3000)
    assert all((a == b).all() for a, b in zip(whole, near_dedup._thinned(near_dedup._bands(sk, 0.4), 400)))


def test_workers_get_batches_of_few_bytes(spark):
    docs = spark.range(1500).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 3000) AS text").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    seen = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["bytes"]) for b in batches)
    each = [x["bytes"] for x in common.stored(docs.mapInArrow(seen, "bytes long")).collect()]
    assert sum(each) > 30e6 and max(each) < common.BATCH_BYTES + 100_000  # all of them came at once
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_near_dedup_divides_the_sets_of_a_node(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SETS", 1 << 14)
    test_near_dedup_verifies_pairs_among_many_of_just_less(spark)


def test_near_dedup_meets_what_a_first_document_represents(spark):
    base = [f"all{k}" for k in range(300)]
    texts = [base]
    for i in range(40):  # 0.95 of the first one
        texts.append(base[:-8] + [f"own{i}x{k}" for k in range(8)])
    for i in range(40):  # 0.57 of one of those, 0.54 of all else
        texts.append([f"new{i}x{k}" for k in range(82)] + texts[1 + i][82:])
    sets = [shingles(" ".join(t)) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= near_dedup.LAMBDA
    assert [[j for j in range(81) if j != i and near(i, j)] for i in range(41, 81)] == [[i - 40] for i in range(41, 81)]
    got = {x["doc_id"]: x["group_id"] for x in near_dedup.groups(frame(spark, [" ".join(t) for t in texts]), large=30).collect()}
    assert sum(got.get(i) == 0 for i in range(41, 81)) >= 37 and all(got[i] == 0 for i in range(41))
    assert set(got.values()) == {0}


def test_substring_dedup_against_brute_force(spark):
    r = np.random.default_rng(2)
    shared = [words(r, n) for n in (50, 51, 80, 49)]
    texts = []
    for i in range(40):
        w = words(r, int(r.integers(0, 90)))
        for s in shared:
            if r.random() < 0.3:
                at = int(r.integers(0, len(w) + 1))
                w = w[:at] + s + w[at:]
        texts.append(" ".join(x.upper() if r.random() < 0.1 else x for x in w))
    texts[7] = texts[8] + ".\n" + texts[8]
    where = collections.defaultdict(list)
    tokens = [list(re.finditer(r"\w+", t)) for t in texts]
    for d, w in enumerate(tokens):
        for p in range(len(w) - 49):
            where[tuple(m.group().lower() for m in w[p : p + 50])].append((d, p))
    want = collections.defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for d, p in places:
                want[d, (d, p) == min(places)] |= set(range(tokens[d][p].start(), tokens[d][p + 49].end()))
    got = collections.defaultdict(set)
    for x in substring_dedup.spans(frame(spark, texts)).collect():
        got[x["doc_id"], x["first"]] |= set(range(x["start"], x["end"]))
    assert want and got == want
    for x in substring_dedup.cut(frame(spark, texts)).collect():
        assert x["text"] == "".join(c for i, c in enumerate(texts[x["doc_id"]]) if i not in want[x["doc_id"], False])


needs_vocabulary = pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary file here")


def size_of(texts):
    return token_counts.Counter(token_counts.vocabulary(token_counts.VOCABULARY))(common.pa.array(texts, common.pa.string())).tolist()


@needs_vocabulary
def test_packing_keeps_limits_and_follows_the_heuristic(spark):
    r = np.random.default_rng(3)
    rows = [(i, k, ("user", "assistant", None)[k % 3], " ".join(words(r, int(r.integers(0, 300))))) for i in range(120) for k in range(int(r.integers(1, 5)))]
    rows += rows[:5] + [(None, 0, "assistant", None)] + [(None, None, "assistant", " ".join(words(r, 300)))] * 3 + [(500, k, "user", "") for k in range(3)]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for c in ("id", "turns", "shard", "tokens", "loss", "copies"):
        t = t.withColumn(c, common.F.lit("x"))
    got = packing.conversations(t, tokens=600, segments=5, loss=300).toPandas()
    by = got.groupby("pack_id")
    assert by["n_tokens"].sum().max() <= 600 and by["loss_tokens"].sum().max() <= 300 and by.size().max() <= 5
    assert all(sorted(x) == list(range(len(x))) for x in by["slot"].apply(list))
    want, heard, convs = collections.Counter(), collections.Counter(), collections.defaultdict(list)
    for (i, k, role, _), n in zip(rows, size_of([x[3] for x in rows])):
        want[i] += n
        heard[i] += n * (role == "assistant")
        convs[i].append((k, n, role == "assistant"))
    for column, whole in (("n_tokens", want), ("loss_tokens", heard)):
        assert {None if pd.isna(k) else int(k): v for k, v in got.groupby("conv_id", dropna=False)[column].sum().items()} == dict(whole)
    long = [i for i in convs if i is not None and (want[i] > 600 or heard[i] > 300)]
    assert len(long) > 20 and (got["conv_id"].isna()).sum() > 4
    for i, part in got[got["conv_id"].notna()].groupby("conv_id"):  # token by token
        flags = [l for _, n, l in sorted(convs[int(i)]) for _ in range(n)]
        pieces = part.sort_values("piece")
        assert pieces["piece"].tolist() == list(range(len(pieces))) and (len(pieces) > 1) == (int(i) in long)
        for p in pieces.itertuples():
            assert p.loss_tokens == sum(flags[p.start : p.start + p.n_tokens]) and (p.start == 300 * p.piece)
    again = packing.conversations(t.repartition(5), tokens=600, segments=5, loss=300).toPandas()
    key = got.columns.tolist()
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    many = spark.createDataFrame([(None, "a b"), (7, "c d")], "doc_id long, text string").crossJoin(spark.range(900).select())
    shards = packing.documents(many, shard=64).selectExpr("shiftright(pack_id, 32) AS s").groupBy("s").count().collect()
    assert len(shards) > 20 and max(x["count"] for x in shards) < 200  # neither nulls nor repeated rows fill a shard
    need, limits = r.integers(1, 9, (40, 3)), np.array([20, 30, 25])
    weight = (need / limits).sum(0)
    left, packs = list(range(40)), []
    while left:  # the same rule, slowly
        room, pack = limits.copy(), []
        while some := [i for i in left if (need[i] <= room).all()]:
            best = max(some, key=lambda i: (round(float(((need[i] / limits) * weight / weight.sum()) @ (room / limits)), 12), -i))
            pack.append(best)
            left.remove(best)
            room = room - need[best]
        packs.append(sorted(pack))
    to = packing.fill(need, limits)
    assert [sorted(np.flatnonzero(to == k).tolist()) for k in range(to.max() + 1)] == packs


def test_classifier_on_held_out_documents(spark):
    r = np.random.default_rng(4)
    y = r.integers(0, 2, 400)
    texts = []
    for good in y:
        w = words(r, int(r.integers(60, 300)))
        if not good:
            at = int(r.integers(0, len(w) - 10))
            w[at : at + 10] = [f"bad{k}" for k in r.integers(0, 20, 10)]
        texts.append(" ".join(w))
    got = quality_classifier.scores(frame(spark, texts), labels_of(spark, [(i, int(y[i]), 0) for i in range(300)])).toPandas().set_index("doc_id").sort_index()
    assert ((got.loc[300:, "score"].to_numpy() >= 0.5) == y[300:]).mean() >= 0.9


def corners_of(rows):
    one = lambda x: image_copies.described(np.frombuffer(x["pixels"], np.uint8).reshape(1, x["height"], x["width"]).astype(np.float32), np.array([x["image_id"]]))
    return np.concatenate([one(x) for x in rows])


def brute_copies(c):
    """Pairs of images of which enough matches agree, all corners compared."""
    c, found = c[np.argsort(c["id"], kind="stable")], []
    bits = np.ascontiguousarray(c["bits"])
    for p in range(0, len(c), 500):
        i, j = np.nonzero(np.bitwise_count(bits[p : p + 500, None] ^ bits[None]).sum(-1) <= image_copies.FARTHEST)
        i += p
        ok = c["id"][i] < c["id"][j]
        found.append(np.stack([i[ok], j[ok]], 1))
    met = collections.defaultdict(list)
    for i, j in np.concatenate(found):
        met[int(c["id"][i]), int(c["id"][j])].append((i, j))
    out = set()
    for p, some in met.items():
        i, j = np.array(some).T
        m = np.empty(len(i), image_copies._MATCH)
        m["a"], m["b"], m["at"] = *p, np.stack([c["x"][i], c["y"][i], c["x"][j], c["y"][j]], 1)
        m["angle"], m["level"] = np.stack([c["angle"][i], c["angle"][j]], 1), np.stack([c["level"][i], c["level"][j]], 1)
        if len(m) >= image_copies.INLIERS and image_copies.agreed(image_copies.distinct(m))[0] >= image_copies.INLIERS:
            out.add(p)
    return out


def joined(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_image_copies_against_brute_force(spark):
    r = np.random.default_rng(6)
    e = spark.createDataFrame([(i, [float(x) for x in r.normal(size=64)]) for i in range(60)] + [(None, None), (991, [1.0]), (990, [0.0] * 64)], "vec_id long, embedding array<float>")
    media = image_copies.media(e)
    want = brute_copies(corners_of(media.where("pixels IS NOT NULL").collect()))
    for c in ("bucket", "corners", "matches", "links", "a.b"):
        media = media.withColumn(c, common.F.lit("x"))
    got = {(x["image_a"], x["image_b"]) for x in image_copies.copies(media).collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want and not [p for p in got if p[0] // 2 != p[1] // 2]
    own = {k: (2 * k, 2 * k + 1) in got for k in range(60)}
    assert sum(own.values()) >= 45 and all(own[k] for k in range(0, 60, 3))  # a third resized, a third turned
    rows = {x["image_id"]: x for x in image_copies.groups(media).collect()}
    assert {i: x["group_id"] for i, x in rows.items()} == joined(got) and all(x["partner"] == i ^ 1 and x["links"] == 1 for i, x in rows.items())


def image_row(i, image):
    return (i, image.shape[1], image.shape[0], bytearray(np.clip(image, 0, 255).astype(np.uint8).tobytes()))


IMAGES = "image_id long, width int, height int, pixels binary"


def test_image_copies_at_other_sizes_scales_and_turns(spark):
    r = np.random.default_rng(26)
    rows, pairs = [], set()
    for k in range(8):
        base = image_copies._smooth(r.normal(0, 1, (1, 240, 300)).astype(np.float32), 2.5)[0]
        base = 128 + 40 * base / base.std()
        edits = [base[60:150, 100:200], 128 + 0.25 * (base - 128), image_copies.turned(base, 0.4 + 0.45 * k), image_copies._resized(base[None], 150, 188)[0], base + r.normal(0, 8, base.shape)]
        rows += [image_row(10 * k + i, x) for i, x in enumerate([base, *edits])]
        pairs |= {(10 * k, 10 * k + i) for i in range(1, 6)}
    got = {x["image_id"]: x for x in image_copies.groups(spark.createDataFrame(rows, IMAGES)).collect()}
    by = collections.Counter(b % 10 for a, b in pairs if a in got and b in got and got[a]["group_id"] == got[b]["group_id"])
    assert all(by[i] >= 7 for i in range(1, 6)), by
    assert all(x["group_id"] // 10 == i // 10 for i, x in got.items())
    links = {(x["image_a"], x["image_b"]): x for x in image_copies.copies(spark.createDataFrame(rows, IMAGES)).collect()}
    small = [links[10 * k, 10 * k + 4]["scale"] for k in range(8) if (10 * k, 10 * k + 4) in links]
    turns = [np.angle(np.exp(1j * (links[10 * k, 10 * k + 3]["turn"] - 0.4 - 0.45 * k))) for k in range(8) if (10 * k, 10 * k + 3) in links]
    assert small and np.allclose(small, 150 / 240, atol=0.06) and turns and np.allclose(turns, 0, atol=0.06)


def test_image_copies_of_hundreds_and_odd_images(spark):
    r = np.random.default_rng(27)
    base = image_copies._smooth(r.normal(0, 1, (1, 90, 90)).astype(np.float32), 2.5)[0]
    base = 128 + 40 * base / base.std()
    rows = [image_row(i, base + r.normal(0, 3, base.shape)) for i in range(300)]
    rows += [image_row(1000 + i, base + r.normal(0, 3, base.shape)) for i in range(3) for _ in range(2)]  # repeated ids
    rows += [(2000, 90, 90, bytearray(8100)), (2001, 90, 90, bytearray(8100)), (2002, 5, 5, bytearray(25)), (2003, 9, 9, bytearray(5)), (2004, None, 9, None), (None, 90, 90, rows[0][3]), (2005, 0, 0, bytearray(0))]
    d = spark.createDataFrame(rows, IMAGES)
    got = {x["image_id"]: x["group_id"] for x in image_copies.groups(d).collect()}
    assert got == dict.fromkeys([*range(300), 1000, 1001, 1002], 0)
    assert image_copies.copies(d).count() < 303 * 302 / 4  # not all pairs are made
    board = (np.indices((96, 96)) // 8).sum(0) % 2 * 200.0
    c = image_copies.described(board[None].astype(np.float32), np.array([1]))
    flat = c[c["level"] == 0]
    assert len(flat) and flat["y"].min() < 24 and flat["x"].min() < 24 and flat["y"].max() > 72  # no part of the image is preferred
    x = np.zeros((1, 40, 40), np.int64) - 1
    x[0, 10, 10] = x[0, 10, 13] = x[0, 30, 30] = 7
    assert np.argwhere(image_copies._tops(x, 6)).tolist() == [[0, 10, 10], [0, 30, 30]]


def test_long_runs_keep_apart_and_lead_together():
    r = np.random.default_rng(28)
    base = r.integers(0, 2, (5, image_copies.TESTS))
    flat = base.repeat(2000, 0)
    flat ^= r.random(flat.shape) < 0.01
    bits = np.packbits(flat.astype(bool), axis=1).view("<u8")
    out = []
    image_copies._led(bits, np.arange(len(bits)), np.arange(len(bits)), np.zeros(len(bits), np.int64), out)
    pairs = [(int(a), int(b)) for i, j in out for a, b in zip(i, j)]
    group = joined(pairs)
    assert len(set(group.values())) == 5 and len(group) == 10_000 and len(pairs) < 40 * len(bits)


def test_long_runs_of_unlike_corners_take_few_steps(monkeypatch):
    r, steps, count = np.random.default_rng(21), [], np.bitwise_count
    base = r.integers(0, 2, image_copies.TESTS)
    flips = r.random((2000, image_copies.TESTS)) < 0.07  # of one another by 25 bits on average, as chance matches are
    flips[1500:1600] = flips[:100] ^ (r.random((100, image_copies.TESTS)) < 0.01)  # and copies of some
    bits = np.packbits(base ^ flips, axis=1).view(np.uint64)
    ids, rows = np.arange(2000) // 2, np.arange(2000)
    d = count(bits[:, None] ^ bits[None]).sum(-1)
    leads, want = np.ones(2000, bool), set()
    for i in range(2000):  # leader by leader, and what few represented ones match
        if leads[i]:
            there = np.flatnonzero(leads | (rows == i))
            there = there[there > i]
            held = there[d[i, there] <= image_copies.TIGHT]
            ring = there[d[i, there] <= image_copies.FARTHEST + image_copies.TIGHT]
            assert len(held) <= image_copies.SMALL
            want |= {(x, y) for x in [i, *held.tolist()] for y in (there if x == i else ring).tolist() if d[x, y] <= image_copies.FARTHEST and ids[x] != ids[y]}
            leads[held] = False
    monkeypatch.setattr(np, "bitwise_count", lambda x: steps.append(1) or count(x))
    out, hot = [], []
    image_copies._led(bits, ids, rows, np.zeros(2000, np.int64), out, hot=hot)
    got = {(min(p), max(p)) for a, b in out for p in zip(a.tolist(), b.tolist())}
    assert got == {(min(p), max(p)) for p in want} and len(got) > 10_000 and not np.concatenate(hot).size
    assert len(steps) < 400, len(steps)  # a step or more for every leader before


def test_long_runs_lose_no_match_of_what_leaders_represent():
    r = np.random.default_rng(29)

    def near(bits, n):
        out = bits.copy()
        out[r.permutation(image_copies.TESTS)[:n]] ^= True
        return out

    def run(represented):
        first = r.random(image_copies.TESTS) < 0.5
        held = [near(first, 6) for _ in range(represented)]
        far = first ^ held[0]
        other = held[0].copy()
        other[np.flatnonzero(~far)[:22]] ^= True  # 22 bits from a represented one, 28 from the leader
        return np.packbits(np.array([first, *held, other]), axis=1).view("<u8")

    bits = run(12)
    d = np.bitwise_count(bits[:, None] ^ bits[None]).sum(-1)
    assert d[0, -1] == 28 and d[1, -1] == 22
    out, hot, n = [], [], len(bits)
    image_copies._led(bits, np.arange(n), np.arange(n), np.zeros(n, np.int64), out, hot=hot)
    assert {(int(a), int(b)) for i, j in out for a, b in zip(i, j)} == {(i, j) for i, j in itertools.combinations(range(n), 2) if d[i, j] <= image_copies.FARTHEST}
    assert not len(np.concatenate(hot))
    bits = run(40)  # more than SMALL: the images are met again, with labels
    n, hot = len(bits), []
    image_copies._led(bits, np.arange(n), np.arange(n), np.zeros(n, np.int64), [], hot=hot)
    assert set(np.concatenate(hot).tolist()) == set(range(1, n))
    label, out = np.append(np.zeros(n - 1, np.int64), 7), []
    image_copies._across(bits, label, np.arange(n), out)
    d = np.bitwise_count(bits ^ bits[-1]).sum(1)
    assert {(int(a), int(b)) for i, j in out for a, b in zip(i, j)} == {(i, n - 1) for i in range(n - 1) if d[i] <= image_copies.FARTHEST}


def test_lm_scores_against_exact_counts(spark):
    r = np.random.default_rng(8)
    texts = [" ".join(WORDS[min(int(x), 99)] for x in r.exponential(12, int(r.integers(0, 80)))) for _ in range(60)]
    one, two = collections.Counter(), collections.Counter()
    for t in texts:
        w = t.split()
        one.update(w)
        two.update(zip(w, w[1:]))
    q = lambda n: 0.0 if not n else (2 ** (n.bit_length() - 1) + 2 ** n.bit_length() - 1) / 2
    words_, distinct = sum(one.values()), len(one)
    p1 = lambda w: (q(one[w]) + 0.5) / (words_ + distinct / 2 + 0.5)
    d = frame(spark, texts)
    got = {x["doc_id"]: x for x in lm_scoring.scores(d).collect()}
    off = []
    for i, t in enumerate(texts):
        w = t.split()
        lp = sum(np.log(lm_scoring.WEIGHT * min(1, q(two[w[k - 1], x]) / q(one[w[k - 1]])) + (1 - lm_scoring.WEIGHT) * p1(x)) if k else np.log(p1(x)) for k, x in enumerate(w))
        assert got[i]["n_words"] == len(w)
        off.append(abs(got[i]["log_prob"] - lp) / max(1, len(w)))
    assert np.mean(off) < 0.02  # false positives of the filter apart
    for i, x in enumerate(lm_scoring.scores(d, most_bytes=300).collect()):
        assert abs(got[x["doc_id"]]["log_prob"] - x["log_prob"]) < 1e-6


def test_lm_query_scores_by_all_counts(spark, tmp_path):
    r = np.random.default_rng(18)
    texts = [" ".join(WORDS[min(int(x), 99)] for x in r.exponential(25, int(r.integers(1, 60)))) for _ in range(60)]
    one, two = collections.Counter(), collections.Counter()
    for t in texts:
        w = t.split()
        one.update(w)
        two.update(zip(w, w[1:]))
    assert sum(n == 1 for n in two.values()) > 0.4 * len(two)
    q = lambda n: (2 ** (n.bit_length() - 1) + 2 ** n.bit_length() - 1) / 2
    p1 = lambda w: (q(one[w]) + 0.5) / (sum(one.values()) + len(one) / 2 + 0.5)
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["log_prob"] for x in queries()["op6_lm_scoring"](spark, str(tmp_path)).collect()}
    off = []
    for i, t in enumerate(texts):
        w = t.split()
        lp = sum(np.log(lm_scoring.WEIGHT * min(1, q(two[w[k - 1], x]) / q(one[w[k - 1]])) + (1 - lm_scoring.WEIGHT) * p1(x)) if k else np.log(p1(x)) for k, x in enumerate(w))
        off.append(abs(got[i] - lp) / len(w))
    assert np.mean(off) < 0.02
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for x in lm_scoring.scores(d, most_bytes=300).collect():
        assert abs(got[x["doc_id"]] - x["log_prob"]) < 1e-6
    seen, never = lm_scoring.scores(frame(spark, ["bana bano"]), corpus=frame(spark, ["bana bano"])).collect(), lm_scoring.scores(frame(spark, ["bano bana"]), corpus=frame(spark, ["bana bano"])).collect()
    assert seen[0]["log_prob"] > never[0]["log_prob"] + 0.5


def test_mixing_against_brute_force(spark):
    r = np.random.default_rng(9)
    rows = [(int(i), "x" * int(r.integers(0, 50)), None, ("a", "a", "a", "b", None)[int(r.integers(5))], 1) for i in r.permutation(300)]
    d = spark.createDataFrame(rows + rows[:3], DOCS)
    weights = {"a": 1.0, "b": 2.0}
    got = collections.Counter((x["doc_id"], x["source"]) for x in mixing.copies(d, weights=weights).collect())
    rate = {x["src"]: (x["step"], x["start"]) for x in mixing.rates(d, weights=weights).collect()}
    want = collections.Counter()
    for s in ("a", "b", None):
        step, at = rate[s or ""]
        for x in sorted((x for x in rows + rows[:3] if x[3] == s), key=lambda x: (hashlib.md5(str(x[0]).encode()).hexdigest()[:3], x[0])):
            n = (at + step) // mixing.ONE - at // mixing.ONE
            at += step
            if n:
                want[x[0], s] += n
    assert got == want and rate[""][0] == 0
    size = {i: len(t) for i, t, *_ in rows}
    chars = {s: sum(size[i] * n for (i, t), n in got.items() if t == s) for s in "ab"}
    assert 1.7 < chars["b"] / chars["a"] < 2.3


@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary file here")
def test_token_counts_against_an_encoder(spark):
    import base64

    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(10)
    bits = ["the", " over", "  ", "\n\n", "'s", "'ll", "12", " 3", "ß", "é", "你好", "🙂", "!!", " (", "\t", "zzzzzzzz", "<|endoftext|>", "A", " ", "don't"]
    texts = ["".join(bits[i] for i in r.integers(0, len(bits), int(r.integers(0, 60)))) for _ in range(300)] + [None, "", "a" * 5000]
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.counts(frame(spark, texts)).collect()}
    assert got == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}


def test_quality_rules_against_plain_counts(spark):
    r = np.random.default_rng(11)
    texts = [" ".join(words(r, int(r.integers(5, 60)))) + "." for _ in range(40)] + [" ".join(f"junk{k}" for k in r.integers(0, 9, 20)) for _ in range(10)]
    good = set(range(0, 40, 2))
    d = frame(spark, texts)
    got = {x["doc_id"]: x for x in quality_rules.scores(d, labels_of(spark, [(i, 1, 0) for i in good] + [(45, 1, 1)]), n=1 << 24).collect()}  # buckets enough for no two to meet
    grams = []
    for t in texts:
        w = re.findall(r"\w+|[^\w\s]+", t)
        grams.append((collections.Counter(w), collections.Counter(zip(w, w[1:]))))
    scale = sum(len(t.encode()) for t in texts) / sum(len(texts[i].encode()) for i in good)
    raw, target = collections.Counter(), collections.Counter()
    for i, (a, b) in enumerate(grams):
        for g, n in [*a.items(), *b.items()]:
            raw[g] += n
            target[g] += n * scale * (i in good)
    prior = quality_rules.PRIOR * scale
    for i, own in enumerate(grams):
        score = 0
        for part, weight in zip(own, (1, quality_rules.PAIRS)):
            llr = sum(n * np.log((max(target[g] - n * scale * (i in good), 0) + prior) / (max(raw[g] - n, 0) + prior)) for g, n in part.items())
            score += weight * llr / max(1, sum(part.values()))
        assert abs(got[i]["score"] - score) < 2e-4
    assert not any(got[i]["keep"] for i in range(40, 50)) and sum(got[i]["keep"] for i in range(40)) >= 36


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", None if i == 3 else "é<p>" * (i * 7)) for i in range(20)] + [(None, None, ""), (5, "http://x/5", "again"), (50, "u\r\nv", "x" * 12_000_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", common.F.lit("z")).repartition(2)
    files = common.stored(warc.from_pages(p, f"file://{tmp_path}/mono"))
    got = warc.normalise(files, f"file://{tmp_path}/norm").collect()
    assert len(got) == len(rows) and {x["status"] for x in got} == {"ok"}
    bodies = collections.Counter()
    for x in got:
        data = warc.read(f"file://{tmp_path}/norm/{x['file']}", x["offset"], x["length"])
        assert data.startswith(b"WARC/1.0\r\n") and data.endswith(b"\r\n\r\n")
        bodies[x["page_id"], data.partition(b"\r\n\r\n")[2][:-4]] += 1
    assert bodies == collections.Counter((i, (h or "").encode()) for i, _, h in rows)
    whole = next((tmp_path / "mono").glob("*.gz")).read_bytes()
    (tmp_path / "bad.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "none.gz").write_bytes(b"")
    odd_ = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/bad.gz",), (f"file://{tmp_path}/none.gz",)], "path string"), f"file://{tmp_path}/odd").collect()
    assert [x["status"] for x in odd_ if x["file"] == "none.gz"] == [] and "truncated" in {x["status"] for x in odd_}


def test_pipeline_drops_a_hot_group_within_memory(spark, tmp_path):
    r = np.random.default_rng(34)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if x > 0.04 else f"n{i}x{k}" for k, (w, x) in enumerate(zip(base, r.random(60)))) for i in range(4000)]
    left = corpus_pipeline.near_duplicates(spark, frame(spark, texts), str(tmp_path)).select("doc_id").collect()
    assert [x["doc_id"] for x in left] == [0]
    most = 0  # the highest resident size of any Python worker so far, in MB
    for status in pathlib.Path("/proc").glob("[0-9]*/status"):
        try:
            if "pyspark.daemon" in (status.parent / "cmdline").read_text():
                most = max(most, int(re.search(r"VmHWM:\s+(\d+)", status.read_text())[1]) // 1024)
        except (OSError, TypeError):
            continue  # it ended meanwhile
    assert 0 < most < 700, most


def test_pipeline_stages_take_effect(spark, tmp_path):
    r = np.random.default_rng(12)
    texts = [" ".join(words(r, int(r.integers(70, 160)))) for _ in range(120)]
    shared = " ".join(words(r, 60))
    texts[10] += " " + shared
    texts[11] = shared + " " + texts[11]
    texts[20] = texts[21]
    for i in (30, 31, 33, 35):
        texts[i] = " ".join(f"junk{k}" for k in r.integers(0, 9, 90))
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, [(i, 1, 0) for i in range(0, 120, 2) if i != 30]).write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({x["doc_id"]: x for x in docs.collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert not {30, 31, 33, 35} & set(seen[0]) and {20, 21} <= set(seen[0]) and len(seen[0]) > 110
    assert set(seen[0]) - set(seen[1]) == {21}
    assert shared in seen[2][10]["text"] and shared not in seen[2][11]["text"] and set(seen[2]) == set(seen[1])
    assert set(seen[4]) == set(seen[3])
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == docs.columns and sorted(map(tuple, final.collect())) == sorted(map(tuple, docs.collect()))


def test_near_dedup_meets_pairs_of_hot_groups_and_repeated_ids(spark):
    r = np.random.default_rng(31)
    base = words(r, 80)
    texts = [" ".join(copies_of(r, base, 0.03)) for _ in range(400)] + [" ".join(words(r, 60)) for _ in range(200)]
    texts += [texts[450]] * 50  # exact copies
    d = frame(spark, texts)
    got = {x["doc_id"]: x["group_id"] for x in near_dedup.groups(d, large=100).collect()}  # nodes over ``large`` are led by their first document
    assert {got.get(i) for i in range(400)} == {0} and {got.get(i) for i in [450, *range(600, 650)]} == {450}
    assert len(got) == 451
    two = spark.createDataFrame([(1, texts[500], "en", "a", 1), (1, texts[501], "en", "a", 1), (2, texts[501], "en", "a", 1), (3, texts[500], "en", "a", 1), (4, texts[502], "en", "a", 1)], DOCS)
    assert {x["doc_id"]: x["group_id"] for x in near_dedup.groups(two).collect()} == {1: 1, 2: 1, 3: 1}


def test_near_dedup_recall_at_the_threshold(spark):
    assert all(near_dedup.recall(near_dedup.LAMBDA, d, near_dedup.TREES) >= near_dedup.RECALL for d in range(1, near_dedup.DEPTH + 1))
    r = np.random.default_rng(32)
    low = r.integers(0, 1 << 32, (3000, 2, near_dedup.T), dtype=np.uint32)
    same = r.random((3000, near_dedup.T)) < near_dedup.LAMBDA
    low[:, 1][same] = low[:, 0][same]
    met = np.zeros(3000, bool)  # pairs at the threshold, followed down to nodes of the greatest depth
    for tree in range(near_dedup.TREES):
        live = [(k, np.uint64(tree + 1)) for k in range(3000) if not met[k]]
        for _ in range(near_dedup.DEPTH):
            node = np.array([n for _, n in live], np.uint64)
            (ra, ca), (rb, cb) = (near_dedup._children(node, np.array([low[k, i] for k, _ in live])) for i in (0, 1))
            a, b = set(zip(ra.tolist(), ca.tolist())), set(zip(rb.tolist(), cb.tolist()))
            live = [(live[i][0], np.uint64(c)) for i, c in a & b]
            if not live:
                break
        met[[k for k, _ in live]] = True
    assert met.mean() >= near_dedup.RECALL


def test_cut_leaves_other_texts_of_a_repeated_id(spark):
    r = np.random.default_rng(33)
    passage = " ".join(words(r, 60))
    kept = " ".join(f"KEEP{k}" for k in range(90))
    rows = [(1, passage), (2, "before " + passage + " after"), (2, kept), (2, kept), (3, kept + " more")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(x) for x in substring_dedup.cut(d).collect())
    assert got == [(1, passage), (2, kept), (2, kept), (2, "before  after"), (3, " more")]


def test_mixing_spreads_strided_and_null_ids(spark):
    rows = [(i * 4096, "t", "en", "a", 1) for i in range(3000)] + [(None, f"text {i}", "en", "a", 1) for i in range(3000)]
    d = spark.createDataFrame(rows, DOCS)
    own = mixing.F.substring(mixing.F.md5(mixing.F.coalesce(mixing.F.col("doc_id").cast("string"), mixing.F.col("text"))), 1, 3)
    assert d.groupBy(own).count().agg({"count": "max"}).first()[0] < 20
    assert mixing.mixed(d).count() == 6000
    o = odd(spark)
    n = collections.Counter((x["doc_id"], x["source"]) for x in mixing.copies(o).collect())
    again = collections.Counter((x["doc_id"], x["source"]) for x in mixing.copies(o.repartition(7)).collect())
    assert n == again and sum(n.values()) > 0
    assert mixing.copies(o, weights={"b": 1.0}).select("source").distinct().collect()[0]["source"] == "b" and mixing.copies(o, weights={}).count() == 0


def test_classifier_gradient_and_fitted_model_on_odd_rows(spark):
    r = np.random.default_rng(34)
    sizes = [1, 3, 2, 5, 1, 4, 2, 3]
    x, y, first = r.normal(size=(sum(sizes), 6)), np.array([0, 1] * 4, float), np.cumsum([0, *sizes[:-1]])
    model = quality_classifier.Attention(6, 4)
    out = model.forward(x, first)[-1]
    p = model.p
    for k, (f, n) in enumerate(zip(first, sizes)):  # plain loops
        bag = x[f : f + n]
        e = np.array([p["w"] @ (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) for h in bag])
        a = np.exp(e) / np.exp(e).sum()
        assert abs(out[k] - 1 / (1 + np.exp(-((a @ bag) @ p["c"] + p["b"][0])))) < 1e-9
    model.p["c"] = r.normal(size=6)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    grad, _ = model.gradient(x, first, y, share)

    def loss():
        out = model.forward(x, first)[-1]
        return -(share * (y * np.log(out) + (1 - y) * np.log(1 - out))).sum()

    for name in model.p:
        flat, g = model.p[name].reshape(-1), grad[name].reshape(-1)
        for i in range(len(flat)):
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g[i]) < 1e-6
    texts = [(" ".join(words(r, 60)) + (" bad0 bad1 bad2 bad3" if k % 2 else "")) for k in range(60)]
    rows = [(100 + k, t, "en", "a", 1) for k, t in enumerate(texts)] + [(100, texts[0], "en", "a", 1), (101, "other " + texts[1], "en", "a", 1)]
    d = odd(spark).unionByName(spark.createDataFrame(rows, DOCS), allowMissingColumns=True)
    labels = labels_of(spark, [(100 + k, 1 - k % 2, 0) for k in range(60)] + [(None, 1, 0), (4, None, 0), (100, 1, 0)])
    got = quality_classifier.scores(d, labels).collect()
    assert len(got) == d.count() and all(0 <= x["score"] <= 1 for x in got) and all(x["score"] == 0 and not x["keep"] for x in got if not x["n_passages"])
    by = collections.defaultdict(set)
    for x in got:
        by[x["doc_id"]].add((x["score"], x["keep"]))
    assert len(by[100]) == len(by[6]) == 1 and len(by[4] | by[5]) == 1
    t = quality_classifier.sample(d, labels)
    assert t["doc_id"].to_pylist() == list(range(100, 160)) and len(quality_classifier.sample(d, labels, most=9)) == 9 and 0 < len(quality_classifier.sample(d, labels, most_bytes=2000)) < 10


def test_warc_reports_what_is_damaged(spark, tmp_path):
    import gzip
    import zlib

    def listed(name, data):
        (tmp_path / name).write_bytes(data)
        rows = list(warc.normalised(f"file://{tmp_path}/{name}", f"file://{tmp_path}/out/{name}"))
        held = (tmp_path / "out" / name).read_bytes()
        for x in rows:
            if x[-1] == "ok":
                assert zlib.decompress(held[x[5] : x[5] + x[6]], 31).startswith(b"WARC/1.0")
        assert sum(x[6] for x in rows if x[-1] == "ok") == len(held) == (rows and max([x[5] + x[6] for x in rows if x[-1] == "ok"], default=0) or 0)
        return [x[2] if x[-1] == "ok" else x[-1] for x in rows]

    one = [warc.record(k, f"http://x/{k}", "text " * 50) for k in range(5)]
    members = [gzip.compress(x) for x in one]
    assert listed("a.gz", b"".join(members)) == [0, 1, 2, 3, 4]
    assert listed("zeros.gz", members[0] + bytes(512) + members[1] + bytes(100)) == [0, 1]
    bad = bytearray(members[2])
    bad[12:40] = bytes(28)
    assert listed("member.gz", members[0] + members[1] + bytes(bad) + members[3]) == [0, 1, "truncated"]  # damaged at a boundary
    assert listed("cut.gz", b"".join(members)[: len(b"".join(members[:3])) + 30]) == [0, 1, 2, "truncated"]
    assert listed("header.gz", gzip.compress(one[0] + b"junk\r\n\r\n" + one[1] + one[2].replace(b"Content-Length: ", b"Content-Length: x") + one[3])) == [0, "malformed", 1, "malformed", 3]
    assert listed("short.gz", gzip.compress(one[0] + one[1].replace(b"Content-Length: 250", b"Content-Length: 240") + one[2])) == [0, "malformed", 2]
    assert listed("id.gz", gzip.compress(one[0].replace(b"X-Page-Id: 0", b"X-Page-Id: abc") + one[1].replace(b"X-Page-Id: 1", b"X-Page-Id: 99999999999999999999") + one[2])) == [None, None, 2]
    long = warc.record(7, "http://x/" + "y" * 3_000_000, "z")
    assert listed("long.gz", gzip.compress(one[0] + long + one[1])) == [0, 7, 1]
    large = warc.record(8, "u", "".join(map(str, np.random.default_rng(1).integers(0, 1 << 62, 700_000))))
    assert listed("large.gz", gzip.compress(one[0] + large, 1)[:-3_000_000]) == [0, "truncated"]  # nothing of the half record is left
    assert listed("end.gz", gzip.compress(one[0] + one[1][:60])) == [0, "truncated"] and listed("plain.gz", b"no gzip") == ["truncated"]


@needs_vocabulary
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    d = odd(spark)
    labels_of(spark, [(4, 1, 0), (6, None, None)]).write.parquet(f"{tmp_path}/labels.parquet")
    docs = d
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        assert f(spark, d.limit(0), str(tmp_path)).count() == 0
        docs = common.stored(f(spark, docs, str(tmp_path)))
        assert docs.columns == d.columns and [x.dataType for x in docs.schema] == [x.dataType for x in d.schema], name
        ids = collections.Counter(x["doc_id"] for x in docs.select("doc_id").collect())
        if k == 0:
            assert ids[None] == 1 and ids[6] == 2 and ids[4] == ids[5] == 1 and not ids[1] and not ids[2] and not ids[3]
        if k in (1, 2):
            assert ids[4] == 1 and not ids[5] and ids[6] == 2 and ids[None] == 1
    packs = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(x["piece"] == 0 for x in packs) == docs.count() and corpus_pipeline.STAGES[-1][1](spark, d.limit(0), str(tmp_path)).count() == 0
    d.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
