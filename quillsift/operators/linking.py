"""Mentions to known names: exact, normalised, then by vectors; names in context; a rule for finding names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import context, is_person_context, normalize_name, quoted
from ..plans.shared import checkpointed

#: Rows of a tile of left and of right vectors, numbers that the left vectors of a task have together, and pairs that are computed at once.
ROWS, TILE, VALUES, MANY = 1024, 2048, 1 << 22, 1 << 16
NONE = np.iinfo(np.int64).max
CAPITALISED = r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)+"


def occurrences(text: Column, pattern: str) -> Column:
    """array of (start, end, text) of all matches of a regular expression of Java, which must not match the empty string."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("all"))
    step = lambda acc, x: F.struct((acc["at"] + x["g"] + F.length(x["m"])).alias("at"), F.concat(acc["all"], F.array(F.struct((acc["at"] + x["g"]).alias("start"), (acc["at"] + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("text")))).alias("all"))
    return F.when(text.isNotNull(), F.aggregate(pairs, none, step)["all"])


def entities(docs: DataFrame, text: str = "text", finder: Callable | None = None, labels: tuple[str, ...] = ("PERSON",), least: int = 2) -> DataFrame:
    """``docs`` with a row for each name found: ``entity``, ``label``, ``start``, ``end``.

    Without ``finder`` (texts -> lists of (start, end, label), called on batches), runs of two or more capitalised words are persons.
    """
    if finder is None:
        d = docs.withColumn("_e", F.explode(occurrences(F.col(f"`{text}`"), CAPITALISED))).select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_e.text").alias("entity"), F.lit("PERSON").alias("label"), F.col("_e.start").alias("start"), F.col("_e.end").alias("end"))
    else:
        kind = "array<struct<start:int,end:int,label:string>>"
        found = F.pandas_udf(lambda s: pd.Series([[{"start": a, "end": b, "label": x} for a, b, x in each] for each in finder([t or "" for t in s])], index=s.index), kind)
        d = docs.withColumn("_e", F.explode(found(F.col(f"`{text}`")))).select(*[F.col(f"`{c}`") for c in docs.columns], F.expr(f"substring(`{text}`, _e.start + 1, _e.end - _e.start)").alias("entity"), F.col("_e.label").alias("label"), F.col("_e.start").alias("start"), F.col("_e.end").alias("end"))
    return d.where(F.col("label").isin(*labels)).withColumn("entity", F.trim("entity")).where(F.length("entity") >= least)


def link_index(kb: DataFrame, canonical: str = "canonical", aliases: str = "aliases", order: str | None = None) -> DataFrame:
    """(name, canonical) of every canonical name and alias; of two entries for a name the later counts."""
    names = F.array_distinct(F.concat(F.array(F.col(canonical)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))
    d = kb.select(F.explode(names).alias("name"), F.col(canonical).alias("canonical"), (F.col(order) if order else F.lit(0)).alias("o"))
    return d.groupBy("name").agg(F.max_by("canonical", F.struct("o", "canonical")).alias("canonical"))


def link(mentions: DataFrame, index: DataFrame, text: str = "entity") -> DataFrame:
    """``mentions`` with ``linked``, ``confidence`` and ``method``: exact 1.0, normalised 0.9, else null, 0.0 and none."""
    normal = index.select(normalize_name(F.col("name")).alias("norm"), "canonical").where("norm <> ''").groupBy("norm").agg(F.min("canonical").alias("canonical"))
    c = F.col(f"m.`{text}`")
    d = mentions.alias("m").join(index.alias("x"), c == F.col("x.name"), "left").join(normal.alias("y"), normalize_name(c) == F.col("y.norm"), "left")
    exact, near = F.col("x.canonical"), F.col("y.canonical")
    method = F.when(exact.isNotNull(), "exact").when(near.isNotNull(), "normalized").otherwise("none")
    sure = F.when(exact.isNotNull(), 1.0).when(near.isNotNull(), 0.9).otherwise(0.0)
    return d.select(*[F.col(f"m.`{n}`") for n in mentions.columns], F.coalesce(exact, near).alias("linked"), sure.alias("confidence"), method.alias("method"))


def _vectors(column: pa.Array) -> np.ndarray:
    """The vectors of a column, as rows of length 1."""
    sizes = column.value_lengths().to_numpy()
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


class _Nearest:
    """A group of left vectors that meets tiles of right ones, whose ids ascend: single precision rules out most pairs, the others are computed in double.

    With ``k`` it holds the best so far of each left vector, and what can't surpass the last of them is ruled out.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, same: bool, least: float, k: int | None):
        self.ids, self.v, self.v32, self.same, self.least, self.k = ids, v, v.astype(np.float32), same, least, k
        self.slack = 1e-6 + (v.shape[1] + 8) * 2.0**-23  # rounding to six places, and what single precision may be off by
        if k is not None:
            self.s, self.other = np.full((len(ids), k), float(least)), np.full((len(ids), k), NONE)

    def meet(self, ids: np.ndarray, v: np.ndarray):
        v32 = v.astype(np.float32).T
        for at in range(0, len(self.ids), ROWS):
            to = min(at + ROWS, len(self.ids))
            cut = np.full(to - at, self.least) if self.k is None else self.s[at:to, -1]
            p, q = np.divmod(np.flatnonzero(self.v32[at:to] @ v32 >= (cut - self.slack).astype(np.float32)[:, None]), len(ids))
            if len(p) <= (to - at) * len(ids) // 32:
                s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.v[at + p[i : i + MANY]], v[q[i : i + MANY]]) for i in range(0, len(p), MANY))]).round(6)
            else:  # so many that the whole product is less work
                every = np.round(self.v[at:to] @ v.T, 6)
                if self.same:
                    every[self.ids[at:to, None] == ids] = -2
                ok = every >= cut[:, None]
                if self.k is not None and self.k < len(ids):
                    ok &= every >= -np.partition(-every, self.k - 1, axis=1)[:, self.k - 1 : self.k]  # ties stay
                p, q = np.nonzero(ok)
                s = every[p, q]
            ok = (s >= cut[p]) & ((self.ids[at + p] != ids[q]) if self.same else True)
            if self.k is not None:
                ok &= (s > cut[p]) | (ids[q] < self.other[at + p, -1])
            p, q, s = at + p[ok], ids[q[ok]], s[ok]
            if self.k is not None:
                self._take(p, q, s)
            else:
                for i in range(0, len(p), MANY):
                    yield _pairs(self.ids[p[i : i + MANY]], q[i : i + MANY], s[i : i + MANY])

    def _take(self, p: np.ndarray, q: np.ndarray, s: np.ndarray) -> None:
        if not len(p):
            return
        rows = np.unique(p)
        every, other, sim = np.concatenate([np.repeat(rows, self.k), p]), np.concatenate([self.other[rows].ravel(), q]), np.concatenate([self.s[rows].ravel(), s])
        order = np.lexsort((other, -sim, every))
        every, other, sim = every[order], other[order], sim[order]
        nth = np.arange(len(every)) - np.searchsorted(every, every)
        best = nth < self.k
        self.other[every[best], nth[best]], self.s[every[best], nth[best]] = other[best], sim[best]

    def rest(self):
        for at in range(0, len(self.ids) if self.k is not None else 0, ROWS):
            other = self.other[at : at + ROWS]
            p, q = np.nonzero(other != NONE)
            yield _pairs(self.ids[at + p], other[p, q], self.s[at + p, q])


def _pairs(i: np.ndarray, j: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(s)], ["id", "other", "similarity"])


def similar(left: DataFrame, right: DataFrame | None = None, vec_id: str = "vec_id", vector: str = "embedding", least: float = -1.0, k: int | None = None) -> DataFrame:
    """(id, other, similarity): cosines of at least ``least`` of every pair of a left and a right vector, or the ``k`` largest of each id.

    Every pair is compared. A task holds a group of left vectors, of VALUES numbers, and a share of the right ones streams by, so its
    memory doesn't grow with the tables. Without ``right`` a vector isn't paired with itself.
    Vectors that are null or empty are left out; all must be of one length.
    """
    same = right is None
    right = left if same else right
    a, b = (d.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND size(v) > 0") for d in (left, right))
    if {a.schema["v"].dataType.simpleString(), b.schema["v"].dataType.simpleString()} != {"array<float>"}:
        a, b = (d.withColumn("v", F.col("v").cast("array<double>")) for d in (a, b))
    n, length = a.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    m = n if same else b.count()
    cores = left.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(-(-n // ROWS), cores * -(-n // (cores * max(ROWS, VALUES // length)))))  # every core has as many
    shares = max(1, min(-(-m // TILE), cores // groups))  # few, as each finds the best of its own
    a = a.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).select(F.expr(f"CAST(pmod(xxhash64(id), {groups}) * {shares} + h AS INT)").alias("cell"), F.lit(False).alias("right"), "id", "v")
    b = b.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(F.expr(f"CAST(g * {shares} + pmod(xxhash64(id), {shares}) AS INT)").alias("cell"), F.lit(True).alias("right"), "id", "v")

    def product(batches):
        group, found = [], None
        for t in batches:
            if not t.num_rows:
                continue
            ids, v, at = t.column("id").to_numpy(), _vectors(t.column("v")), t.num_rows - t.column("right").true_count
            if at:
                group.append((ids[:at], v[:at]))
            if group and at < len(ids):
                found = found or _Nearest(*map(np.concatenate, zip(*group)), same, least, k)
                for i in range(at, len(ids), TILE):
                    yield from found.meet(ids[i : i + TILE], v[i : i + TILE])
        if found:
            yield from found.rest()

    cells = a.union(b).repartitionById(groups * shares, "cell").sortWithinPartitions("right", "id").select("right", "id", "v")
    d = cells.mapInArrow(product, "id long, other long, similarity double")
    if k is None:
        return d
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def link_by_vector(mentions: DataFrame, kb: DataFrame, threshold: float = 0.7, alternatives: int = 5, **columns) -> DataFrame:
    """(id, linked, confidence, alternatives): the most similar entry, and those that follow it, of each mention that has one."""
    top = similar(mentions, kb, least=threshold, k=alternatives + 1, **columns)
    each = F.sort_array(F.collect_list(F.struct("rank", "other", "similarity")))
    return top.groupBy("id").agg(each.alias("a")).select("id", F.col("a")[0]["other"].alias("linked"), F.col("a")[0]["similarity"].alias("confidence"), F.expr(f"transform(slice(a, 2, {alternatives}), x -> x.other)").alias("alternatives"))


def link_all(mentions: DataFrame, kb: DataFrame, embed: Callable[[Column], Column] | None = None, text: str = "entity", canonical: str = "canonical", aliases: str = "aliases", threshold: float = 0.8, alternatives: int = 5) -> DataFrame:
    """``mentions`` with ``linked``, ``confidence``, ``method`` and ``alternatives``: exact, normalised, then, for those that are left, by vectors.

    ``embed`` makes a column of vectors from one of names. Each different text that is left is compared once, with every canonical name.
    """
    none = F.array().cast("array<struct<name:string,confidence:double>>")
    d = link(mentions, link_index(kb, canonical, aliases), text).withColumn("alternatives", none)
    if embed is None:
        return d
    c = F.col(f"`{text}`")
    left = checkpointed(d.where("method = 'none'").select(c.alias("name")).where("name IS NOT NULL").distinct().select("name", F.xxhash64("name").alias("vec_id"), embed(F.col("name")).alias("embedding")))
    known = checkpointed(kb.select(F.col(canonical).alias("known")).distinct().select("known", F.xxhash64("known").alias("vec_id"), embed(F.col("known")).alias("embedding")))
    top = similar(left, known, least=threshold, k=alternatives + 1)
    top = top.join(known.select(F.col("vec_id").alias("other"), "known"), "other").join(left.select(F.col("vec_id").alias("id"), "name"), "id")
    each = top.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("known").alias("name"), F.col("similarity").alias("confidence")))).alias("a"))
    each = each.select(F.col("name").alias("_name"), F.col("a")[0]["name"].alias("_best"), F.col("a")[0]["confidence"].alias("_sure"), F.expr("transform(slice(a, 2, size(a)), x -> struct(x.name AS name, x.confidence AS confidence))").alias("_rest"))
    d = d.join(each, (F.col("method") == "none") & (c == F.col("_name")), "left")
    won = F.col("_best").isNotNull()
    found = {"linked": F.coalesce("linked", "_best"), "confidence": F.when(won, F.col("_sure")).otherwise(F.col("confidence")), "method": F.when(won, "semantic").otherwise(F.col("method")), "alternatives": F.when(won, F.col("_rest")).otherwise(F.col("alternatives"))}
    return d.select(*[F.col(f"`{n}`") for n in mentions.columns], *[v.alias(k) for k, v in found.items()])


def process_text(docs: DataFrame, text: str = "text", finder: Callable | None = None, kb: DataFrame | None = None, extract: bool = True, link_entities: bool = False, least: int = 2, threshold: float = 0.8, embed: Callable | None = None) -> DataFrame:
    """A row for each person found in ``docs``, linked to ``kb`` if asked for; without ``extract`` no row, but the same columns."""
    d = entities(docs, text, finder, ("PERSON",), least)
    if not extract:
        d = d.limit(0)
    return link_all(d, kb, embed, threshold=threshold) if link_entities and kb is not None else d


def in_context(docs: DataFrame, names: list[str], doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """(doc, name, start, context, person): each place where a name stands, as a substring without regard to case."""
    if any(not n.strip() for n in names):
        raise ValueError("a name is empty")
    t = F.col(f"`{text}`")

    def placed(n: str) -> Column:
        return F.transform(occurrences(F.lower(t), quoted(n.lower())), lambda x: F.struct(F.lit(n).alias("name"), x["start"].alias("start"), x["end"].alias("end")))

    each = F.explode(F.flatten(F.array(*map(placed, names))))
    d = docs.select(F.col(f"`{doc_id}`").alias("doc"), t.alias("_t"), each.alias("_m"))
    s, e = F.col("_m.start"), F.col("_m.end")
    return d.select("doc", F.col("_m.name").alias("name"), s.alias("start"), context(F.col("_t"), s, e, window).alias("context"), is_person_context(F.col("_t"), s, e, window).alias("person"))


def context_counts(found: DataFrame, names: list[str]) -> DataFrame:
    """(name, match_count, person_matches) of every name, also those that stand nowhere."""
    every = found.sparkSession.createDataFrame([(n,) for n in names], "name string")
    c = found.groupBy("name").agg(F.count(F.lit(1)).alias("match_count"), F.count_if("person").alias("person_matches"))
    return every.join(c, "name", "left").select("name", F.coalesce("match_count", F.lit(0)).alias("match_count"), F.coalesce("person_matches", F.lit(0)).alias("person_matches"))
