"""Search of every name in every text.

Up to MOST_NAMES names go to the workers as one automaton and the corpus is read once, without a shuffle: each task finds all
occurrences of all names, with offsets, in time linear in the text. Longer lists are cut into portions that are searched one
after another, so memory is bounded however long the list is.

A name matches where it stands between word boundaries, without regard to case. The default is that every name is searched by
itself, so names may overlap, and occurrences of one don't; ``overlap="per_uid"`` resolves overlaps among the names of a uid.
Names longer than a threshold of ``edits`` also match word-aligned windows within its edit distance; of overlapping windows
the nearest, then first, then shortest is taken.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, edit_threshold
from ..plans.shared import text_slices
from ..sources.files import write_table

MOST_NAMES = 200_000
MOST_ROWS = 8192  # found, before they leave the worker; a text comes with all of its own
FIELDS = ["uniqid", "n", "match", "start", "end"]
FOUND = ["doc", *FIELDS, "uid_seq", "kw_seq", "distance"]


def keyword_list(names: DataFrame, uid: str = "uniqid", name: str = "search_name", order: Column | str | None = None) -> list[tuple[str, str, int, int]]:
    """(uid, keyword, place of the uid, place of the keyword in it), places by first appearance; blank names go."""
    rows = names.select(F.col(f"`{uid}`").cast("string").alias("u"), F.lower(F.trim(F.col(f"`{name}`"))).alias("k"), (F.lit(0) if order is None else F.col(order) if isinstance(order, str) else order).alias("o"))
    rows = rows.where("k <> ''")
    places: dict[str, list[int]] = {}
    out = []
    for r in (rows if order is None else rows.orderBy("o", "u", "k")).select("u", "k").collect():  # the list that goes to the workers
        p = places.setdefault(r["u"], [len(places), 0])
        out.append((r["u"], r["k"], p[0], p[1]))
        p[1] += 1
    return out


def _word(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether both ends are boundaries between a word character and another, or the text's end."""
    before = _word(text[start - 1]) if start else False
    after = _word(text[end]) if end < len(text) else False
    return before != _word(text[start]) and after != _word(text[end - 1])


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most`` + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def segments(word: str, k: int) -> list[tuple[int, str]]:
    """k + 1 even pieces and their offsets: within k edits, at least one stands unchanged, moved by at most k."""
    size, extra = divmod(len(word), k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = size + (i >= k + 1 - extra)
        out.append((at, word[at : at + n]))
        at += n
    return out


class Finder:
    """All occurrences of a list of keywords in a text."""

    def __init__(self, keywords: list[tuple[str, str, int, int]], edits: list | None = None):
        self.keywords = keywords
        self.k = [edit_threshold(len(k[1]), edits) for k in keywords]
        table: dict[str, list] = {}
        for i, (kw, k) in enumerate(zip((x[1] for x in keywords), self.k)):
            for at, piece in segments(kw, k) if k else [(0, kw)]:
                if piece:
                    table.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in table.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if table:
            self.automaton.make_automaton()
        self.some = bool(table)

    def __call__(self, text: str) -> list[tuple[int, int, int, int]]:
        """(keyword index, start, end, distance), by keyword and start."""
        if not self.some or not text:
            return []
        low, found, near, done = _lower(text), [], {}, {}
        for end, (n, owners) in self.automaton.iter(low):
            start = end + 1 - n
            for i, at in owners:
                if self.k[i]:
                    near.setdefault(i, set()).add(start - at)
                elif start >= done.get(i, 0) and _bounded(text, start, end + 1):
                    found.append((i, start, end + 1, 0))
                    done[i] = end + 1
        if near:
            edges, inside = [], False
            for p, ch in enumerate(low):
                if _word(ch) != inside:
                    edges.append(p)
                    inside = not inside
            if inside:
                edges.append(len(low))
            starts, ends = edges[::2], edges[1::2]
            for i, places in near.items():
                found += self._windows(i, sorted(places), low, starts, ends)
        found.sort()
        return found

    def _windows(self, i, places, low, starts, ends):
        from bisect import bisect_left, bisect_right

        kw, k = self.keywords[i][1], self.k[i]
        tried, fits = set(), []
        for p in places:
            for s in starts[bisect_left(starts, p - k) : bisect_right(starts, p + k)]:
                for e in ends[bisect_left(ends, s + len(kw) - k) : bisect_right(ends, s + len(kw) + k)]:
                    if e > s and (s, e) not in tried:
                        tried.add((s, e))
                        d = distance(low[s:e], kw, k)
                        if d <= k:
                            fits.append((d, s, e - s))
        taken = []
        for d, s, n in sorted(fits):
            if all(s + n <= a or s >= b for _, a, b, _ in taken):
                taken.append((i, s, s + n, d))
        return taken


def _apart(hits: list, keywords: list) -> list:
    """Without overlaps among the keywords of a uid: the leftmost, and at one place the first keyword, wins."""
    reach: dict[int, int] = {}
    out = []
    for h in sorted(hits, key=lambda h: (keywords[h[0]][2], h[1], keywords[h[0]][3])):
        u = keywords[h[0]][2]
        if h[1] >= reach.get(u, 0):
            out.append(h)
            reach[u] = h[2]
    return out


def mentions(docs: DataFrame, names: DataFrame, doc_id: str = "uniqid", text: str = "text", uid: str = "uniqid", name: str = "search_name",
             order: Column | str | None = None, edits: list | None = None, overlap: str = "all", max_results: int | None = 20, clean: bool = False,
             stopwords: list[str] | None = None, most_names: int = MOST_NAMES) -> DataFrame:
    """(doc, uniqid, n, match, start, end, uid_seq, kw_seq, distance): one row for each occurrence.

    With ``max_results`` only the first of a document in the order of uid, keyword and start are kept. ``clean`` searches the
    cleaned text, to which the offsets then refer.
    """
    if overlap not in ("all", "per_uid"):
        raise ValueError("overlap must be 'all' or 'per_uid'")
    keywords = keyword_list(names, uid, name, order)
    if overlap == "per_uid":
        keywords.sort(key=lambda k: (k[2], k[3]))
    source = F.col(f"`{text}`")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc"), (clean_text(source, stopwords) if clean else source).alias("text"))
    if not clean:  # a cleaned text that is blank matches nothing anyway; a filter on it would have it cleaned twice
        base = base.where(F.length(F.trim("text")) > 0)
    schema = f"doc {docs.schema[doc_id].dataType.simpleString()}, uniqid string, n int, match string, start int, end int, uid_seq int, kw_seq int, distance int"
    parts, at = [], 0
    while at < len(keywords) or not parts:
        to = min(len(keywords), at + most_names)
        while overlap == "per_uid" and to < len(keywords) and keywords[to][2] == keywords[to - 1][2]:
            to += 1
        parts.append(base.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(keywords[at:to]), edits, overlap, max_results), schema))
        at = max(to, 1)
    found = reduce(DataFrame.unionByName, parts)
    if max_results is not None and len(parts) > 1:
        found = first_of(found, max_results)
    return found


_finders: dict = {}


def _finder(keywords, edits, number: str) -> tuple[list, Finder]:
    """The list of a broadcast and its automaton, which a worker process builds once and keeps for the tasks that follow."""
    if number not in _finders:
        _finders.clear()  # one list at a time
        _finders[number] = keywords.value, Finder(keywords.value, edits)
    return _finders[number]


def _searcher(keywords, edits, overlap, max_results):
    number = uuid.uuid4().hex

    def search(batches):
        listed, find = _finder(keywords, edits, number)
        for batch in batches:
            docs, texts = batch.column("doc"), batch.column("text")
            rows = []
            for at, to in text_slices(texts):
                for i, t in enumerate(texts[at:to].to_pylist(), at):
                    hits = find(t)
                    if overlap == "per_uid":
                        hits = _apart(hits, listed)
                    hits = sorted((listed[k][2], listed[k][3], s, e, d, listed[k][0]) for k, s, e, d in hits)
                    rows += [(i, u, 1, _lower(t[s:e]), s, e, us, ks, d) for us, ks, s, e, d, u in hits[:max_results]]
                    if len(rows) >= MOST_ROWS:
                        yield _found(docs, rows)
                        rows = []
            if rows:
                yield _found(docs, rows)

    return search


def _found(docs: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    places, *rest = zip(*rows)
    kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 5]
    return pa.RecordBatch.from_arrays([docs.take(pa.array(places, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds))], FOUND)


def search_to(docs: DataFrame, names: DataFrame, path: str, doc_id: str = "uniqid", text: str = "text", k: int = 20, columns: list[str] | None = None, fields: list[str] | None = None, **options) -> dict:
    """Writes the wide result to ``path`` and returns rows read and written, seconds and rows a second, all counted on the way."""
    began, read, out = time.time(), Observation(), Observation()
    found = mentions(docs, names, doc_id, text, max_results=k, **options)
    result = wide(docs.observe(read, F.count(F.lit(1)).alias("n")), found, doc_id, columns, k, fields)
    write_table(result.observe(out, F.count(F.lit(1)).alias("n")), path)
    seconds = time.time() - began
    total = read.get["n"]
    return {"total_rows": total, "total_results": out.get["n"], "processing_time": seconds, "rows_per_second": total / seconds if seconds > 0 else 0.0}


def first_of(found: DataFrame, max_results: int) -> DataFrame:
    """The first occurrences of each document in the order of uid, keyword and start."""
    w = Window.partitionBy("doc").orderBy("uid_seq", "kw_seq", "start", "end")
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max_results).drop("_rank")


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("count"))


def grouped(found: DataFrame) -> DataFrame:
    """One row for each document and uid: n occurrences, with match, start and end joined by semicolons in text order."""
    each = F.sort_array(F.collect_list(F.struct("start", "end", "match")))
    g = found.groupBy("doc", "uniqid").agg(F.count(F.lit(1)).alias("n"), each.alias("m"))
    return g.select("doc", "uniqid", "n", *[F.array_join(F.col(f"m.{c}").cast("array<string>"), ";").alias(c) for c in ("match", "start", "end")])


def wide(docs: DataFrame, found: DataFrame, doc_id: str = "uniqid", columns: list[str] | None = None, k: int = 20, fields: list[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """Input columns, name1.uniqid to namek.end, and count; one row for each document with a match, or each document."""
    fields = fields or [*FIELDS, "count"]
    unknown = set(fields) - {*FIELDS, "count"} | set(columns or []) - set(docs.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    places = ["uid_seq", "kw_seq", "start", "end"]
    m = found.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(*places, "uniqid", "n", "match"))).alias("m"))
    d = docs.join(m, docs[f"`{doc_id}`"] == m["doc"], "left" if keep_empty else "inner")
    size = F.when(F.col("m").isNull(), 0).otherwise(F.size("m"))
    out = [F.col(f"`{c}`") for c in (columns or docs.columns)]
    for i in range(k):
        hit = F.get("m", F.lit(i))
        out += [F.coalesce(hit[f].cast("string"), F.lit("")).alias(f"name{i + 1}.{f}") for f in FIELDS if f in fields]
    if "count" in fields:
        out.append(F.least(size, F.lit(k)).alias("count"))
    return d.select(*out)


class BaseSearchEngine:
    """Names and their places; a subclass says in ``hits`` what of them is in a text, as (keyword index, start, end, distance)."""

    def __init__(self, names: list[tuple[str, str]], edits: list | None = None):
        places: dict[str, list[int]] = {}
        self.keywords = []
        for uid, name in names:
            if k := name.strip().lower():
                p = places.setdefault(uid, [len(places), 0])
                self.keywords.append((uid, k, p[0], p[1]))
                p[1] += 1
        self.edits = edits

    def threshold(self, keyword: str) -> int:
        return edit_threshold(len(keyword), self.edits)

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        raise TypeError("a search engine must say what it finds: override hits(text)")

    def search(self, text: str, max_results: int | None = 20) -> list[dict]:
        hits = list(self.hits(text or ""))
        hits.sort(key=lambda h: (self.keywords[h[0]][2], self.keywords[h[0]][3], h[1]))
        return [{"uniqid": self.keywords[i][0], "n": 1, "match": _lower(text[s:e]), "start": s, "end": e} for i, s, e, _ in hits[:max_results]]


class Engine(BaseSearchEngine):
    """Search in one text at a time, in process; ``create_engine`` makes one."""

    def __init__(self, names: list[tuple[str, str]], edits: list | None = None, overlap: str = "all"):
        super().__init__(names, edits)
        self.overlap, self.find = overlap, Finder(self.keywords, edits)

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        hits = self.find(text)
        return _apart(hits, self.keywords) if self.overlap == "per_uid" else hits


STRATEGIES: dict[str, Callable[..., BaseSearchEngine]] = {
    "basic": lambda names, edits: Engine(names, edits, "per_uid"),
    "optimized": Engine,
    "streaming": Engine,
}


def create_engine(names: list[tuple[str, str]], edits: list | None = None, strategy: str | type[BaseSearchEngine] = "optimized") -> BaseSearchEngine:
    """``optimized`` reports overlaps, ``basic`` resolves them within a uid, ``streaming`` is for texts that come one by one; or a class of one's own."""
    if isinstance(strategy, str) and strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return (STRATEGIES[strategy] if isinstance(strategy, str) else strategy)(names, edits)


SearchMultipleKeywords = VectorizedSearchEngine = Engine
create_optimized_search_engine = create_engine


def search_names(docs: DataFrame, names: DataFrame, doc_id: str = "uniqid", text: str = "text", columns: list[str] | None = None, fields: list[str] | None = None, k: int = 20, **options) -> DataFrame:
    """The wide result of ``mentions`` in one call."""
    return wide(docs, mentions(docs, names, doc_id, text, max_results=k, **options), doc_id, columns, k, fields)


search_names_optimized = search_to
