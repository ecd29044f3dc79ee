"""Search patterns: expansion of names, drop list, and removal of patterns that can't tell people apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import edit_threshold_column, thresholds
from ..plans.shared import checkpointed, ranked

DEFAULT = ["FirstName LastName", "NickName LastName", "Prefix LastName"]
LISTS = {"Prefix": "prefixes", "NickName": "nick_names"}


def expand(names: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """A row for each way to fill each pattern: ``names`` with ``pat_ord``, ``prod_ord`` and ``search_name`` of two parts or more."""
    options = []
    for k, p in enumerate(patterns or DEFAULT):
        ways = None
        for token in p.split():
            source = LISTS.get(token, token)
            if source not in names.columns:
                raise ValueError(f"pattern {p!r} needs column {source!r}")
            c = F.coalesce(F.col(f"`{source}`"), F.lit(""))
            values = F.split(c, ";", -1) if token in LISTS else F.array(F.lower(c))
            one = F.transform(values, lambda x: F.array(x))
            ways = one if ways is None else _product(ways, values)
        options.append(F.struct(F.lit(k).alias("pat_ord"), ways.alias("ways")))
    d = names.select("*", F.explode(F.array(*options)).alias("_o")).select(*[F.col(f"`{c}`") for c in names.columns], F.col("_o.pat_ord").alias("pat_ord"), F.posexplode("_o.ways").alias("prod_ord", "_w"))
    d = d.withColumn("_w", F.filter("_w", lambda x: x != "")).where(F.size("_w") > 1)
    return d.withColumn("search_name", F.array_join("_w", " ")).drop("_w")


def _product(ways, values):
    return F.flatten(F.transform(ways, lambda a: F.transform(values, lambda b: F.concat(a, F.array(b)))))


def drop_listed(patterns: DataFrame, listed: DataFrame, column: str = "search_name", name: str = "search_name") -> DataFrame:
    """Without the patterns of the list, which is compared in lower case."""
    drop = listed.select(F.lower(F.trim(F.col(f"`{column}`"))).alias("_drop")).where("_drop <> ''").distinct()
    return patterns.join(drop, F.lower(F.col(f"`{name}`")) == F.col("_drop"), "left_anti")


def dedup_exact(patterns: DataFrame, order: list[str], uid: str = "uniqid", name: str = "search_name") -> DataFrame:
    """The first row of each pattern, where all rows of the pattern are of one ``uid``."""
    by = Window.partitionBy(name)
    d = patterns.withColumns({"_lo": F.min(uid).over(by), "_hi": F.max(uid).over(by), "_nth": F.row_number().over(by.orderBy(*order))})
    return d.where("_nth = 1 AND _lo <=> _hi").drop("_lo", "_hi", "_nth")


def near_pairs(left: DataFrame, right: DataFrame, edits: list | None) -> DataFrame:
    """(i, j, d): pairs of rows (id, name) within the edit distance that the length of the left name allows.

    The left name is cut into one piece more than edits are allowed, so one piece stands unchanged in the right name, moved by no
    more than that; pieces are joined by equality and only such pairs are measured.
    """
    most = max([d for _, d in thresholds(edits)], default=0)
    k, n = edit_threshold_column(F.length("name"), edits), F.length("name")
    a = left.select(F.col("id").alias("i"), F.col("name").alias("a"), k.alias("k"), n.alias("n"))
    a = a.withColumns({"size": F.expr("n div (k + 1)"), "plain": F.expr("k + 1 - n % (k + 1)")})
    a = a.select("i", "a", "k", "n", F.explode(F.expr("transform(sequence(0, k), x -> struct(x * size + greatest(0, x - plain) AS at, size + int(x >= plain) AS len))")).alias("p"))
    a = a.select("i", "a", "k", "n", F.col("p.at").alias("at"), F.col("p.len").alias("len"), F.expr("substring(a, p.at + 1, p.len)").alias("piece"))
    lens = sorted(r[0] for r in a.select("len").distinct().collect())  # lengths of pieces: some tens
    if not lens:
        return a.select("i", F.col("i").alias("j"), F.lit(0).alias("d"))
    b = right.select(F.col("id").alias("j"), F.col("name").alias("b"), F.length("name").alias("m"))
    b = b.select("j", "b", "m", F.explode(F.array(*[F.lit(x) for x in lens])).alias("len")).where("len <= m AND (len > 0 OR m <= %d)" % (2 * most))
    b = b.select("j", "b", "m", "len", F.explode(F.expr("sequence(0, CASE WHEN len = 0 THEN 0 ELSE m - len END)")).alias("to")).withColumn("piece", F.expr("substring(b, to + 1, len)"))
    met = a.join(b, ["piece", "len"]).where("abs(n - m) <= k AND (len = 0 OR abs(at - to) <= k)").select("i", "j", "a", "b", "k").distinct()
    return met.withColumn("d", F.expr(f"CASE WHEN a = b THEN 0 ELSE levenshtein(a, b, {most}) END")).where("d >= 0 AND d <= k").select("i", "j", "d")


def dedup_fuzzy(patterns: DataFrame, order: str, edits: list | None, uid: str = "uniqid", name: str = "search_name") -> DataFrame:
    """Rows in ``order`` strike out later ones near them, and themselves if a later one has another ``uid``; struck rows strike no more.

    ``order`` is a whole number. Equal names are near each other, so of a name only the first row can go unstruck: names strike each other
    in the order of their first rows, and of the other rows only the last one, and the last of another uid than that, are kept, which
    say whether a later one has another uid. Pairs are thus of different names, however often a name occurs. Each round settles the
    names whose earlier neighbours are settled, and is cut by checkpoint().
    """
    d = checkpointed(ranked(patterns, "_i", order))
    rows = d.select(F.col("_i").alias("i"), F.col(name).alias("name"), F.struct(F.col(uid).alias("u")).alias("u")).where("name IS NOT NULL")  # in a struct a null uid is one, too
    last = rows.groupBy("name", "u").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    ends = last.groupBy("name").agg(F.min_by("u", "lo").alias("u"), F.min("lo").alias("id"), F.max("hi").alias("hi1"), F.max_by("u", "hi").alias("u1"))
    other = last.join(ends.select("name", "u1"), "name").where("NOT u <=> u1").groupBy("name").agg(F.max("hi").alias("hi2"))
    names = checkpointed(ends.join(other, "name", "left").select("id", "name", "u", "hi1", "u1", "hi2"))
    near = near_pairs(names.select("id", "name"), names.select("id", "name"), edits)
    later = F.when(~F.col("u").eqNullSafe(F.col("u1")), F.col("hi1") > F.col("i")).otherwise(F.coalesce(F.col("hi2") > F.col("i"), F.lit(False)))
    met = near.join(names.select(F.col("id").alias("i"), "u"), "i").join(names.select(F.col("id").alias("j"), "u1", "hi1", "hi2"), "j")
    met = checkpointed(met.select("i", "j", later.alias("other")))
    edges = met.where("i < j").select("i", "j")
    state = checkpointed(names.select("id").join(edges.select(F.col("j").alias("id")).distinct().withColumn("s", F.lit("open")), "id", "left").select("id", F.coalesce("s", F.lit("active")).alias("s")))
    while not state.where("s = 'open'").isEmpty():
        into = edges.join(state.select(F.col("id").alias("i"), F.col("s").alias("si")), "i").groupBy(F.col("j").alias("id"))
        now = into.agg(F.when(F.bool_or(F.col("si") == "active"), "struck").when(F.bool_and(F.col("si") == "struck"), "active").otherwise("open").alias("new"))
        state = checkpointed(state.join(now, "id", "left").select("id", F.when(F.col("s") == "open", F.col("new")).otherwise(F.col("s")).alias("s")))
    shared = met.where("other").select(F.col("i").alias("id")).distinct()
    kept = state.where("s = 'active'").select("id").join(shared, "id", "left_anti").select(F.col("id").alias("_i"))
    return d.join(kept.withColumn("_kept", F.lit(True)), "_i", "left").where(F.col("_kept") | F.col(name).isNull()).drop("_i", "_kept")


def preprocess(names: DataFrame, patterns: list[str] | None = None, edits: list | None = None, drop: DataFrame | None = None, order: str = "uniqid", uid: str = "uniqid") -> DataFrame:
    """Expansion, drop list and removal of ambiguous patterns, exact or by edit distance."""
    d = expand(names, patterns)
    if drop is not None:
        d = drop_listed(d, drop)
    places = [order, "pat_ord", "prod_ord"]
    if not edits:
        return dedup_exact(d, places, uid).drop("pat_ord", "prod_ord")
    return dedup_fuzzy(ranked(d, "_place", order, "pat_ord", "prod_ord"), "_place", edits, uid).drop("_place", "pat_ord", "prod_ord")


preprocess_names = preprocess
