"""Titles and nicknames for cleaned names: lookups that keep every name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import numbered


def prefix_table(rows: DataFrame, key: str, value: str = "prefixes", order: str | None = None) -> DataFrame:
    """(key, prefixes): the last row of each key counts."""
    d = rows if order else numbered(rows, "_ord")
    return d.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.max_by(f"`{value}`", order or "_ord").alias("prefixes"))


def nickname_table(lines: DataFrame, text: str = "value", order: str | None = None) -> DataFrame:
    """(key, nick_names) of lines 'name, name - nick, nick'; lower case; the first line of a name counts."""
    d = lines if order else numbered(lines, "_ord")
    sides = F.split(F.lower(f"`{text}`"), "-", 2)
    d = d.where(F.col(f"`{text}`").contains("-")).select(F.col(order or "_ord").alias("o"), sides[0].alias("names"), sides[1].alias("nicks"))
    trimmed = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return d.select("o", F.explode(trimmed("names")).alias("key"), F.array_join(trimmed("nicks"), ";").alias("nick_names")).groupBy("key").agg(F.min_by("nick_names", "o").alias("nick_names"))


def read_prefixes(spark: SparkSession, path: str, key: str) -> DataFrame:
    return prefix_table(spark.read.csv(path, header=True), key)


def read_nicknames(spark: SparkSession, path: str) -> DataFrame:
    return nickname_table(spark.read.text(path))


def augment_names(names: DataFrame, prefixes: DataFrame | None = None, nicknames: DataFrame | None = None, prefix_column: str = "seat", name_column: str = "FirstName") -> DataFrame:
    """``names`` with ``prefixes`` and ``nick_names``, empty where nothing is known. Catalyst broadcasts tables that are small."""
    own = [F.col(f"n.`{c}`") for c in names.columns if c not in ("prefixes", "nick_names")]
    d, found = names.alias("n"), {"prefixes": F.lit(""), "nick_names": F.lit("")}
    if prefixes is not None:
        d, found["prefixes"] = d.join(prefixes.alias("p"), F.col(f"n.`{prefix_column}`") == F.col("p.key"), "left"), F.coalesce("p.prefixes", F.lit(""))
    if nicknames is not None:
        d, found["nick_names"] = d.join(nicknames.alias("k"), F.lower(F.col(f"n.`{name_column}`")) == F.col("k.key"), "left"), F.coalesce("k.nick_names", F.lit(""))
    return d.select(*own, *[c.alias(n) for n, c in found.items()])


merge_supp = augment_names
