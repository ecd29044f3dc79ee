"""Raw names to parts: split cells, strip remarks, parse, standardise, keep the first of equal names, number the rest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import FIELDS, ROMAN, STRUCT, parse, title_case
from ..functions.text import remove_extra_space
from ..plans.shared import free, numbered, ranked

PARTS = ["FirstName", "MiddleInitial/Name", "LastName", "RomanNumeral", "Title", "Suffix"]


def fragments(c: Column) -> Column:
    """The names of a cell, between ampersands and slashes."""
    return F.split(c, "[&/]", -1)


def without_remarks(c: Column) -> Column:
    """Without what stands between the first opening and last closing parenthesis, then quote."""
    return F.regexp_replace(F.regexp_replace(c, r"\s*\(.*\)\s*", " "), r"\s*['\"].*[\"']\s*", " ")


def _two_step(name: str | None) -> dict[str, str]:
    p = parse(name)
    tail = [x.strip() for x in p["suffix"].split(",")]
    return parse(f"{p['first']}, {tail[1]} {tail[0]}") if not p["last"] and len(tail) > 1 else p


def parts(c: Column) -> Column:
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_two_step(x) for x in s], columns=FIELDS)

    return F.pandas_udf(run, STRUCT)(c)


def _in(x: Column, words: list[str]) -> Column:
    return x.isin(*words)


def standardised(df: DataFrame, p: str) -> DataFrame:
    """Columns _first, _mid, _last, _key, _roman, _title, _suffix from the struct ``p`` of parsed parts."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    d = df.withColumns({"_first": F.lower(f"{p}.first"), "_mids": words(F.lower(f"{p}.middle")), "_last": F.col(f"{p}.last"), "_title": F.col(f"{p}.title")})
    d = d.withColumn("_tail", F.filter(F.transform(F.split(f"{p}.suffix", ","), lambda x: F.trim(x)), lambda x: x != ""))
    d = d.withColumns({"_roman": F.coalesce(F.try_element_at(F.filter("_tail", lambda x: _in(x, ROMAN)), F.lit(-1)), F.lit("")), "_suffix": F.array_join(F.filter("_tail", lambda x: ~_in(x, ROMAN)), ", ")})
    d = d.withColumn("_key", F.lower(F.trim(F.concat("_last", F.lit(" "), "_roman"))))
    end = F.coalesce(F.regexp_replace(F.try_element_at("_mids", F.lit(-1)), r"\.", ""), F.lit(""))
    is_roman = (F.size("_mids") >= 2) & _in(F.upper(end), ROMAN)
    most = F.slice("_mids", F.lit(1), F.greatest(F.size("_mids") - 1, F.lit(0)))
    d = d.withColumns({"_roman": F.when(is_roman, F.upper(end)).otherwise(F.col("_roman")), "_mids": F.when(is_roman, most).otherwise(F.col("_mids"))})
    is_title = _in(end, ["mr", "ms"])
    d = d.withColumns({"_title": F.when(is_title, end).otherwise(F.col("_title")), "_mids": F.when(is_title, most).otherwise(F.col("_mids"))})
    named = _in(F.col("_title"), ["POPE", "BARON", "MAHDI"])
    d = d.withColumns({"_first": F.when(named, F.concat(F.lower("_title"), F.lit(" "), "_first")).otherwise(F.col("_first")), "_title": F.when(named, "").otherwise(F.col("_title"))})
    suffix = F.trim(F.regexp_replace(F.concat("_suffix", F.lit(" ")), r"(?i)(JR|SR|PHD)[^.]", "$1."))
    return d.withColumns({"_suffix": suffix, "_mid": F.array_join(F.transform("_mids", lambda x: F.when(F.length(x) == 1, F.concat(x, F.lit("."))).otherwise(x)), " ")})


def clean_names(raw: DataFrame, column: str = "Name", order: str | None = None, keep_all: bool = False) -> DataFrame:
    """Input columns, ``uniqid`` (1, 2, ... in input order) and the six columns of PARTS; of equal names the first stays.

    ``order`` names a whole-number column that gives the input order; without it rows are numbered as they are read. A null cell
    gives no name, an empty one a name without parts.
    """
    if column not in raw.columns:
        raise ValueError(f"no column {column!r}")
    at = order or free(raw, "_ord")
    d = raw if order else numbered(raw, at)
    names = d.select(*[F.col(f"`{c}`") for c in d.columns], F.posexplode(fragments(F.col(f"`{column}`"))).alias("_frag", "_name"))
    d = standardised(names.withColumn("_p", parts(without_remarks(F.col("_name")))), "_p")
    if not keep_all:
        w = Window.partitionBy("_first", "_mid", "_key").orderBy(at, "_frag")
        d = d.withColumn("_nth", F.row_number().over(w)).where("_nth = 1")
    out = [F.upper("_first"), F.upper("_mid"), F.col("_last"), F.upper("_roman"), F.upper("_title"), F.upper("_suffix")]
    d = d.select(*[F.col(f"`{c}`") for c in raw.columns if c not in PARTS], *[c for c in [at] if c not in raw.columns], "_frag", *[c.alias(n) for c, n in zip(out, PARTS)])
    return ranked(d, free(raw, "uniqid"), at, "_frag").drop("_frag", *[c for c in [at] if c not in raw.columns])


def clean_names_loose(raw: DataFrame, column: str = "Name", keep_all: bool = False) -> DataFrame:
    """The form for endless input: one name a cell, title case, ``uniqid`` from the name's hash; blank names go; no order needed."""
    name = remove_extra_space(F.col(f"`{column}`"))
    d = raw.withColumn("_name", name).where("_name <> ''").withColumn("_p", parts(F.col("_name")))
    cols = {"FirstName": "first", "MiddleName": "middle", "LastName": "last", "Prefix": "title", "Suffix": "suffix"}
    d = d.select(*[F.col(f"`{c}`") for c in raw.columns], F.xxhash64("_name").cast("string").alias("uniqid"), *[title_case(F.col(f"_p.{v}")).alias(k) for k, v in cols.items()])
    return d if keep_all else d.dropDuplicates(["FirstName", "LastName"])
