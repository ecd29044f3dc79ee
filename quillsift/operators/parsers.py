"""Choice between name parsers: by rule, by a model that the caller brings, or by what a name looks like."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import parse

INDIAN = "kumar kumari singh sharma gupta patel reddy rao nair iyer mukherjee banerjee chatterjee agarwal jain shah devi lal ram krishna lakshmi priya raj prasad".split()
FIELDS = ["first_name", "middle_name", "last_name", "title", "suffix", "nickname"]
STRUCT = "original string, " + ", ".join(f"{f} string" for f in FIELDS) + ", confidence double, parser_used string"
MODEL_CONFIDENCE = 0.8


def is_indian_name(c: Column, words: list[str] | None = None) -> Column:
    """Whether any of the words is a part of the name, also inside a longer word."""
    return F.coalesce(F.lower(c).rlike("|".join(words or INDIAN)), F.lit(False))


def _row(name, p: dict, confidence: float, used: str):
    return (name, *[p.get(k) or None for k in ("first", "middle", "last", "title", "suffix", "nickname")], confidence, used)


def _results(names: list[str | None], parser: str, model: Callable | None, batch_size: int, ml_threshold: float, words: list[str] | None = None) -> list[tuple]:
    """A row for each name; the model is called for those that go to it only, ``batch_size`` at a time."""
    indian = re.compile("|".join(words or INDIAN))
    to_model = [k for k, x in enumerate(names) if parser == "model" or parser == "auto" and x and indian.search(x.lower())]
    guesses: dict[int, dict] = {}
    for at in range(0, len(to_model) if model else 0, batch_size):
        part = to_model[at : at + batch_size]
        guesses |= {k: g for k, g in zip(part, model([names[k] or "" for k in part])) if g}
    out, chosen = [], set(to_model)
    for k, x in enumerate(names):
        g = guesses.get(k)
        sure = float(g.get("confidence", MODEL_CONFIDENCE)) if g else None
        if g and (parser == "model" or sure >= ml_threshold):
            out.append(_row(x, g, sure, "model"))
        elif k in chosen and not g:
            out.append(_row(x, parse(x), 0.0 if x is None else MODEL_CONFIDENCE, "model"))
        else:
            out.append(_row(x, parse(x), 0.0 if x is None else 1.0, "rule"))
    return out


def parsed_name(c: Column, parser: str = "auto", model: Callable[[list[str]], list[dict]] | None = None, batch_size: int = 100, ml_threshold: float = 0.8) -> Column:
    """Struct of a name. ``model`` maps names to dicts of first, last, confidence; without one the rules stand in for it at confidence 0.8.

    ``auto`` sends names that look Indian to the model, and what it is less sure of than ``ml_threshold`` back to the rules.
    """
    if parser not in ("auto", "rule", "model"):
        raise ValueError(f"unknown parser {parser!r}")

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_results(s.tolist(), parser, model, batch_size, ml_threshold), columns=["original", *FIELDS, "confidence", "parser_used"])

    return F.pandas_udf(run, STRUCT)(c)


def parse_frame(df: DataFrame, column: str, parser: str = "auto", components: bool = True, model: Callable | None = None, **options) -> DataFrame:
    """``df`` with seven parsed columns, or one struct column ``parsed_name``."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    d = df.withColumn("parsed_name", parsed_name(F.col(f"`{column}`"), parser, model, **options))
    if not components:
        return d
    names = {f"parsed_{k}": f"parsed_name.{k}" for k in ("first_name", "middle_name", "last_name", "title", "suffix", "confidence")} | {"parser_used": "parsed_name.parser_used"}
    return d.withColumns({k: F.col(v) for k, v in names.items()}).drop("parsed_name")


def parse_names(names: str | list[str] | DataFrame, parser: str = "auto", column: str = "name", **options):
    """What ``names`` is decides: a dict for one name, a list of dicts for a list, a DataFrame for a DataFrame."""
    if isinstance(names, DataFrame):
        return parse_frame(names, column, parser, **options)
    some = [names] if isinstance(names, str) else list(names)
    rows = _results(some, parser, options.get("model"), options.get("batch_size", 100), options.get("ml_threshold", 0.8))
    out = [dict(zip(["original", *FIELDS, "confidence", "parser_used"], r)) for r in rows]
    return out[0] if isinstance(names, str) else out


def compare_parsers(df: DataFrame, column: str, model: Callable | None = None, **options) -> DataFrame:
    """``df`` with ``asked`` and ``parsed``: a row for each name and parser."""
    c = F.col(f"`{column}`")
    each = [F.struct(F.lit(p).alias("asked"), parsed_name(c, p, model, **options).alias("parsed")) for p in ("rule", "model", "auto")]
    return df.withColumn("_each", F.explode(F.array(*each))).select(*[F.col(f"`{x}`") for x in df.columns], "_each.asked", "_each.parsed")


def full_name(p: str) -> Column:
    parts = [F.when(F.col(f"{p}.{k}") != "", F.col(f"{p}.{k}")) for k in ("title", "first_name", "middle_name", "last_name", "suffix")]
    return F.concat_ws(" ", *parts)


def as_json(p: str) -> Column:
    return F.to_json(p)


def least_sure(parsed: DataFrame, column: str, least: float = 0.7, k: int = 10) -> DataFrame:
    """(column, parsed_confidence, parser_used): the ``k`` names, a report, of the least confidence under ``least``."""
    c = F.col(f"`{column}`")
    return parsed.where(F.col("parsed_confidence") < least).select(c, "parsed_confidence", "parser_used").orderBy("parsed_confidence", c).limit(k)


def confidence_split(parsed: DataFrame, least: float = 0.7) -> DataFrame:
    """(confident, n, mean): names at and under a confidence."""
    c = F.col("parsed_confidence")
    return parsed.groupBy((c >= least).alias("confident")).agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean"))


def parsing_stats(parsed: DataFrame) -> DataFrame:
    """(parser_used, total, avg_confidence, min_confidence, confident, complete) by parser."""
    c = F.col("parsed_confidence")
    both = F.col("parsed_first_name").isNotNull() & F.col("parsed_last_name").isNotNull()
    return parsed.groupBy("parser_used").agg(F.count(F.lit(1)).alias("total"), F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.count_if(c >= 0.8).alias("confident"), F.count_if(both).alias("complete"))
