"""A parser of Western person names: words, commas and small closed lists decide; no model is involved."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TITLES = set("mr mrs ms miss dr prof professor sir dame lady lord rev reverend hon honorable judge justice senator sen rep representative congressman congresswoman governor gov mayor president pope baron baroness mahdi captain capt colonel col major maj general gen lieutenant lt sergeant sgt sheikh imam rabbi father sister brother king queen prince princess".split())
SUFFIXES = set("jr sr ii iii iv vi vii viii ix esq phd md dds dvm jd llb llm mba cpa rn".split())
PARTICLES = set("van von der den de del della di da du la le los las dos das bin ibn al el ter ten st st. mac vander".split())
ROMAN = "I II III IV V VI VII VIII IX X".split()
FIELDS = ["first", "middle", "last", "title", "suffix", "nickname"]
STRUCT = ", ".join(f"{f} string" for f in FIELDS)


def _bare(w: str) -> str:
    return w.replace(".", "").lower()


def _suffix(w: str) -> bool:
    return _bare(w) in SUFFIXES


def _given(words: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Titles in front, names, suffixes behind."""
    i, j = 0, len(words)
    while i < j - 1 and _bare(words[i]) in TITLES:
        i += 1
    if i == j - 1 and j == 1 and _bare(words[0]) in TITLES and words[0].endswith("."):
        i = 1
    while j > i + 1 and _suffix(words[j - 1]):
        j -= 1
    return words[:i], words[i:j], words[j:]


def parse(name: str | None) -> dict[str, str]:
    """The parts of a name; missing ones are empty."""
    out = dict.fromkeys(FIELDS, "")
    if not name:
        return out
    nick = re.findall(r"\(([^)]*)\)|\"([^\"]*)\"|(?<!\w)'([^']*)'(?!\w)", name)
    name = re.sub(r"\([^)]*\)|\"[^\"]*\"|(?<!\w)'[^']*'(?!\w)", " ", name)
    out["nickname"] = " ".join(x for t in nick for x in t if x).strip()
    parts = [p for p in (re.split(r"\s+", p.strip()) for p in name.split(",")) if p != [""]]
    if not parts:
        return out
    tail: list[str] = []
    while len(parts) > 1 and all(map(_suffix, parts[-1])):
        tail = [" ".join(parts.pop()), *tail]
    if len(parts) > 1:  # last name first
        _, last, own = _given(parts[0])
        titles, given, more = _given([w for p in parts[1:] for w in p])
        suffixes = [*own, *more]
        first, middle = given[:1], given[1:]
    else:
        titles, words, suffixes = _given(parts[0])
        k = len(words) - 1
        while k > 1 and _bare(words[k - 1]) in PARTICLES:
            k -= 1
        if len(words) == 1:
            first, middle, last = ([], [], words) if titles else (words, [], [])
        else:
            first, middle, last = words[:1], words[1:k], words[k:]
    out |= {"first": " ".join(first), "middle": " ".join(middle), "last": " ".join(last), "title": " ".join(titles), "suffix": ", ".join([*suffixes, *tail])}
    return out


def parsed(c: Column) -> Column:
    """struct(first, middle, last, title, suffix, nickname) of a name; Arrow batches."""

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(x) for x in s], columns=FIELDS)

    return F.pandas_udf(run, STRUCT)(c)


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first, also behind hyphens and apostrophes."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
