"""Text functions as Spark columns; only stemming and exact decomposition of rare characters go through Arrow."""

from __future__ import annotations

import re
import string
import unicodedata
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.shared import text_slices
from .stem import porter, porter2
from .stopwords import ENGLISH

#: Words whose stems a task remembers, and of those before them.
MOST_STEMS = 1 << 17
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SENTENCE_KEEPERS = "Dr Gov Jr Mr Mrs Ms Prof Rep Sen Sr".split()
#: Signs of a person nearby: forms of address, ways to speak, relations.
PERSON_SIGNS = sorted(
    "mrs. mr. ms. prof. dr. judge mayor governor president professor senator congresswoman congressman "
    "argued declared claimed announced stated told said representative spokesperson partner friend colleague "
    "sister brother mother father vice_president according_to husband_of wife_of daughter_of son_of".replace("_", "\n").split(" ")
)
PERSON_SIGNS = [s.replace("\n", " ") for s in PERSON_SIGNS]


def lower_case(c: Column) -> Column:
    return F.lower(c)


@cache
def _accents() -> tuple[str, str, str]:
    """Characters whose decomposition is one character, those characters, and characters that vanish."""
    to: dict[str, str] = {}
    gone = []
    for i in range(0x80, 0x10000):
        if 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4:
            continue
        ch = chr(i)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if plain == ch:
            continue
        if len(plain) == 1:
            to[ch] = plain
        elif not plain:
            gone.append(ch)
    return "".join(to), "".join(to.values()), "".join(gone)


def remove_accents(c: Column) -> Column:
    """Letters without their marks; what then remains of U+0080 to U+00FF is deleted, other scripts stay."""
    a, b, gone = _accents()
    return F.regexp_replace(F.translate(c, a + gone, b), r"[\x80-\xFF]", "")


@F.pandas_udf(StringType())
def remove_accents_exact(s: pd.Series) -> pd.Series:
    """As ``remove_accents``, with characters that decompose to several (ligatures, Hangul) too."""

    def plain(t):
        return None if t is None else re.sub("[\x80-\xff]", "", "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)))

    return s.map(plain)


def remove_special_chars(c: Column) -> Column:
    return F.translate(c, "".join(sorted(set(string.punctuation) - set(".,?"))), "")


def remove_punctuation(c: Column) -> Column:
    return F.translate(c, string.punctuation, "")


def remove_extra_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Runs of word characters and runs of other signs."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def default_stopwords() -> tuple[str, ...]:
    return ENGLISH


def remove_stopwords(c: Column, words: list[str] | None = None) -> Column:
    stop = list(default_stopwords() if words is None else words)
    kept = F.filter(tokens(c), lambda x: ~x.isin(*stop)) if stop else tokens(c)  # a hash lookup a token
    return F.array_join(kept, " ")


def clean_text(c: Column, words: list[str] | None = None) -> Column:
    """Lower case, special characters, accents, stop words, punctuation and white space, in this order."""
    c = remove_accents(remove_special_chars(lower_case(c)))
    return remove_extra_space(remove_punctuation(remove_stopwords(c, words)))


def clean_text_by(c: Column, special: bool = True, accents: bool = True, stopwords: bool = True, stem: bool = False, snowball: bool = False, punctuation: bool = True, words: list[str] | None = None) -> Column:
    """Lower case, then the steps that are chosen, in the order of ``clean_text``; stemming comes after stop words."""
    c = lower_case(c)
    c = remove_special_chars(c) if special else c
    c = remove_accents(c) if accents else c
    c = remove_stopwords(c, words) if stopwords else c
    c = stemmed(c, snowball) if stem else c
    return remove_extra_space(remove_punctuation(c) if punctuation else c)


class _Stems:
    """Texts with stems for words; of these the last ones, at least ``most``, are remembered, and those in use stay."""

    def __init__(self, stem, most: int):
        self.stem, self.most, self.known, self.older = stem, most, {}, {}

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        out = []
        for w in re.findall(r"\w+|[^\w\s]+", text):
            if (s := self.known.get(w)) is None:
                if len(self.known) >= self.most:
                    self.known, self.older = {}, self.known
                if (s := self.older.get(w)) is None:
                    s = self.stem(w)
                self.known[w] = s
            out.append(s)
        return " ".join(out)


def stemmed(c: Column, snowball: bool = False) -> Column:
    one = _Stems(porter2 if snowball else porter, MOST_STEMS)

    def run(texts: pa.Array) -> pa.Array:
        """A batch of Spark's lies here once, and once stemmed; of Python's strings only those of a slice."""
        parts = [pa.array(map(one, texts[a:b].to_pylist()), pa.string()) for a, b in text_slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.arrow_udf(run, StringType())(c)


def _sentence_break() -> str:
    keep = "".join(rf"(?<!\b{k}\.)" for k in SENTENCE_KEEPERS)
    return rf"(?i)(?:(?<=[.!?])|(?<=[.!?]['\"])){keep}(?U:\s+)"


def split_sentences(c: Column) -> Column:
    """struct(sentences, offsets): offsets are 0 and the places of the white space between sentences."""
    parts, gaps = F.split(c, _sentence_break(), -1), F.regexp_extract_all(c, F.lit(_sentence_break()), F.lit(0))
    sizes = F.zip_with(parts, gaps, lambda p, g: F.struct(F.length(p).alias("p"), F.coalesce(F.length(g), F.lit(0)).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("all"))
    run = F.aggregate(
        F.slice(sizes, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        start,
        lambda acc, x: F.struct((acc["at"] + x["p"] + x["g"]).alias("at"), F.concat(acc["all"], F.array(acc["at"] + x["p"])).alias("all")),
    )
    return F.when(c.isNotNull(), F.struct(parts.alias("sentences"), run["all"].alias("offsets")))


def normalize_name(c: Column) -> Column:
    return remove_extra_space(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))


def quoted(word: str) -> str:
    """``word`` as a literal of Java's regular expressions."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def context(c: Column, start: Column, end: Column, window: int = 50) -> Column:
    first = F.greatest(F.lit(0), start - window)
    return F.substring(c, first + 1, F.least(F.length(c), end + window) - first)


def is_person_context(c: Column, start: Column, end: Column, window: int = 50) -> Column:
    return F.lower(context(c, start, end, window)).rlike("|".join(map(quoted, PERSON_SIGNS)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; 0 for empty, null or zero vectors, and for vectors of different length."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    c = dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & ~F.isnan(c), c), F.lit(0.0))


def thresholds(edits: list | None) -> list[tuple[int, int]]:
    """Pairs (length, distance) from such pairs, or from lengths of which the k-th stands for distance k."""
    edits = list(edits or [])
    if edits and not isinstance(edits[0], (list, tuple)):
        edits = [(n, k + 1) for k, n in enumerate(edits)]
    return [(int(a), int(b)) for a, b in edits]


def edit_threshold(length: int, edits: list | None) -> int:
    """The distance of the last pair that ``length`` exceeds; 0 without one."""
    return next((d for n, d in reversed(thresholds(edits)) if length > n), 0)


def edit_threshold_column(length: Column, edits: list | None) -> Column:
    out = F.lit(0)
    for n, d in thresholds(edits):
        out = F.when(length > n, F.lit(d)).otherwise(out)
    return out


def split_list(c: Column) -> Column:
    return F.split(c, ";", -1)


def join_list(c: Column) -> Column:
    """Non-blank items, trimmed, joined by semicolons."""
    return F.array_join(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""), ";")


def chunk_file(chunk: Column, name: str) -> Column:
    return F.format_string(f"chunk_%02d/{name}", chunk)


def register(spark: SparkSession) -> list[str]:
    """Makes the scalar functions available to SQL; returns their names."""
    body = {
        "qs_remove_extra_space": ("t STRING", r"trim(regexp_replace(t, r'(?U)\s+', ' '))"),
        "qs_normalize_name": ("t STRING", r"trim(regexp_replace(regexp_replace(lower(t), r'[^\p{L}\p{N}_\s]', ''), r'(?U)\s+', ' '))"),
        "qs_context": ("t STRING, s INT, e INT, w INT", "substring(t, greatest(0, s - w) + 1, least(length(t), e + w) - greatest(0, s - w))"),
    }
    for name, (args, expression) in body.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS STRING RETURN {expression}")
    spark.udf.register("qs_remove_accents", remove_accents_exact)
    return [*body, "qs_remove_accents"]
