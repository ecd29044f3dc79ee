"""Rules for rows: what breaks one goes to a second table with the names of the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ["FirstName LastName", "NickName LastName", "Prefix LastName", "FirstName MiddleName LastName", "LastName FirstName", "LastName"]

CLEANED_NAME = {"uniqid": "length(trim(uniqid)) > 0", "original_name": "length(trim(original_name)) > 0"}
PATTERN = {"pattern": "pattern IN (" + ", ".join(f"'{x}'" for x in FORMATS) + ")", "confidence": "confidence IS NULL OR confidence BETWEEN 0 AND 1"}
RESULT = {"match_count": "match_count = size(matches) AND size(matches) = size(starts) AND size(starts) = size(ends)", "scores": "size(scores) = 0 OR size(scores) = size(matches)"}
DOCUMENT = {"id": "length(trim(id)) > 0", "text": "length(trim(text)) > 0"}
MENTION = {"start": "start >= 0", "end": "end > start", "text": "length(trim(text)) > 0"}
LINK = {"confidence": "confidence BETWEEN 0 AND 1"}
STATS = {"counts": "processed >= 0 AND failed >= 0", "seconds": "seconds >= 0"}


def validate(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with ``errors``; a rule whose value is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(r), F.lit(False)), F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())
    d = df.withColumn("errors", broken)
    return d.where(F.size("errors") == 0).drop("errors"), d.where(F.size("errors") > 0)


def documents_per_second(processed: str = "processed", seconds: str = "seconds"):
    return F.when(F.col(seconds) > 0, F.col(processed) / F.col(seconds)).otherwise(0.0)
