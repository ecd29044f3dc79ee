"""Mixing sources to target weights by systematic sampling.

A source of weight w and size s (characters) gets T * w / s copies expected of each of its documents, T being the size
wanted in all. Within a source the expected copies are summed in a fixed order of documents, one random offset is added,
and a document is emitted once for each integer that its interval crosses. So the copies of a document are the floor or the
ceiling of what is expected, and a source's total is off by less than one document.

Weights default to size ** ``TEMPERATURE``, normalised, and T to the size of the input. Expected copies are fixed-point
integers (1 / 2 ** 24), so that sums are exact in any order. The prefix sum has two levels: blocks of documents
(three hexadecimal digits of the MD5 sum of doc_id, of the text where that is null) are summed first, the sums of at most
``BLOCKS`` rows a source are added up, and documents are summed within their block; so no task holds a whole source, however
hot, and ids of a common stride are spread like any others. Rates are broadcast up to MOST_SOURCES sources, joined beyond.

Defined cases: null and missing sources form one source of their own; a source with a given weight of 0 or less, or none,
gives nothing; null texts have size 0 and are drawn at their source's rate; a source of size 0 is drawn at rate 1; rows
with null doc_id come first in their block; repeated rows (same doc_id) are ordered by text and, being alike beyond that,
interchangeable: each has its own interval. An empty table gives an empty result. Other columns are not read by ``copies``
and passed on by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

ONE = 1 << 24
BLOCKS = 4096  # 16 ** 3
MOST_SOURCES = 100_000
TEMPERATURE = 0.7
SEED = "mix-1"


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, total: float | None = None, seed: str = SEED) -> DataFrame:
    """(src, step, start): expected copies a document and the random offset, both in units of 1 / ONE. A row a source."""
    s = stored(docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size")))
    if weights is None:
        s = s.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        m = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0] or "", float(kv[1]))]) if weights else F.expr("map('', 0D)")
        s = s.withColumn("w", F.greatest(F.coalesce(m[F.col("src")], F.lit(0.0)), F.lit(0.0)))
    both = s.agg(F.sum("size").alias("size"), F.sum("w").alias("w")).first()
    want, all_w = F.lit(float(total if total is not None else both["size"] or 0)), F.lit(float(both["w"] or 0))
    share = F.when(all_w > 0, F.col("w") / all_w)
    rate = F.when(F.col("size") == 0, (F.col("w") > 0).cast("double") if weights is not None else F.lit(1.0)).otherwise(want * share / F.col("size"))
    unit = F.conv(F.substring(F.md5(F.concat(F.col("src"), F.lit(f":{seed}"))), 1, 6), 16, 10).cast("long")
    return s.select("src", F.round(F.coalesce(rate, F.lit(0.0)) * ONE).cast("long").alias("step"), unit.alias("start"))


def drawn(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """(row, copy): a row for every copy emitted, with ``columns`` of the document as a struct."""
    own = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))), 1, 3)
    src, block = F.coalesce("source", F.lit("")).alias("src"), own.alias("block")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), src, block, F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"))
    sums = docs.groupBy(src, block).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("src", "block", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("src", "block").orderBy("id", "tie"))
    found = stored(rates(docs, **options))
    d = d.withColumn("rank", rank).join(sums, ["src", "block"]).join(F.broadcast(found) if found.count() <= MOST_SOURCES else found, "src")
    upto = (F.col("before") + F.col("rank")) * F.col("step") + F.col("start")
    n = (F.floor(upto / F.lit(ONE)) - F.floor((upto - F.col("step")) / F.lit(ONE))).cast("int")
    return d.select("row", n.alias("n")).where("n > 0").select("row", F.explode(F.expr("sequence(0, n - 1)")).alias("copy"))


def copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, copy): a row for every copy emitted, copies of a document numbered from 0."""
    return drawn(docs, ["doc_id", "source"], **options).select("row.doc_id", "row.source", "copy")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture with the columns of ``docs``; a document drawn k times is there k times."""
    return drawn(docs, docs.columns, **options).select("row.*")


def oracle(temperature: float = TEMPERATURE, seed: str = SEED) -> str:
    return f"""
    WITH s AS (SELECT coalesce(source, '') AS src, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY 1),
    t AS (SELECT src, size, pow(CAST(size AS DOUBLE), {temperature}) AS w FROM s),
    r AS (SELECT src, CAST(round(CASE WHEN size = 0 THEN 1.0 ELSE CAST(sum(size) OVER () AS DOUBLE) * (w / sum(w) OVER ()) / size END * {ONE}) AS BIGINT) AS step,
                 CAST('0x' || substr(md5(src || ':{seed}'), 1, 6) AS BIGINT) AS start FROM t),
    d AS (SELECT doc_id, source, coalesce(source, '') AS src,
                 row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 3), doc_id) AS k FROM documents),
    c AS (SELECT doc_id, source, (k * step + start) // {ONE} - ((k - 1) * step + start) // {ONE} AS n FROM d JOIN r USING (src))
    SELECT doc_id, source, CAST(unnest(range(n)) AS INTEGER) AS copy FROM c WHERE n > 0"""
