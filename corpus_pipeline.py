"""Corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing; every stage works on what the last one left.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet in the shared folder and reads
again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.

Defined cases, for every stage: an empty table gives an empty one; further columns are passed on under their names, also those that
an operator uses for itself, and those with dots; texts count whole, however long; the rows that come out don't depend on the order
in which they are read. What a stage does with nulls, repeated rows and ties stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import common, mixing, near_dedup, packing, quality_rules, substring_dedup


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text; those rejected go.

    Null, empty and blank texts are rejected; rows of null doc_id and repeated rows are each judged by their text; a null language is
    a language of its own; in a language without trusted text, and without any labels, all that has a word stays; a score equal to
    the threshold stays.
    """
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    The least doc_id of a group stays, with all rows that repeat it; rows of null doc_id, and texts without words, always stay.
    """
    return near_dedup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one, or they themselves, hold already; ``n_chars`` is kept in step.

    Earlier is the lower doc_id, then the place in the text; a doc_id repeated with the same text is one document, with another text
    another; rows of null doc_id stay as they are, as do null and short texts; a document of which no word is left goes.
    """
    cut = substring_dedup.cut(docs)
    return cut.withColumn("n_chars", F.length("text").cast(cut.schema["n_chars"].dataType)) if "n_chars" in cut.columns else cut


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources have their target weights.

    A row drawn k times is there k times; null is a source; null texts have size 0; rows of null doc_id and repeated rows have each
    an interval of their own; a source of size 0 is passed on as it is.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pack and place of every document, or piece of one.

    Null and empty texts are examples of 0 tokens; rows of null doc_id and repeated rows are each an example; among equals the lower
    doc_id comes first, nulls before all.
    """
    return packing.documents(docs)


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixing", mix), ("packing", pack)]

#: Hashed multinomials, set similarity and greedy packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, (pack_id, slot, doc_id, piece, start, n_tokens, loss_tokens), each stage written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
