"""Tables in files: CSV (plain or gzip) of strings, JSON, Parquet, workbooks where pandas can read them; split and merged corpora; text exports."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chunk_file
from ..plans.shared import free, numbered

FORMATS = ("csv", "json", "parquet", "xlsx")


def _kind(path: str) -> str:
    parts = path.rstrip("/").lower().split("/")[-1].removesuffix(".gz").split(".")
    return parts[-1] if parts[-1] in FORMATS else "csv"


def _hadoop(spark: SparkSession, path: str):
    """The file system and path of Hadoop."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def read_table(spark: SparkSession, path: str | list[str], kind: str | None = None, lines: bool = True) -> DataFrame:
    """CSV columns are strings, and what is missing is empty; gzip is known by its ending.

    ``lines`` lets cells hold line breaks, as they may; a large file known to have none is read in parts without it. A workbook, which
    has a million rows at most, is read by the driver.
    """
    kind = kind or _kind(path if isinstance(path, str) else path[0])
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if kind == "xlsx":
        return _workbook(spark, path)
    if kind != "csv":
        return spark.read.format(kind).load(path)
    d = spark.read.csv(path, header=True, inferSchema=False, multiLine=lines, quote='"', escape='"', maxCharsPerColumn=-1, enforceSchema=False)
    return d.na.fill("")


def _workbook(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    try:
        d = pd.read_excel(path, dtype=str).fillna("")
    except ImportError as e:
        raise ValueError("workbooks need the package openpyxl") from e
    return spark.createDataFrame(d) if len(d) else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in d.columns))


def read_name_list(spark: SparkSession, path: str, uid: str = "uniqid", name: str = "search_name") -> DataFrame:
    d = read_table(spark, path)
    for c in (uid, name):
        if c not in d.columns:
            raise ValueError(f"no column {c!r} in {path}")
    return d.select(F.col(f"`{uid}`").alias("uniqid"), F.col(f"`{name}`").alias("search_name"))


def read_drop_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("search_name")).where("search_name <> ''")


def write_table(df: DataFrame, path: str, kind: str | None = None, append: bool = False, one_file: bool = False, compression: str | None = None, confidence: bool = True, overwrite: bool = True) -> None:
    """Overwrites, or appends; with ``overwrite=False`` it appends to what is there and begins what isn't. ``confidence=False`` leaves out columns with that word in their name."""
    d = df if confidence else df.drop(*[c for c in df.columns if "confidence" in c.lower()])
    w = (d.coalesce(1) if one_file else d).write.mode("append" if append or not overwrite else "overwrite")
    if compression:
        w = w.option("compression", compression)
    kind = kind or _kind(path)
    if kind not in FORMATS[:3]:
        raise ValueError(f"can't write format {kind!r}")
    (w.option("header", True).option("escape", '"') if kind == "csv" else w).format(kind).save(path)


def write_counted(df: DataFrame, path: str, **options) -> int:
    """As ``write_table``; returns the number of rows, counted on the way."""
    seen = Observation("rows")
    write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), path, **options)
    return seen.get["n"]


def chunked(df: DataFrame, size: int = 1000, uid: str = "uniqid", order: str | None = None) -> DataFrame:
    """``df`` with ``uid`` (the row number from 0, if there is none) and ``chunk_id``."""
    own = "_row"
    d = numbered(df, own)
    if uid not in df.columns:
        d = d.withColumn(uid, F.col(own).cast("string"))
    return d.withColumn("chunk_id", F.floor(F.col(own) / size)).drop(own)


def split_corpus(df: DataFrame, folder: str, size: int = 1000, kind: str = "csv", name: str = "part") -> int:
    """Writes chunks of ``size`` rows to folders chunk_00, chunk_01, ...; returns how many."""
    d = chunked(df, size).withColumn("chunk", chunk_file(F.col("chunk_id"), name))
    d.drop("chunk_id").write.mode("overwrite").partitionBy("chunk").option("header", True).format(kind).save(folder)
    return -(-df.count() // size)


def split_rows(df: DataFrame, folder: str, most: int = 10_000, stem: str = "rows") -> list[str]:
    """Writes CSV files {stem}_part001.csv, {stem}_part002.csv, ... of ``most`` rows, the last of what is left; returns their names."""
    spark, own, at = df.sparkSession, free(df, "_part"), free(df, "_nth")
    d = numbered(df, at).withColumn(own, F.floor(F.col(at) / most) + 1)
    raw = f"{folder}/.{stem}"
    d.repartition(own).sortWithinPartitions(own, at).drop(at).write.mode("overwrite").partitionBy(own).option("header", True).option("escape", '"').csv(raw)
    fs, p = _hadoop(spark, raw)
    have = {x.getPath().getName() for x in fs.listStatus(p.getParent())}
    parts = {}
    for file in (x.getPath() for x in fs.globStatus(_hadoop(spark, f"{raw}/{own}=*/*.csv")[1])):  # one listing for all files
        k = int(str(file).rsplit("/", 2)[1].partition("=")[2])
        if k in parts:
            raise RuntimeError(f"part {k} of {stem} lies in two files")
        parts[k] = file
    names = {k: f"{stem}_part{k:03d}.csv" for k in sorted(parts)}
    for k, name in names.items():
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if name in have:
            fs.delete(to, False)
        if not fs.rename(parts[k], to):
            raise OSError(f"can't move {parts[k]} to {to}")
    fs.delete(p, True)
    return list(names.values())


def read_parts(spark: SparkSession, folder: str, file: str = "file") -> DataFrame:
    """All tables of a folder of CSV files with the same columns, read at once, and in ``file`` the name of the file that a row is from."""
    return read_table(spark, folder, "csv").withColumn(file, F.substring_index(F.input_file_name(), "/", -1))


def merge_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows under the columns of all tables; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def merge_files(spark: SparkSession, paths: list[str], to: str) -> int:
    return write_counted(merge_tables([read_table(spark, p) for p in paths]), to)


def export_text(df: DataFrame, folder: str, text: str = "text", again: bool = False, like: str | None = None, below: str | None = None) -> bool:
    """One text row a document; returns False, and writes nothing, where the export is there already.

    With ``like``, the path of what is exported, and ``below``, the folder that it lies in, the export goes to the same place below ``folder``.
    """
    if like:
        place = like[len(below.rstrip("/")) + 1 :] if below and like.startswith(below.rstrip("/") + "/") else like.rstrip("/").rpartition("/")[2]
        folder = f"{folder}/{re.sub(r'[.](csv|json|parquet)([.]gz)?$', '', place)}"
    if not again and exists(df.sparkSession, folder):
        return False
    df.select(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(folder)
    return True


def choose_mode(path: str, most_mb: float = 500, spark: SparkSession | None = None) -> str:
    """'streaming' where two and a half times the file is over the limit, in whatever file system it is; Spark needs neither, callers may want to know."""
    fs, p = _hadoop(spark or SparkSession.active(), path)
    return "streaming" if 2.5 * fs.getContentSummary(p).getLength() / 2**20 > most_mb else "batch"


merge_results, split_text_corpus = merge_files, split_corpus
