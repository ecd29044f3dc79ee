"""Lineage cuts and row numbers that hold at any size."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where that is unset and all runs in one process one is chosen here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = f"file:///tmp/quillsift-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def own_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` lacks."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def numbered(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``df`` with dense row numbers in the order in which it is read; it is read once, by a checkpoint() of its rows."""
    own = free(df, "_at")
    d = checkpointed(df.withColumn(own, F.monotonically_increasing_id()))
    sizes = d.groupBy(F.shiftright(own, 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))  # a row a partition
    at = F.col("_before") + F.col(own) - F.shiftleft(F.col("_part"), 33) + start
    return d.join(F.broadcast(offsets), F.shiftright(own, 33) == F.col("_part")).select(*[F.col(f"`{c}`") for c in df.columns], at.cast("long").alias(name))


def ranked(df: DataFrame, name: str, order: str, *then: str, start: int = 1) -> DataFrame:
    """``df`` with its dense rank in the order of ``order``, then of ``then``: ranges of it are sorted by themselves and counted."""
    by = [F.col(f"`{c}`") for c in (order, *then)]
    return numbered(df.repartitionByRange(*by).sortWithinPartitions(*by), name, start)


def text_slices(texts: pa.Array, most: int = 1 << 19):
    """(from, to) of runs of rows with about ``most`` bytes of text together; a longer text comes alone."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 1)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, to
        at = to
