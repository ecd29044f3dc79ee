"""Search and cleaning of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import clean, search


def read_stream(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(kind)
    if kind == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.load(folder)


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], to: str, checkpoint: str, progress: Callable[[int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Writes ``work`` of every micro-batch below ``to``, in a folder by batch, so a batch that is repeated replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")
        if progress:
            progress(number)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def search_stream(stream: DataFrame, names: DataFrame, to: str, checkpoint: str, progress: Callable[[int], None] | None = None, once: bool = True, **options) -> StreamingQuery:
    return each_batch(stream, lambda b: search.mentions(b, names, **options), to, checkpoint, progress, once)


def clean_stream(stream: DataFrame, to: str, checkpoint: str, column: str = "Name", once: bool = True) -> StreamingQuery:
    """Cleaned names; equal names are dropped within the whole stream by Spark's state."""
    d = clean.clean_names_loose(stream, column)
    w = d.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", to)
    return (w.trigger(availableNow=True) if once else w).start()


def rate(query: StreamingQuery, total: int | None = None) -> dict:
    """Batch, rows so far, rows a second, and, where the ``total`` number of rows is known, per cent done and seconds left."""
    reports = query.recentProgress
    if not reports:
        return {}
    rows, seconds = sum(p["numInputRows"] for p in reports), sum(p["batchDuration"] for p in reports) / 1000
    speed = rows / seconds if seconds > 0 else 0.0
    out = {"batch": reports[-1]["batchId"], "rows": rows, "rows_per_second": speed}
    return out | ({"percent": 100 * rows / total, "seconds_left": max(0, total - rows) / speed if speed > 0 else 0.0} if total else {})
