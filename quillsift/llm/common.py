"""What the operators of this subpackage share: the shared folder, whole-text word hashing in numpy, column blocks.

Words are runs of ASCII letters, digits, underscore and every non-ASCII character; a null text counts as empty.
Hashes are 64-bit and depend on the bytes alone, so every worker and every retry gives the same ones.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
P = np.uint64(0x9E3779B97F4A7C15)
PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

CLASS = np.zeros(256, np.uint8)  # 0 space and control, 1 word, 2 punctuation
CLASS[0x21:0x7F] = 2
CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and all runs in one process one is chosen here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = f"file:///tmp/quillsift-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path


def delete_at_exit(spark: SparkSession, path: str) -> str:
    """Has Spark's file system remove ``path`` when the application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


@contextmanager
def short_batches(spark: SparkSession):
    """What runs here sends Python workers at most BATCH_BYTES and a row at a time; Spark's own bounds are 10,000 rows and 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = delete_at_exit(spark, shared_dir(spark))
    with short_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, whatever the case of letters."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def plain_names(df: DataFrame) -> list[str]:
    """The column names of ``df``, with others in place of those that mapInArrow can't resolve."""
    out: list[str] = []
    for i, c in enumerate(df.columns):
        out.append(fresh(df, f"c{i}") if "." in c or "`" in c else c)
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buckets(df: DataFrame, each: int = 32 << 20) -> int:
    """How many blocks by hash to make of what is gathered from ``df``: four a partition, and so many that one holds about ``each`` bytes of input."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(4 * partitions(df), min(size // each, 1 << 17) if size < 1 << 55 else 0)  # beyond that, Spark doesn't know


def small(df: DataFrame, column: str, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows of one number each; else Spark joins by shuffle."""
    df = df.select(column)
    return F.broadcast(df) if df.count() <= most_rows else df


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, SLICE_BYTES + 4096)
        for key, base in (("p", P), ("i", PINV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(a, out=a)
            _powers[key] = a
    return _powers["p"], _powers["i"]


def slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Cuts record batches into runs of rows with about ``most`` bytes of text; a longer text comes alone and whole."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the rows in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if off else np.zeros(len(texts) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def folded(buf: np.ndarray) -> np.ndarray:
    """Lower case of the ASCII and Latin-1 letters in UTF-8; every byte stays where it is."""
    buf = FOLD[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
    buf[at] += 0x20
    return buf


class Words:
    """Tokens of many texts: byte ``start`` and ``end``, ``hash``, ``row``, and the n + 1 offsets ``first`` by row.

    ``in_place`` folds case so that offsets hold for the text as it is; else all letters are lower-cased first.
    """

    def __init__(self, texts: pa.Array, punct: bool = False, in_place: bool = False):
        if not in_place:
            texts = pc.utf8_lower(pc.fill_null(texts, ""))
        buf, self.off = raw(texts)
        if in_place:
            buf = folded(buf)
        n, rows = len(buf), len(self.off) - 1
        c = CLASS[buf]
        if not punct:
            c[c == 2] = 0
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = c[:-1], c[1:]
        some = self.off[1:] > self.off[:-1]
        before[self.off[:-1][some]] = 0
        after[self.off[1:][some] - 1] = 0
        self.start = np.flatnonzero((c != before) & (c > 0))
        self.end = np.flatnonzero((c != after) & (c > 0)) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        self.buf, self.kind = buf, c[self.start]
        p, inv = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inv[self.start])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and rows of the n-grams of successive tokens of a text."""
        h, row = self.hash, self.row
        if n == 1:
            return h, row
        if len(h) < n:
            return h[:0], row[:0]
        m = len(h) - n + 1
        g = h[:m].copy()
        for k in range(1, n):
            g = mix(g * P + h[k : k + m])
        ok = row[:m] == row[n - 1 :]
        return g[ok], row[:m][ok]


def blocks(keys: np.ndarray, n: int, *columns: np.ndarray):
    """(bucket, bytes of each column) for the rows whose key falls in it; the bucket comes from the key's high bits."""
    b = ((keys >> np.uint64(40)) % np.uint64(n)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    edge = np.searchsorted(b[order], np.arange(n + 1))
    columns = [c[order] for c in columns]
    for k in np.flatnonzero(np.diff(edge)):
        yield (int(k), *(c[edge[k] : edge[k + 1]].tobytes() for c in columns))


def unpack(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)
