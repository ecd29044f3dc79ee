"""Packing: vector bin packing by the dot-product heuristic, for instruction data.

Examples go into packs under three limits at once: tokens, segments (examples, or pieces of one) and loss-bearing tokens.
A pack is filled by taking, again and again, the example that fits and has the largest weighted dot product of what it
needs and what is left, both as shares of the limits; a dimension weighs as much as all examples together need of it.
When nothing fits, the next pack is opened. Tokens are those of a byte-level BPE vocabulary (see ``token_counts``).

Examples are dealt by hash to shards of about SHARD examples, which are packed independently: the number of shards grows with the
data, the work and memory of one doesn't, and a shard leaves at most one badly filled pack. Examples that are alike in all that is
packed are counted first and dealt by their number too, so no key, null or repeated, fills a shard. Shards are spread over
partitions of a given number, as what they cost isn't seen from their bytes.

An example over a limit is cut into pieces of min(tokens, loss) tokens, which fit by themselves, numbered from 0. Conversations
are summed up, not collected; only for those over a limit are the turns' places worked out, by prefix sums of two levels.

Defined cases: null texts have 0 tokens and an example of 0 tokens is placed like any other; a null role bears no loss; a turn
of null conv_id is an example of its own; repeated turns are each counted, repeated documents are each an example; ties go to
the lower id, nulls first, then the lower piece; turns of equal number follow one another by tokens; texts count whole; an empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, slices, stored
from .token_counts import VOCABULARY, Counter, vocabulary

TOKENS, SEGMENTS, LOSS = 2048, 16, 1024
SHARD = 4096
BLOCK = 4096


def counted(texts: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(id, turn, loss, tokens) of rows (id, turn, loss, text)."""
    table = texts.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))  # of the vocabulary's size

    def count(batches):
        counter = Counter(table.value)
        for s in slices(batches):
            yield pa.RecordBatch.from_arrays([s.column("id"), s.column("turn"), s.column("loss"), pa.array(counter(s.column("text")), pa.int64())], ["id", "turn", "loss", "tokens"])

    return texts.select("id", "turn", "loss", "text").mapInArrow(count, "id long, turn long, loss boolean, tokens long")


def fill(need: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The pack of each example, numbered from 0 in the order opened; ``need`` is an array of (examples, dimensions)."""
    share = need / limits
    weight = share.sum(0)
    weight /= max(weight.sum(), 1e-12)
    pack, left, k = np.full(len(need), -1), np.arange(len(need)), 0
    while len(left):
        room, part, used = limits.copy(), share[left] * weight, np.zeros(len(left), bool)
        rest = need[left]
        while True:
            fits = (rest <= room).all(1) & ~used
            if not fits.any():
                break
            i = int(np.argmax(np.where(fits, part @ (room / limits), -1.0)))
            used[i] = True
            pack[left[i]] = k
            room = room - rest[i]
        if not used.any():
            raise ValueError("an example doesn't fit into an empty pack")
        left, k = left[~used], k + 1
    return pack


def _cut(examples: DataFrame, size: int) -> DataFrame:
    """(id, piece, start, n_tokens, loss_tokens) of examples (id, tokens) of one text each, whose every token bears loss."""
    pieces = F.explode(F.expr(f"sequence(0L, greatest(tokens - 1, 0L) div {size})")).alias("piece")
    return examples.select("id", "tokens", pieces).selectExpr("id", "piece", f"piece * {size} AS start", f"least({size}, tokens - piece * {size}) AS n_tokens", f"least({size}, tokens - piece * {size}) AS loss_tokens")


def _long(turns: DataFrame, size: int) -> DataFrame:
    """(id, piece, start, n_tokens, loss_tokens) of conversations over a limit, from their turns (id, turn, loss, tokens)."""
    t = turns.withColumn("block", F.expr(f"floor(coalesce(turn, -1) / {BLOCK})"))
    sums = t.groupBy("id", "block").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("id").alias("_id"), F.col("block").alias("_block"), before.alias("before"))
    end = F.col("before") + F.sum("tokens").over(Window.partitionBy("id", "block").orderBy("turn", "tokens", "loss").rowsBetween(Window.unboundedPreceding, 0))
    t = t.join(sums, (F.col("id") == F.col("_id")) & (F.col("block") == F.col("_block"))).withColumn("end", end).withColumn("at", F.col("end") - F.col("tokens")).where("tokens > 0")
    t = t.select("id", "loss", "at", "end", F.explode(F.expr(f"sequence(at div {size}, (end - 1) div {size})")).alias("piece"))
    part = F.expr(f"least(end, (piece + 1) * {size}) - greatest(at, piece * {size})")
    t = t.groupBy("id", "piece").agg(F.sum(part).alias("n_tokens"), F.sum(F.when(F.col("loss"), part).otherwise(0)).alias("loss_tokens"))
    return t.select("id", "piece", (F.col("piece") * size).alias("start"), "n_tokens", "loss_tokens")


def _packed(items: DataFrame, name: str, tokens: int, segments: int, loss: int, shard: int) -> DataFrame:
    """Packs rows (id, piece, start, n_tokens, loss_tokens)."""
    columns = ["id", "piece", "start", "n_tokens", "loss_tokens"]
    items = stored(items.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")))
    n = max(1, -(-(items.agg(F.sum("copies")).first()[0] or 0) // shard))
    limits = np.array([tokens, segments, loss], np.int64)

    def pack(key, table):
        a = {c: table[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[1:]}
        ids, no = table["id"].fill_null(0).to_numpy(), table["id"].is_null().to_numpy()
        order = np.lexsort((a["loss_tokens"], a["n_tokens"], a["piece"], ids, ~no))
        need = np.stack([a["n_tokens"], np.ones(len(ids), np.int64), a["loss_tokens"]], 1)[order]
        to = fill(need, limits)
        by = np.argsort(to, kind="stable")
        order, to = order[by], to[by]
        slot = np.arange(len(to)) - np.searchsorted(to, to)
        return pa.table({
            "pack_id": (key[0].as_py() << 32) + to, "slot": slot.astype(np.int32), name: pa.array(ids[order], mask=no[order]), "piece": a["piece"][order].astype(np.int32),
            "start": a["start"][order], "n_tokens": a["n_tokens"][order], "loss_tokens": a["loss_tokens"][order],
        })

    each = items.select(*columns, F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    dealt = each.select(*columns, F.expr(f"pmod(xxhash64({', '.join(columns)}, copy), {n})").alias("shard")).repartition(min(n, 4 * partitions(items)), "shard")
    return dealt.groupBy("shard").applyInArrow(pack, f"pack_id long, slot int, `{name}` long, piece int, start long, n_tokens long, loss_tokens long")


def conversations(turns: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, shard: int = SHARD, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(pack_id, slot, conv_id, piece, start, n_tokens, loss_tokens) of all conversations; what the assistant says bears loss."""
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss")
    each = stored(counted(turns.select(F.col("conv_id").cast("long").alias("id"), F.col("turn").cast("long").alias("turn"), assistant, "text"), vocabulary_path))
    lossy = F.sum(F.when(F.col("loss"), F.col("tokens")).otherwise(0))
    sums = each.where("id IS NOT NULL").groupBy("id").agg(F.sum("tokens").alias("n_tokens"), lossy.alias("loss_tokens"))
    fits = (F.col("n_tokens") <= tokens) & (F.col("loss_tokens") <= loss)
    whole = sums.where(fits).selectExpr("id", "0L AS piece", "0L AS start", "n_tokens", "loss_tokens")
    long = _long(each.join(sums.where(~fits).select("id"), "id", "left_semi"), min(tokens, loss))
    lone = each.where("id IS NULL")
    heard, said = _cut(lone.where("NOT loss"), tokens).withColumn("loss_tokens", F.lit(0).cast("long")), _cut(lone.where("loss"), min(tokens, loss))
    return _packed(whole.union(long).union(heard).union(said), "conv_id", tokens, segments, loss, shard)


def documents(docs: DataFrame, tokens: int = TOKENS, segments: int = SEGMENTS, shard: int = SHARD, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(pack_id, slot, doc_id, piece, start, n_tokens, loss_tokens) of all documents, whose every token bears loss."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("turn"), F.lit(True).alias("loss"), "text")
    return _packed(_cut(counted(texts, vocabulary_path).select("id", "tokens"), tokens), "doc_id", tokens, segments, tokens, shard)
