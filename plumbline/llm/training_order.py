"""Training-order materialisation: every token sequence gets a global slot by a keyed permutation and is laid out in
fixed-stride shards.

Ranges of slots are ranges of whole shards, computed from the total: a task lays out one shard, or a few neighbouring ones where
there are more than MOST_RANGES, and the files are written from that layout without another shuffle.

A document's ids, closed by an end id, are cut into sequences of fixed length, the last one padded. Sequences are numbered
densely by two-level prefix sums over blocks of about BLOCK_SEQUENCES; a Feistel network over the next power of four, walking its cycle until it lands below the
number of sequences, permutes the numbers. Shard and offset follow from the slot, so reading resumes anywhere.

Defined cases: a null or empty text is one sequence holding the end id; repeated rows have sequences of their own; an empty
table has none; other columns, whatever their names, are left out; by default ids are the text's bytes, 256 ends a document
and 257 pads. A very long text is held whole while it is cut. `read_shards` opens no shard before the first one asked for, but
reads that one from its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

SEQUENCE, SHARD_SEQUENCES, BLOCK_SEQUENCES, ROUNDS = 1_024, 8_192, 65_536, 6
#: Tasks that lay out shards, at most.
MOST_RANGES = 20_000
END, PAD = 256, 257


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of [0, n): balanced Feistel rounds with cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), x.astype(np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for r in range(ROUNDS):
            z = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << np.uint64(half)) | right

    todo = np.arange(len(out))
    while len(todo):
        out[todo] = once(out[todo])
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def training_order(docs: DataFrame, key: int = 1, sequence: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES, tokens: str | None = None, end: int = END, pad: int = PAD) -> DataFrame:
    """slot, shard, byte_offset, doc_id, chunk, n_tokens and record (2 bytes an id, little-endian), in slot order, each task
    with a range of whole shards. `tokens` names an array of ids below 65,536, with `end` and `pad` free among them; without it the
    ids are the bytes of `text`. Ids are shuffled twice: to number sequences and to lay them out."""
    spark = docs.sparkSession
    width = 1 if tokens is None else 2
    rows = docs.select("doc_id", (F.encode(text_of("text"), "UTF-8") if tokens is None else _two_bytes(F.col(tokens))).alias("__b"))
    rows = rows.withColumn("__n", (F.floor(F.octet_length("__b") / (width * sequence)) + 1).cast("bigint"))
    blocks = max(1, -(-(rows.agg(F.sum("__n")).first()[0] or 0) // BLOCK_SEQUENCES))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64("doc_id", "__b"), F.lit(blocks)).cast("int"))
    sums = dict(rows.groupBy("__block").agg(F.sum("__n")).collect())  # one number for each BLOCK_SEQUENCES sequences
    starts, total = [], 0
    for b in sorted(sums):
        starts.append((b, total))
        total += sums[b]
    offsets = spark.createDataFrame(starts, "__block int, __start bigint")
    order = Window.partitionBy("__block").orderBy("doc_id", "__b").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).join(F.broadcast(offsets), "__block")
    pieces = F.transform(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int")), lambda i: F.substring(F.col("__b"), i * (width * sequence) + 1, F.lit(width * sequence)))
    chunks = numbered.select("doc_id", (F.col("__start") + F.col("__before")).alias("__first"), "__n", pieces.alias("__pieces"))
    chunks = chunks.select("doc_id", "__first", "__n", F.posexplode("__pieces").alias("chunk", "__piece"))
    chunks = chunks.select("doc_id", "chunk", (F.col("chunk") + 1 == F.col("__n")).alias("__last"), (F.col("__first") + F.col("chunk")).alias("__ordinal"), "__piece")
    kind = docs.schema["doc_id"].dataType.simpleString()
    n_shards = max(1, -(-total // shard_sequences))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = permute(batch.column("__ordinal").to_numpy(zero_copy_only=False), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // shard_sequences), *(batch.column(c) for c in ("doc_id", "chunk", "__last", "__piece"))], ["slot", "shard", "doc_id", "chunk", "__last", "__piece"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, out = [], []
            for piece, last in zip(batch.column("__piece").to_pylist(), batch.column("__last").to_pylist()):
                ids, n = np.full(sequence, pad, "<u2"), len(piece) // width
                ids[:n] = np.frombuffer(piece, "u1" if width == 1 else "<u2")
                if last:
                    ids[n] = end
                n_tokens.append(n + last)
                out.append(ids.tobytes())
            offset = (batch.column("slot").to_numpy(zero_copy_only=False) % shard_sequences) * stride(sequence)
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("shard"), pa.array(offset), batch.column("doc_id"), batch.column("chunk"), pa.array(n_tokens, pa.int32()), pa.array(out, pa.binary())], ["slot", "shard", "byte_offset", "doc_id", "chunk", "n_tokens", "record"])

    placed = chunks.mapInArrow(slots, f"slot bigint, shard bigint, doc_id {kind}, chunk int, __last boolean, __piece binary")
    n_ranges = min(n_shards, MOST_RANGES)
    of = F.expr(f"cast(shard * {n_ranges} div {n_shards} as int)")
    laid = placed.repartitionById(n_ranges, of).sortWithinPartitions("slot")
    return laid.mapInArrow(records, f"slot bigint, shard bigint, byte_offset bigint, doc_id {kind}, chunk int, n_tokens int, record binary")


def _two_bytes(ids):
    """An array of ids as bytes, two for each, little-endian; null is empty."""
    pair = lambda i: F.concat(F.lpad(F.hex(i % 256), 2, "0"), F.lpad(F.hex(F.shiftright(i, 8)), 2, "0"))
    return F.coalesce(F.unhex(F.array_join(F.transform(ids, pair), "")), F.lit(b""))


def stride(sequence: int = SEQUENCE) -> int:
    """Bytes from one record of a shard to the next: two for each id, and the line end that Spark's text writer adds."""
    return 2 * sequence + 1


def write_shards(ordered: DataFrame, path: str) -> None:
    """One fixed-stride binary file for each shard, under shard=<n>/, from the layout of `training_order`, whose tasks hold whole shards."""
    laid = ordered.select("shard", "slot", F.col("record").cast("string").alias("value"))
    laid = laid.sortWithinPartitions("shard", "slot").select("shard", "value")
    laid.write.partitionBy("shard").mode("overwrite").text(path)


def read_shards(spark: SparkSession, path: str, start: int = 0, sequence: int = SEQUENCE, shard_sequences: int = SHARD_SEQUENCES) -> DataFrame:
    """slot and record from slot `start` on; shards before it are not opened."""
    step = stride(sequence)
    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= start // shard_sequences).select("shard", "content")
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("content") / step).cast("int") - 1))
    cut = files.select("shard", "content", at.alias("i"))
    slot = F.col("shard").cast("bigint") * shard_sequences + F.col("i")
    return cut.select(slot.alias("slot"), F.substring(F.col("content"), F.col("i") * step + 1, F.lit(2 * sequence)).alias("record")).where(F.col("slot") >= start)
