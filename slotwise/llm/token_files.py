"""Token files: patched frame-of-reference blocks, written and read by Spark.

A corpus is a folder of Parquet files whose rows are pages.  A page holds whole documents
in ascending id order, some ``PAGE`` ids or one longer document:

    shard, within      place in the order: shards are ranges of ids; the ids before the page in its shard
    doc_ids, counts    its documents and how many ids each has
    payload            blocks of ``BLOCK`` ids, each
                         u4 least id, u1 width, u2 exceptions,
                         the ids minus the least, packed at ``width`` bits (low bits first),
                         exceptions: u2 places, then u4 values minus the least
    block_starts       where each block begins in the payload

The width is the least that holds ``PERCENTILE`` % of a block's values; higher values are
exceptions, in whole, and leave zeros in the packed part.  A reader that wants the ids
from i on goes to block i // BLOCK.

Pages are read by name of the column, so an executor that is lost costs only its tasks.

Defined cases: null texts count as empty; a null id comes first; repeated ids keep their
rows, in the order of their texts; every document has its end id; an empty table makes
an empty folder that reads as no rows; further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotwise.llm.store import in_small_batches, new_path, written
from slotwise.llm.vocabulary import runs, word_ids

BLOCK = 4096
PAGE = 1 << 20
PERCENTILE = 95
PAGES_AT_ONCE = 16  # pages that go to a worker at once
PAGES = (
    "shard int, within long, doc_ids array<long>, counts array<long>, n_ids long, "
    "payload binary, block_starts array<long>"
)
_HEAD = struct.Struct("<IBH")


def pack_bits(value: np.ndarray, width: int) -> bytes:
    """Values side by side at ``width`` bits each, low bits first.

    Up to 16 bits eight values are put together at once: four in each of two words of 64
    bits, and the two words in the ``width`` bytes that eight values fill.
    """
    if width > 16:
        bits = np.unpackbits(value.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        return np.packbits(bits.ravel(), bitorder="little").tobytes()
    eights = np.zeros((-(-len(value) // 8), 2, 4), "<u8")
    eights.reshape(-1)[: len(value)] = value
    eights <<= np.arange(4, dtype=np.uint64) * np.uint64(width)
    fours = eights[:, :, 0] | eights[:, :, 1] | eights[:, :, 2] | eights[:, :, 3]
    words = np.empty_like(fours)
    words[:, 0] = fours[:, 0] | fours[:, 1] << np.uint64(4 * width)
    words[:, 1] = fours[:, 1] >> np.uint64(64 - 4 * width)
    return words.view(np.uint8)[:, :width].tobytes()[: (len(value) * width + 7) // 8]


def unpack_bits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    if width > 16:
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :width] = np.unpackbits(packed, bitorder="little")[: n * width].reshape(n, width)
        return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().copy()
    filled = np.zeros((-(-n // 8), width), np.uint8)
    filled.reshape(-1)[: len(packed)] = packed
    words = np.zeros((len(filled), 16), np.uint8)
    words[:, :width] = filled
    low, high = words.view("<u8").T
    fours = np.stack([low, low >> np.uint64(4 * width) | high << np.uint64(64 - 4 * width)], axis=1)
    ones = np.uint64((1 << width) - 1)
    value = fours[:, :, None] >> (np.arange(4, dtype=np.uint64) * np.uint64(width)) & ones
    return value.reshape(-1)[:n].astype(np.uint32)


def pack_block(ids: np.ndarray) -> bytes:
    least = int(ids.min())
    value = (ids - np.uint32(least)).astype(np.uint32)
    width = int(np.partition(value, -(-len(value) * PERCENTILE // 100) - 1)[-(-len(value) * PERCENTILE // 100) - 1]).bit_length()
    odd = np.flatnonzero(value >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    kept = value.copy()
    kept[odd] = 0
    packed = pack_bits(kept, width)
    return _HEAD.pack(least, width, len(odd)) + packed + odd.astype("<u2").tobytes() + value[odd].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int, n: int) -> np.ndarray:
    least, width, exceptions = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    value = unpack_bits(np.frombuffer(data, np.uint8, size, at), n, width)
    at += size
    places = np.frombuffer(data, "<u2", exceptions, at)
    value[places] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
    return value + np.uint32(least)


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    out, starts, at = [], [], 0
    for first in range(0, len(ids), BLOCK):
        starts.append(at)
        out.append(pack_block(ids[first : first + BLOCK]))
        at += len(out[-1])
    return b"".join(out), starts


def unpack(payload: bytes, block_starts: list[int], n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids from ``first`` to ``last`` of a page; only the blocks that hold them are read."""
    last = n if last is None else last
    blocks = range(first // BLOCK, -(-last // BLOCK))
    parts = [unpack_block(payload, block_starts[b], min(BLOCK, n - b * BLOCK)) for b in blocks]
    return np.concatenate([np.zeros(0, np.uint32), *parts])[first - blocks.start * BLOCK :][: last - first]


def write(
    docs: DataFrame, folder: str, path: str, lower: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every row with the tokenizer file and write the token files of the corpus."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path, lower)
        shard, within, names, parts, held = None, 0, [], [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            shards, doc_ids = batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist()
            for first, last in runs(texts, PAGE):
                for i, ids in enumerate(encoder.encode(texts[first:last]), first):
                    ids += end
                    if held and held + len(ids) // 4 > PAGE:
                        yield _page(shard, within, names, parts)
                        within, names, parts, held = within + held, [], [], 0
                    shard = shards[i]
                    names.append(doc_ids[i])
                    parts.append(ids)
                    held += len(ids) // 4
        if names:
            yield _page(shard, within, names, parts)

    (
        in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .withColumn("shard", F.spark_partition_id())
        .mapInArrow(run, PAGES)
        .write.parquet(folder)
    )


def _page(shard: int, within: int, names: list, parts: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(parts), "<u4")
    payload, starts = pack(ids)
    cells = [shard, within, names, [len(p) // 4 for p in parts], len(ids), payload, starts]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays(
        [pa.array([c], k) for c, k in zip(cells, kinds)],
        names=["shard", "within", "doc_ids", "counts", "n_ids", "payload", "block_starts"],
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of a corpus with the number of ids before each.

    A page knows the ids before it in its shard; those before the shard come from a table
    of one row per shard (one per task that wrote), the only one that is summed in order.
    Written first, it is known to be small, so the pages need no shuffle to meet it.
    """
    df = spark.read.schema(PAGES).parquet(folder)
    totals = df.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = written(totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "shards")
    return df.join(shards, "shard").withColumn("start", F.col("first") + F.col("within"))


def read(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """Per document of the corpus: doc_id, start, n_tokens and its ids (or their crc32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                page = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids = unpack(page["payload"], page["block_starts"], page["n_ids"])
                ends = np.cumsum(np.array(page["counts"], np.int64))
                begins = ends - np.array(page["counts"], np.int64)
                if digests:
                    data = ids.astype("<u4").tobytes()
                    shown = pa.array([zlib.crc32(data[4 * b : 4 * e]) for b, e in zip(begins, ends)], pa.int64())
                else:
                    offsets = pa.array(np.append(begins, ends[-1]).astype(np.int32))
                    shown = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page["doc_ids"], pa.int64()), pa.array(begins + page["start"]), pa.array(page["counts"], pa.int64()), shown],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    shown = "ids long" if digests else "ids array<long>"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES_AT_ONCE))
    placed = pages(spark, folder).select("doc_ids", "counts", "n_ids", "payload", "block_starts", "start")
    out = placed.mapInArrow(run, f"doc_id long, start long, n_tokens long, {shown}")
    return out.withColumnRenamed("ids", "ids_crc32") if digests else out


def round_trip(docs: DataFrame, path: str, lower: bool = False, end_id: int = 2) -> DataFrame:
    """Token files of ``docs``, written to the shared folder and read back; one row per document."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    write(docs, folder, path, lower, end_id)
    return read(spark, folder, digests=True)
