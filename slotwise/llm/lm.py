"""Scores of whole texts by a bigram model held in a log-frequency Bloom filter.

Training texts are counted word by word and pair by pair.  The count of a pair is
quantised to a level, 1 + floor(log2(count)), and the filter holds (pair, 1) up to
(pair, level): asking for level 1, 2, ... until one is missing gives the level back,
never too low and rarely too high.  Word counts are exact.  A text's score is

    sum over its tokens w after h of log10((f(h, w) + MU * p(w)) / (c(h) + MU)),
    p(w) = (c(w) + 1) / (N + V + 1)

with f the filter's count (the middle of its level, at most c(h) and c(w)); a text starts
after an end.  The base score is the sum of log10 p(w).

How it runs: counts go by hash to parts, as packed arrays summed once per stretch of
texts before the shuffle; a part becomes one section of the filter, with ``BITS`` bits
for each entry.  The sections, in one file, are sent to every executor and mapped, not
loaded, by its workers.  For exact word counts, texts are dealt to batches of about
``BATCH`` characters by hash; a batch asks the parts for its distinct words and scores
its texts with the answers.  Everything is counted over all training rows; parts, batches
and filter grow with the input, what a task holds doesn't.

Words are 64-bit fingerprints (see ``hashing``), pairs 32 bits inside their part.

Defined cases: a null text counts as empty and is one end; texts of white space
likewise; a null id is held out; without training rows N and V are 0 and every
probability is 1; repeated rows get equal scores, and count in training as often as they
occur; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.hashing import U, mix, odd_numbers, words_of
from slotwise.llm.store import in_small_batches, new_path, written

END = U(0x5851F42D4C957F2D)  # the end token's fingerprint
BITS, PROBES, MU = 12, 6, 3.0
BATCH = 4_000_000  # characters
STRETCH = 512  # texts counted together, at most
WORDS, PAIRS = 0, 1


def _texts(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, tokens (an end before the first text and after each), bounds of each text's own."""
    for first, words, bounds in words_of(batch.column("text").to_pylist()):
        n = len(bounds) - 1
        tokens = np.insert(words, np.concatenate([[0], bounds[1:]]), END)
        yield first, tokens, bounds + np.arange(1, n + 2)


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    one, two = odd_numbers(2)
    return mix(tokens[:-1] * one + tokens[1:] * two)


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys of each part."""
    part = ((keys >> U(32)) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order], prepend=-1, append=parts))
    for lo, hi in zip(edge[:-1], edge[1:]):
        yield int(part[order[lo]]), order[lo:hi]


def _chunks(docs: DataFrame, parts: int) -> DataFrame:
    """Counts of words and pairs of training texts, per stretch of texts and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRETCH):
                words, pairs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for _, tokens, _ in _texts(batch.slice(at, STRETCH)):
                    words.append(tokens[1:])
                    pairs.append(pair_hashes(tokens))
                rows = []
                for kind, seen in ((WORDS, words), (PAIRS, pairs)):
                    keys, n = np.unique(np.concatenate(seen), return_counts=True)
                    for part, those in _by_part(keys, parts):
                        packed = keys[those] if kind == WORDS else keys[those].astype(np.uint32)
                        rows.append((kind, part, packed.tobytes(), n[those].astype("<u4").tobytes()))
                yield _record(rows)

    train = docs.filter(~F.col("held_out")).select("text")
    return train.mapInArrow(run, "kind int, part int, keys binary, counts binary")


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "part", "keys", "counts"])


def _summed(table: pa.Table, width: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of packed rows and their summed counts."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), width)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order].astype(np.int64), first) if len(keys) else np.zeros(0, np.int64)
    return keys[first], total


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log2(counts).astype(np.int64)


def _places(keys: np.ndarray, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """Bits of (key, level) in a section of ``size`` bits."""
    h = mix(keys.astype(np.uint64) * odd_numbers(1)[0] + U(level))
    a, b = h >> U(32), (h & U(0xFFFFFFFF)) | U(1)
    for i in range(PROBES):
        yield (a + U(i) * b) % size


def section(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of one part of the filter."""
    levels = level_of(counts)
    size = max(64, int(levels.sum()) * BITS + 7 & ~7)
    bits = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(keys[levels >= level], level, U(size)):
            bits[place] = 1
    return np.packbits(bits, bitorder="little")


class CountFilter:
    """The sections of all parts behind each other."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.data, self.starts, self.sizes = data, starts, sizes

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        """Level of each pair, 0 if it isn't there: asked level by level."""
        out = np.zeros(len(pairs), np.int64)
        part = ((pairs >> U(32)) % U(len(self.sizes))).astype(np.int64)
        open_, keys = np.arange(len(pairs)), pairs & U(0xFFFFFFFF)
        level = 1
        while len(open_):
            size = self.sizes[part[open_]]
            there = size > 0
            there_at = np.flatnonzero(there)
            for place in _places(keys[open_], level, np.maximum(size, U(1))):
                here = place[there_at]
                byte = self.data[self.starts[part[open_[there_at]]] + (here >> U(3)).astype(np.int64)]
                there_at = there_at[(byte >> (here & U(7)).astype(np.uint8)) & 1 == 1]
                if not len(there_at):
                    break
            open_ = open_[there_at]
            out[open_] = level
            level += 1
        return out


def count_at(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, 1.5 * 2.0 ** (levels - 1) - 0.5))


def _sections_and_words(chunks: DataFrame) -> DataFrame:
    """Per part: its section of the filter, and its distinct words with their counts."""

    def run(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        if kind == PAIRS:
            keys, counts = _summed(table, "<u4")
            return pa.table(_columns(kind, part, section(keys, counts).tobytes(), b"", 0, 0))
        keys, counts = _summed(table, "<u8")
        return pa.table(_columns(kind, part, keys.tobytes(), counts.astype("<i8").tobytes(), int(counts.sum()), len(keys)))

    return chunks.groupBy("kind", "part").applyInArrow(
        run, "kind int, part int, keys binary, counts binary, tokens long, types long"
    )


def _columns(kind: int, part: int, keys: bytes, counts: bytes, tokens: int, types: int) -> dict:
    return {
        "kind": pa.array([kind], pa.int32()),
        "part": pa.array([part], pa.int32()),
        "keys": pa.array([keys], pa.binary()),
        "counts": pa.array([counts], pa.binary()),
        "tokens": pa.array([tokens], pa.int64()),
        "types": pa.array([types], pa.int64()),
    }


def _sent_filter(sections: DataFrame, parts: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The sections behind each other in one file of the shared folder that every executor gets; where each begins.

    They pass the driver one by one.
    """
    spark = sections.sparkSession
    starts, sizes, at = np.zeros(parts, np.int64), np.zeros(parts, np.uint64), 0
    path = new_path(spark, "pairs")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    for row in sections.select("part", "keys").toLocalIterator():
        starts[row.part], sizes[row.part] = at, 8 * len(row["keys"])
        file.write(bytearray(row["keys"]))
        at += len(row["keys"])
    file.write(bytearray(1))
    file.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1], starts, sizes


_mapped: dict[str, np.ndarray] = {}


def _data(name: str) -> np.ndarray:
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = np.memmap(SparkFiles.get(name), np.uint8, "r")
    return _mapped[name]


def _asked(dealt: DataFrame, parts: int) -> DataFrame:
    """Distinct words of each batch, by part."""

    def run(table: pa.Table) -> pa.Table:
        seen = [np.unique(tokens) for _, tokens, _ in _texts(table)]
        keys = np.unique(np.concatenate(seen))
        rows = [(part, table.column("batch")[0].as_py(), keys[those].tobytes()) for part, those in _by_part(keys, parts)]
        part, batch, packed = zip(*rows)
        return pa.table({"part": pa.array(part, pa.int32()), "batch": pa.array(batch, pa.int64()), "keys": pa.array(packed, pa.binary())})

    return dealt.groupBy("batch").applyInArrow(run, "part int, batch long, keys binary")


def _answered(asked: DataFrame, words: DataFrame) -> DataFrame:
    """The words that the batches asked for, with their counts."""

    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        keys, counts = np.zeros(0, "<u8"), np.zeros(0, "<i8")
        if held.num_rows:
            keys = np.frombuffer(held.column("keys")[0].as_py(), "<u8")
            counts = np.frombuffer(held.column("counts")[0].as_py(), "<i8")
        out = []
        for packed in asks.column("keys").to_pylist():
            out.append(_counts_of(np.frombuffer(packed, "<u8"), keys, counts).astype("<i8").tobytes())
        return pa.table({"b": asks.column("batch"), "keys": asks.column("keys"), "counts": pa.array(out, pa.binary())})

    held = words.select(F.col("part").alias("p"), "keys", "counts").groupBy("p")
    return asked.groupBy("part").cogroup(held).applyInArrow(run, "b long, keys binary, counts binary")


def _counts_of(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of the wanted words by sorted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def score_texts(tokens, bounds, counts, total: int, types: int, pairs: CountFilter) -> tuple[np.ndarray, ...]:
    """n_tokens, n_known, base score and score of each text of a run.

    ``counts`` are those of ``tokens``; text i has the tokens from bounds[i] to bounds[i + 1].
    """
    log_p = np.log10((counts + 1) / (total + types + 1))
    c, before = counts[1:].astype(np.float64), counts[:-1].astype(np.float64)
    found = np.minimum(count_at(pairs.levels(pair_hashes(tokens))), np.minimum(c, before))
    log_s = np.log10((found + MU * 10 ** log_p[1:]) / (before + MU))
    first = bounds[:-1]
    total_of = lambda x: np.add.reduceat(x, first)
    return (
        np.diff(bounds),
        total_of((counts > 0).astype(np.int64)[: bounds[-1]]),
        total_of(log_p[: bounds[-1]]),
        np.add.reduceat(log_s[: bounds[-1] - 1], first - 1),
    )


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame) -> DataFrame:
    """Scores of every row of docs (doc_id, held_out, text), learned from those not held out."""
    chars = docs.select(F.sum(F.length("text"))).head()[0] or 0
    parts = int(-(-chars // BATCH)) or 1
    learned = written(_sections_and_words(_chunks(docs, parts)), "counts")
    total, types = learned.filter(F.col("kind") == WORDS).select(F.sum("tokens"), F.sum("types")).head()
    total, types = total or 0, types or 0
    name, starts, sizes = _sent_filter(learned.filter(F.col("kind") == PAIRS), parts)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(answers.column("keys").to_pylist()), "<u8")
        counts = np.frombuffer(b"".join(answers.column("counts").to_pylist()), "<i8")
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        pairs = CountFilter(_data(name), starts, sizes)
        parts_of = []
        for _, tokens, bounds in _texts(texts):
            parts_of.append(score_texts(tokens, bounds, _counts_of(tokens, keys, counts), total, types, pairs))
        n, known, base, score = (np.concatenate(x) for x in zip(*parts_of))
        columns = [n, known, np.full(len(n), total), base, score]
        return pa.table(
            [texts.column("doc_id"), texts.column("held_out"), *map(pa.array, columns)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("batch")
    dealt = docs.select(batch, "doc_id", "held_out", "text")
    answers = _answered(_asked(dealt, parts), learned.filter(F.col("kind") == WORDS))
    return dealt.groupBy("batch").cogroup(answers.groupBy("b")).applyInArrow(run, RESULT)


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row, learned from rows whose crc32(id as text) mod 7 is not 2."""
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(True))
    return scored(rows.withColumn("held_out", held_out))
