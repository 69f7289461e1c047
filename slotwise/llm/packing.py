"""Packing of whole documents into sequences of a fixed capacity.

Only how many pieces there are of each length matters, so the instance is a histogram of
at most ``capacity`` rows, whatever the number of documents; that alone comes to the
driver.  There it is reduced by dominance: a small set of lengths is fixed for good if it
provably is part of some best packing.  What is left is packed best fit, longest first.
A fixed set and a best-fit step are both written as intervals: "the pieces of this length
with ranks from a to b go, m by m, to the sequences from s on, at this place".  The rank
of a piece among those of its length comes from counts per (length, salt) and row numbers
inside, so a length that holds a third of all pieces is numbered by many tasks.  Pieces
meet their intervals by length and by a block of ranks.

Dominance (w: lengths, c: capacity).  For a piece x:
* no other piece fits beside it: it is alone;
* a piece y with w(x) + w(y) = c: {x, y};
* no two pieces fit beside it: {x, y} with the longest y that fits;
* no three fit, and no two that fit are together longer than the longest single y that
  fits: {x, y}.
Each set dominates every set that holds x: the rest of such a set can be exchanged for y.

Defined cases: null texts count as empty; a document without tokens is no piece (with an
end token every document has one); repeated rows are pieces of their own; an empty table
gives no rows; a document longer than the capacity is cut into pieces of the capacity,
the last may be shorter; further columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.store import in_small_batches, written
from slotwise.llm.vocabulary import runs, word_ids

SALTS = 64
RANK_BLOCK = 1 << 12
INTERVALS = "length long, lo long, hi long, per long, sequence long, place long"


class Instance:
    """Counts per length that shrink as pieces are placed, and the intervals of what was placed."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {length: n for length, n in counts.items() if n}
        self.lengths = sorted(self.left)
        self.capacity = capacity
        self.ranked: dict[int, int] = {}
        self.sequences = 0
        self.intervals: list[tuple[int, int, int, int, int, int]] = []

    def take(self, length: int, n: int, per: int, sequence: int, place: int) -> None:
        """Place ``n`` pieces, ``per`` in each sequence from ``sequence`` on, from ``place`` on."""
        lo = self.ranked.get(length, 0)
        self.ranked[length] = lo + n
        self.intervals.append((length, lo, lo + n, per, sequence, place))
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect_left(self.lengths, length))

    def fix(self, lengths: list[int], times: int) -> None:
        """``times`` sequences that hold just these lengths."""
        place, i = 0, 0
        while i < len(lengths):
            per = lengths.count(lengths[i])
            self.take(lengths[i], times * per, per, self.sequences, place)
            place += per * lengths[i]
            i += per
        self.sequences += times

    def longest_upto(self, room: int, beside: int | None = None) -> int | None:
        """Longest length that fits the room, when one piece of ``beside`` is out."""
        at = bisect_right(self.lengths, room) - 1
        if at >= 0 and self.lengths[at] == beside and self.left[beside] < 2:
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def smallest(self, n: int, beside: int) -> list[int]:
        out: list[int] = []
        for length in self.lengths:
            out += [length] * min(n - len(out), self.left[length] - (length == beside))
            if len(out) == n:
                break
        return out


def reduce_by_dominance(work: Instance) -> None:
    """Fix sets that some best packing holds, until no rule applies."""
    for length in [x for x in work.lengths if 2 * x <= work.capacity]:
        other = work.capacity - length
        if other == length and work.left.get(length, 0) > 1:
            work.fix([length, length], work.left[length] // 2)
        elif other != length and length in work.left and other in work.left:
            work.fix([other, length], min(work.left[length], work.left[other]))
    changed = True
    while changed:
        changed = False
        for length in reversed(list(work.lengths)):
            while length in work.left:
                times = _fix_one(work, length)
                changed |= times > 0
                if not times:
                    break


def _fix_one(work: Instance, length: int) -> int:
    """Fix sets around the pieces of a length; how many sequences that made."""
    room = work.capacity - length
    other = work.longest_upto(room, length)
    if other is None:
        times = work.left[length] if work.longest_upto(room) is None else 1
        work.fix([length], times)
        return times
    two = work.smallest(2, length)
    pair_fits = len(two) == 2 and sum(two) <= room
    if pair_fits and other != room:
        three = work.smallest(3, length)
        if len(three) == 3 and sum(three) <= room or _longest_pair(work, room, length) > other:
            return 0
    # The rule holds as long as the shortest lengths and ``other`` stay; take one less than would exhaust them.
    used = [length, other]
    spare = min(work.left[x] // used.count(x) for x in used)
    times = max(1, spare - 3) if pair_fits else spare
    work.fix(used, times)
    return times


def _longest_pair(work: Instance, room: int, beside: int) -> int:
    """Greatest sum of two lengths within the room (0: none), one piece of ``beside`` being out."""
    best, low, high = 0, 0, bisect_right(work.lengths, room) - 1
    count = lambda x: work.left[x] - (x == beside)
    while low <= high:
        a, b = work.lengths[low], work.lengths[high]
        if a + b > room or count(b) < 1:
            high -= 1
        elif count(a) < 1:
            low += 1
        else:
            if a != b or count(a) > 1:
                best = max(best, a + b)
            low += 1
    return best


def best_fit(work: Instance) -> None:
    """Pack the rest, longest first, each into the fullest sequence with room for it.

    Sequences with the same room are ranges of numbers; a step fills a whole range.
    """
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, start: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((start, n))

    while work.lengths:
        length = work.lengths[-1]
        while length in work.left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, per = work.capacity, work.capacity // length
                n = max(1, work.left[length] // per)
                start = work.sequences
                work.sequences += n
            else:
                room = rooms[at]
                per = room // length
                start, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(at)
            full = min(n, work.left[length] // per)
            if full:
                work.take(length, full * per, per, start, work.capacity - room)
                put(room - per * length, start, full)
            rest = work.left.get(length, 0)
            if n > full and 0 < rest < per:
                work.take(length, rest, rest, start + full, work.capacity - room)
                put(room - rest * length, start + full, 1)
                full += 1
            put(room, start + full, n - full)


def plan(counts: dict[int, int], capacity: int) -> Instance:
    work = Instance(counts, capacity)
    reduce_by_dominance(work)
    best_fit(work)
    return work


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their number (from 0) among those of equal length."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(_by("length").orderBy("salt").rowsBetween(-(1 << 31), -1))
    starts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(_by("length", "salt").orderBy("doc_id", "piece"))
    return (
        salted.withColumn("inside", inside)
        .join(starts, ["length", "salt"])
        .withColumn("rank", F.col("first") + F.col("inside") - 1)
        .drop("salt", "first", "inside")
    )


def _by(*columns):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("a piece is from 1 to the capacity long")
    intervals = spark.createDataFrame(plan(counts, capacity).intervals, INTERVALS)
    # An interval stands in each block of ranks that it touches: short ones in one or two, long ones in
    # as many as there are pieces over the block's size, so a pair of length and block has few of them.
    blocks = F.sequence(F.floor(F.col("lo") / RANK_BLOCK), F.floor((F.col("hi") - 1) / RANK_BLOCK))
    intervals = intervals.withColumn("block", F.explode(blocks))
    numbered = ranked(pieces).withColumn("block", F.floor(F.col("rank") / RANK_BLOCK))
    nth = F.col("rank") - F.col("lo")
    return (
        numbered.join(intervals, ["length", "block"])
        .filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("per")))
        .withColumn("offset", F.col("place") + F.pmod(nth, F.col("per")) * F.col("length"))
        .drop("block", "rank", "lo", "hi", "per", "sequence", "place")
    )


def cut_pieces(
    docs: DataFrame, path: str, lower: bool, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every row, an end id after them, cut into pieces: doc_id, piece, start, length, ids_crc32."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path, lower)
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for first, last in runs(texts):
                rows = []
                for name, ids in zip(names[first:last], encoder.encode(texts[first:last])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((name, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def packed_documents(docs: DataFrame, path: str, lower: bool = True, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    pieces = written(cut_pieces(docs, path, lower, end_id, capacity), "pieces")
    return packed(pieces, capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast(T.LongType()), F.col("offset").cast(T.LongType())
    )
