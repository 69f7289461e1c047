"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Two words that differ by one inserted, deleted or replaced letter have letter counts whose
squared distance is 1 (lengths one apart) or 2 (equal lengths).  The squared distances of
a block of words come from one matrix product of their counts, |x|^2 + |y|^2 - 2 xy; pairs
at most two apart, of equal or adjacent lengths, stay, and their letters are compared.

Blocks: the letters are dealt to four parts.  One edit touches at most two of them, so a
near pair agrees in the counts of at least two; every word comes once under each two of
its parts (six keys), and only words of one key meet, in order of length, so that a strip
of words meets those of its own and the next length alone.  A pair is taken under the
first two parts in which it agrees.  A key of more than ``TILE`` words is cut into tiles
by a hash of the word, and each two tiles meet in a unit of their own: no task holds a
key as a whole and none is left out.

Words are counted where the texts are read; only counts of distinct words are shuffled.
The best neighbour of a word is an aggregate, and roots are found by doubling: every word
looks one, two, four, ... forms ahead, so the rounds follow the logarithm of the longest
chain.

Defined cases: null text has no words; a null id is an empty string in the key of the
rare typing faults; equal words of any number of documents are one word; ties of a form
go to the smallest word in code-point order; a run as long as a text is one word; a word
without near words has 0 of them, no form and itself as root; an empty table, or one
without words, gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.store import in_small_batches, written

LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
FAULT = 199
TILE = 4096  # words of a key that meet in one unit, of a usual length at most
USUAL = 64
STRIP = 512  # rows of one matrix product
COLUMNS = 4096  # columns of one matrix product
HELD_WORDS = 200_000  # distinct words a task counts before it hands them on
HELD_LETTERS = 1 << 22  # letters compared at once

PARTS = 4
KEYS = [(p, q) for p in range(PARTS) for q in range(p + 1, PARTS)]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile(f"[a-z\xc0-\xff]{{{LEAST_LETTERS},}}")
_ALPHABET = [*range(97, 123), *range(0xC0, 0x100)]
_PLACE = np.zeros(256, np.int64)
_PLACE[_ALPHABET] = np.arange(len(_ALPHABET))
# Letters go to parts in turn, the frequent ones of Latin script first, so that parts hold like shares.
_DEALT = [ord(c) for c in "etaoinsrhldcumfpgwybvkxjqz"] + list(range(0xC0, 0x100))
_PART = np.zeros(len(_ALPHABET), np.int64)
_PART[_PLACE[_DEALT]] = np.arange(len(_DEALT)) % PARTS
_MULTIPLIER = np.random.default_rng(11).integers(1 << 62, size=(len(KEYS), len(_ALPHABET))) * 2 + 1
for _k, _pair in enumerate(KEYS):
    _MULTIPLIER[_k, ~np.isin(_PART, _pair)] = 0
# For each set of parts that differ (a bit each), the first key whose parts don't.
_FIRST = np.array([next((k for k, (p, q) in enumerate(KEYS) if not (bits >> p | bits >> q) & 1), -1) for bits in range(1 << PARTS)])


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``."""
    words = written(counted_words(docs, id_col, text_col), "words")
    near = written(near_words(words), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    form_n = -F.col("best.less")
    known = words.join(best, "word", "left").withColumn("is_form", F.coalesce(form_n >= RATIO * F.col("n"), F.lit(False)))
    formed = written(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("is_form"), F.col("best.near")).alias("form"),
            F.when(F.col("is_form"), form_n).cast("long").alias("form_n"),
        ),
        "formed",
    )
    chains = roots(formed.filter("form is not null").select("word", "form"))
    return formed.join(chains, "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms from each word on; no chain of ``forms`` closes."""
    ahead = forms.select("word", F.col("form").alias("root"))
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        looked = written(ahead.join(step, "root", "left").select("word", "root", "further"), "roots")
        ahead = looked.select("word", F.coalesce("further", "root").alias("root"))
        if looked.filter("further is not null").isEmpty():
            return ahead


# ---- words and their counts


def counted_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): runs of letters with one in 199 mistyped, long and frequent enough."""
    rows = in_small_batches(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).filter(F.col(text_col).isNotNull()))
    partial = rows.mapInArrow(_counts, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            start = zlib.crc32(f"{doc_id}:".encode())
            for run, n in Counter(_RUN.findall(text.as_py().encode().translate(_LOWER).decode())).items():
                mark = zlib.crc32(run.encode(), start)
                if mark % FAULT:
                    held[run] += n
                elif len(run) > LEAST_LETTERS:
                    at = mark % len(run)
                    held[run[:at] + run[at + 1 :]] += n
            if len(held) > HELD_WORDS:
                yield _word_batch(held)
                held.clear()
    if held:
        yield _word_batch(held)


def _word_batch(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


# ---- pairs of near words


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, near, near_n) for each two of ``words`` (word, n; one row a word) one edit apart, both ways."""
    keyed = written(words.mapInArrow(_keyed, "word string, n long, k int, key long"), "keyed")
    # A key of one word has no pair; others get as many tiles as they fill.
    letters = F.sum(F.greatest(F.lit(USUAL), F.char_length("word")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m"), letters.alias("letters")).filter("m > 1")
    tiles = F.ceil(F.col("letters") / (tile * USUAL)).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int")
    placed = keyed.join(sizes.select("key", tiles.alias("tiles")), "key").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    units = placed.select("key", "k", "word", "n", "own", other).select(
        "key", "k", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("upper"),
        F.char_length("word").alias("length"), "word", "n",
    )
    unit = ["key", "low", "high"]
    return units.repartition(*unit).sortWithinPartitions(*unit, "length").mapInArrow(_pairs, "word string, near string, near_n long")


class Letters:
    """Letters of words, one after another, with counts for each word."""

    def __init__(self, words: list[str]):
        raw = "".join(words).encode("latin-1")
        self.codes = np.frombuffer(raw, np.uint8)
        self.length = np.fromiter((len(w) for w in words), np.int64, len(words))
        self.start = np.cumsum(self.length) - self.length

    def counts(self, lo: int, hi: int) -> np.ndarray:
        """Letter counts of words ``lo`` to ``hi``."""
        size = len(_ALPHABET)
        first, last = self.start[lo], self.start[hi - 1] + self.length[hi - 1]
        row = np.repeat(np.arange(hi - lo), self.length[lo:hi])
        flat = np.bincount(row * size + _PLACE[self.codes[first:last]], minlength=(hi - lo) * size)
        return flat.reshape(hi - lo, size)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the word pairs are exactly one edit apart; words of ``b`` are as long as those of ``a`` or one longer."""
        out = np.zeros(len(a), bool)
        for length in np.unique(self.length[a]):
            for more in (0, 1):
                some = np.flatnonzero((self.length[a] == length) & (self.length[b] == length + more))
                step = max(1, HELD_LETTERS // int(length))
                for at in range(0, len(some), step):
                    part = some[at : at + step]
                    place = np.arange(length)
                    x = self.codes[self.start[a[part], None] + place]
                    y = self.start[b[part], None] + place
                    same = x == self.codes[y]
                    if more:
                        # As many letters agree from the left and, moved by one, from the right as the shorter has.
                        moved = (x == self.codes[y + 1])[:, ::-1]
                        left = np.where(same.all(1), length, same.argmin(1))
                        right = np.where(moved.all(1), length, moved.argmin(1))
                        out[part] = left + right >= length
                    else:
                        out[part] = (~same).sum(1) == 1
        return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word under a fingerprint of its counts in each two parts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            words = part.column(0).to_pylist()
            counts = Letters(words).counts(0, len(words)).astype(np.int64)
            keys = counts @ _MULTIPLIER.T + np.arange(len(KEYS)) * 0x1E3779B97F4A7C15
            times = len(KEYS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(words, object), times), pa.string()),
                    pa.array(np.repeat(part.column(1).to_numpy(), times)),
                    pa.array(np.tile(np.arange(times, dtype=np.int32), len(words))),
                    pa.array(keys.ravel()),
                ],
                names=["word", "n", "k", "key"],
            )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted units; a unit that a batch cuts waits for its rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        unit = _units(table)
        end = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
        if end >= TILE:
            yield from _near_in(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
    if held:
        yield from _near_in(pa.Table.from_batches(held).combine_chunks())


def _units(table: pa.Table) -> np.ndarray:
    """A number for each row's unit, rising from 0."""
    changed = np.zeros(table.num_rows, bool)
    for name in ("key", "low", "high"):
        column = table.column(name).to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.cumsum(changed)


def _near_in(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Strips of rows against the rows of their units from there to the end of the next length."""
    if not table.num_rows:
        return
    words, n, k = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("k").to_numpy()
    text = np.array(words, object)
    unit, upper = _units(table), table.column("upper").to_numpy(zero_copy_only=False)
    crossed = table.column("low").to_numpy() != table.column("high").to_numpy()
    letters = Letters(words)
    # Rows are sorted by (unit, length): partners of a row end where the unit's next length ends.
    width = int(letters.length.max()) + 2
    order = unit * width + letters.length
    stop = np.searchsorted(order, order + 1, side="right")
    for lo in range(0, len(words), STRIP):
        hi = min(lo + STRIP, len(words))
        end = int(stop[lo:hi].max())
        rows = letters.counts(lo, hi)
        for left in range(lo, end, COLUMNS):
            right = min(left + COLUMNS, end)
            across = rows if (left, right) == (lo, hi) else letters.counts(left, right)
            a, b = _at_most_two(rows, across)
            a, b = a + lo, b + left
            keep = (b > a) & (unit[a] == unit[b]) & (b < stop[a]) & (~crossed[a] | (upper[a] != upper[b]))
            a, b = a[keep], b[keep]
            keep = letters.near(a, b)
            a, b = a[keep], b[keep]
            differ = rows[a - lo] != across[b - left]
            bits = sum(differ[:, _PART == p].any(1).astype(np.int64) << p for p in range(PARTS))
            keep = _FIRST[bits] == k[a]
            a, b = a[keep], b[keep]
            if len(a):
                both, others = np.concatenate([a, b]), np.concatenate([b, a])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(text[both], pa.string()), pa.array(text[others], pa.string()), pa.array(n[others])], names=["word", "near", "near_n"]
                )


def _at_most_two(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two count matrices whose squared distance is at most 2, from their Gram matrix.

    32-bit floats where they hold every product exactly.
    """
    used = x.any(0) | y.any(0)
    exact = np.float32 if max(x.sum(1).max(), y.sum(1).max()) < 2000 else np.float64
    x, y = x[:, used].astype(exact), y[:, used].astype(exact)
    # xy >= (|x|^2 + |y|^2 - 2) / 2
    gram = x @ y.T
    gram -= (x * x).sum(1)[:, None] / 2
    return np.nonzero(gram >= (y * y).sum(1) / 2 - 1)
