"""Jaccard join of documents by their word n-grams: components of linked documents.

Two documents link when the Jaccard similarity of their sets of distinct word n-grams
is at least ``percent`` / 100.  Overlaps are the product of the sparse document by n-gram
incidence matrix with its transpose, formed in blocks of documents and of n-grams:
overlap counts grow from one block of n-grams to the next, and a pair goes as soon as its
sizes rule it out.  Sets of x and y n-grams that link differ in at most
``(100 - percent) * (x + y) / (100 + percent)`` n-grams, d; what two sets hold in the
blocks so far less twice their overlap there is a lower bound of that difference, and
over all blocks it is the difference.

The same bound tells which documents meet at all.  Cut the n-gram space into d + 1 ranges
of hashes: in one range at least both documents hold the same n-grams.  So each document
emits one key per range, (size class, range, hash of its n-grams there), and only
documents that share a key can link; sharing a passage is not enough to share a range.
There are some more ranges than d + 1, so that empty ones give no keys: of the ranges that
two linked sets share, more are filled than there are spare ones, unless both sets have
more empty ranges than that; such sets emit keys for their empty ranges too.

1. Documents with the same set are one class.  Classes emit their keys.
2. Keys with several classes are lists; of lists with the same members one is kept.  Each
   class first meets one other, the smallest first member of its lists.  The first block
   of n-grams is a quarter of the hash space (less in sets of 8192 and more); pairs that
   it leaves in reach get the product over whole sets, which are made for them only.
   Their links give components.
3. In lists that still hold several components, members of different components meet.
   Lists whose smallest members are of one component by now go together, as they share
   most of their members; where they do, these meet once, in one cell, else list by list.
   Large cells are cut into blocks of at most ``BLOCK`` x ``BLOCK`` members, multiplied
   whole; pairs of small cells are entries of one masked product.  This happens twice: the
   first block of n-grams says only who has anyone of another component in reach, and
   those meet again with their whole sets, of which a forest of links comes back.  So a
   group of near copies costs a row per member and block, no row per pair, and no link
   that could join two components is lost.

Defined cases: null and empty texts, and texts of white space, have an empty set and
link with nothing; a text shorter than ``n`` words is one n-gram; rows with equal sets
always link; repeated ids are rows of their own; a null id never names a component
where another id can (all null: the component is null); further columns are not read.
Sets are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.components import components
from slotwise.llm.hashing import U, mix, shingle_hashes, words_of
from slotwise.llm.store import forget, in_small_batches, written

BLOCK = 2048  # list members that meet at once
SHORT = 64  # members of a list whose pairs are listed
FIRST_BITS = 62  # of a hash in the first block of n-grams: a quarter of them
BLOCKS = 4  # of columns in a product of pairs
ENTRIES = 1 << 22  # of incidence rows multiplied at once
COLUMNS = 1024  # of a block of a product of long lists
PAIRS_PER_BIN = 2000
STEP = 1.5  # ratio of neighbouring size classes
SEEN = 200_000  # sets a task remembers, so as not to emit a copy's keys again
BITMAP_BITS = 26  # of a filter sent to the tasks at most: 8 MB, whatever the input
ROWS_PER_BIN = 20_000
WHOLE_ROWS_PER_BIN = 5_000  # where whole sets meet
DENSE = 4  # lists whose pairs are a part of this or more of their members' pairs meet as one
MET = "home long, deal long, key long, i int, j int, own int, m long, name long, n long, root long"


@dataclass(frozen=True)
class Rule:
    """Words per n-gram and the least similarity in percent."""

    words: int = 3
    percent: int = 90

    def __post_init__(self):
        if self.words < 1 or not 100 / STEP < self.percent <= 100:
            raise ValueError("one word at least, and a similarity that neighbouring size classes cover")

    def most_different(self, sizes):
        """How many n-grams two linked sets with this sum of sizes can differ in."""
        return (100 - self.percent) * sizes // (100 + self.percent)

    def classes(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Size classes in which a set of ``n`` can meet a linked one, with their number of blocks.

        Of these, as many as the last number can be empty in a set without harm.
        """
        home = int(np.log(n) / np.log(STEP) + 1e-9)
        for c in (home, home + 1):
            least, most = STEP**c, int(STEP ** (c + 1)) + 1
            if c == home or n * 100 // self.percent + 1 >= least:
                needed = int(self.most_different(2 * most)) + 1
                fewest = least * self.percent / 100 / needed  # n-grams per block, in the smallest sets
                spare = int(1.5 * needed * np.exp(-0.8 * fewest)) + 1 if needed > 1 else 0
                yield c, needed + spare, spare


def grams_of(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-gram hashes of each text of a batch."""
    for first, words, bounds in words_of(batch.column("text").to_pylist()):
        for i in range(len(bounds) - 1):
            yield first + i, np.unique(shingle_hashes(words[bounds[i] : bounds[i + 1]], rule.words))


def set_hash(grams: np.ndarray) -> int:
    return int(mix(np.array([mix(grams ^ U(0x51ED27)).sum() + U(len(grams))], np.uint64)).view(np.int64)[0])


def block_keys(grams: np.ndarray, rule: Rule) -> np.ndarray:
    """Keys under which a set can meet a linked one.

    Blocks are runs of the sorted hashes, as a block is a range of hash values.  Where
    one block is all there is, only equal sets link, which needs no key.
    """
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(mix(grams + U(0x2545F491)), out=total[1:])
    keys = []
    for c, blocks, spare in rule.classes(len(grams)):
        if blocks > 1:
            edge = np.searchsorted(grams, _edges(blocks))
            found = mix(np.diff(total[edge]) + mix(np.arange(blocks, dtype=np.uint64) + U(c << 40)))
            filled = np.diff(edge) > 0
            keys.append(found[filled] if blocks - filled.sum() <= spare else found)
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


_edge_cache: dict[int, np.ndarray] = {}


def _edges(blocks: int) -> np.ndarray:
    if blocks not in _edge_cache:
        inner = [(i << 64) // blocks for i in range(blocks)]
        _edge_cache[blocks] = np.array([*inner, (1 << 64) - 1], np.uint64)
    return _edge_cache[blocks]


def level(n):
    """Sets of 8192 n-grams and more halve their first block for each doubling."""
    return np.maximum(np.frexp(np.asarray(n, np.float64))[1] - 13, 0)


def first_block(grams: np.ndarray) -> bytes:
    """The columns of the first block in which a set stands, as 32-bit numbers in order.

    N-grams that share a number count once; that never adds to the difference of two sets.
    """
    end = np.searchsorted(grams, U(1 << (FIRST_BITS - int(level(len(grams))))))
    return np.unique((grams[:end] >> U(FIRST_BITS - 32)).astype(np.uint32)).tobytes()


@dataclass(frozen=True)
class Incidence:
    """Rows of the incidence matrix: sizes of the whole sets, columns in order, where rows end."""

    sizes: np.ndarray
    columns: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(sizes: np.ndarray, packed: list[bytes], kind) -> Incidence:
        ends = np.cumsum([len(x) for x in packed], dtype=np.int64) // np.dtype(kind).itemsize
        return Incidence(sizes, np.frombuffer(b"".join(packed), kind), ends)

    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def below(self, limit: int) -> Incidence:
        kept = self.columns < limit
        ends = np.concatenate([[0], np.cumsum(kept)])[self.ends]
        return Incidence(self.sizes, self.columns[kept], ends)


def by_level(rows: Incidence, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, Incidence]]:
    """Pairs of first blocks with rows cut to the columns that both ends of a pair tell."""
    levels = np.maximum(level(rows.sizes[a]), level(rows.sizes[b]))
    for cut in np.unique(levels):
        yield np.flatnonzero(levels == cut), rows.below(1 << (32 - int(cut))) if cut else rows


def pairs_in_reach(rows: Incidence, a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Which pairs of rows differ in no more columns than their sizes allow.

    Only the asked entries of the product are formed, a block of columns at a time.
    """
    allowed, differ = rule.most_different(rows.sizes[a] + rows.sizes[b]), np.zeros(len(a), np.int64)
    if not len(a) or not len(rows.columns):
        return differ <= allowed
    names, column = np.unique(rows.columns, return_inverse=True)
    width = len(names)
    held = np.bincount(rows.rows() * BLOCKS + column * BLOCKS // width, minlength=len(rows.ends) * BLOCKS)
    end = np.cumsum(held).reshape(-1, BLOCKS)
    held = held.reshape(-1, BLOCKS)
    for block in range(BLOCKS):
        live = np.flatnonzero(differ <= allowed)
        weight = np.cumsum(held[a[live], block] + held[b[live], block])
        for part in np.split(live, np.searchsorted(weight, np.arange(ENTRIES, weight[-1] if len(weight) else 0, ENTRIES))):
            left, right = (
                _entries(end[x[part], block] - held[x[part], block], held[x[part], block], column, width) for x in (a, b)
            )
            place = np.minimum(np.searchsorted(left, right), max(len(left) - 1, 0))
            met = right[left[place] == right] // width if len(left) else right[:0]
            overlap = np.bincount(met, minlength=len(part))
            differ[part] += held[a[part], block] + held[b[part], block] - 2 * overlap
    return differ <= allowed


def _entries(start: np.ndarray, count: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """(pair, column) of the runs of entries of one side of pairs, as one ascending number."""
    pair = np.repeat(np.arange(len(start)), count)
    at = np.arange(len(pair)) + np.repeat(start - (np.cumsum(count) - count), count)
    return pair * width + column[at]


def product(rows: Incidence, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlaps of all rows of ``left`` with all of ``right``, a block of shared columns at a time.

    Rows that meet among themselves share only columns that stand in two of them.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    start = rows.ends - np.diff(rows.ends, prepend=0)
    sides = []
    for side in (left, right):
        count = rows.ends[side] - start[side]
        row = np.repeat(np.arange(len(side)), count)
        at = np.arange(len(row)) + np.repeat(start[side] - (np.cumsum(count) - count), count)
        order = np.argsort(rows.columns[at], kind="stable")
        sides.append((row[order], rows.columns[at][order]))
    alike = np.array_equal(left, right)
    if alike:
        columns, stand = np.unique(sides[0][1], return_counts=True)
        shared = columns[stand > 1]
    else:
        shared = np.intersect1d(sides[0][1], sides[1][1])
    for at in range(0, len(shared), COLUMNS):
        block, filled = shared[at : at + COLUMNS], []
        for (row, column), side in zip(sides, (left, right), strict=True):
            run = slice(np.searchsorted(column, block[0]), np.searchsorted(column, block[-1], side="right"))
            place = np.searchsorted(block, column[run])
            known = block[np.minimum(place, len(block) - 1)] == column[run]
            dense = np.zeros((len(side), len(block)), np.float32)
            dense[row[run][known], place[known]] = 1
            filled.append(dense)
        out += filled[0] @ filled[1].T
    if alike:
        np.fill_diagonal(out, rows.ends[left] - start[left])
    return out


def profiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: size and hash of its set, and its keys once per task and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            size, name, keys = [], [], []
            for _, grams in grams_of(batch, rule):
                size.append(len(grams))
                name.append(set_hash(grams) if len(grams) else None)
                new = len(grams) > 0 and name[-1] not in seen
                keys.append(block_keys(grams, rule) if new else np.zeros(0, np.int64))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name[-1])
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(name, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                ],
                names=["doc_id", "n", "name", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, name long, keys array<long>")


def bitmap(numbers: DataFrame, column: str) -> bytes:
    """A filter that holds every number of the column (and, by chance, others), of 8 to 16 bits a number.

    Its size ends at ``BITMAP_BITS``: beyond some 10 million numbers more pass by chance.
    """
    size = min(BITMAP_BITS, max(16, (8 * numbers.count()).bit_length()))
    spread = F.xxhash64(F.col(column))
    words = (
        numbers.select(
            F.shiftrightunsigned(spread, 64 - size + 6).alias("w"),
            F.expr(f"shiftleft(1L, cast(xxhash64({column}) & 63 as int))").alias("bit"),
        )
        .groupBy("w")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (size - 6), np.int64)
    out[words["w"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def in_bitmap(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the numbers, hashed by Spark's ``xxhash64``, the filter holds."""
    h, size = hashed.view(np.uint64), (64 * len(bits)).bit_length() - 1
    return (bits[(h >> U(64 - size + 6)).astype(np.int64)] >> (h & U(63))) & U(1) == 1


def in_reach(pairs: DataFrame, sets: DataFrame, rule: Rule, whole: bool) -> DataFrame:
    """Of the distinct pairs (a, b) those that the product over ``sets`` leaves in reach.

    Pairs of one ``b`` stand together, in bins that hold each set once; a ``b`` with many
    pairs is dealt to several bins.
    """
    bins = int(pairs.count() // PAIRS_PER_BIN) + 1
    spread = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_PER_BIN).alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    placed = pairs.join(spread, "b").select("a", "b", F.pmod(F.xxhash64("b", part), F.lit(bins)).alias("bin"))
    asked = placed.select(F.col("bin").alias("home"), F.col("a").alias("name")).union(placed.select("bin", "b")).distinct()

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        name = sets.column("name").to_numpy()
        order = np.argsort(name)
        rows = Incidence.of(sets.column("n").to_numpy(), sets.column("cols").to_pylist(), np.uint64 if whole else np.uint32)
        a, b = (order[np.searchsorted(name, pairs.column(end).to_numpy(), sorter=order)] for end in "ab")
        near = np.zeros(len(a), bool)
        for some, cut in [(np.arange(len(a)), rows)] if whole else by_level(rows, a, b):
            near[some] = pairs_in_reach(cut, a[some], b[some], rule)
        return pairs.select(["a", "b"]).filter(pa.array(near))

    rows = asked.join(sets, "name").select("home", "name", "n", "cols")
    return placed.groupBy("bin").cogroup(rows.groupBy("home")).applyInArrow(run, "a long, b long")


def links_of(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, rule: Rule) -> DataFrame:
    """Of the candidate pairs (a, b) those that link by the product over whole sets, written.

    Only the sets of these pairs are made, from the texts of the classes' first documents.
    """
    names = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()
    asked = written(firsts.join(names, "name", "left_semi"), "asked")
    sets = written(_candidate_sets(docs, asked, rule, whole=True), "sets")
    links = written(in_reach(pairs, sets, rule, whole=True), "overlaps")
    forget(asked, sets)
    return links


def _candidate_sets(docs: DataFrame, firsts: DataFrame, rule: Rule, whole: bool) -> DataFrame:
    """Size and first block of columns, or the ``whole`` set, of the classes' first documents.

    The filter of ids may let a few other documents through; nothing refers to them.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(firsts, "first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits.value, np.uint64)
        for batch in batches:
            hashed = batch.column("hashed").to_numpy(zero_copy_only=False)
            mine = pa.RecordBatch.from_arrays([batch.column("text")], ["text"]).filter(pa.array(in_bitmap(held, hashed)))
            for at in range(0, mine.num_rows, 256):
                grams = [g for _, g in grams_of(mine.slice(at, 256), rule) if len(g)]
                told = [g.tobytes() if whole else first_block(g) for g in grams]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_hash(g) for g in grams], pa.int64()), pa.array([len(g) for g in grams], pa.int64()), pa.array(told, pa.binary())],
                    names=["name", "n", "cols"],
                )

    hashed = docs.select("text", F.xxhash64("doc_id").alias("hashed"))
    return hashed.mapInArrow(run, "name long, n long, cols binary").dropDuplicates(["name"])


def _members(held: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, name, n, hub) of the classes that stand in lists; other keys go before the shuffle.

    Near copies share most of their keys: of lists with equal members one stays.
    """
    bits = held.sparkSession.sparkContext.broadcast(bitmap(lists, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(bits.value, np.uint64)
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(filled, batch.column("hashed").to_numpy(zero_copy_only=False))))

    flat = held.select(F.explode("keys").alias("key"), "name", "n").withColumn("hashed", F.xxhash64("key"))
    kept = flat.mapInArrow(run, "key long, name long, n long, hashed long").drop("hashed")
    members = written(kept.join(lists, "key").select("key", "name", "n", "hub").distinct(), "found")
    alike = members.groupBy("key").agg(
        F.count("*").alias("m"),
        F.bit_xor(F.xxhash64("name")).alias("x"),
        F.bit_xor(F.xxhash64("name", F.lit(1))).alias("y"),
    )
    kept = alike.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key")
    one_of_each = written(members.join(kept, "key", "left_semi"), "members")
    forget(members)
    return one_of_each


def _cells(rows: DataFrame) -> DataFrame:
    """The cells in which members of lists with several components meet, a row per member and block, written.

    The home of a list is the component of its smallest member; a home's lists are one cell
    if they list no small part of the pairs of all their members.
    """
    sizes = rows.groupBy("key").agg(
        F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("root", "name").alias("home")
    )
    open_rows = written(rows.join(sizes.filter("lo <> hi").select("key", "m", "home"), "key"), "open")
    homes = open_rows.groupBy("home", "name").agg(F.count("*").alias("times"), F.sum("m").alias("pairs"))
    homes = homes.groupBy("home").agg(
        F.count("*").alias("every"), F.sum("times").alias("times"), F.sum("pairs").alias("pairs")
    )
    one = F.col("every") * F.col("every") <= DENSE * F.col("pairs")
    deals = F.ceil(F.col("times") / ROWS_PER_BIN)
    cells = open_rows.join(homes, "home").select(
        "home",
        F.when(one, F.lit(0)).otherwise(F.pmod(F.xxhash64("key"), deals)).cast("long").alias("deal"),
        F.when(one, F.col("home")).otherwise(F.col("key")).alias("key"),
        F.when(one, F.col("every")).otherwise(F.col("m")).alias("m"),
        "name",
        "n",
        "root",
    )
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    met = (
        cells.distinct()
        .withColumn("own", F.pmod(F.xxhash64("name"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
    )
    met = written(met.select([c.split()[0] for c in MET.split(", ")]), "met")
    forget(open_rows)
    return met


def _meet(met: DataFrame, sets: DataFrame, rule: Rule, whole: bool) -> DataFrame:
    """What members of cells find of other components: the rows of those with anyone in reach, or links by ``whole`` sets.

    The links (a, b) of a bin are a forest of its components.  A bin holds each set once.
    """
    bins = int(met.count() // (WHOLE_ROWS_PER_BIN if whole else ROWS_PER_BIN)) + 1
    dealt = met.withColumn("bin", F.pmod(F.xxhash64("home", "deal", "i", "j"), F.lit(bins)))
    asked = dealt.select(F.col("bin").alias("at"), F.col("name").alias("set")).distinct()
    columns = asked.join(sets.select(F.col("name").alias("set"), "cols"), "set")

    def run(lists: pa.Table, columns: pa.Table) -> pa.Table:
        group = lists.drop_columns(["bin"]).to_pandas()
        names, first, row = np.unique(group["name"].to_numpy(), return_index=True, return_inverse=True)
        n, root = group["n"].to_numpy()[first], group["root"].to_numpy()[first]
        packed = columns.column("cols").take(pa.array(np.argsort(columns.column("set").to_numpy())))
        held = Incidence.of(n, packed.to_pylist(), np.uint64 if whole else np.uint32)
        short = group["m"].to_numpy() <= min(SHORT, BLOCK)
        found = [_short_pairs(group["key"].to_numpy()[short], row[short], root, held, rule, whole, whole)]
        near = np.zeros(len(names), bool)
        near[found[0]] = True
        own, at_cell = group["own"].to_numpy(), np.flatnonzero(~short)
        for at in group[~short].groupby(["key", "i", "j"]).indices.values():
            at = at_cell[at]
            i, j = group["i"].iat[at[0]], group["j"].iat[at[0]]
            left, right = row[at[own[at] == i]], row[at[own[at] == j]]
            pairs = _long_pairs(left, right, i != j, root, held, rule, whole, whole)
            if whole:
                found.append(pairs)
            near[pairs] = True
        if not whole:
            return lists.drop_columns(["bin"]).filter(pa.array(near[row]))
        pairs = np.concatenate(found)
        pairs = pairs[_forest(root[pairs])]
        return pa.table({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

    return dealt.groupBy("bin").cogroup(columns.groupBy("at")).applyInArrow(run, "a long, b long" if whole else MET)


def _forest(ends: np.ndarray) -> list[int]:
    """Which of the edges (rows of two ends) join what those before them do not."""
    parent: dict[int, int] = {}
    kept = []
    for at, (a, b) in enumerate(ends.tolist()):
        while parent.get(a, a) != a:
            parent[a] = a = parent.get(parent[a], parent[a])
        while parent.get(b, b) != b:
            parent[b] = b = parent.get(parent[b], parent[b])
        if a != b:
            parent[a] = b
            kept.append(at)
    return kept


def _short_pairs(key, row, root, held: Incidence, rule: Rule, spanning: bool, whole: bool = False) -> np.ndarray:
    """Pairs in reach of members of the same short list; if asked, one for each two components."""
    order = np.argsort(key, kind="stable")
    key, row, found = key[order], row[order], [np.zeros((0, 2), np.int64)]
    for step in range(1, SHORT):
        at = np.flatnonzero(key[step:] == key[:-step])
        if not len(at):
            break
        a, b = np.minimum(row[at], row[at + step]), np.maximum(row[at], row[at + step])
        open_pair = (root[a] != root[b]) & _sizes_meet(held.sizes[a], held.sizes[b], rule)
        found.append(np.stack([a[open_pair], b[open_pair]], axis=1))
    a, b = np.unique(np.concatenate(found), axis=0).T
    near = np.zeros(len(a), bool)
    for some, cut in [(np.arange(len(a)), held)] if whole else by_level(held, a, b):
        near[some] = pairs_in_reach(cut, a[some], b[some], rule)
    a, b = a[near], b[near]
    if spanning:
        ends = np.stack([np.minimum(root[a], root[b]), np.maximum(root[a], root[b])], axis=1)
        one = np.unique(ends, axis=0, return_index=True)[1]
        a, b = a[one], b[one]
    return np.stack([a, b], axis=1)


def _long_pairs(
    left, right, apart: bool, root, held: Incidence, rule: Rule, spanning: bool, whole: bool = False
) -> np.ndarray:
    """Pairs in reach of two blocks of members; of these a spanning set of what they would join, if asked."""
    near = np.zeros((len(left), len(right)), bool)
    levels = level(held.sizes) * (not whole)
    for cut in np.unique(levels[np.concatenate([left, right])]):
        rows = held.below(1 << (32 - int(cut))) if cut else held
        for l, r in ((cut, cut), (cut, cut - 1), (cut - 1, cut)):  # sizes that link are in one level or in neighbours
            x, y = np.flatnonzero(levels[left] == l), np.flatnonzero(levels[right] == r)
            if len(x) and len(y):
                n, count = held.sizes, np.diff(rows.ends, prepend=0)
                differ = count[left[x]][:, None] + count[right[y]] - 2 * product(rows, left[x], right[y])
                allowed = rule.most_different(n[left[x]][:, None] + n[right[y]])
                near[np.ix_(x, y)] = (differ <= allowed) & _sizes_meet(n[left[x]][:, None], n[right[y]], rule)
    of, out = root.copy(), [np.zeros((0, 2), np.int64)]
    for at, x in enumerate(left):
        y = right[near[at]]
        y = y[(of[y] != of[x]) & (apart | (y > x))]
        if spanning and len(y):
            joined, first = np.unique(of[y], return_index=True)
            y = y[first]
            for part in (left, right):
                of[part[np.isin(of[part], joined)]] = of[x]
        out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    return np.concatenate(out)


def _sizes_meet(x: np.ndarray, y: np.ndarray, rule: Rule) -> np.ndarray:
    return 100 * np.minimum(x, y) >= rule.percent * np.maximum(x, y)


def jaccard_components(
    docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = written(profiles(docs, rule), "profiles")
    lists = written(
        held.select(F.explode("keys").alias("key"), "name")
        .groupBy("key")
        .agg(F.min("name").alias("hub"), F.max("name").alias("top"))
        .filter("hub <> top")
        .select("key", "hub"),
        "lists",
    )
    members = _members(held, lists)
    full, held = held, written(held.drop("keys"), "sizes")
    classes = held.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"))
    forget(full, lists)
    firsts = written(members.select("name").distinct().join(classes.select("name", "first_id"), "name"), "firsts")
    blocks = written(_candidate_sets(docs, firsts, rule, whole=False), "blocks")
    stars = members.groupBy(F.col("name").alias("a")).agg(F.min("hub").alias("b")).filter("a <> b")
    stars = written(stars, "stars")
    near = written(in_reach(stars, blocks, rule, whole=False), "near")
    links = links_of(near, docs, firsts, rule)
    roots = components(links)
    rows = members.join(roots, F.col("name") == F.col("node"), "left").select(
        "key", "name", "n", F.coalesce("root", "name").alias("root")
    )
    rows = written(rows, "rows")
    met = _cells(rows)
    open_met = written(_meet(met, blocks, rule, whole=False), "open_met")
    forget(rows, met)
    if not open_met.isEmpty():
        asked = written(firsts.join(open_met.select("name").distinct(), "name", "left_semi"), "asked")
        sets = written(_candidate_sets(docs, asked, rule, whole=True), "sets")
        more = written(_meet(open_met, sets, rule, whole=True), "more")
        forget(asked, sets)
        if not more.isEmpty():
            forget(roots)
            roots = components(links.union(more))
    forget(open_met)
    named = classes.join(roots, F.col("name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "name"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = written(named.select("name", "root").join(least, "root").select("name", "component_id"), "classes")
    forget(members, firsts, stars, near, blocks, roots)
    return held.join(of_class, "name", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
