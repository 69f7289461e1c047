"""Repair of the turn structure of conversations by Wagner-Fischer target alignment.

A conversation's role initials must read ``(s?(ua)+)?``.  For each feasible length that
grammar has one string; the turns are aligned with the string of each length by a table
of edit costs (keep 0, rerole 1, delete 2, insert 5; a truncated turn that stays costs 5
more; a blank or repeated turn must go).  Lengths are tried from the likeliest on.  A
length whose difference to the number of turns costs more than the incumbent is not
tried, and a table is filled only in the Ukkonen band of diagonals on which the incumbent
can still be reached.  Tables hold the cost to the end, so that a trace from the start
can take the smallest edit initial (D, I, K, R) that keeps the cost; of traces of equal
cost the least string, the audit, wins.

Conversations are rows of one shuffle, sorted by (conversation, turn, role, text) and
read in a stream.  One that has more than ``BLOCK`` rows is not gathered: its equal rows
are merged with a count, its distinct rows are laid over range partitions and cut into
blocks.  Each block is aligned by the same tables from each place in the grammar to each
other (nothing yet, after s, after u, after a); the blocks' costs and audits are then
chained, and each block is repaired by its own part of the best chain.  Two audits of the
same rows and cost are never one the beginning of the other, so the least chain consists
of least parts.  Only numbers and audits of a long conversation meet in one task; the
audit is one string of the result anyway.

Defined cases: null role or text is one space; rows of one turn are ordered by role, then
text (code points), null turns come first; a null conversation id is a conversation of
its own; a role is known by its first character, any other than s, u and a must be
changed or deleted; a conversation all of whose rows count 0 times has no turns: zeros,
an empty audit and no repaired turn; an empty table gives no rows; very long texts are
held one conversation (or block) at a time; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from slotwise.llm.store import in_small_batches, written

BLOCK = 256  # rows of a conversation that are aligned at once
SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
CONVERSATION = ["nameless", "name"]
PLACES = "osua"  # nothing yet, after s, after u, after a

_TURNS = "turns array<struct<role:string,text:string>>"
_TOTALS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PIECE = f"nameless boolean, name string, piece long, pieces long, gaps long, {_TOTALS}, {_TURNS}"
_WAYS = "ways array<struct<entry:string,exit:string,cost:long,audit:string>>"
_SUMMARY = f"nameless boolean, name string, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, {_WAYS}"
_CHOSEN = f"nameless boolean, name string, block long, piece long, pieces long, entry string, part string, {_TOTALS}"


# ---- alignment of one run of turns


def targets(entry: str, exits: str, turns: int) -> list[tuple[int, int, str]]:
    """(least cost of the length, length, first letter) of each feasible target, the likeliest first."""
    found = []
    for first in "us" if entry == "o" else "a" if entry == "u" else "u":
        for length in range(turns + (DELETE * turns + 2 * INSERT) // INSERT + 1):
            if length == 0:
                end = entry if first != "s" else ""
            else:
                end = letter(first, length - 1)
            if end and end in exits:
                found.append((_apart(length - turns), length, first))
    return sorted(found, key=lambda t: (t[0], t[1]))


def letter(first: str, place: int) -> str:
    """The letter of the alternating target that begins with ``first``."""
    if first == "s":
        return "s" if place == 0 else "ua"[(place - 1) % 2]
    return first if place % 2 == 0 else "ua"[first == "u"]


def _apart(more: int) -> int:
    return INSERT * more if more > 0 else -DELETE * more


def aligned(turns: list[tuple[str, bool]], after: list[str], entry: str = "o", exits: str = "oa") -> tuple[int, str] | None:
    """Least (cost, audit) that leads from place ``entry`` of the grammar to one of ``exits``.

    ``turns`` are (role initial, is truncated) of those that may stay; ``after`` are the
    forced edits that follow each.  None if no edits lead there.
    """
    costs = []
    for initial, cut in turns:
        costs.append({x: (0 if x == initial else REROLE) + TRUNCATED * cut for x in "ua"})
        if initial == "s":
            costs[-1]["s"] = TRUNCATED * cut
    n = len(turns)
    best, incumbent = None, DELETE * n + 2 * INSERT  # all turns deleted, two inserted: leads from any place to u or a
    for least, length, first in targets(entry, exits, n):
        if least > incumbent:
            break
        target = [letter(first, j) for j in range(length)]
        table, low = _banded(costs, target, incumbent)
        cost = table[0][-low]
        if cost <= incumbent:
            found = (cost, _traced(turns, target, table, low, after))
            best = found if best is None else min(best, found)
            incumbent = best[0]
    return best


def _banded(costs: list[dict], target: list[str], incumbent: int) -> tuple[list[list[float]], int]:
    """Costs to the end for each turn and diagonal (target place less turn) within the band, and the lowest diagonal."""
    n, length = len(costs), len(target)
    never = float("inf")
    low = high = 0
    while low > -n and _apart(low - 1) + _apart(length - n - low + 1) <= incumbent:
        low -= 1
    while high < length and _apart(high + 1) + _apart(length - n - high - 1) <= incumbent:
        high += 1
    width = high - low + 1
    below = [never] * (width + 1)
    table = [below] * (n + 1)
    for i in range(n, -1, -1):
        row = [never] * (width + 1)  # the last cell stays out of reach
        cost = costs[i] if i < n else {}
        for d in range(width - 1, -1, -1):
            j = i + low + d
            if j < 0 or j > length:
                continue
            if j == length:
                least = 0 if i == n else never
            else:
                least = row[d + 1] + INSERT if target[j] != "s" else never
                if (c := cost.get(target[j])) is not None and below[d] + c < least:
                    least = below[d] + c
            if i < n and d and below[d - 1] + DELETE < least:
                least = below[d - 1] + DELETE
            row[d] = least
        table[i] = below = row
    return table, low


def _traced(turns: list, target: list[str], table: list[list[float]], low: int, after: list[str]) -> str:
    """The least string of edits that keeps the cost of the table's start."""
    i, d, out = 0, -low, []
    n, length = len(turns), len(target)
    while i < n or i + low + d < length:
        j, here = i + low + d, table[i][d]
        if i < n and d and table[i + 1][d - 1] + DELETE == here:
            out += "D", after[i]
            i, d = i + 1, d - 1
        elif j < length and target[j] != "s" and table[i][d + 1] + INSERT == here:
            out.append("I")
            d += 1
        else:
            out += "K" if turns[i][0] == target[j] else "R", after[i]
            i += 1
    return "".join(out)


def replayed(rows: list[tuple[str, str, int]], audit: str, entry: str = "o") -> list[dict]:
    """The turns that the edits of ``audit`` leave of rows of (role, text, times), from place ``entry`` on."""
    out, place, letters = [], entry, iter(audit)

    def inserted() -> str:
        """Write what is inserted before the next turn; the edit of that turn."""
        nonlocal place
        while (edit := next(letters, "")) == "I":
            place = "a" if place == "u" else "u"
            out.append({"role": ROLES[place], "text": ""})
        return edit

    for role, text, times in rows:
        for _ in range(times):
            edit = inserted()
            if edit == "K":
                place = role[:1]
                out.append({"role": role, "text": text})
            elif edit == "R":
                place = "a" if place == "u" else "u"
                out.append({"role": ROLES[place], "text": text})
    inserted()
    return out


class Faults:
    """Counts of faults, and what may stay, of rows that come in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.turns: list[tuple[str, bool]] = []
        self.forced = [0]  # rows that must go: before all turns, then after each
        self.seen: set[bytes] = set()

    def add(self, role: str, text: str, times: int, repeated: bool | None = None) -> None:
        """``repeated``: known to be seen in an earlier block or not; by default what was added here tells."""
        initial, bare = role[:1], text.strip(SPACES)
        if repeated is None:
            mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            repeated = mark in self.seen
            self.seen.add(mark)
        stays = bool(bare) and not repeated
        if not bare:
            self.blank += times
        else:
            self.duplicate += times - stays
        if stays:
            cut = not bare.endswith(ENDS)
            self.truncated += cut
            self.turns.append((initial, cut))
            self.forced.append(0)
        self.forced[-1] += times - stays
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += (times - 1) * (initial + initial not in LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial

    def repair(self, entry: str = "o", exits: str = "oa") -> tuple[int, str] | None:
        parts = ["D" * k for k in self.forced]
        found = aligned(self.turns, parts[1:], entry, exits)
        return found and (found[0] + DELETE * sum(self.forced), parts[0] + found[1])


# ---- conversations


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``turns`` with faults by crc32 of ``conversation:turn`` modulo 20, and ``times``, how often each row stands there.

    0: not at all; 1: empty text; 2: text without ``.!?``; 3: twice; 4: role user.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    fault = F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")) % 20
    return turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def repaired(turns: DataFrame, times: Column | None = None, block: int = BLOCK) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text), for a long one a row for each of its pieces.

    conv_id, piece (from 0), pieces, ``turns`` (repaired role and text of this piece) and,
    with piece 0 alone, those of the whole conversation: gaps, blank, duplicate,
    truncated, illegal, cost, audit.  ``times`` says how often a row stands there, once by
    default; 0 names a conversation without giving it a turn.
    """
    kind = turns.schema["conv_id"].dataType
    rows = turns.select(
        F.col("conv_id").isNull().alias("nameless"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("name"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
        (times if times is not None else F.lit(1)).cast("long").alias("times"),
    )
    long = written(rows.groupBy(*CONVERSATION).agg(F.count_if(F.col("times") > 0).alias("n")).filter(F.col("n") > block).drop("n"), "long")
    if long.isEmpty():
        found = _short(rows, block)
    else:
        short = rows.join(long, CONVERSATION, "left_anti")
        found = _short(short, block).unionByName(_long(rows.join(long, CONVERSATION, "left_semi").filter("times > 0"), block))
    return found.select(F.when(~F.col("nameless"), F.col("name")).cast(kind).alias("conv_id"), *[c for c in found.columns if c not in CONVERSATION])


def _in_order(df: DataFrame, by: list, then: list) -> DataFrame:
    """Rows of equal ``by`` in one task, sorted, and handed on in bounded batches."""
    return in_small_batches(df.repartition(*by).sortWithinPartitions(*by, *then))


def _streamed(by: int, work: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: pa.Schema) -> Callable:
    """A function for mapInArrow: ``work`` on each run of rows whose first ``by`` columns are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        out: list[tuple] = []
        for key, own in groupby(rows, lambda r: r[:by]):
            for row in work(key, own):
                out.append(row)
                if len(out) == 500:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _mapped(df: DataFrame, by: int, work: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(_streamed(by, work, to_arrow_schema(StructType.fromDDL(schema))), schema)


def _short(rows: DataFrame, block: int) -> DataFrame:
    """Whole conversations of at most ``block`` rows."""
    return _mapped(_in_order(rows, CONVERSATION, [F.col("turn").asc_nulls_first(), "role", "text"]), 2, _conversation, _PIECE)


def _conversation(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    faults, kept, places = Faults(), [], set()
    for *_, turn, role, text, times in rows:
        if times:
            faults.add(role, text, times)
            kept.append((role, text, times))
            places.add(turn)
    places.discard(None)
    gaps = max(places) - min(places) + 1 - len(places) if places else 0
    cost, audit = faults.repair()
    yield (*key, 0, 1, gaps, faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost, audit, replayed(kept, audit))


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of any length, cut into blocks of at most ``block`` distinct rows."""
    order = [*CONVERSATION, F.col("turn").asc_nulls_first(), "role", "text"]
    runs = rows.groupBy(*CONVERSATION, "turn", "role", "text").agg(F.sum("times").alias("times"))
    place = F.monotonically_increasing_id()
    placed = runs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place)
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(placed.withColumns({"digest": digest, "block": F.col("place") - inside % block}), "placed")
    first = placed.groupBy(*CONVERSATION, "digest").agg(F.min("place").alias("first"))
    marked = placed.join(first, [*CONVERSATION, "digest"]).select(
        *CONVERSATION, "block", "place", "role", "text", "times", (F.col("place") > F.col("first")).alias("repeated")
    )
    marked = written(marked, "marked")
    unit = [*CONVERSATION, "block"]
    summaries = written(_mapped(_in_order(marked, unit, ["place"]), 3, _summary, _SUMMARY), "summaries")
    chosen = written(_mapped(_in_order(summaries, CONVERSATION, ["block"]), 2, _chained, _CHOSEN), "chosen")
    gaps = placed.groupBy(*CONVERSATION).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    )
    columns = [c for c in chosen.columns if c not in (*unit, "entry", "part")]
    parts = marked.join(chosen.select(*unit, "entry", "part"), unit)
    pieces = _mapped(_in_order(parts, unit, ["place"]), 3, _replayed_block, f"nameless boolean, name string, block long, {_TURNS}")
    return pieces.join(chosen.select(*unit, *columns), unit).join(gaps, CONVERSATION).withColumn(
        "gaps", F.when(F.col("piece") == 0, F.col("gaps"))
    ).drop("block")


def _summary(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Faults of a block, and its least cost and audit between any two places of the grammar."""
    faults = Faults()
    for *_, role, text, times, repeated in rows:
        faults.add(role, text, times, repeated)
    ways = []
    for entry in PLACES:
        for end in PLACES:
            if found := faults.repair(entry, end):
                ways.append({"entry": entry, "exit": end, "cost": found[0], "audit": found[1]})
    yield (*key, faults.blank, faults.duplicate, faults.truncated, faults.illegal, faults.first, faults.last, ways)


def _chained(key: tuple, blocks: Iterator[tuple]) -> Iterator[tuple]:
    """The least chain through the blocks of a conversation, in order: a row for each block."""
    counts, last = [0, 0, 0, 0], None
    best, steps, numbers = {"o": (0, "")}, [], []
    for _, _, block, *own, first, end, ways in blocks:
        counts = [a + b for a, b in zip(counts, own, strict=True)]
        counts[3] += last is not None and last + first not in LEGAL
        last = end
        reached, step = {}, {}
        for way in ways:
            if (before := best.get(way["entry"])) is None:
                continue
            cost, place = before[0] + way["cost"], way["exit"]
            if place in reached and reached[place][0] < cost:
                continue
            found = (cost, before[1] + way["audit"])
            if place not in reached or found < reached[place]:
                reached[place], step[place] = found, (way["entry"], way["audit"])
        best = reached
        steps.append(step)
        numbers.append(block)
    (cost, audit), place = min((best[end], end) for end in "oa" if end in best)
    parts = []
    for step in reversed(steps):
        place, part = step[place]
        parts.append((place, part))
    for i, (block, (entry, part)) in enumerate(zip(numbers, reversed(parts), strict=True)):
        totals = (*counts, cost, audit) if i == 0 else (None,) * 6
        yield (*key, block, i, len(numbers), entry, part, *totals)


def _replayed_block(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
    own = list(rows)
    *_, entry, part = own[0]
    yield (*key, replayed([(r[4], r[5], r[6]) for r in own], part, entry))


def digests(pieces: DataFrame) -> DataFrame:
    """``repaired`` with a row for each conversation and ``repaired_sha256`` of its ``role:text`` lines, no turns.

    The pieces of a long conversation are hashed one after another, none beside another.
    """
    lines = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    facts = [c for c in pieces.columns if c not in ("piece", "pieces", "turns")]
    one = pieces.filter("pieces = 1").select(*facts, F.sha2(lines, 256).alias("repaired_sha256"))
    name = [F.col("conv_id").isNull().alias("nameless"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("name")]
    many = pieces.filter("pieces > 1").select(*name, "piece", *facts, F.size("turns").alias("n"), lines.alias("lines"))

    def hashed(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        state, started, head = hashlib.sha256(), False, None
        for _, _, piece, *found, n, text in rows:
            head = found if piece == 0 else head
            if n:
                state.update((("\n" if started else "") + text).encode())
                started = True
        yield (*head, state.hexdigest())

    streamed = _streamed(2, hashed, to_arrow_schema(one.schema))
    return one.unionByName(_in_order(many, CONVERSATION, ["piece"]).mapInArrow(streamed, one.schema))
