"""Mixing of sources to target weights by capped water-filling.

All sources share as many words as the table holds, in proportion to their weights.  A
source whose share is above ``epochs`` times its own words is clamped there and the
excess is shared anew by weight among the others, until none is above.  A target is then
met by repetitions: every document of a source is taken whole as often as the target
covers the source, and the rest goes to the documents that come first in a seeded order,
one more time each, the last of them only with the words that are still missing.  Taken
words therefore add up to the target, rounded half up.

The seeded order is that of an MD5 digest of seed, id and text, so it depends on neither
partitions nor earlier runs.  Where a source's order is cut is searched digit by digit: words are summed
per source and next three hex digits, and only the cell that holds the cut is looked into
further.  No source is ever sorted, and one that holds most rows sends at most 4096 sums
a task.  Rows with one digest are equal rows; a row number tells them apart, and which of
them is taken once more makes no difference to the rows that come out.

Sources are numbered in code-point order over range partitions and filled by aggregates,
so their number is not bound by the driver either.

Defined cases: a null text has no words; a null id is an empty string in the digest; a
null source is a source of its own, the last one; a source without words has target 0 and
gives nothing; repeated rows are documents of their own; an empty table gives no rows; a
very long text is one document, cut only if the cut falls inside it; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm.store import written

WORD = r"[^\x20\x09-\x0D]++"
SOURCE = ["nameless", "name"]
DIGEST, NUMBER, STEP = 32, 16, 3  # hex digits of a digest, of a row number, of one step of the search


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    epochs: int = 3,
    seed: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``.

    ``weights`` go to the sources in code-point order, null last, over and over.
    ``taken`` counts the words the mix takes of the document, repetitions included.
    """
    sized = written(_sized(docs, seed, id_col, text_col, source_col), "sized")
    targets = written(_targets(_numbered(sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))), weights, epochs), "targets")
    plan = targets.join(_cuts(sized, targets), SOURCE, "left")
    more = (
        F.when(F.col("key") < F.col("cut"), F.col("size"))
        .when(F.col("key") == F.col("cut"), F.least("size", F.col("extra") - F.col("before")))
        .otherwise(F.lit(0))
    )
    return sized.join(plan, SOURCE).select(
        "doc_id",
        F.when(~F.col("nameless"), F.col("name")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + more).cast("long").alias("taken"),
    )


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """A narrow row per document: source, number of words and place in the seeded order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)
    number = F.lpad(F.hex(F.monotonically_increasing_id()), NUMBER, "0")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).isNull().alias("nameless"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.concat(F.md5(seeded.cast("binary")), F.lower(number)).alias("key"),
    )


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, their number (from 0) in code-point order, null last."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = sources.repartitionByRange(*SOURCE).sortWithinPartitions(*SOURCE)
    ranged = written(ranged.withColumns({"part": F.spark_partition_id(), "inside": inside}), "sources")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    return ranged.join(starts, "part").withColumn("place", F.col("start") + F.col("inside")).drop("part", "inside", "start")


def _targets(sources: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """Targets by water-filling, split into whole repetitions and the words beyond them."""
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = written(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs), "weighted")
    total, free = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, free = int(total or 0), int(free or 0)
    share, above = total, F.lit(False)
    while free:
        # share / free is what a unit of weight gets; it never falls, so a clamped source stays clamped.
        above = _exact("cap") * _exact(free) < _exact(share) * _exact("weight")
        clamped, rest = sources.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if (total - int(clamped or 0), int(rest or 0)) == (share, free):
            break
        share, free = total - int(clamped or 0), int(rest or 0)
    even = (F.lit(share).cast("long") * F.col("weight")).cast("double") / F.lit(float(free or 1))
    found = sources.withColumn("target", F.when(above, F.col("cap").cast("double")).otherwise(even))
    want, size = F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size")
    whole = F.when(size > 0, F.floor(want / size)).otherwise(0).cast("long")
    return found.withColumn("whole", whole).select(
        *SOURCE, "source_size", "target", "whole", F.when(size > 0, want - F.col("whole") * size).otherwise(0).cast("long").alias("extra")
    )


def _exact(value: int | str) -> Column:
    """A whole number whose products don't overflow."""
    return (F.col(value) if isinstance(value, str) else F.lit(Decimal(value))).cast("decimal(19,0)")


def _cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, cut, before): the key at which ``extra`` words are full, and the words of smaller keys."""
    rows = sized.filter("size > 0").select(*SOURCE, "size", "key")
    state = targets.filter("extra > 0").select(*SOURCE, "extra", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    found = state.limit(0)
    while not state.isEmpty():
        cell = F.expr(f"substring(key, 1, length(cut) + {STEP})")
        sums = (
            rows.join(state, SOURCE)
            .filter(F.col("key").startswith(F.col("cut")))
            .groupBy(*SOURCE, "extra", "before", cell.alias("cell"))
            .agg(F.sum("size").alias("mass"), F.min("key").alias("low"), F.max("key").alias("high"))
        )
        upto = Window.partitionBy(*SOURCE).orderBy("cell")  # at most 16 ** STEP rows
        stop = F.col("before") + F.sum("mass").over(upto)
        holds = (F.col("stop") >= F.col("extra")) & (F.col("stop") - F.col("mass") < F.col("extra"))
        # One row left is the cut itself; rows of one digest differ in their numbers only.
        same = F.substring("low", 1, DIGEST) == F.substring("high", 1, DIGEST)
        longer = F.when(same, F.substring("low", 1, DIGEST)).otherwise("")
        cut = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.length("cell") > F.length(longer), F.col("cell")).otherwise(longer)
        opened = sums.withColumn("stop", stop).filter(holds)
        opened = written(opened.select(*SOURCE, "extra", cut.alias("cut"), (F.col("stop") - F.col("mass")).alias("before")), "cells")
        done = F.length("cut") == DIGEST + NUMBER
        found, state = found.union(opened.filter(done)), opened.filter(~done)
    return found.drop("extra")
