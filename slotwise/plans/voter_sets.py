"""Voter sets: overlap of two sources, bitfields, time to a share, inclusion.

These analyses are described, not given as queries; limits and rules that the
description leaves open are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.labels import percentage, range_label, ratio
from slotwise.operators.aggregates import distinct_count
from slotwise.operators.joins import null_safe_join
from slotwise.operators.quantiles import COUNT, HIGH, MEAN, agg_with_quantiles, summarize, values_at_ranks
from slotwise.operators.ranges import next_after
from slotwise.operators.scalars import one_row
from slotwise.operators.shares import share_of_total


def set_overlap(left: DataFrame, right: DataFrame, group: Sequence[str], member: str) -> DataFrame:
    """Per group: members in both sets, in one only, and the Jaccard ratio.

    The sets are stacked and reduced per (group, member), which combines before
    the shuffle; no set is ever collected.
    """
    sides = left.select(*group, member, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*group, member, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    members = sides.groupBy(*group, member).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    out = members.groupBy(*group).agg(
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("in_both"),
        F.count_if(F.col("_r") == 0).alias("only_left"),
        F.count_if(F.col("_l") == 0).alias("only_right"),
    )
    return out.withColumn(
        "jaccard", ratio(F.col("in_both"), F.col("in_both") + F.col("only_left") + F.col("only_right"))
    )


def overlap_summary(overlap: DataFrame, measure: str, probs: Mapping[str, float]) -> DataFrame:
    """Mean, quantiles and maximum of one measure over the groups."""
    return summarize(overlap, [], measure, probs, mean=MEAN, max=HIGH, groups=COUNT)


def overlap_buckets(overlap: DataFrame, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    label = range_label(F.col("jaccard"), edges, labels).alias("bucket")
    return share_of_total(overlap.groupBy(label).agg(F.count("*").alias("groups")), "groups", "pct", 2)


def _byte(bits: Column, index: Column) -> Column:
    """Value of one byte of a bitfield in hex text, without 0x."""
    return F.conv(F.substring(bits, (index * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def popcount(bits: Column) -> Column:
    """Set bits of a bitfield given as hex text (a 0x in front is allowed)."""
    clean = F.regexp_replace(bits, "^0[xX]", "")
    chunks = F.sequence(F.lit(1), F.greatest(F.length(clean), F.lit(1)), F.lit(8))
    part = F.transform(
        chunks, lambda at: F.bit_count(F.coalesce(F.conv(F.substring(clean, at, F.lit(8)), 16, 10), F.lit("0")).cast("bigint"))
    )
    return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)


def decode_voters(df: DataFrame, bits: str, committee: str, out: str, keep: Sequence[str]) -> DataFrame:
    """One row per committee member whose bit is set.

    Bit i of the field is bit i % 8, counted from the low end, of byte i / 8.
    """
    clean = F.regexp_replace(F.col(bits), "^0[xX]", "")
    rows = df.select(*keep, clean.alias("_bits"), F.posexplode(committee).alias("_at", out))
    byte = _byte(F.col("_bits"), F.floor(F.col("_at") / 8))
    set_ = F.expr("shiftright(_byte, _at % 8) & 1") == 1
    return rows.withColumn("_byte", byte).where(set_).select(*keep, out)


def estimated_voters(
    df: DataFrame, group: Sequence[str], committee: str, set_bits: Column, out: str, terminator: int = 1
) -> DataFrame:
    """Largest bit count per committee less the terminator bit, summed per group."""
    best = df.groupBy(*group, committee).agg(F.max(set_bits - F.lit(terminator)).alias("_best"))
    return best.groupBy(*group).agg(F.sum("_best").cast("bigint").alias(out))


def time_to_share(
    df: DataFrame, group: Sequence[str], voter: str, at: str, share: float, expected: Column | DataFrame, out: str
) -> DataFrame:
    """First time at which ``share`` of the expected voters was seen; NULL if never.

    ``expected`` is one number for all groups, or a table with a row for each value of some
    group columns and the number beside them, as ``estimated_voters`` makes it.  The wanted voter is the one of rank ceil(share * expected), so the time is a
    rank of the first sightings and no group is sorted as a whole.
    """
    first = df.groupBy(*group, voter).agg(F.min(at).alias("_first"))
    rank = f"ceil(_expected * {share!r}D) - 1"
    if isinstance(expected, DataFrame):
        (number,) = [c for c in expected.columns if c not in group]
        constants = expected.withColumnRenamed(number, "_expected")
    else:
        constants = {"_expected": expected}
    found = values_at_ranks(first, group, "_first", {out: rank}, constants=constants)
    return found.select(*group, out, F.col("_total").alias("voters"))


def reached_curve(
    df: DataFrame, waited: str, step: int, cells: int, out: str = "reached_pct", keys: Sequence[str] = ()
) -> DataFrame:
    """Share of all groups, or of those of each key, that had reached the limit by each grid time.

    ``waited`` is NULL for groups that never did; they stay in the total.  Groups are
    counted per grid cell first; the running sum of a key is over its ``cells`` grid rows
    only, which come from one row a key, so rows and grid are never joined.
    """
    named = [F.col(f"`{k}`") for k in keys]
    cell = F.when(F.col(waited).isNotNull(), F.greatest(F.ceil(F.col(waited) / F.lit(step)), F.lit(0))).cast("int")
    counted = df.groupBy(*named, cell.alias("cell")).agg(F.count("*").alias("_n"))
    # Cells beyond the grid, and groups that never reached, count in the total alone.
    of_key = counted.groupBy(*named).agg(
        F.sum("_n").alias("_total"), F.map_from_entries(F.expr(f"collect_list(struct(cell, _n)) filter (where cell <= {cells})")).alias("_counts")
    )
    grid = F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda c: F.struct(c.alias("cell"), F.coalesce(F.try_element_at("_counts", c), F.lit(0)).alias("_n")))
    rows = of_key.select(*named, "_total", F.inline(grid))
    upto = Window.partitionBy(*named).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        *named,
        (F.col("cell") * F.lit(step)).cast("bigint").alias("at"),
        percentage(F.sum("_n").over(upto), F.col("_total"), 4).alias(out),
    )


def agreement_matrix(df: DataFrame, left: Column, right: Column, names: tuple[str, str]) -> DataFrame:
    """The four cells of two verdicts, with shares."""
    cells = df.groupBy(left.alias(names[0]), right.alias(names[1])).agg(F.count("*").alias("cells"))
    return share_of_total(cells, "cells", "pct", 4)


def first_inclusion(
    subjects: DataFrame, events: DataFrame, keys: Sequence[str], start: str, at: str, delay: Column
) -> DataFrame:
    """Per subject the first event of its keys after its start, and the delay; NULL without one.

    ``start`` and ``at`` are whole numbers (slots, days).  Each subject is asked for its
    own start, by an ordered lookup: subjects of one key never meet all its events.
    """
    keys = list(keys)
    found = next_after(subjects, events, start, at, at, keys)
    asked = subjects.withColumn(start, F.col(start).cast("bigint"))
    return null_safe_join(asked, found, [*keys, start], "left").withColumn("delay", delay)


def first_following_share(
    subjects: DataFrame, events: DataFrame, members: DataFrame, start: str, at: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Per start, how many of its members stand in the first event after it.

    ``subjects`` has (start, keys); ``events`` the times ``at`` at which anything was
    included at all; ``members`` (start, keys, at) the times at which members of a start
    were.  ``included`` counts those at the first event; members are counted once.
    """
    keys = list(keys)
    total = subjects.groupBy(start).agg(F.count("*").alias("members"))
    first = next_after(total, events, start, at, "first_at")
    met = members.select(start, *keys, at).join(first, start).where(F.col(at) == F.col("first_at"))
    hits = met.select(start, *keys, at).distinct().groupBy(start).agg(F.count("*").alias("included"))
    out = total.join(first, start, "left").join(hits, start, "left")
    out = out.withColumn("included", F.coalesce("included", F.lit(0)))
    return out.withColumn("included_share", percentage(F.col("included"), F.col("members"), 4))


def inclusion_report(
    rows: DataFrame, keys: Sequence[str], delay: str, within: float, probs: Mapping[str, float]
) -> DataFrame:
    aggs = [
        F.count("*").alias("subjects"),
        F.count_if(F.col(delay).isNull()).alias("never"),
        F.avg(delay).alias("avg_delay"),
        percentage(F.count_if(F.col(delay) <= within), F.count("*"), 4).alias("within_pct"),
    ]
    return agg_with_quantiles(rows, keys, aggs, delay, probs)


def orphan_support(
    subjects: DataFrame, share: Column, keys: Sequence[str], limits: Sequence[float]
) -> DataFrame:
    """Support of each subject: counts over limits, none, maximum, mean, median."""
    rows = subjects.withColumn("_share", share)
    aggs = [
        F.count("*").alias("subjects"),
        F.count_if(F.col("_share") == 0).alias("without_support"),
        *[F.count_if(F.col("_share") >= x).alias(f"over_{i}") for i, x in enumerate(limits)],
        F.max("_share").alias("max_share"),
        F.avg("_share").alias("mean_share"),
    ]
    return agg_with_quantiles(rows, keys, aggs, "_share", {"median_share": 0.5})


def source_gap(
    df: DataFrame, slot: str, source: str, member: str, low_slots: Column | None = None
) -> DataFrame:
    """Distinct members per slot and source, and the gap to the union of sources.

    ``low_slots`` is a condition on ``baseline`` (members of all sources in the
    slot) that marks outage slots to leave out.
    """
    baseline = distinct_count(df, [slot], member, "baseline")
    counts = distinct_count(df, [slot, source], member, "members").join(baseline, slot)
    if low_slots is not None:
        counts = counts.where(~low_slots)
    rows = counts.withColumn("gap", F.col("baseline") - F.col("members"))
    aggs = [
        F.count("*").alias("slots"),
        F.avg("members").alias("mean_members"),
        F.avg("gap").alias("mean_gap"),
    ]
    probs = {"median_members": 0.5, "p90_members": 0.9, "p99_members": 0.99}
    return agg_with_quantiles(rows, [source], aggs, "members", probs)
