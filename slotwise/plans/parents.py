"""Blocks built on a parent that was not the newest canonical block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import timeparts as tp
from slotwise.functions.labels import label_like, null_default, percentage, tidy
from slotwise.operators.aggregates import min_sample
from slotwise.operators.joins import parent_child
from slotwise.operators.quantiles import HIGH, counted_values, quantiles_of
from slotwise.operators.ranges import range_max
from slotwise.operators.scalars import shared
from slotwise.operators.shares import share_of_total, top_k
from slotwise.sources.scan import Period, scan_window
from slotwise.sources.tables import SLOT_TIME, Tables

# Period, start of the parent search, entity groups.
QUARTER = Period("2025-10-27 00:00:00", "2026-01-27 00:00:00")
LOOKBACK = Period("2025-10-01 00:00:00")
GROUPS = [
    ("solo_stakers", "Solo Stakers"),
    ("rocketpool", "Rocket Pool"),
    ("csm_operator%_lido", "Lido CSM"),
    ("%_lido", "Lido Professional"),
    ("lido", "Lido Professional"),
]
CANONICAL, ORPHANED = "canonical", "orphaned"


def blocks_with_parent(t: Tables, period: Period = QUARTER, lookback: Period = LOOKBACK) -> DataFrame:
    """Blocks of the period with their parent's slot and the staleness verdict.

    Only blocks more than one slot behind their parent need the range lookup.  Parents and
    canonical points lie below the block they are asked for, so one history, from the
    earlier start to the period's end, is read and reduced for all three.
    """
    starts = (period.start, lookback.start)
    history = t.latest("fct_block", Period(None if None in starts else min(starts), period.end))
    history = history.where(F.col("slot").isNotNull() & F.col("block_root").isNotNull())  # a block has both; joins ask for it
    history = shared(history.select("slot", "block_root", "parent_root", "status", SLOT_TIME))
    known, blocks = (scan_window(history, SLOT_TIME, part) for part in (lookback, period))
    linked = parent_child(blocks, known, [("parent_root", "block_root")], {"slot": "parent_slot"})
    linked = linked.select(
        F.col("slot").alias("proposed_slot"),
        "parent_slot",
        (F.col("slot") - F.col("parent_slot")).alias("parent_distance"),
        "status",
        SLOT_TIME,
    )
    canonical = known.where(F.col("status") == CANONICAL).select("slot")
    latest = range_max(
        linked.where(F.col("parent_distance") > 1),
        canonical,
        low="parent_slot",
        high="proposed_slot",
        point="slot",
        out="latest_canonical_slot",
    )
    flagged = linked.join(latest, ["proposed_slot", "parent_slot"], "left")
    stale = (F.col("parent_distance") > 1) & (F.col("latest_canonical_slot") > F.col("parent_slot"))
    return flagged.withColumn("is_truly_stale", F.coalesce(stale, F.lit(False)))


def _count_orphaned_stale() -> Column:
    return F.count_if((F.col("status") == ORPHANED) & F.col("is_truly_stale"))


def _stale_columns() -> list[Column]:
    stale = F.count_if(F.col("is_truly_stale"))
    return [
        F.count("*").alias("total_blocks"),
        stale.alias("truly_stale_blocks"),
        percentage(stale, F.count("*"), 4).alias("truly_stale_pct"),
    ]


def _with_entity(t: Tables, links: DataFrame, period: Period) -> DataFrame:
    entities = t.latest("fct_block_proposer_entity", period).select(F.col("slot").alias("proposed_slot"), "entity")
    return links.join(entities, "proposed_slot", "left").withColumn(
        "entity_group", label_like(F.col("entity"), GROUPS, "Other", null_label="Unknown")
    )


def _stale_summary(rows: DataFrame, key: str) -> DataFrame:
    """Counts of all blocks and quantiles of the stale ones' distance, from one counted table."""
    rows = rows.withColumn("stale_distance", F.when(F.col("is_truly_stale"), F.col("parent_distance")))
    sums = {"total_blocks": F.count("*"), "truly_stale_blocks": F.count_if(F.col("is_truly_stale")), "orphaned_truly_stale": _count_orphaned_stale()}
    counted = counted_values(rows, [key], "stale_distance", sums=sums)
    stats = {c: f"sum({c})" for c in sums} | {"max_distance": HIGH}
    out = quantiles_of(counted, [key], {"p50_distance": 0.5, "p95_distance": 0.95}, stats)
    return out.withColumn("truly_stale_pct", percentage(F.col("truly_stale_blocks"), F.col("total_blocks"), 4))


def daily(t: Tables, period: Period = QUARTER, lookback: Period = LOOKBACK) -> DataFrame:
    links = blocks_with_parent(t, period, lookback)
    return (
        links.groupBy(tp.day(F.col(SLOT_TIME)).alias("day"))
        .agg(*_stale_columns(), _count_orphaned_stale().alias("orphaned_truly_stale"))
        .orderBy("day")
    )


def distances(t: Tables, period: Period = QUARTER, lookback: Period = LOOKBACK) -> DataFrame:
    """All blocks by parent distance.

    ``truly_stale_or_normal`` counts distance 1 or a newer canonical block;
    ``missed_slots_only`` the rest of the distances above 1.
    """
    distance, latest = F.col("parent_distance"), F.col("latest_canonical_slot")
    newer = F.coalesce(latest > F.col("parent_slot"), F.lit(False))
    none_newer = latest.isNull() | (latest == F.col("parent_slot"))
    orphaned = F.count_if(F.col("status") == ORPHANED)
    out = blocks_with_parent(t, period, lookback).groupBy("parent_distance").agg(
        F.count("*").alias("block_count"),
        F.count_if(F.col("status") == CANONICAL).alias("canonical"),
        orphaned.alias("orphaned"),
        percentage(orphaned, F.count("*"), 2).alias("orphan_rate_pct"),
        F.count_if((distance == 1) | newer).alias("truly_stale_or_normal"),
        F.count_if((distance > 1) & none_newer).alias("missed_slots_only"),
    )
    return share_of_total(out, "block_count", "pct", 4).orderBy("parent_distance")


def distances_by_group(t: Tables, period: Period = QUARTER, lookback: Period = LOOKBACK) -> DataFrame:
    links = blocks_with_parent(t, period, lookback).where(F.col("parent_distance") > 1)
    keys = ["entity_group", "parent_distance"]
    return (
        _with_entity(t, links, period)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("total_blocks"),
            F.count_if(F.col("is_truly_stale")).alias("truly_stale_blocks"),
            F.count_if(F.col("status") == ORPHANED).alias("orphaned_blocks"),
        )
        .orderBy(*keys)
    )


_STALE = ["total_blocks", "truly_stale_blocks", "truly_stale_pct", "orphaned_truly_stale"]


def by_group(t: Tables, period: Period = QUARTER, lookback: Period = LOOKBACK) -> DataFrame:
    out = _stale_summary(_with_entity(t, blocks_with_parent(t, period, lookback), period), "entity_group")
    out = out.select("entity_group", *_STALE, "max_distance", "p50_distance", "p95_distance")
    return out.orderBy(F.col("truly_stale_pct").desc(), "entity_group")


def top_entities(
    t: Tables, period: Period = QUARTER, lookback: Period = LOOKBACK, min_blocks: int = 100, n: int = 30
) -> DataFrame:
    rows = _with_entity(t, blocks_with_parent(t, period, lookback), period)
    out = _stale_summary(rows.withColumn("entity", null_default(F.col("entity"), "Unknown")), "entity")
    shown = [tidy(p, 1).alias(p) for p in ("p50_distance", "p95_distance")]
    best = min_sample(out, "total_blocks", min_blocks).select("entity", *_STALE, *shown)
    return top_k(best, [F.col("truly_stale_pct").desc(), F.col("entity")], n)


def weekly_by_group(t: Tables, period: Period = QUARTER, lookback: Period = LOOKBACK) -> DataFrame:
    rows = _with_entity(t, blocks_with_parent(t, period, lookback), period)
    rows = rows.withColumn("week", tp.week(F.col(SLOT_TIME)))
    if period.end is not None:
        rows = rows.where(F.col("week") < F.lit(period.end).cast("timestamp").cast("date"))
    keys = ["week", "entity_group"]
    return rows.groupBy(*keys).agg(*_stale_columns()).orderBy(*keys)
