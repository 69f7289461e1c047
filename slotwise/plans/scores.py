"""Entities scored by how late their blocks arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.labels import null_default, percentage, position_in, range_label, tidy
from slotwise.operators.aggregates import first_seen, min_sample, zscore_class, zscores
from slotwise.operators.joins import left_fill
from slotwise.operators.quantiles import COUNT, summarize
from slotwise.operators.shares import top_k
from slotwise.plans.arrivals import EIGHT_DAYS, SEEN, sightings
from slotwise.sources.scan import Period
from slotwise.sources.tables import SLOT_TIME, Tables

# Class and range names, late limit.
CLASSES = ["Conservative", "Neutral", "Suspect"]
SCORE_EDGES = [-2, -1, 0, 1, 2, 3]
SCORE_LABELS = ["z < -2", "-2 ≤ z < -1", "-1 ≤ z < 0", "0 ≤ z < 1", "1 ≤ z < 2", "2 ≤ z < 3", "z ≥ 3"]
LATE_MS = 2000
MIN_BLOCKS = 10


def _slot_arrival(t: Tables, period: Period) -> DataFrame:
    return first_seen(sightings(t, period), ["slot"], SEEN, "first_ms")


def _proposed(t: Tables, period: Period) -> DataFrame:
    return t.latest("fct_block_proposer_entity", period)


def entity_arrival(t: Tables, period: Period, min_blocks: int | None = None) -> DataFrame:
    """Median first arrival per entity; ``min_blocks`` cuts entities before scoring."""
    # Read twice, for the rows and for their mean: a merge join is planned alike both times,
    # so the shuffle of the counted arrivals is made once and reused.
    rows = _proposed(t, period).join(_slot_arrival(t, period).hint("merge"), "slot")
    rows = rows.select(null_default(F.col("entity"), "unknown").alias("entity"), "first_ms")
    out = summarize(rows, ["entity"], "first_ms", {"_p50": 0.5}, block_count=COUNT)
    out = out.select("entity", "block_count", (F.col("_p50") / 1000.0).alias("median_arrival_seconds"))
    return out if min_blocks is None else min_sample(out, "block_count", min_blocks)


def scored(t: Tables, period: Period, min_blocks: int | None = None) -> DataFrame:
    """Score against mean and deviation over the entities that are left."""
    out = zscores(entity_arrival(t, period, min_blocks), "median_arrival_seconds", "_z")
    return out.withColumn("classification", zscore_class(F.col("_z"), CLASSES))


def _listed(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "entity",
        "block_count",
        tidy("median_arrival_seconds", 3).alias("arrival_seconds"),
        tidy("_z", 2).alias("z_score"),
        *more,
    )


def classes(t: Tables, period: Period = EIGHT_DAYS) -> DataFrame:
    return (
        scored(t, period)
        .groupBy("classification")
        .agg(
            F.count("*").alias("entity_count"),
            F.sum("block_count").alias("total_blocks"),
            tidy(F.avg("median_arrival_seconds"), 3).alias("avg_arrival_seconds"),
        )
        .orderBy(position_in(F.col("classification"), CLASSES))
    )


def entities(t: Tables, period: Period = EIGHT_DAYS) -> DataFrame:
    return _listed(scored(t, period), "classification").orderBy(F.col("z_score").desc(), "entity")


def chart(t: Tables, period: Period = EIGHT_DAYS, min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """Scored over all entities; small ones are left out afterwards."""
    rows = min_sample(scored(t, period), "block_count", min_blocks)
    return _listed(rows, "classification").orderBy(F.col("block_count").desc(), F.col("z_score").desc(), "entity")


def lowest(t: Tables, period: Period = EIGHT_DAYS, min_blocks: int = MIN_BLOCKS, n: int = 20) -> DataFrame:
    """Small entities are left out before scoring."""
    rows = _listed(scored(t, period, min_blocks).where(F.col("_z") < 0))
    return top_k(rows, [F.col("z_score"), F.col("entity")], n)


def highest(
    t: Tables, period: Period = EIGHT_DAYS, min_blocks: int = MIN_BLOCKS, n: int = 20, above: float = 2.0
) -> DataFrame:
    rows = _listed(scored(t, period, min_blocks).where(F.col("_z") > above))
    return top_k(rows, [F.col("z_score").desc(), F.col("entity")], n)


def score_ranges(t: Tables, period: Period = EIGHT_DAYS) -> DataFrame:
    z = F.col("_z")
    return (
        scored(t, period)
        .groupBy(
            range_label(z, SCORE_EDGES, SCORE_LABELS).alias("score_bucket"),
            range_label(z, SCORE_EDGES, list(range(1, len(SCORE_LABELS) + 1))).alias("bucket_order"),
        )
        .agg(F.count("*").alias("entity_count"))
        .orderBy("bucket_order")
    )


def vote_impact(t: Tables, period: Period = EIGHT_DAYS) -> DataFrame:
    """Head vote share per class and blob count.

    The class list names missing entities 'unknown'; the vote rows keep NULL,
    so votes for blocks without an entity do not match.
    """
    votes = t.latest("fct_attestation_correctness_head", period).where(F.col("votes_head").isNotNull())
    rows = votes.join(t.latest("fct_block_proposer_entity", period).select("slot", "entity"), "slot")
    blobs = t.latest("fct_block_blob_count_head", period).select("slot", "blob_count")
    rows = left_fill(rows, blobs, ["slot"], {"blob_count": 0})
    sums = rows.groupBy("entity", "blob_count").agg(F.sum("votes_head").alias("_head"), F.sum("votes_max").alias("_max"))
    labelled = sums.join(scored(t, period).select("entity", "classification"), "entity")
    return (
        labelled.groupBy("classification", "blob_count")
        .agg(
            percentage(F.sum("_head"), F.sum("_max"), 2).alias("head_vote_percentage"),
            F.sum("_max").alias("total_attestations"),
        )
        .orderBy(position_in(F.col("classification"), CLASSES), "blob_count")
    )


def _late(t: Tables, period: Period) -> DataFrame:
    late = _slot_arrival(t, period).where(F.col("first_ms") > LATE_MS)
    rows = _proposed(t, period).join(late, "slot")
    return rows.select(
        "slot",
        SLOT_TIME,
        null_default(F.col("entity"), "unknown").alias("entity"),
        (F.col("first_ms") / 1000.0).alias("arrival_seconds"),
    )


def late_by_entity(t: Tables, period: Period = EIGHT_DAYS, n: int = 15) -> DataFrame:
    out = _late(t, period).groupBy("entity").agg(
        F.count("*").alias("late_block_count"), tidy(F.avg("arrival_seconds"), 3).alias("avg_arrival_seconds")
    )
    return top_k(out, [F.col("late_block_count").desc(), F.col("entity")], n)


def late_recent(t: Tables, period: Period = EIGHT_DAYS, n: int = 50) -> DataFrame:
    return top_k(_late(t, period), [F.col(SLOT_TIME).desc(), F.col("slot").desc()], n)
