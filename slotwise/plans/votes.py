"""Vote shares: daily thresholds, participation, reorgs, accuracy per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import timeparts as tp
from slotwise.functions.labels import label_like, null_default, percentage, tidy
from slotwise.operators.aggregates import (
    distinct_count,
    min_sample,
    residual_group,
    threshold_rates,
    weighted_percentage,
)
from slotwise.operators.joins import left_fill
from slotwise.plans.arrivals import INCIDENT_DAY, INCIDENT_SLOT
from slotwise.sources.scan import Period, id_range
from slotwise.sources.tables import SLOT_TIME, VERSION, Tables

# Periods, limits, validator groups.
VOTE_PERIOD = Period("2025-11-07", "2026-03-18")
DAILY_PERIOD = Period("2025-06-01", "2026-03-18")
ATTESTER_WEEK = Period("2026-01-14", "2026-01-21")
PROPOSER_MONTH = Period("2025-12-21", "2026-01-21")
LIMITS = (95, 90, 85, 80)
GROUPS = [("csm_operator%", "Lido CSM"), ("rocketpool", "Rocketpool"), ("solo_stakers", "Solo Stakers")]
INCIDENT_SLOTS = (13505940, 13505950)


def thresholds_daily(
    t: Tables,
    period: Period = VOTE_PERIOD,
    limits=LIMITS,
    min_committee: int = 29000,
    completeness: float = 0.9,
    min_slots: int = 5000,
) -> DataFrame:
    """Slots per day whose vote share reaches each limit."""
    head, most = F.col("votes_head"), F.col("votes_max")
    rows = t.window("fct_attestation_correctness_canonical", period).where(
        (most >= min_committee) & (head + F.col("votes_other") >= most * F.lit(completeness))
    )
    out = rows.groupBy(tp.day(F.col(SLOT_TIME)).alias("date")).agg(
        F.count("*").alias("total_slots"),
        *threshold_rates(percentage(head, most), limits, "confirmed_{}", "pct_{}"),
    )
    return min_sample(out, "total_slots", min_slots).orderBy("date")


def participation_daily(t: Tables, period: Period = DAILY_PERIOD) -> DataFrame:
    rates = [f"{m}_participation_rate" for m in ("avg", "p50", "p05", "min")]
    rows = t.window("fct_attestation_participation_rate_daily", period)
    return rows.select(
        F.col("day_start_date").alias("date"), "slot_count", *[tidy(c, 2).alias(c) for c in rates]
    ).orderBy("date")


def reorgs_daily(t: Tables, period: Period = DAILY_PERIOD, max_depth: int = 5) -> DataFrame:
    rows = t.window("fct_reorg_daily", period).where(F.col("depth") <= max_depth)
    return rows.select(F.col("day_start_date").alias("date"), "depth", "reorg_count").orderBy("date", "depth")


def _is_known(source: Column) -> Column:
    return label_like(source, GROUPS).isNotNull()


def _validator_groups(t: Tables) -> DataFrame:
    """Newest known source per validator; a (version, source) pair fixes ties."""
    known = t["dim_node"].where(_is_known(F.col("source")))
    newest = F.max(F.struct(F.col(VERSION).alias("v"), F.col("source").alias("s")))
    return known.groupBy("validator_index").agg(label_like(newest.getField("s"), GROUPS).alias("entity_group"))


def _votes_by_validator(t: Tables, period: Period, dedup: bool) -> DataFrame:
    name = "fct_attestation_correctness_by_validator_head"
    return t.latest(name, period) if dedup else t.window(name, period)


def _grouped_votes(t: Tables, period: Period, dedup: bool, *keys: str) -> DataFrame:
    rows = _votes_by_validator(t, period, dedup).where(F.col("slot_distance").isNotNull())
    rows = rows.withColumnRenamed("attesting_validator_index", "validator_index")
    return rows.join(_validator_groups(t), "validator_index").groupBy("entity_group", *keys).agg(
        F.count_if(F.col("slot_distance") == 0).alias("correct_head"), F.count("*").alias("total")
    )


def attester_accuracy_by_blobs(t: Tables, period: Period = ATTESTER_WEEK, dedup: bool = False) -> DataFrame:
    """Correct votes per validator group and blob count.

    Votes are summed per (group, slot) before the blob counts are joined.
    """
    sums = _grouped_votes(t, period, dedup, "slot")
    blobs = t.latest("fct_block_blob_count_head", period).select("slot", "blob_count")
    rows = left_fill(sums, blobs, ["slot"], {"blob_count": 0})
    keys = ["entity_group", "blob_count"]
    out = rows.groupBy(*keys).agg(F.sum("correct_head").alias("correct_head"), F.sum("total").alias("total"))
    return out.withColumn("head_accuracy_pct", percentage(F.col("correct_head"), F.col("total"), 2)).orderBy(*keys)


def attester_accuracy(
    t: Tables, period: Period = ATTESTER_WEEK, dedup: bool = False, residual: bool = True
) -> DataFrame:
    """Correct votes per group; 'Other' is the network total minus the known groups."""
    out = _grouped_votes(t, period, dedup)
    if residual:
        rows = _votes_by_validator(t, period, dedup).where(F.col("slot_distance").isNotNull())
        total = rows.agg(
            F.count_if(F.col("slot_distance") == 0).alias("correct_head"), F.count("*").alias("total")
        )
        out = residual_group(out, total, "entity_group", "Other", ["correct_head", "total"])
    return out.withColumn("head_accuracy_pct", percentage(F.col("correct_head"), F.col("total"), 2)).orderBy(
        F.col("total").desc(), "entity_group"
    )


def _proposer_votes(t: Tables, period: Period) -> DataFrame:
    groups = t.latest("fct_block_proposer_entity", period).select(
        "slot", label_like(F.col("entity"), GROUPS, "Other").alias("entity_group")
    )
    votes = t.latest("fct_attestation_correctness_head", period).where(F.col("votes_head").isNotNull())
    return votes.join(groups, "slot")


def _vote_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("votes_head").alias("votes_for_head"),
        F.sum("votes_max").alias("total_votes"),
        weighted_percentage(F.col("votes_head"), F.col("votes_max")).alias("head_vote_pct"),
    )


def proposer_votes_by_blobs(t: Tables, period: Period = PROPOSER_MONTH) -> DataFrame:
    blobs = t.latest("fct_block_blob_count_head", period).select("slot", "blob_count")
    rows = left_fill(_proposer_votes(t, period), blobs, ["slot"], {"blob_count": 0})
    keys = ["entity_group", "blob_count"]
    return _vote_sums(rows, keys).orderBy(*keys)


def proposer_votes(t: Tables, period: Period = PROPOSER_MONTH) -> DataFrame:
    return _vote_sums(_proposer_votes(t, period), ["entity_group"]).orderBy(
        F.col("total_votes").desc(), "entity_group"
    )


def slot_accuracy(
    t: Tables, period: Period = INCIDENT_DAY, slots: tuple[int, int] | None = INCIDENT_SLOTS
) -> DataFrame:
    """Correct votes per slot, for a slot range or (None) every slot."""
    rows = t.latest("fct_attestation_correctness_by_validator_head", period)
    if slots is not None:
        rows = id_range(rows, "slot", *slots)
    right = F.count_if(F.col("slot_distance") == 0)
    return (
        rows.groupBy("slot")
        .agg(
            F.count("*").alias("total_attestations"),
            right.alias("correct_head_votes"),
            percentage(right, F.count("*"), 2).alias("head_accuracy_pct"),
        )
        .orderBy("slot")
    )


def slot_voters(t: Tables, period: Period = INCIDENT_DAY, slot: int | None = INCIDENT_SLOT) -> DataFrame:
    """Distinct validators per entity that voted for the block of a slot.

    Validators are made distinct first; a validator with several sources counts
    once under each, as the source table is not reduced here.
    """
    rows = t.window("fct_attestation_correctness_by_validator_head", period).where(F.col("slot_distance") == 0)
    keys = ["entity"] if slot is not None else ["slot", "entity"]
    if slot is not None:
        rows = rows.where(F.col("slot") == slot)
    voters = rows.select(*keys[:-1], F.col("attesting_validator_index").alias("validator_index")).distinct()
    named = voters.join(t["dim_node"].select("validator_index", "source"), "validator_index", "left")
    named = named.withColumn("entity", null_default(F.col("source"), "unknown"))
    return distinct_count(named, keys, "validator_index", "validator_count").orderBy(
        *keys[:-1], F.col("validator_count").desc(), "entity"
    )


def slot_payload_by_client(t: Tables, period: Period = INCIDENT_DAY, slot: int | None = INCIDENT_SLOT) -> DataFrame:
    rows = t.latest("fct_engine_new_payload_by_el_client", period)
    rows = rows.withColumnRenamed("meta_execution_implementation", "el_client")
    keys = [] if slot is not None else ["slot"]
    if slot is not None:
        rows = rows.where(F.col("slot") == slot)
    return rows.select(*keys, "el_client", "avg_duration_ms", "max_duration_ms", "observation_count").orderBy(
        *keys, F.col("avg_duration_ms").desc(), "el_client"
    )
