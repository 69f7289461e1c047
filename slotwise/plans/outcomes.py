"""Fetch outcomes of array elements: shares, timing under control, submitters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import arrays
from slotwise.functions import timeparts as tp
from slotwise.functions.labels import extract_group, percentage, range_label, ratio, tidy
from slotwise.operators.aggregates import min_sample, outcome_status
from slotwise.operators.joins import membership_flag, null_safe_join, with_every_outcome
from slotwise.operators.quantiles import COUNT, MEAN, exact_quantiles, summarize
from slotwise.operators.shares import share_of_total, top_k
from slotwise.plans.sentinels import name_senders
from slotwise.sources.scan import Period
from slotwise.sources.tables import SLOT_TIME, Tables

# Outcomes, client pattern, labels, ranges.
GOOD, BAD = "SUCCESS", "EMPTY"
CLIENT_PATTERN = "-(besu|erigon|geth|nethermind|reth|ethrex)-"
FULL_LABEL = "Full propagation (all SUCCESS)"
NONE_LABEL = "Truly private (all EMPTY)"
MIXED_LABEL = "Partial propagation (mixed)"
TIMING_EDGES = [1000, 1500, 2000, 2500, 3000, 4000]
TIMING_LABELS = ["< 1s", "1-1.5s", "1.5-2s", "2-2.5s", "2.5-3s", "3-4s", "> 4s"]
FOUR_DAYS = Period("2026-01-17 00:00:00", "2026-01-21 00:00:00")
GROUP = ["slot", "block_root"]


def _fetches(t: Tables, period: Period) -> DataFrame:
    return t.window("consensus_engine_api_get_blobs", period).where(F.col("requested_count") > 0)


def _clear(t: Tables, period: Period) -> DataFrame:
    return _fetches(t, period).where(F.col("status").isin(GOOD, BAD))


def _timed(t: Tables, period: Period) -> DataFrame:
    """Fetches of blocks that saw both outcomes, with the node's head time."""
    heads = (
        t.window("beacon_api_eth_v1_events_head", period)
        .groupBy("slot", F.col("block").alias("block_root"), "meta_client_name")
        .agg(F.min("propagation_slot_start_diff").alias("head_time_ms"))
    )
    rows = with_every_outcome(_clear(t, period), GROUP, "status", [GOOD, BAD])
    return rows.join(heads, [*GROUP, "meta_client_name"]).withColumnRenamed("status", "getblobs_status")


def timing_by_client(t: Tables, period: Period = FOUR_DAYS, min_observations: int = 50) -> DataFrame:
    rows = _timed(t, period).withColumn("el_client", extract_group(F.col("meta_client_name"), CLIENT_PATTERN))
    keys = ["el_client", "getblobs_status"]
    out = summarize(
        rows.where(F.col("el_client") != ""),
        keys,
        "head_time_ms",
        {"median_head_time_ms": 0.5},
        observations=COUNT,
        avg_head_time_ms=MEAN,
    )
    times = [tidy(c, 1).alias(c) for c in ("avg_head_time_ms", "median_head_time_ms")]
    return min_sample(out, "observations", min_observations).select(*keys, "observations", *times).orderBy(*keys)


def rate_hourly(t: Tables, period: Period = FOUR_DAYS) -> DataFrame:
    def rate(status: str) -> Column:
        return percentage(F.count_if(F.col("status") == status), F.count("*"), 1)

    hour = tp.hour_label(F.col(SLOT_TIME)).alias("hour")
    return (
        _clear(t, period)
        .groupBy(hour)
        .agg(rate(BAD).alias("empty_rate"), rate(GOOD).alias("success_rate"), F.count("*").alias("observations"))
        .orderBy("hour")
    )


def by_source(t: Tables, period: Period = FOUR_DAYS) -> DataFrame:
    """Slots by block source and by whether all, none or some fetches succeeded."""
    stats = _fetches(t, period).groupBy("slot").agg(
        F.max("requested_count").alias("_blobs"),
        F.count_if(F.col("status") == GOOD).alias("_good"),
        F.count_if(F.col("status") == BAD).alias("_bad"),
        F.count("*").alias("_nodes"),
    )
    relayed = t.window("mev_relay_proposer_payload_delivered", period)
    rows = membership_flag(stats, relayed, ["slot"], "_relayed").withColumns(
        {
            "block_source": F.when(F.col("_relayed"), "MEV").otherwise("Local"),
            "mempool_status": outcome_status(F.col("_good"), F.col("_bad"), FULL_LABEL, NONE_LABEL, MIXED_LABEL),
        }
    )
    return (
        rows.groupBy("block_source", "mempool_status")
        .agg(
            F.count("*").alias("slots"),
            tidy(F.avg("_blobs"), 1).alias("avg_blobs"),
            tidy(F.avg(percentage(F.col("_bad"), F.col("_nodes"))), 1).alias("avg_empty_pct"),
            tidy(F.avg("_nodes"), 1).alias("avg_nodes_observed"),
        )
        .orderBy(F.col("block_source").desc(), "mempool_status")
    )


def timing(t: Tables, period: Period = FOUR_DAYS) -> DataFrame:
    keys = ["getblobs_status"]
    # One shuffle of (status, slot, time) counts feeds both the quantiles and the
    # distinct slots; both read its row count, so that Spark reuses it.
    rows = _timed(t, period).groupBy(*keys, "slot", "head_time_ms").agg(F.count("*").alias("_rows"))
    slots = rows.groupBy(*keys, "slot").agg(F.sum("_rows").alias("_rows")).where(F.col("_rows") > 0)
    probs = {
        "median_head_time_ms": 0.5,
        "p25_head_time_ms": 0.25,
        "p75_head_time_ms": 0.75,
        "p95_head_time_ms": 0.95,
    }
    stats = {"observations": COUNT, "avg_head_time_ms": MEAN}
    out = exact_quantiles(rows, keys, "head_time_ms", probs, stats, weight="_rows")
    out = null_safe_join(out, slots.groupBy(*keys).agg(F.count("*").alias("unique_slots")), keys)
    return out.select(
        *keys, "observations", "unique_slots", *[tidy(c, 1).alias(c) for c in ("avg_head_time_ms", *probs)]
    ).orderBy(*keys)


def shares(t: Tables, period: Period = FOUR_DAYS) -> DataFrame:
    out = _fetches(t, period).groupBy("status").agg(
        F.count("*").alias("observations"),
        tidy(F.avg("requested_count"), 1).alias("avg_blobs_requested"),
        tidy(F.avg("returned_count"), 1).alias("avg_blobs_returned"),
    )
    out = share_of_total(out, "observations", "pct", 2)
    return out.select("status", "observations", "pct", "avg_blobs_requested", "avg_blobs_returned").orderBy(
        F.col("observations").desc(), "status"
    )


def timing_by_size(t: Tables, period: Period = FOUR_DAYS, min_observations: int = 20) -> DataFrame:
    rows = _timed(t, period).withColumnRenamed("requested_count", "blob_count")
    keys = ["blob_count", "getblobs_status"]
    out = summarize(rows, keys, "head_time_ms", {"median_head_time_ms": 0.5}, observations=COUNT)
    out = out.withColumn("median_head_time_ms", tidy("median_head_time_ms", 0))
    return min_sample(out, "observations", min_observations).orderBy(*keys)


def timing_ranges(t: Tables, period: Period = FOUR_DAYS) -> DataFrame:
    rows = _timed(t, period).withColumn(
        "timing_bucket", range_label(F.col("head_time_ms"), TIMING_EDGES, TIMING_LABELS)
    )
    keys = ["getblobs_status", "timing_bucket"]
    return rows.groupBy(*keys).agg(F.count("*").alias("observations")).orderBy(*keys)


def element_outcomes(t: Tables, period: Period) -> DataFrame:
    """Per array element: nodes with each outcome over all slots, mean empty rate.

    Elements are exploded and counted per (slot, element) with partial sums.
    """
    per_slot = (
        _fetches(t, period)
        .select("slot", "status", F.explode("versioned_hashes").alias("versioned_hash"))
        .groupBy("slot", "versioned_hash")
        .agg(
            F.count_if(F.col("status") == GOOD).alias("_good"),
            F.count_if(F.col("status") == BAD).alias("_bad"),
            F.count("*").alias("_all"),
        )
    )
    return per_slot.groupBy("versioned_hash").agg(
        F.sum("_good").alias("good"),
        F.sum("_bad").alias("bad"),
        F.avg(percentage(F.col("_bad"), F.col("_all"))).alias("avg_empty_rate"),
    )


def _element_status(full: str, none: str, mixed: str) -> Column:
    return outcome_status(F.col("good"), F.col("bad"), full, none, mixed, none_first=True)


def _sent_elements(t: Tables, period: Period) -> DataFrame:
    rows = t.window("canonical_beacon_block_execution_transaction", period)
    return rows.where(arrays.length(F.col("blob_hashes")) > 0).select(
        F.col("from").alias("address"), F.explode("blob_hashes").alias("versioned_hash")
    )


def _sent_outcomes(t: Tables, period: Period) -> DataFrame:
    """Sent elements with a known outcome, summed per sender before naming."""
    status = _element_status("full", "none", "mixed")
    rows = _sent_elements(t, period).join(element_outcomes(t, period).withColumn("_s", status), "versioned_hash")
    return rows.groupBy("address").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("_s") == "none").alias("_none"),
        F.count_if(F.col("_s") == "mixed").alias("_mixed"),
        F.count_if(F.col("_s") == "full").alias("_full"),
        F.sum("avg_empty_rate").alias("_rate"),
    )


def rate_by_submitter(t: Tables, period: Period = FOUR_DAYS, n: int = 15) -> DataFrame:
    """Share of elements no node had, for the submitters with most elements."""
    named = name_senders(t, _sent_outcomes(t, period), "address", "submitter_name")
    out = named.groupBy("submitter_name").agg(
        F.sum("_n").alias("total_blobs"), F.sum("_none").alias("unavailable_blobs")
    )
    out = out.withColumn("unavailable_rate", ratio(F.col("unavailable_blobs"), F.col("total_blobs")))
    return top_k(out, [F.col("total_blobs").desc(), F.col("submitter_name")], n)


def summary_by_submitter(t: Tables, period: Period = FOUR_DAYS, min_blobs: int = 100, n: int = 30) -> DataFrame:
    named = name_senders(t, _sent_outcomes(t, period), "address", "submitter_name")
    out = named.groupBy("submitter_name").agg(
        F.sum("_n").alias("total_blobs"),
        F.sum("_none").alias("unavailable"),
        F.sum("_mixed").alias("partial"),
        F.sum("_full").alias("full_propagation"),
        tidy(ratio(F.sum("_rate"), F.sum("_n")), 1).alias("empty_rate"),
    )
    order = [F.col("unavailable").desc(), F.col("empty_rate").desc(), F.col("submitter_name")]
    return top_k(min_sample(out, "total_blobs", min_blobs), order, n)


def element_totals(t: Tables, period: Period = FOUR_DAYS) -> DataFrame:
    status = _element_status("Full Propagation", "Unavailable", "Partial Propagation").alias("status")
    counted = element_outcomes(t, period).groupBy(status).agg(F.count("*").alias("blob_count"))
    return share_of_total(counted, "blob_count", "pct", 2).orderBy(F.col("blob_count").desc(), "status")


def private_senders(t: Tables, period: Period = FOUR_DAYS) -> DataFrame:
    """Elements per sender that no node had."""
    missing = element_outcomes(t, period).where(F.col("good") == 0).select("versioned_hash")
    sent = _sent_elements(t, period).join(missing, "versioned_hash").groupBy("address").agg(F.count("*").alias("_n"))
    named = name_senders(t, sent, "address", "submitter_name")
    return (
        named.groupBy("submitter_name", "address")
        .agg(F.sum("_n").alias("private_blobs"))
        .orderBy(F.col("private_blobs").desc(), "submitter_name", "address")
    )
