"""Gossip arrival of aggregate messages: peak, tail, repeats and slow peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import timeparts as tp
from slotwise.functions.labels import blank_default, histogram_bin, label_like, percentage, position_in, range_label, tidy
from slotwise.operators.aggregates import min_sample, novel_vs_repeat
from slotwise.operators.joins import shifted_join
from slotwise.operators.quantiles import agg_with_quantiles, one_pass_quantile
from slotwise.operators.shares import share_in_group
from slotwise.sources.scan import Period
from slotwise.sources.tables import Tables

# Arrival ranges in milliseconds, agent patterns, class names.
PEAK = (4000, 11000)
TAIL = (12000, 20000)
AGENTS = [
    ("%prysm%", "Prysm"),
    ("%lighthouse%", "Lighthouse"),
    ("%erigon%", "Erigon"),
    ("%teku%", "Teku"),
    ("%nimbus%", "Nimbus"),
    ("%lodestar%", "Lodestar"),
    ("%grandine%", "Grandine"),
]
AGENTS_PER_PEER = [
    ("%prysm%", "Prysm"),
    ("%lighthouse%", "Lighthouse"),
    ("%teku%", "Teku"),
    ("%erigon%", "Erigon"),
    ("%nimbus%", "Nimbus"),
    ("%lodestar%", "Lodestar"),
    ("%grandine%", "Grandine"),
]
SLOW_AGENT = "%prysm%"
STATES = ["Had block", "Caught behind"]
BEHAVIOURS = ["Sent nothing", "Only peak", "Peak and tail", "Only tail"]
BEHIND_CLASSES = ["Rarely (<10%)", "Sometimes (10-40%)", "Often (40-80%)", "Always (>80%)"]
DAY = Period("2026-02-05", "2026-02-06")
QUARTER_HOUR = Period("2026-02-05 12:00:00", "2026-02-05 12:15:00")
HOUR = Period("2026-02-05 12:00:00", "2026-02-05 13:00:00")


def _in(value: Column, limits: tuple[int, int]) -> Column:
    return value.between(*limits)


def _messages(t: Tables, period: Period, low: int, high: int) -> DataFrame:
    rows = t.window("libp2p_gossipsub_aggregate_and_proof", period)
    return rows.where(F.col("propagation_slot_start_diff").between(low, high))


def _per_peer_volume(rows: DataFrame, *more: Column) -> DataFrame:
    diff = F.col("propagation_slot_start_diff")
    return rows.groupBy(F.col("peer_id_unique_key").alias("peer_id"), *more).agg(
        F.count_if(_in(diff, PEAK)).alias("peak"), F.count_if(_in(diff, TAIL)).alias("tail")
    )


def _agents(t: Tables, period: Period, rules) -> DataFrame:
    label = label_like(F.col("remote_agent_implementation"), rules, "Unknown")
    beats = t.window("libp2p_synthetic_heartbeat", period)
    return beats.select(F.col("remote_peer_id_unique_key").alias("peer_id"), label.alias("agent")).distinct()


def _slow_peers(t: Tables, period: Period) -> DataFrame:
    beats = t.window("libp2p_synthetic_heartbeat", period)
    return beats.where(F.col("remote_agent_implementation").like(SLOW_AGENT))


def _slot_status(t: Tables, period: Period, seconds: tuple[int, int]) -> DataFrame:
    """Per (peer, slot): was the peer behind in the checked seconds of the slot?"""
    at = F.col("event_date_time")
    rows = t.window("libp2p_handle_status", period).where(
        (F.col("direction") == "outbound")
        & F.col("response_head_slot").isNotNull()
        & F.col("request_head_slot").isNotNull()
        & tp.seconds_into_slot(at).between(*seconds)
    )
    behind = (F.col("response_head_slot") < F.col("request_head_slot")).cast("int")
    return rows.groupBy(F.col("peer_id_unique_key").alias("peer_id"), tp.slot_number(at).alias("slot_num")).agg(
        F.max(behind).alias("is_behind")
    )


def tail_vs_next_block(t: Tables, period: Period = DAY) -> DataFrame:
    """Median tail arrival of slot N next to median block arrival of slot N + 1."""
    diff = F.col("propagation_slot_start_diff")
    tail = _messages(t, period, *TAIL).groupBy("slot").agg(tidy(one_pass_quantile(diff, 0.5)).alias("tail_p50"))
    blocks = t.window("libp2p_gossipsub_beacon_block", period).where(diff.between(0, 12000))
    nxt = blocks.groupBy("slot").agg(tidy(one_pass_quantile(diff, 0.5)).alias("next_block_p50"))
    return shifted_join(tail, nxt, "slot", 1).select("slot", "tail_p50", "next_block_p50").orderBy("slot")


def client_breakdown(t: Tables, period: Period = DAY) -> DataFrame:
    """Peak and tail messages per client of the relaying peer.

    Messages are summed per peer before the names are attached.
    """
    volume = _per_peer_volume(_messages(t, period, PEAK[0], TAIL[1]))
    named = volume.join(_agents(t, period, AGENTS), "peer_id", "left")
    sums = (
        named.withColumn("client", blank_default(F.col("agent"), "Unknown"))
        .groupBy("client")
        .agg(F.sum("peak").alias("peak_cnt"), F.sum("tail").alias("tail_cnt"))
    )
    total = F.col("peak_cnt") + F.col("tail_cnt")
    return sums.withColumn("total_cnt", total).withColumn(
        "tail_pct", percentage(F.col("tail_cnt"), total, 1)
    ).orderBy(F.col("tail_pct").desc(), "client")


def arrival_histogram(t: Tables, period: Period = DAY, low: int = 4000, high: int = 22000, width: int = 250) -> DataFrame:
    bin_ms = histogram_bin(F.col("propagation_slot_start_diff"), width)
    return _messages(t, period, low, high).groupBy(bin_ms.alias("bin_ms")).agg(F.count("*").alias("cnt")).orderBy("bin_ms")


def behind_state_behaviour(t: Tables, period: Period = QUARTER_HOUR, seconds: tuple[int, int] = (5, 8)) -> DataFrame:
    """What peers forwarded in a slot, by whether they were caught behind in it."""
    slow = _slow_peers(t, period).select(F.col("remote_peer_id_unique_key").alias("peer_id")).distinct()
    slot = tp.slot_number(F.col("slot_start_date_time")).alias("slot_num")
    sent = _per_peer_volume(_messages(t, period, PEAK[0], TAIL[1]), slot)
    rows = _slot_status(t, period, seconds).join(slow, "peer_id", "left_semi").join(sent, ["peer_id", "slot_num"], "left")
    peak, tail = F.coalesce("peak", F.lit(0)), F.coalesce("tail", F.lit(0))
    labelled = rows.select(
        F.when(F.col("is_behind") == 1, STATES[1]).otherwise(STATES[0]).alias("state"),
        F.when((peak == 0) & (tail == 0), BEHAVIOURS[0])
        .when(tail == 0, BEHAVIOURS[1])
        .when(peak > 0, BEHAVIOURS[2])
        .otherwise(BEHAVIOURS[3])
        .alias("behavior"),
    )
    counted = labelled.groupBy("state", "behavior").agg(F.count("*").alias("cnt"))
    return share_in_group(counted, ["state"], "cnt", "pct", 1).orderBy(
        position_in(F.col("state"), STATES), position_in(F.col("behavior"), BEHAVIOURS)
    )


def peer_tail_box(t: Tables, period: Period = DAY, min_messages: int = 100) -> DataFrame:
    """Quantiles over peers of the tail share, per client."""
    volume = _per_peer_volume(_messages(t, period, PEAK[0], TAIL[1]))
    total = F.col("peak") + F.col("tail")
    peers = volume.where(total >= min_messages).withColumn("tail_pct", percentage(F.col("tail"), total, 1))
    named = peers.join(_agents(t, period, AGENTS_PER_PEER).withColumnRenamed("agent", "client"), "peer_id")
    probs = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    out = agg_with_quantiles(
        named.where(F.col("client") != "Unknown"),
        ["client"],
        [F.count("*").alias("peer_count")],
        "tail_pct",
        probs,
    )
    return out.withColumns({p: tidy(p, 1) for p in probs}).orderBy(F.col("median").desc(), "client")


def repeat_histogram(t: Tables, period: Period = HOUR, high: int = 24000, width: int = 1000) -> DataFrame:
    """Sightings per second of the slot: first bin of the message, or later."""
    diff = F.col("propagation_slot_start_diff")
    rows = _messages(t, period, 0, high).select(
        "message_id", (histogram_bin(diff, width) / width).cast("bigint").alias("bin_s")
    )
    return novel_vs_repeat(rows, ["message_id"], "bin_s", "novel_cnt", "rebroadcast_cnt").orderBy("bin_s")


def behind_classes(t: Tables, period: Period = QUARTER_HOUR, seconds: tuple[int, int] = (5, 8)) -> DataFrame:
    """Peers classed by the share of slots in which they were behind, with message volume."""
    slow = _slow_peers(t, period).select(F.col("remote_peer_id_unique_key").alias("peer_id")).distinct()
    rate = (
        _slot_status(t, period, seconds)
        .groupBy("peer_id")
        .agg(percentage(F.sum("is_behind"), F.count("*")).alias("behind_pct"))
        .join(slow, "peer_id", "left_semi")
    )
    volume = _per_peer_volume(_messages(t, period, PEAK[0], TAIL[1]))
    rows = rate.join(volume, "peer_id", "left").withColumn(
        "category", range_label(F.col("behind_pct"), [10, 40, 80], BEHIND_CLASSES)
    )
    out = rows.groupBy("category").agg(
        F.count("*").alias("peer_count"),
        tidy(F.avg("behind_pct"), 1).alias("avg_behind_pct"),
        F.coalesce(F.sum("peak"), F.lit(0)).alias("total_peak_msgs"),
        F.coalesce(F.sum("tail"), F.lit(0)).alias("total_tail_msgs"),
    )
    return out.withColumn("total_msgs", F.col("total_peak_msgs") + F.col("total_tail_msgs")).orderBy(
        position_in(F.col("category"), BEHIND_CLASSES)
    )


def version_volume(t: Tables, period: Period = QUARTER_HOUR, min_messages: int = 1000) -> DataFrame:
    """Message volume per software version; a peer counts under its smallest version text."""
    versions = (
        _slow_peers(t, period)
        .groupBy(F.col("remote_peer_id_unique_key").alias("peer_id"))
        .agg(F.min("remote_agent_version").alias("version"))
    )
    volume = _per_peer_volume(_messages(t, period, PEAK[0], TAIL[1]))
    # One row per peer on both sides, so counting rows counts distinct peers.
    out = versions.join(volume, "peer_id", "left").groupBy("version").agg(
        F.count("*").alias("peer_count"),
        F.coalesce(F.sum("peak"), F.lit(0)).alias("peak_msgs"),
        F.coalesce(F.sum("tail"), F.lit(0)).alias("tail_msgs"),
    )
    total = F.col("peak_msgs") + F.col("tail_msgs")
    out = out.withColumn("total_msgs", total).withColumn("tail_pct", percentage(F.col("tail_msgs"), total, 1))
    return min_sample(out, "total_msgs", min_messages).orderBy(F.col("total_msgs").desc(), "version")
