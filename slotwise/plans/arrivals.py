"""First sightings of blocks by nodes: wins, ranks, medians, arrival ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import timeparts as tp
from slotwise.functions.labels import range_label, tidy
from slotwise.operators.aggregates import conditional, distinct_count, union_metrics, win_rate, winners
from slotwise.operators.quantiles import COUNT, HIGH, LOW, MEAN, one_pass_quantile, summarize
from slotwise.operators.shares import rank_of_members
from slotwise.sources.scan import Period
from slotwise.sources.tables import SLOT_TIME, Tables

# The followed node, its week, the longest arrival, ranges.
NODE = "utility-mainnet-prysm-geth-tysm-003"
WEEK = Period("2026-01-14", "2026-01-21")
EIGHT_DAYS = Period("2026-01-13", "2026-01-21")
INCIDENT_DAY = Period("2026-01-20", "2026-01-21")
INCIDENT_SLOT = 13505944
LIMIT_MS = 12000
RANGE_EDGES_MS = [500, 1000, 1500, 2000, 2500, 3000]
RANGE_LABELS = ["0-0.5s", "0.5-1s", "1-1.5s", "1.5-2s", "2-2.5s", "2.5-3s", "3s+"]
BLOCK = ["slot", "block_root"]
SEEN = "seen_slot_start_diff"


def sightings(t: Tables, period: Period) -> DataFrame:
    return t.latest("fct_block_first_seen_by_node", period)


def _in_limit(t: Tables, period: Period) -> DataFrame:
    """Sightings up to the limit, with their day."""
    return sightings(t, period).where(F.col(SEEN) <= LIMIT_MS).withColumn("day", tp.day(F.col(SLOT_TIME)))


def _block_stats(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
    out = rows.groupBy(*keys).agg(
        conditional(F.min, F.col(SEEN), F.col("node_id") == node).alias("ours"),
        one_pass_quantile(F.col(SEEN), 0.5).alias("middle"),
        F.min(SEEN).alias("fastest"),
        F.avg(SEEN).alias("mean"),
    )
    return out.where(F.col("ours") > 0)


def win_rate_daily(t: Tables, period: Period = WEEK, node: str = NODE) -> DataFrame:
    won = winners(_in_limit(t, period), ["day", *BLOCK], "node_id", SEEN, "first_node")
    return win_rate(won, ["day"], "first_node", node).orderBy("day")


def win_rate_vs_nodes(t: Tables, period: Period = WEEK, node: str = NODE) -> DataFrame:
    rows = _in_limit(t, period)
    rates = win_rate(winners(rows, ["day", *BLOCK], "node_id", SEEN, "first_node"), ["day"], "first_node", node)
    nodes = distinct_count(rows, ["day"], "node_id", "competing_nodes")
    return rates.join(nodes, "day").orderBy("day")


def delta_daily(t: Tables, period: Period = WEEK, node: str = NODE) -> DataFrame:
    stats = _block_stats(_in_limit(t, period), ["day", *BLOCK], node)
    delta = tidy(F.avg(F.col("ours") - F.col("middle")))
    return stats.groupBy("day").agg(delta.alias("Delta from Median")).orderBy("day")


def timing_daily(t: Tables, period: Period = WEEK, node: str = NODE) -> DataFrame:
    stats = _block_stats(_in_limit(t, period), ["day", *BLOCK], node)
    return (
        stats.groupBy("day")
        .agg(
            tidy(F.avg("ours")).alias("Our Node"),
            tidy(F.avg("middle")).alias("Network Median"),
            tidy(F.avg("fastest")).alias("Network Fastest"),
        )
        .orderBy("day")
    )


def comparison(t: Tables, period: Period = WEEK, node: str = NODE) -> DataFrame:
    """Six named averages over the same blocks, from one pass."""

    def mean(value: Column) -> Column:
        return tidy(F.avg(value))

    ours, middle, fastest = F.col("ours"), F.col("middle"), F.col("fastest")
    metrics = {
        "High-Peer Node Average": mean(ours),
        "Network Fastest": mean(fastest),
        "Network Median": mean(middle),
        "Network Mean": mean(F.col("mean")),
        "Diff vs Median (negative = faster)": mean(ours - middle),
        "Diff vs Fastest": mean(ours - fastest),
    }
    stats = _block_stats(_in_limit(t, period), BLOCK, node)
    return union_metrics(stats, metrics, "metric", "value_ms").orderBy("metric")


def scatter(t: Tables, period: Period = WEEK, node: str = NODE) -> DataFrame:
    stats = _block_stats(_in_limit(t, period), ["slot"], node)
    return stats.select(
        "slot",
        tidy("middle").alias("network_median_ms"),
        F.col("ours").cast("double").alias("our_time_ms"),
        tidy(F.col("ours") - F.col("middle")).alias("diff_ms"),
    ).orderBy("slot")


def _rank_percentiles(t: Tables, period: Period, node: str) -> DataFrame:
    rows = _in_limit(t, period)
    ranked = rank_of_members(rows, ["day", *BLOCK], [SEEN, "node_id"], F.col("node_id") == node)
    behind = (F.col("group_size") - F.col("rank") + 1).cast("double")
    return ranked.withColumn("percentile", behind * 100.0 / F.col("group_size"))


def rank_daily(t: Tables, period: Period = WEEK, node: str = NODE) -> DataFrame:
    probs = {"median_percentile": 0.5, "p25_percentile": 0.25, "p75_percentile": 0.75}
    rows = _rank_percentiles(t, period, node)
    out = summarize(rows, ["day"], "percentile", probs, mean_percentile=MEAN, block_count=COUNT)
    shown = ("median_percentile", "mean_percentile", "p25_percentile", "p75_percentile")
    return out.select("day", *[tidy(c, 1).alias(c) for c in shown], "block_count").orderBy("day")


def rank_quartiles_daily(t: Tables, period: Period = WEEK, node: str = NODE) -> DataFrame:
    """(1 - (rank - 1) / n) * 100, which is the same place written another way."""
    probs = {"P25": 0.25, "Median": 0.5, "P75": 0.75}
    rows = _rank_percentiles(t, period, node).withColumn(
        "percentile", (1 - (F.col("rank") - 1) / F.col("group_size")) * 100
    )
    out = summarize(rows, ["day"], "percentile", probs, Mean=MEAN)
    return out.select("day", *[tidy(c, 1).alias(c) for c in ("P25", "Median", "Mean", "P75")]).orderBy("day")


def slot_by_client(t: Tables, period: Period = INCIDENT_DAY, slot: int | None = INCIDENT_SLOT) -> DataFrame:
    """Arrival per client for one slot; with ``slot=None`` for every slot."""
    rows = sightings(t, period).where(F.col("meta_consensus_implementation") != "")
    rows = rows.withColumnRenamed("meta_consensus_implementation", "cl_client")
    keys = ["cl_client"] if slot is not None else ["slot", "cl_client"]
    if slot is not None:
        rows = rows.where(F.col("slot") == slot)
    out = summarize(
        rows, keys, SEEN, {"p50_arrival_ms": 0.5}, min_arrival_ms=LOW, max_arrival_ms=HIGH, node_count=COUNT
    )
    return out.select(
        *keys, "min_arrival_ms", tidy("p50_arrival_ms").alias("p50_arrival_ms"), "max_arrival_ms", "node_count"
    ).orderBy(*keys[:-1], "p50_arrival_ms", "cl_client")


def by_client(t: Tables, period: Period = EIGHT_DAYS) -> DataFrame:
    rows = sightings(t, period).withColumnRenamed("meta_consensus_implementation", "consensus_client")
    out = summarize(rows, ["consensus_client"], SEEN, {"_p50": 0.5}, sample_count=COUNT)
    return out.select(
        "consensus_client", (F.col("_p50") / 1000.0).alias("median_arrival_seconds"), "sample_count"
    ).orderBy("median_arrival_seconds", "consensus_client")


def percentiles(t: Tables, period: Period = EIGHT_DAYS) -> DataFrame:
    probs = {"p5_seconds": 0.05, "p50_seconds": 0.5, "p95_seconds": 0.95}
    out = summarize(sightings(t, period), [], SEEN, probs, total_blocks=COUNT)
    return out.select(*[(F.col(p) / 1000.0).alias(p) for p in probs], "total_blocks")


def ranges(t: Tables, period: Period = EIGHT_DAYS) -> DataFrame:
    label = range_label(F.col(SEEN), RANGE_EDGES_MS, RANGE_LABELS)
    order = range_label(F.col(SEEN), RANGE_EDGES_MS, list(range(1, len(RANGE_LABELS) + 1)))
    return (
        sightings(t, period)
        .groupBy(label.alias("timing_bucket"), order.alias("bucket_order"))
        .agg(F.count("*").alias("block_count"))
        .orderBy("bucket_order")
    )
