"""Distinct peers per hour, client and address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import timeparts as tp
from slotwise.operators.aggregates import distinct_count
from slotwise.sources.scan import Period
from slotwise.sources.tables import EVENT_TIME, Tables

WEEK = Period("2026-01-16 00:00:00", "2026-01-23 00:00:00")
PEER = "remote_peer_id_unique_key"


def _beats(t: Tables, period: Period) -> DataFrame:
    rows = t.window("libp2p_synthetic_heartbeat", period).where(F.col("remote_ip").isNotNull())
    return rows.withColumn("_hour", tp.hour(F.col(EVENT_TIME)))


def hourly_by_client(t: Tables, period: Period = WEEK) -> DataFrame:
    rows = _beats(t, period).where(F.col("remote_agent_implementation") != "")
    rows = rows.withColumnRenamed("remote_agent_implementation", "client")
    counts = distinct_count(rows, ["_hour", "client"], PEER, "nodes").orderBy("_hour", "client")
    return counts.select(tp.hour_label(F.col("_hour")).alias("hour"), "client", "nodes")


def hourly(t: Tables, period: Period = WEEK) -> DataFrame:
    counts = distinct_count(_beats(t, period), ["_hour"], PEER, "Distinct Nodes").orderBy("_hour")
    return counts.select(tp.hour_label(F.col("_hour")).alias("hour"), "Distinct Nodes")


def per_address(t: Tables, period: Period = WEEK) -> DataFrame:
    """Addresses by the largest number of peers seen on them in one hour."""
    hourly_peers = distinct_count(_beats(t, period), ["remote_ip", "_hour"], PEER, "_peers")
    largest = hourly_peers.groupBy("remote_ip").agg(F.max("_peers").alias("Peer IDs"))
    return largest.groupBy("Peer IDs").agg(F.count("*").alias("IP Count")).orderBy("Peer IDs")
