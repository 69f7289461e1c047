"""Array elements equal to a sentinel value, by day, sender and entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import arrays
from slotwise.functions import timeparts as tp
from slotwise.functions.labels import normalise_key, percentage
from slotwise.operators.joins import attach_names
from slotwise.operators.shares import top_k
from slotwise.sources.scan import Period
from slotwise.sources.tables import SLOT_TIME, Tables

# Fixed value: hash of the commitment to an empty blob.
EMPTY_BLOB_HASH = "0x010657f37554c781402a22917dee2f75def7ab966d7b770905398eba3c444014"
WEEK = Period("2026-01-16 00:00:00", "2026-01-23 00:00:00")


def _transactions(t: Tables, period: Period) -> DataFrame:
    rows = t.window("canonical_beacon_block_execution_transaction", period)
    return rows.where(arrays.length(F.col("blob_hashes")) > 0)


def _with_sentinel(t: Tables, period: Period, sentinel: str) -> DataFrame:
    hashes = F.col("blob_hashes")
    return (
        _transactions(t, period)
        .where(arrays.contains(hashes, sentinel))
        .withColumn("_empty", arrays.count_matching(hashes, sentinel))
    )


def name_senders(t: Tables, df: DataFrame, sender: str, out: str) -> DataFrame:
    names = t.window("blob_submitter")
    return attach_names(df, names, F.lower(F.col(sender)), normalise_key(F.col("address")), "name", out, "Unknown")


def _per_sender(t: Tables, period: Period, sentinel: str, *more: str) -> DataFrame:
    rows = _with_sentinel(t, period, sentinel)
    return rows.groupBy(F.col("from").alias("address"), *more).agg(
        F.count("*").alias("_txs"), F.sum("_empty").alias("_empties")
    )


def by_entity(t: Tables, period: Period = WEEK, sentinel: str = EMPTY_BLOB_HASH) -> DataFrame:
    named = name_senders(t, _per_sender(t, period, sentinel), "address", "entity")
    return (
        named.groupBy("entity")
        .agg(
            F.sum("_txs").alias("total_txs"),
            F.sum("_empties").alias("empty_blobs"),
            F.count("*").alias("num_addresses"),
        )
        .orderBy(F.col("empty_blobs").desc(), "entity")
    )


def daily(t: Tables, period: Period = WEEK, sentinel: str = EMPTY_BLOB_HASH) -> DataFrame:
    hashes = F.col("blob_hashes")
    out = _transactions(t, period).groupBy(tp.day(F.col(SLOT_TIME)).alias("day")).agg(
        F.sum(arrays.length(hashes)).alias("Total Blobs"),
        F.sum(arrays.count_matching(hashes, sentinel)).alias("Empty Blobs"),
    )
    return out.withColumn("Empty Blob %", percentage(F.col("Empty Blobs"), F.col("Total Blobs"), 2)).orderBy("day")


def daily_by_entity(t: Tables, period: Period = WEEK, sentinel: str = EMPTY_BLOB_HASH) -> DataFrame:
    rows = _with_sentinel(t, period, sentinel).withColumn("day", tp.day(F.col(SLOT_TIME)))
    sums = rows.groupBy("day", F.col("from").alias("address")).agg(F.sum("_empty").alias("_empties"))
    named = name_senders(t, sums, "address", "entity")
    return named.groupBy("day", "entity").agg(F.sum("_empties").alias("empty_blobs")).orderBy("day", "entity")


def top_senders(t: Tables, period: Period = WEEK, sentinel: str = EMPTY_BLOB_HASH, n: int = 15) -> DataFrame:
    named = name_senders(t, _per_sender(t, period, sentinel), "address", "entity")
    sums = named.groupBy("address", "entity").agg(
        F.sum("_txs").alias("total_txs"), F.sum("_empties").alias("empty_blobs")
    )
    return top_k(sums, [F.col("empty_blobs").desc(), F.col("address"), F.col("entity")], n)
