"""Calls of the fixed-address operations: callers, gas, shares, time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.labels import id_bucket, label_lookup, percentage, tidy
from slotwise.operators.aggregates import counts_of_counts
from slotwise.operators.joins import parent_child
from slotwise.operators.quantiles import COUNT, MEAN, TOTAL, summarize
from slotwise.operators.shares import share_in_group, share_of_total, top_k
from slotwise.sources.scan import id_range
from slotwise.sources.tables import Tables

# Operations by address number, block ranges, bucket.
NAMES = {
    1: "ecrecover",
    2: "sha256",
    3: "ripemd160",
    4: "identity",
    5: "modexp",
    6: "ecAdd",
    7: "ecMul",
    8: "ecPairing",
    9: "blake2f",
    10: "point_eval",
    11: "bls12_g1add",
    12: "bls12_g1mul",
    13: "bls12_g1multiexp",
    14: "bls12_g2add",
    15: "bls12_g2mul",
    16: "bls12_g2multiexp",
    17: "bls12_pairing",
    18: "bls12_map_fp_to_g1",
    19: "bls12_map_fp2_to_g2",
}
PAIRING_OPERATIONS = (6, 7, 8)
BLS_OPERATIONS = tuple(range(11, 20))
UNNAMED_IN_SERIES = (3, 9)
RECENT_BLOCKS = (24540000, 24546241)
ALL_BLOCKS = (24120001, 24546241)
BLOCKS_PER_BUCKET = 7200

FRAME_KEY = [
    ("block_number", "block_number"),
    ("transaction_hash", "transaction_hash"),
    ("parent_call_frame_id", "call_frame_id"),
]


def address(number: int) -> str:
    """Address of a fixed operation: its number as 20 bytes of hex."""
    return f"0x{number:040x}"


def names_of(numbers: Sequence[int], prefix: str = "") -> dict[str, str]:
    return {address(n): NAMES[n].removeprefix(prefix) for n in numbers}


def _frames(t: Tables, blocks: tuple[int | None, int | None]) -> DataFrame:
    """Block numbers are part of the key, so the range may cut before the reduction."""
    bounded = Tables({**t, "int_transaction_call_frame": id_range(t["int_transaction_call_frame"], "block_number", *blocks)})
    return bounded.latest("int_transaction_call_frame")


def _calls(t: Tables, blocks, numbers: Sequence[int]) -> DataFrame:
    return _frames(t, blocks).where(F.col("target_address").isin(*[address(n) for n in numbers]))


def callers(
    t: Tables,
    numbers: Sequence[int],
    blocks=RECENT_BLOCKS,
    n: int = 15,
    count: str = "total_calls",
    per_operation: bool = False,
) -> DataFrame:
    """Contracts that call the operations most, with gas figures.

    Calls are summed per parent frame before the parent's address is joined.
    """
    frames = _frames(t, blocks)
    child = frames.where(
        F.col("target_address").isin(*[address(i) for i in numbers])
        & (F.col("opcode_count") == 0)
        & (F.col("gas") > 0)
        & (F.col("depth") > 0)
    ).withColumn("precompile", label_lookup(F.col("target_address"), names_of(numbers), "unknown"))
    per_parent = child.groupBy("block_number", "transaction_hash", "parent_call_frame_id", "precompile").agg(
        F.count("*").alias("_n"), F.sum("gas").alias("_sum"), F.min("gas").alias("_min"), F.max("gas").alias("_max")
    )
    linked = parent_child(per_parent, frames, FRAME_KEY, {"target_address": "calling_contract"})
    keys = ["calling_contract", *(["precompile"] if per_operation else [])]
    out = linked.groupBy(*keys).agg(
        F.sum("_n").alias(count),
        F.sum("_sum").alias("total_gas"),
        tidy(F.try_divide(F.sum("_sum").cast("double"), F.sum("_n")), 0).alias("avg_gas"),
        F.min("_min").alias("min_gas"),
        F.max("_max").alias("max_gas"),
    )
    return top_k(out, [F.col(count).desc(), *[F.col(k) for k in keys]], n)


def gas_values(t: Tables, number: int, blocks=ALL_BLOCKS, n: int = 20) -> DataFrame:
    """Most frequent gas values of one operation; shares refer to all its calls."""
    counted = _calls(t, blocks, [number]).groupBy(F.col("gas").alias("gas_value")).agg(F.count("*").alias("call_count"))
    shared = share_of_total(counted, "call_count", "pct", 4)
    return top_k(shared, [F.col("call_count").desc(), F.col("gas_value")], n)


def gas_values_by_operation(t: Tables, numbers: Sequence[int], blocks=ALL_BLOCKS, prefix: str = "") -> DataFrame:
    name = label_lookup(F.col("target_address"), names_of(numbers, prefix), "unknown")
    counted = (
        _calls(t, blocks, numbers)
        .groupBy(name.alias("precompile"), F.col("gas").alias("gas_value"))
        .agg(F.count("*").alias("call_count"))
    )
    return share_in_group(counted, ["precompile"], "call_count", "pct", 4).select(
        "precompile", "gas_value", "call_count", "pct"
    ).orderBy("precompile", F.col("call_count").desc(), "gas_value")


def calls_per_transaction(t: Tables, number: int = 5, blocks=RECENT_BLOCKS, n: int = 20, per: str = "modexp_count") -> DataFrame:
    counted = counts_of_counts(_calls(t, blocks, [number]), ["transaction_hash"], per, "tx_count")
    shared = share_of_total(counted, "tx_count", "pct", 2)
    return top_k(shared, [F.col("tx_count").desc(), F.col(per)], n)


def ranking(t: Tables, blocks=ALL_BLOCKS) -> DataFrame:
    name = label_lookup(F.col("target_address"), names_of(list(NAMES)))
    rows = _calls(t, blocks, list(NAMES)).withColumn("precompile", name)
    out = summarize(
        rows, ["precompile"], "gas", {"median_gas": 0.5}, call_count=COUNT, total_gas=TOTAL, avg_gas=MEAN
    )
    whole = Window.partitionBy()  # one row for each of the fixed names
    return out.withColumns(
        {
            "avg_gas": tidy("avg_gas", 0),
            "call_pct": percentage(F.col("call_count"), F.sum("call_count").over(whole), 2),
            "gas_pct": percentage(F.col("total_gas"), F.sum("total_gas").over(whole), 2),
        }
    ).orderBy(F.col("call_count").desc(), "precompile")


def time_series(t: Tables, blocks=ALL_BLOCKS, size: int = BLOCKS_PER_BUCKET) -> DataFrame:
    """Calls and gas per block bucket; two operations have no name of their own here."""
    named = names_of([n for n in NAMES if n not in UNNAMED_IN_SERIES])
    return (
        _calls(t, blocks, list(NAMES))
        .groupBy(
            id_bucket(F.col("block_number"), size).alias("block_bucket"),
            label_lookup(F.col("target_address"), named, "other").alias("precompile"),
        )
        .agg(F.count("*").alias("total_calls"), F.sum("gas").alias("total_gas"))
        .orderBy("block_bucket", F.col("total_calls").desc(), "precompile")
    )
