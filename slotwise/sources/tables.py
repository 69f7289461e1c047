"""The event tables the analyses read: time column, key and version.

A user hands in DataFrames by table name.  A column that a table's spec declares must be
there; ``Tables.reduced`` says that keyed tables hold one row per key already.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from slotwise.functions.timeparts import GENESIS, SLOT_SECONDS
from slotwise.sources.scan import Clock, Period, latest_version, scan_window, slot_window

SLOT_TIME = "slot_start_date_time"
EVENT_TIME = "event_date_time"
VERSION = "updated_date_time"


@dataclass(frozen=True)
class TableSpec:
    time: str | None
    keys: tuple[str, ...] = ()
    ties: tuple[str, ...] = ()
    network: bool = False  # rows of several networks
    slot: str | None = None  # slot number by which a table without time is cut


SPECS = {
    # Raw events, read as they are.
    "libp2p_gossipsub_aggregate_and_proof": TableSpec(SLOT_TIME, network=True),
    "libp2p_gossipsub_beacon_block": TableSpec(SLOT_TIME, network=True),
    "libp2p_synthetic_heartbeat": TableSpec(EVENT_TIME, network=True),
    "libp2p_handle_status": TableSpec(EVENT_TIME, network=True),
    "canonical_beacon_block_execution_transaction": TableSpec(SLOT_TIME, network=True),
    "blob_submitter": TableSpec(None, network=True),
    "consensus_engine_api_get_blobs": TableSpec(SLOT_TIME, network=True),
    "execution_engine_get_blobs": TableSpec(EVENT_TIME, network=True),
    "consensus_engine_api_new_payload": TableSpec(None, network=True),
    "execution_engine_new_payload": TableSpec(EVENT_TIME, network=True),
    "beacon_api_eth_v1_events_head": TableSpec(SLOT_TIME, network=True),
    "mev_relay_proposer_payload_delivered": TableSpec(SLOT_TIME, network=True),
    "cpu_utilization": TableSpec("window_start", network=True),
    # Pre-aggregated tables, newest row per key.
    "fct_block": TableSpec(SLOT_TIME, ("slot", "block_root")),
    "fct_block_head": TableSpec(SLOT_TIME, ("slot", "block_root")),
    "fct_block_mev": TableSpec(SLOT_TIME, ("slot", "block_root")),
    "fct_block_first_seen_by_node": TableSpec(
        SLOT_TIME, ("slot", "block_root", "node_id"), ("seen_slot_start_diff",)
    ),
    "fct_block_proposer_entity": TableSpec(SLOT_TIME, ("slot",)),
    "fct_block_blob_count_head": TableSpec(None, ("slot",), slot="slot"),
    "fct_attestation_correctness_head": TableSpec(SLOT_TIME, ("slot",)),
    "fct_attestation_correctness_canonical": TableSpec(SLOT_TIME),
    "fct_attestation_correctness_by_validator_head": TableSpec(
        SLOT_TIME, ("slot", "attesting_validator_index"), ("slot_distance",)
    ),
    "dim_node": TableSpec(None),
    "fct_attestation_participation_rate_daily": TableSpec("day_start_date"),
    "fct_reorg_daily": TableSpec("day_start_date"),
    "fct_engine_new_payload_by_el_client": TableSpec(SLOT_TIME, ("slot", "meta_execution_implementation")),
    "int_transaction_call_frame": TableSpec(
        None, ("block_number", "transaction_hash", "call_frame_id"), ("gas", "target_address")
    ),
}


# Start of the first slot of a network.
CLOCKS = {"mainnet": Clock(GENESIS, SLOT_SECONDS)}


class Tables(dict):
    """DataFrames by table name, with the two ways the analyses read them.

    A network with a known clock lets a period cut tables that have slots but no time;
    others are read whole.
    """

    clocks = CLOCKS
    network = "mainnet"
    reduced = False
    source = ""  # what the tables were made from, for fingerprints of results

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, names: Sequence[str] = tuple(SPECS)) -> Tables:
        tables = cls({name: spark.read.parquet(f"{root.rstrip('/')}/{name}") for name in names})
        tables.source = root.rstrip("/")
        return tables

    def window(self, name: str, period: Period | None = None, time: str | None = None) -> DataFrame:
        network = self.network if SPECS[name].network else None
        return scan_window(self[name], time or SPECS[name].time, period, network)

    def latest(self, name: str, period: Period | None = None) -> DataFrame:
        """Newest row per key in the period.

        The period cuts whole keys, by time or by slot, so it may run before the
        reduction; every other filter belongs after it.
        """
        spec, clock = SPECS[name], self.clocks.get(self.network)
        df = self[name] if spec.time is None else self.window(name, period)
        if spec.time is None and spec.slot and period and clock:
            df = slot_window(df, spec.slot, period, clock)
        if self.reduced or not spec.keys:
            return df
        if VERSION not in df.columns:
            raise ValueError(f"{name} has no column {VERSION}; set reduced if it holds one row per key")
        return latest_version(df, spec.keys, VERSION, spec.ties)
