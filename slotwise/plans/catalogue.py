"""The 97 catalogue analyses by name, with the fixed parameters they were published with.

"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from slotwise.plans import (
    arrivals,
    block_size,
    call_frames,
    cpu,
    gossip,
    observers,
    outcomes,
    parents,
    peers,
    scores,
    sentinels,
    votes,
)
from slotwise.sources.tables import Tables

Analysis = Callable[..., DataFrame]


def _callers(number: int, count: str = "total_calls") -> Analysis:
    return partial(call_frames.callers, numbers=[number], count=count)


def _gas(number: int) -> Analysis:
    return partial(call_frames.gas_values, number=number)


# number: (name, analysis)
CATALOGUE: dict[int, tuple[str, Analysis]] = {
    1: ("gossip_tail_vs_next_block", gossip.tail_vs_next_block),
    2: ("gossip_client_breakdown", gossip.client_breakdown),
    3: ("gossip_arrival_histogram", gossip.arrival_histogram),
    4: ("gossip_behind_state_behaviour", gossip.behind_state_behaviour),
    5: ("gossip_peer_tail_box", gossip.peer_tail_box),
    6: ("gossip_repeat_histogram", gossip.repeat_histogram),
    7: ("gossip_behind_classes", gossip.behind_classes),
    8: ("gossip_version_volume", gossip.version_volume),
    9: ("sentinel_by_entity", sentinels.by_entity),
    10: ("sentinel_daily", sentinels.daily),
    11: ("sentinel_daily_by_entity", sentinels.daily_by_entity),
    12: ("sentinel_top_senders", sentinels.top_senders),
    13: ("peers_hourly_by_client", peers.hourly_by_client),
    14: ("peers_hourly", peers.hourly),
    15: ("peers_per_address", peers.per_address),
    16: ("cpu_reference_figures", cpu.reference_figures),
    17: ("cpu_by_cycle_position", cpu.by_cycle_position),
    18: ("cpu_hourly", cpu.hourly),
    19: ("cpu_intra_slot", cpu.intra_slot),
    20: ("cpu_summary", cpu.summary),
    21: (
        "cpu_intra_slot_by_node",
        partial(cpu.intra_slot, clients=cpu.EXECUTION_CLIENTS, nodes=cpu.EXECUTION_NODES, per_node=True),
    ),
    22: (
        "cpu_summary_by_node",
        partial(
            cpu.summary,
            clients=cpu.EXECUTION_CLIENTS,
            nodes=cpu.EXECUTION_NODES[:1],
            per_node=True,
            with_p99=False,
        ),
    ),
    23: ("outcome_timing_by_client", outcomes.timing_by_client),
    24: ("outcome_rate_hourly", outcomes.rate_hourly),
    25: ("outcome_by_source", outcomes.by_source),
    26: ("outcome_timing", outcomes.timing),
    27: ("outcome_shares", outcomes.shares),
    28: ("outcome_timing_by_size", outcomes.timing_by_size),
    29: ("outcome_timing_ranges", outcomes.timing_ranges),
    30: ("observer_day_comparison", observers.day_comparison),
    31: ("observer_difference_by_client", observers.difference_by_client),
    32: ("observer_difference_hourly", observers.difference_hourly),
    33: ("observer_difference_ranges", observers.difference_ranges),
    34: ("observer_difference_by_size", observers.difference_by_size),
    35: ("observer_difference_per_element", observers.difference_per_element),
    36: ("element_rate_by_submitter", outcomes.rate_by_submitter),
    37: ("element_summary_by_submitter", outcomes.summary_by_submitter),
    38: ("element_totals", outcomes.element_totals),
    39: ("element_private_senders", outcomes.private_senders),
    40: ("dispersion_by_size_and_source", block_size.dispersion_by_size_and_source),
    41: ("size_headline_by_source", block_size.headline_by_source),
    42: ("arrival_by_size", block_size.arrival_by_size),
    43: ("dispersion_by_size", block_size.dispersion_by_size),
    44: ("vote_thresholds_daily", votes.thresholds_daily),
    45: ("participation_daily", votes.participation_daily),
    46: ("reorgs_daily", votes.reorgs_daily),
    47: ("attester_accuracy_by_blobs", votes.attester_accuracy_by_blobs),
    48: ("attester_accuracy", votes.attester_accuracy),
    49: ("proposer_votes_by_blobs", votes.proposer_votes_by_blobs),
    50: ("proposer_votes", votes.proposer_votes),
    51: ("arrival_delta_daily", arrivals.delta_daily),
    52: ("arrival_rank_daily", arrivals.rank_daily),
    53: ("arrival_rank_quartiles_daily", arrivals.rank_quartiles_daily),
    54: ("arrival_comparison", arrivals.comparison),
    55: ("arrival_timing_daily", arrivals.timing_daily),
    56: ("arrival_scatter", arrivals.scatter),
    57: ("arrival_win_rate_daily", arrivals.win_rate_daily),
    58: ("arrival_win_rate_vs_nodes", arrivals.win_rate_vs_nodes),
    59: ("stale_parents_daily", parents.daily),
    60: ("parent_distances", parents.distances),
    61: ("parent_distances_by_group", parents.distances_by_group),
    62: ("stale_parents_by_group", parents.by_group),
    63: ("stale_parents_top_entities", parents.top_entities),
    64: ("stale_parents_weekly_by_group", parents.weekly_by_group),
    65: ("callers_blake2f", _callers(9, "blake2f_calls")),
    66: ("gas_values_blake2f", _gas(9)),
    67: (
        "gas_values_bls12",
        partial(call_frames.gas_values_by_operation, numbers=call_frames.BLS_OPERATIONS, prefix="bls12_"),
    ),
    68: (
        "callers_bn128",
        partial(call_frames.callers, numbers=call_frames.PAIRING_OPERATIONS, n=20, per_operation=True),
    ),
    69: ("gas_values_bn128", partial(call_frames.gas_values_by_operation, numbers=call_frames.PAIRING_OPERATIONS)),
    70: ("callers_ecrecover", _callers(1)),
    71: ("gas_values_ecrecover", _gas(1)),
    72: ("callers_identity", _callers(4)),
    73: ("gas_values_identity", _gas(4)),
    74: ("callers_modexp", _callers(5, "modexp_calls")),
    75: ("gas_values_modexp", _gas(5)),
    76: ("modexp_calls_per_transaction", call_frames.calls_per_transaction),
    77: ("callers_point_eval", _callers(10, "point_eval_calls")),
    78: ("operation_ranking", call_frames.ranking),
    79: ("callers_sha256", _callers(2)),
    80: ("gas_values_sha256", _gas(2)),
    81: ("operation_time_series", call_frames.time_series),
    82: ("slot_arrival_by_client", arrivals.slot_by_client),
    83: ("slot_vote_accuracy", votes.slot_accuracy),
    84: ("slot_voters_by_entity", votes.slot_voters),
    85: ("slot_payload_by_client", votes.slot_payload_by_client),
    86: ("arrival_by_client", arrivals.by_client),
    87: ("arrival_percentiles", arrivals.percentiles),
    88: ("score_classes", scores.classes),
    89: ("score_entities", scores.entities),
    90: ("score_vote_impact", scores.vote_impact),
    91: ("late_blocks_by_entity", scores.late_by_entity),
    92: ("late_blocks_recent", scores.late_recent),
    93: ("score_ranges", scores.score_ranges),
    94: ("score_chart", scores.chart),
    95: ("arrival_ranges", arrivals.ranges),
    96: ("score_lowest", scores.lowest),
    97: ("score_highest", scores.highest),
}
BY_NAME: dict[str, Analysis] = dict(CATALOGUE.values())


def run(name: str, t: Tables, spark: SparkSession | None = None, **params) -> DataFrame:
    """One catalogue analysis; ``params`` replace the published parameters."""
    if name == "cpu_reference_figures":
        return cpu.reference_figures(spark or SparkSession.active())
    return BY_NAME[name](t, **params)
