"""CPU use of clients: summaries, hours, place in the epoch and in the slot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import timeparts as tp
from slotwise.functions.labels import clamped_utilization, tidy
from slotwise.operators.quantiles import HIGH, MEAN, summarize
from slotwise.sources.scan import Period, inline_rows
from slotwise.sources.tables import Tables

# The measured week, clients and nodes.
WEEK = Period("2026-03-10", "2026-03-17")
CONSENSUS_CLIENTS = ("lighthouse", "prysm", "lodestar", "nimbus")
CONSENSUS_NODES = (
    "utility-mainnet-lighthouse-geth-001",
    "utility-mainnet-prysm-geth-tysm-001",
    "utility-mainnet-lodestar-nethermind-001",
    "utility-mainnet-nimbus-besu-001",
)
EXECUTION_CLIENTS = ("geth",)
EXECUTION_NODES = CONSENSUS_NODES[:2]
# Cores of the reference machines, 24 h average and 95th percentile.
REFERENCE_FIGURES = [
    ("geth", 0.89, 1.03, 0.25, 0.33, 1.14),
    ("besu", 0.60, 0.68, 0.31, 0.39, 0.91),
    ("nethermind", 0.58, 0.67, 0.19, 0.27, 0.77),
    ("reth", 0.56, 0.64, 0.48, 0.74, 1.04),
    ("ethrex", 0.58, 0.66, 0.27, 0.31, 0.85),
    ("erigon", 0.49, 0.63, 0.15, 0.25, 0.64),
]
REFERENCE_SCHEMA = (
    "el_client string, cl_avg_cores double, cl_p95_cores double, "
    "el_avg_cores double, el_p95_cores double, total_avg_cores double"
)
SUB_WINDOW_MS = 200
LAST_SUB_WINDOW = 59


def reference_figures(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, REFERENCE_FIGURES, REFERENCE_SCHEMA).orderBy(F.col("total_avg_cores").desc())


def _samples(t: Tables, period: Period, clients: Sequence[str] | None, nodes: Sequence[str] | None) -> DataFrame:
    rows = t.window("cpu_utilization", period)
    if clients is not None:
        rows = rows.where(F.col("client_type").isin(*clients))
    if nodes is not None:
        rows = rows.where(F.col("meta_client_name").isin(*nodes))
    return rows.withColumn(
        "cores", clamped_utilization(F.col("total_on_cpu_ns"), F.col("interval_ms"), F.col("system_cores"))
    )


def _average(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(tidy(F.avg("cores"), 3).alias("avg_cores")).orderBy(*keys)


def by_cycle_position(t: Tables, period=WEEK, clients=CONSENSUS_CLIENTS, nodes=CONSENSUS_NODES) -> DataFrame:
    rows = _samples(t, period, clients, nodes)
    rows = rows.withColumn("slot_in_epoch", tp.cycle_position(F.col("wallclock_slot")))
    return _average(rows, ["client_type", "slot_in_epoch"])


def hourly(t: Tables, period=WEEK, clients=CONSENSUS_CLIENTS, nodes=CONSENSUS_NODES) -> DataFrame:
    rows = _samples(t, period, clients, nodes).withColumn("hour", tp.hour(F.col("window_start")))
    return _average(rows, ["hour", "client_type"])


def intra_slot(
    t: Tables, period=WEEK, clients=CONSENSUS_CLIENTS, nodes=CONSENSUS_NODES, per_node: bool = False
) -> DataFrame:
    """Average per sub-window of the slot; the range filter runs before grouping."""
    rows = _samples(t, period, clients, nodes).withColumns(
        {
            "epoch_position": tp.cycle_label(F.col("wallclock_slot")),
            "window_in_slot": tp.sub_window(
                F.col("window_start"), F.col("wallclock_slot_start_date_time"), SUB_WINDOW_MS
            ),
        }
    )
    keys = ["client_type", *(["meta_client_name"] if per_node else []), "epoch_position", "window_in_slot"]
    return _average(rows.where(F.col("window_in_slot").between(0, LAST_SUB_WINDOW)), keys)


def summary(
    t: Tables,
    period=WEEK,
    clients=CONSENSUS_CLIENTS,
    nodes=CONSENSUS_NODES,
    per_node: bool = False,
    with_p99: bool = True,
) -> DataFrame:
    keys = ["client_type", *(["meta_client_name"] if per_node else [])]
    probs = {"p50_cores": 0.5, "p95_cores": 0.95, **({"p99_cores": 0.99} if with_p99 else {})}
    rows = _samples(t, period, clients, nodes)
    out = summarize(rows, keys, "cores", probs, avg_cores=MEAN, peak_cores=HIGH)
    names = ["avg_cores", *probs, "peak_cores"]
    out = out.select(*keys, *[tidy(c, 2).alias(c) for c in names])
    first = F.col("avg_cores").desc() if per_node else F.col("avg_cores")
    return out.orderBy(first, *keys)
