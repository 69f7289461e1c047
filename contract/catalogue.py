"""The 97 catalogue analyses over the derived tables, whole tables throughout.

The published periods, slots and nodes are replaced by ones of the derived
tables; analyses of one slot run for every slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.derived import DerivedTables
from slotwise.functions.labels import clamped_utilization
from slotwise.plans import catalogue, cpu
from slotwise.sources.scan import Period

NODE = "node-3"
ALL_BLOCKS = (None, None)
DAY_A, DAY_B = "2020-12-01", "2020-12-02"

# Parameters that differ from the published ones, by catalogue number.
PARAMS: dict[int, dict] = {n: {"period": Period()} for n in catalogue.CATALOGUE}
PARAMS[16] = {}
for _n in (51, 52, 53, 54, 55, 56, 57, 58):
    PARAMS[_n]["node"] = NODE
for _n in (59, 60, 61, 62, 63, 64):
    PARAMS[_n]["lookback"] = Period()
for _n in range(65, 82):
    PARAMS[_n] = {"blocks": ALL_BLOCKS}
PARAMS[8]["min_messages"] = 10
PARAMS[5]["min_messages"] = 20
PARAMS[30] |= {"before": DAY_A, "after": DAY_B}
for _n in (31, 32, 33):
    PARAMS[_n]["source"] = "PROXY"
PARAMS[37]["min_blobs"] = 20
PARAMS[44]["min_slots"] = 100
for _n in (82, 84, 85):
    PARAMS[_n]["slot"] = None
PARAMS[83]["slots"] = None
PARAMS[97]["above"] = 0.5
for _n in (42, 43):
    PARAMS[_n]["min_observations"] = 100


def _reference_against_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal figures next to the average measured in the CPU table."""
    samples = DerivedTables(spark, sf_dir)["cpu_utilization"]
    cores = clamped_utilization(F.col("total_on_cpu_ns"), F.col("interval_ms"), F.col("system_cores"))
    measured = samples.groupBy(F.col("client_type").alias("el_client")).agg(
        F.round(F.avg(cores), 3).alias("measured_avg_cores")
    )
    return cpu.reference_figures(spark).join(measured, "el_client", "left")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for number, (name, _) in catalogue.CATALOGUE.items():

        def build(spark: SparkSession, sf_dir: str, name=name, params=PARAMS[number]) -> DataFrame:
            return catalogue.run(name, DerivedTables(spark, sf_dir), spark, **params)

        out[name] = build
    out["cpu_reference_figures"] = _reference_against_measured
    return out
