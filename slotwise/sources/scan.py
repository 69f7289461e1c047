"""Reading event tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """Half-open time range ``start <= t < end``; an open side is None."""

    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class Clock:
    """Slots of a fixed length, counted from a start in Unix seconds."""

    start: int
    length: int

    def slots(self, period: Period) -> tuple[int | None, int | None]:
        """The slots that begin in a period: first, and first beyond it; an open side is None."""
        return self._first(period.start), self._first(period.end)

    def _first(self, at: str | None) -> int | None:
        if at is None:
            return None
        moment = datetime.fromisoformat(at)
        moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
        return max(-int((self.start - Fraction(moment.timestamp())) // self.length), 0)


def slot_window(df: DataFrame, slot_col: str, period: Period, clock: Clock) -> DataFrame:
    """A period cut by slot numbers, for tables without a time column.

    Plain comparisons with literals, as in ``scan_window``.
    """
    first, beyond = clock.slots(period)
    if first is not None:
        df = df.where(F.col(slot_col) >= first)
    if beyond is not None:
        df = df.where(F.col(slot_col) < beyond)
    return df


def scan_window(
    df: DataFrame,
    time_col: str,
    period: Period | None = None,
    network: str | None = None,
    network_col: str = "meta_network_name",
) -> DataFrame:
    """Keep one network and one half-open period.

    Plain comparisons with literals, so they reach the parquet scan and prune
    date partitions.
    """
    if network is not None:
        if network_col not in df.columns:
            raise ValueError(f"no column {network_col} to keep network {network!r} by")
        df = df.where(F.col(network_col) == network)
    if period is None:
        return df
    kind = df.schema[time_col].dataType.simpleString()
    at = F.col(time_col)
    if period.start is not None:
        df = df.where(at >= F.lit(period.start).cast(kind))
    if period.end is not None:
        df = df.where(at < F.lit(period.end).cast(kind))
    return df


def id_range(df: DataFrame, id_col: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Keep ``low <= id <= high``; both ends belong to the range."""
    if low is not None:
        df = df.where(F.col(id_col) >= low)
    if high is not None:
        df = df.where(F.col(id_col) <= high)
    return df


def latest_version(
    df: DataFrame, keys: Sequence[str], version: str, ties: Sequence[str] = ()
) -> DataFrame:
    """Newest row per key.

    ``row_number() = 1`` lets Spark put a group limit in front of the shuffle,
    so at most one row per key and input task travels: a hot key costs nothing.
    """
    newest_first = [F.col(c).desc_nulls_last() for c in (version, *ties)]
    window = Window.partitionBy(*keys).orderBy(*newest_first)
    return (
        df.withColumn("_version_rank", F.row_number().over(window))
        .where(F.col("_version_rank") == 1)
        .drop("_version_rank")
    )


def snapshot_scan(spark: SparkSession, path: str) -> DataFrame:
    """Point-in-time parquet file or folder."""
    return spark.read.parquet(path)


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal table of a few fixed rows."""
    return spark.createDataFrame(list(rows), schema)
