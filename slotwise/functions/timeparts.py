"""Slot arithmetic and calendar buckets.

Timestamps without zone are read as UTC; the session zone is UTC (``session``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the network: genesis second, slot length, slots per epoch.
GENESIS = 1606824023
SLOT_SECONDS = 12
SLOTS_PER_EPOCH = 32


def _instant(ts: Column) -> Column:
    return ts.cast("timestamp")


def _div(a: Column, b: int) -> Column:
    # Both sides are whole numbers, so cutting the fraction is exact.
    return ((a - a % F.lit(b)) / F.lit(b)).cast("bigint")


def day(ts: Column) -> Column:
    return F.to_date(ts)


def hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd HH':00'")


def week(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", ts))


def month(ts: Column) -> Column:
    return F.to_date(F.date_trunc("month", ts))


def millis(ts: Column) -> Column:
    return F.unix_millis(_instant(ts))


def micros(ts: Column) -> Column:
    return F.unix_micros(_instant(ts))


def seconds(ts: Column) -> Column:
    return F.unix_seconds(_instant(ts))


def slot_number(ts: Column, genesis: int = GENESIS, length: int = SLOT_SECONDS) -> Column:
    return _div(seconds(ts) - F.lit(genesis), length)


def seconds_into_slot(ts: Column, genesis: int = GENESIS, length: int = SLOT_SECONDS) -> Column:
    return (seconds(ts) - F.lit(genesis)) % F.lit(length)


def cycle_position(number: Column, length: int = SLOTS_PER_EPOCH) -> Column:
    return number % F.lit(length)


def cycle_label(number: Column, length: int = SLOTS_PER_EPOCH) -> Column:
    place = cycle_position(number, length)
    return (
        F.when(place == 0, "epoch_start").when(place == length - 1, "epoch_end").otherwise("mid_epoch")
    )


def sub_window(at: Column, start: Column, width_ms: int) -> Column:
    """Index of the ``width_ms`` window that ``at`` falls in, counted from ``start``."""
    return ((millis(at) - millis(start)) / F.lit(width_ms)).cast("int")
