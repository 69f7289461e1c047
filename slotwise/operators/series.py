"""Ordered series per key: a prefix scan over cells of about equal size.

Rows are cut into cells by their own places (``operators/cells.py``), so a key that holds
most rows, even all in one second, spreads over tasks.  A first pass sums up each cell, a
running value over the few cells is the carry, and a second pass works inside cells only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from slotwise.operators.cells import BEFORE, HIGH, LOW, opened, ordered_cells, over
from slotwise.operators.joins import null_safe_join


def _in_cells(df: DataFrame, keys: list[str], order: list[str], cells: DataFrame, *carries: str) -> tuple[DataFrame, WindowSpec]:
    """``df`` with its cell's carries in ``_cell``, and the window inside a cell."""
    of_key = cells.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.expr(f"array_sort(collect_list(struct({', '.join((LOW, HIGH, *carries))}))) as _cells")
    )
    rows = opened(df, of_key, keys, order, "_cells").withColumn("_start", F.col("_cell")[LOW])
    return rows, Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_start").orderBy(*order)


def running_total(
    df: DataFrame, keys: Sequence[str], position: str, value: str, out: str, ties: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Cumulative sum along ``position`` and ``ties``, which must tell the rows of a key apart.

    ``parts`` fixes the number of range partitions.
    """
    keys, order = list(keys), [position, *ties]
    cells = ordered_cells(df, keys, order, F.coalesce(F.sum(value), F.lit(0)), parts)
    rows, inside = _in_cells(df, keys, order, cells, BEFORE)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(value).over(upto) + F.col("_cell")[BEFORE]).drop("_cell", "_start")


def previous_value(
    df: DataFrame, keys: Sequence[str], position: str, value: str, out: str, ties: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """The value of the row before along ``position`` and ``ties``; NULL for a key's first row."""
    keys, order = list(keys), [position, *ties]
    last = F.max(F.struct(F.struct(*order).alias("at"), F.col(value).alias("value"))).getField("value")
    cells = ordered_cells(df, keys, order, F.count("*"), parts, _tail=last)
    cells = cells.selectExpr("*", f"lag(_tail) {over(keys, LOW)} as _carry")
    rows, inside = _in_cells(df, keys, order, cells, "_carry")
    first = F.row_number().over(inside) == 1
    rows = rows.withColumns({"_lag": F.lag(value).over(inside), "_first": first})
    return rows.withColumn(out, F.when(F.col("_first"), F.col("_cell")["_carry"]).otherwise(F.col("_lag"))).drop(
        "_cell", "_start", "_lag", "_first"
    )


def counter_rate(
    df: DataFrame,
    keys: Sequence[str],
    seconds: str,
    counter: str,
    window: int,
    step: int,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Per-second rate of a rising counter over the last ``window`` seconds, at
    every multiple of ``step`` from a key's first reading to its last.

    A fall of the counter is a restart: the new reading is the increase.  Where
    nothing rose in the window the rate is 0.
    """
    keys = list(keys)
    prior = previous_value(df, keys, seconds, counter, "_prior", ties)
    gain = F.when(F.col(counter) >= F.col("_prior"), F.col(counter) - F.col("_prior")).otherwise(F.col(counter))

    def step_from(position: Column) -> Column:
        return (F.ceil(position / F.lit(step)) * F.lit(step)).cast("bigint")

    def steps(low: str, high: str) -> Column:
        return F.explode(F.sequence(low, high, F.lit(step).cast("bigint")))

    # An increase at t counts at the steps g with t <= g < t + window.
    gains = (
        prior.where(F.col("_prior").isNotNull())
        .groupBy(
            *keys,
            step_from(F.col(seconds)).alias("_low"),
            (step_from(F.col(seconds) + F.lit(window)) - F.lit(step)).alias("_high"),
        )
        .agg(F.sum(gain).alias("_gain"))
        .where(F.col("_high") >= F.col("_low"))
        .select(*keys, "_gain", steps("_low", "_high").alias("step_at"))
        .groupBy(*keys, "step_at")
        .agg(F.sum("_gain").alias("_gain"))
    )
    axis = (
        df.groupBy(*keys)
        .agg(step_from(F.min(seconds)).alias("_low"), (F.floor(F.max(seconds) / F.lit(step)) * step).cast("bigint").alias("_high"))
        .where(F.col("_high") >= F.col("_low"))
        .select(*keys, steps("_low", "_high").alias("step_at"))
    )
    rate = F.coalesce(F.col("_gain") / F.lit(float(window)), F.lit(0.0))
    return null_safe_join(axis, gains, [*keys, "step_at"], "left").select(*keys, "step_at", rate.alias("rate"))
