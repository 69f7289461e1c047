"""Ordered rows in cells of about equal size, cut where the data says.

Rows are laid over range partitions of (keys, order); Spark takes the bounds from a sample
of the rows themselves, so neither outliers nor clusters at any scale put many rows into
one partition.  What a partition holds of a key is a cell: its first and last place and
its sums.  Cells are few (keys plus partitions at most), so the rows before each are a
running sum over them, and a cell that holds a wanted row is opened by its bounds, which
are values: rows find it wherever they lie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.operators.joins import null_safe_join

LOW, HIGH, BEFORE = "_low", "_high", "_before"


def over(groups: Sequence[str], order: str = "", frame: str = "") -> str:
    """Window text over quoted ``groups``."""
    by = f"partition by {', '.join(f'`{c}`' for c in groups)} " if groups else ""
    return f"over ({by}{f'order by {order} ' if order else ''}{frame})"


RUN = 64  # cells looked through at once
UPTO = "rows between unbounded preceding and current row"


def ordered_cells(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], mass: Column, parts: int | None = None, **aggs: Column
) -> DataFrame:
    """(keys, _low, _high, _mass, _before, aggs): the cells of each key and the mass of those before.

    ``order`` must tell the rows of a key apart; ``_low`` and ``_high`` are its first and
    last value in the cell, a struct if it has several columns.
    """
    by = [F.col(f"`{c}`") for c in (*keys, *order)]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    found = place(order)
    cells = (
        ranged.withColumn("_part", F.spark_partition_id())
        .groupBy(*[F.col(f"`{c}`") for c in keys], "_part")
        .agg(F.min(found).alias(LOW), F.max(found).alias(HIGH), mass.alias("_mass"), *[agg.alias(name) for name, agg in aggs.items()])
        .drop("_part")
    )
    earlier = "rows between unbounded preceding and 1 preceding"
    return cells.selectExpr("*", f"coalesce(sum(_mass) {over(keys, LOW, earlier)}, 0) as {BEFORE}")


def place(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in order]) if len(order) > 1 else F.col(f"`{order[0]}`")


def opened(
    rows: DataFrame, facts: DataFrame, keys: Sequence[str], order: Sequence[str], cells: str, also: Column | None = None
) -> DataFrame:
    """The rows that lie in one of the ``cells`` (sorted array of _low, _high, ...) of their key, with that ``_cell`` and the facts.

    ``also`` keeps further rows, without a cell.

    A row looks through runs of cells, then through the cells of one run.
    """
    at = place(order)

    def holds(low: Column, high: Column) -> Column:
        return (at >= low[LOW]) & (at <= high[HIGH])

    number = F.ceil(F.size(cells) / F.lit(RUN)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(number, F.lit(1)) - 1), lambda i: F.slice(cells, i * RUN + 1, RUN))
    facts = facts.withColumn("_runs", F.when(F.size(cells) > 0, runs)).drop(cells)
    run = F.try_element_at(F.filter("_runs", lambda r: holds(F.element_at(r, 1), F.element_at(r, -1))), F.lit(1))
    cell = F.try_element_at(F.filter(run, lambda c: holds(c, c)), F.lit(1))
    kept = F.col("_cell").isNotNull() if also is None else F.col("_cell").isNotNull() | also
    # A left join: only the facts, a row for each key, can ever be the broadcast side.
    return with_facts(rows, facts, keys, "left").withColumn("_cell", cell).where(kept).drop("_runs")


def with_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their key's row of ``facts``; of the only row as a scalar of the plan."""
    if keys:
        return null_safe_join(rows, facts, list(keys), how)
    held = facts.select(F.struct(*facts.columns).alias("_row")).scalar()
    rows = rows.withColumn("_row", held)
    return rows.select(*[c for c in rows.columns if c != "_row"], *[F.col("_row")[c].alias(c) for c in facts.columns])
