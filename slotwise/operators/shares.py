"""Shares, ranks and top lists over aggregated rows.

Totals are joined or read as a scalar, never taken over a window without
partition, which would move every row to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.labels import percentage
from slotwise.operators.cells import BEFORE, HIGH, LOW, opened, ordered_cells, over, with_facts
from slotwise.operators.joins import null_safe_join
from slotwise.operators.scalars import one_row


def share_of_total(df: DataFrame, measure: str, out: str, digits: int | None = None) -> DataFrame:
    total = one_row(df, total=F.sum(measure))
    return df.withColumn(out, percentage(F.col(measure), total.getField("total"), digits))


def share_in_group(
    df: DataFrame, keys: Sequence[str], measure: str, out: str, digits: int | None = None
) -> DataFrame:
    if not keys:
        return share_of_total(df, measure, out, digits)
    totals = df.groupBy(*keys).agg(F.sum(measure).alias("_total"))
    joined = null_safe_join(df, totals, list(keys))
    return joined.withColumn(out, percentage(F.col(measure), F.col("_total"), digits)).drop("_total")


def rank_of_members(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], member: Column
) -> DataFrame:
    """``row_number`` and group size for a member with one row per group.

    The rank is one more than the number of rows that sort before the member
    row, so it comes from a join with that row and a count; the group itself is
    never sorted in one task.  ``order`` must be unique in a group.  For members
    with many rows per group see ``ranks_in_cells``.
    """
    keys, place = list(keys), F.struct(*order)
    one = F.when(F.min(place) == F.max(place), F.min(place))
    several = F.raise_error(F.lit("a group has several rows of the member; use ranks_in_cells"))
    ours = df.where(member).groupBy(*keys).agg(F.when(F.count("*") > 0, F.coalesce(one, several)).alias("_ours"))
    return (
        with_facts(df.select(*keys, place.alias("_place")), ours, keys)
        .where(F.col("_ours").isNotNull())
        .groupBy(*keys, "_ours")
        .agg(
            (F.count_if(F.col("_place") < F.col("_ours")) + 1).alias("rank"),
            F.count("*").alias("group_size"),
        )
        .select(*keys, "_ours.*", "rank", "group_size")
    )


def ranks_in_cells(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], member: Column, parts: int | None = None
) -> DataFrame:
    """``row_number`` and group size of the member rows, for any number of them.

    ``order`` must be unique in a group.  Rows are laid over range partitions of keys and
    all order columns, so a first column with one frequent value is cut by the others;
    cells with a member row are sorted, each on its own, and start at the number of rows
    in the cells before.  ``parts`` fixes the number of range partitions.
    """
    keys = list(keys)
    rows = df.select(*keys, *order, member.alias("_member"))
    cells = ordered_cells(rows, keys, order, F.count("*"), parts, _any=F.bool_or("_member"))
    cells = cells.selectExpr("*", f"sum(_mass) {over(keys)} as group_size")
    facts = cells.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.expr(f"array_sort(collect_list(case when _any then struct({LOW}, {HIGH}, {BEFORE}) end)) as _open"),
        F.max("group_size").alias("group_size"),
    )
    found = opened(rows, facts, keys, order, "_open").withColumns({"_start": F.col("_cell")[LOW], "_from": F.col("_cell")[BEFORE]})
    inside = Window.partitionBy(*keys, "_start").orderBy(*order)
    ranked = found.withColumn("rank", F.col("_from") + F.row_number().over(inside))
    return ranked.where("_member").select(*keys, *order, "rank", "group_size")


def top_k(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The n first rows; each task keeps n, so nothing larger is gathered."""
    return df.orderBy(*order).limit(n)


def top_ranked(df: DataFrame, order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The n first rows with their number.  Only those n rows are numbered."""
    return top_k(df, order, n).withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
