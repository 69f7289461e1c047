"""Chart-ready tables from long results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.labels import percentage, ratio, tidy
from slotwise.operators.joins import null_safe_join
from slotwise.operators.scalars import one_row
from slotwise.operators.shares import top_k


def pivot_fill(
    df: DataFrame, rows: Sequence[str], column: str, value: str, choices: Sequence, fill=0
) -> DataFrame:
    """Long to wide over the listed choices; gaps take ``fill`` (None keeps NULL)."""
    aggs = []
    for choice in choices:
        cell = F.sum(F.when(F.col(column) == choice, F.col(value)))
        aggs.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(str(choice)))
    return df.groupBy(*rows).agg(*aggs)


def dense_axis(
    df: DataFrame, keys: Sequence[str], position: str, low: int, high: int, fills: Mapping
) -> DataFrame:
    """Every position from low to high for every key; missing cells take a fill.

    The axis is an exploded literal per distinct key, not a product of rows.
    """
    kind = df.schema[position].dataType.simpleString()
    axis = F.explode(F.sequence(F.lit(low).cast(kind), F.lit(high).cast(kind))).alias(position)
    grid = df.select(*keys).distinct().select(*keys, axis)
    out = null_safe_join(grid, df, [*keys, position], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def select_group(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def choices(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def split_wide(df: DataFrame, common: Sequence[str], prefix: str, fields: Sequence[str]) -> DataFrame:
    """One side of a wide table (``<prefix>_<field>``) under neutral names."""
    return df.select(*common, *[F.col(f"{prefix}_{f}").alias(f) for f in fields])


def top_n_across(
    df: DataFrame, key: str, category: str, value: str, n: int, total: str = "total"
) -> DataFrame:
    """Rows of the n keys with the largest sum over all categories."""
    sums = df.groupBy(key).agg(F.sum(value).alias(total))
    best = top_k(sums, [F.col(total).desc(), F.col(key)], n)
    return df.join(best, [key], "inner").select(key, category, value, total)


def share_of_columns(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Each listed column as a percentage of its own total."""
    sums = one_row(df, **{c: F.sum(c) for c in columns})
    return df.withColumns({f"{c}_pct": percentage(F.col(c), sums.getField(c), digits) for c in columns})


def linear_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares line; ``r`` is the root of the explained share, ``corr`` keeps the sign."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.sqrt(F.regr_r2(ys, xs)).alias("r"),
        F.corr(ys, xs).alias("corr"),
        F.min(xs).alias("min_x"),
        F.max(xs).alias("max_x"),
        F.count("*").alias("points"),
    )


def group_totals(df: DataFrame, keys: Sequence[str], values: Sequence[str], share: tuple[str, str, str] | None = None) -> DataFrame:
    """Sums per group; ``share`` = (part, other, name) adds part / (part + other), 0 when empty."""
    out = df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    if share is None:
        return out
    part, other, name = share
    return out.withColumn(name, F.coalesce(ratio(F.col(part), F.col(part) + F.col(other)), F.lit(0.0)))


# Fixed values of the score chart.
BAR_COLOURS = {"low": "#22c55e", "high": "#ef4444", "mid": "#eab308"}


def bar_colour(z: Column) -> Column:
    """The colour turns at z >= 2, while the class still calls z = 2 neutral."""
    return F.when(z < 0, BAR_COLOURS["low"]).when(z >= 2, BAR_COLOURS["high"]).otherwise(BAR_COLOURS["mid"])


def bar_width(z: Column) -> Column:
    return tidy((z + 3) / F.lit(8.0) * 100, 1)
