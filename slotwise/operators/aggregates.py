"""Composed aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.labels import percentage, ratio
from slotwise.operators.scalars import one_row


def conditional(fn, value: Column, condition: Column) -> Column:
    """``fn`` over the rows that meet the condition; NULL without any."""
    return fn(F.when(condition, value))


def min_sample(df: DataFrame, count: str, least: int) -> DataFrame:
    return df.where(F.col(count) >= least)


def threshold_rates(value: Column, limits: Sequence[float], count: str, share: str, digits: int = 2) -> list[Column]:
    """For each limit the number of rows at or above it, then each share of all rows."""
    def name(template, limit):
        return template.format(limit)

    counts = [F.count_if(value >= x).alias(name(count, x)) for x in limits]
    shares = [
        percentage(F.count_if(value >= x), F.count("*"), digits).alias(name(share, x)) for x in limits
    ]
    return counts + shares


def weighted_percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    """Ratio of sums, in percent."""
    return percentage(F.sum(part), F.sum(whole), digits)


def ratio_of_sums(part: Column, whole: Column) -> Column:
    return ratio(F.sum(part), F.sum(whole))


def outcome_status(
    good: Column, bad: Column, full: str, none: str, mixed: str, none_first: bool = False
) -> Column:
    """Label of a group from its counts of good and bad outcomes."""
    all_good, all_bad = (bad == 0, F.lit(full)), (good == 0, F.lit(none))
    first, second = (all_bad, all_good) if none_first else (all_good, all_bad)
    return F.when(*first).when(*second).otherwise(mixed)


def residual_group(known: DataFrame, total: DataFrame, label: str, name: str, measures: Sequence[str]) -> DataFrame:
    """``known`` plus one row: ``total`` (one row) minus the sum of ``known``.

    Both one-row sums are scalars of the plan.
    """
    whole = one_row(total, **{m: F.sum(m) for m in measures})
    part = known.agg(F.struct(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]).alias("_s"))
    rest = part.select(
        F.lit(name).alias(label),
        *[(whole.getField(m) - F.col("_s").getField(m)).alias(m) for m in measures],
    )
    return known.select(label, *measures).unionByName(rest)


def zscores(df: DataFrame, value: str, out: str = "z_score") -> DataFrame:
    """(value - mean) / population standard deviation over all rows."""
    stats = one_row(df, mean=F.avg(value), std=F.stddev_pop(value))
    return df.withColumn(
        out, F.try_divide(F.col(value) - stats.getField("mean"), stats.getField("std"))
    )


def zscore_class(z: Column, labels: Sequence[str], low: float = 0.0, high: float = 2.0) -> Column:
    """labels[0] below ``low``, labels[1] up to and with ``high``, else labels[2]."""
    return F.when(z < low, labels[0]).when(z <= high, labels[1]).otherwise(labels[2])


def first_seen(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias(out))


def dispersion(
    df: DataFrame, keys: Sequence[str], value: str, out: str, rows: DataFrame | None = None
) -> DataFrame:
    """``value`` minus the group's minimum, where positive.

    The minimum is taken over ``df``; ``rows`` (default ``df``) are measured.
    A join of the partial minimum, so a hot group is not sorted in one task.
    """
    start = first_seen(df, keys, value, "_first")
    measured = (df if rows is None else rows).join(start, list(keys), "inner")
    return (
        measured.withColumn(out, F.col(value) - F.col("_first")).where(F.col(out) > 0).drop("_first")
    )


def novel_vs_repeat(df: DataFrame, item: Sequence[str], bin_: str, novel: str, repeat: str) -> DataFrame:
    """Per bin: sightings in the first bin of their item, and later ones.

    Sightings are counted per (item, bin) first, so the window over an item
    holds one row per bin.
    """
    counted = df.groupBy(*item, bin_).agg(F.count("*").alias("_n"))
    start = F.min(bin_).over(Window.partitionBy(*item))
    return (
        counted.withColumn("_first", start)
        .groupBy(bin_)
        .agg(
            F.coalesce(F.sum(F.when(F.col(bin_) <= F.col("_first"), F.col("_n"))), F.lit(0)).alias(novel),
            F.coalesce(F.sum(F.when(F.col(bin_) > F.col("_first"), F.col("_n"))), F.lit(0)).alias(repeat),
        )
    )


def winners(df: DataFrame, keys: Sequence[str], member: str, value: str, out: str) -> DataFrame:
    """Member with the smallest value per group; the smaller member name on ties.

    Minimum of a (value, member) pair: combines before the shuffle.
    """
    best = F.min(F.struct(F.col(value).alias("v"), F.col(member).alias("m")))
    return df.groupBy(*keys).agg(best.getField("m").alias(out))


def win_rate(won: DataFrame, keys: Sequence[str], winner: str, member) -> DataFrame:
    wins = F.count_if(F.col(winner) == member)
    return won.groupBy(*keys).agg(
        wins.alias("wins"),
        F.count("*").alias("total_blocks"),
        percentage(wins, F.count("*"), 2).alias("win_rate_pct"),
    )


def period_delta(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Mean in each period, their difference, and the difference in percent."""
    a, b = conditional(F.avg, value, before), conditional(F.avg, value, after)
    return {"before": a, "after": b, "delta": b - a, "delta_pct": percentage(b - a, a)}


def distinct_count(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Distinct values per key in two steps, so a hot key spreads over its values."""
    pairs = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return pairs.groupBy(*keys).agg(F.count("*").alias(out))


def union_metrics(df: DataFrame, metrics: Mapping[str, Column], name: str, value: str) -> DataFrame:
    """One row per named aggregate of the same rows: one pass, then unpivot."""
    wide = df.agg(*[col.alias(f"m{i}") for i, col in enumerate(metrics.values())])
    pairs = F.array(
        *[F.struct(F.lit(label).alias(name), F.col(f"m{i}").alias(value)) for i, label in enumerate(metrics)]
    )
    return wide.select(F.inline(pairs))


def counts_of_counts(df: DataFrame, keys: Sequence[str], per: str, count: str) -> DataFrame:
    """Histogram of group sizes: rows per key, then keys per size."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias(per))
    return sizes.groupBy(per).agg(F.count("*").alias(count))


