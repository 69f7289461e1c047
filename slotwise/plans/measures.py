"""Described measures: drift, exceedance, recovery, samples, trimmed means, zero rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions.labels import percentage, position_in, range_label, ratio
from slotwise.operators.aggregates import threshold_rates
from slotwise.operators.cells import with_facts
from slotwise.operators.quantiles import agg_with_quantiles, exact_quantiles
from slotwise.operators.ranges import next_after
from slotwise.operators.scalars import one_row
from slotwise.operators.shares import share_of_total


def drift_histogram(df: DataFrame, a: str, b: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """abs(a - b) / a in labelled ranges, with share and running share.

    The last label takes everything above the last edge.  The running sum is
    over one row per label.
    """
    drift = ratio(F.abs(F.col(a) - F.col(b)), F.col(a))
    label = range_label(drift, edges, labels)
    counted = df.groupBy(label.alias("drift_range")).agg(F.count("*").alias("slots"))
    out = share_of_total(counted, "slots", "pct", 4).withColumn("range_order", position_in(F.col("drift_range"), labels))
    total = one_row(counted, slots=F.sum("slots")).getField("slots")
    upto = Window.orderBy("range_order").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumulative_pct", percentage(F.sum("slots").over(upto), total, 4))


def drift_direction(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows in which b is below, at or above a."""
    side = F.signum((F.col(b) - F.col(a)).cast("double")).cast("int").alias("direction")
    return share_of_total(df.groupBy(side).agg(F.count("*").alias("slots")), "slots", "pct", 4)


def threshold_exceedance(
    df: DataFrame, keys: Sequence[str], value: str, limits: Sequence[float], probs: Mapping[str, float]
) -> DataFrame:
    rates = threshold_rates(F.col(value), limits, "over_{}", "pct_over_{}", digits=4)
    return agg_with_quantiles(df, keys, [F.count("*").alias("rows"), *rates], value, probs)


def behind_stretches(
    df: DataFrame, key: str, at: str, behind: Column, distance: Column, limit: int, width: int = 3_600_000_000
) -> DataFrame:
    """Each unbroken stretch of rows behind: start, rows, greatest distance, and whether it ended within ``limit``.

    Rows behind that have the same next row not behind are one stretch, so stretches are
    groups and no key is sorted.  ``recovered_after`` counts from the first row of a
    stretch and is NULL, ``recovered`` false, for one that never ends.
    """
    late = df.where(behind).select(key, at, distance.alias("_distance"))
    found = next_after(late, df.where(~behind), at, at, "_next", [key], width=width)
    after = F.col("_next") - F.min(at)
    return (
        late.join(found, [key, at], "left")
        .groupBy(key, "_next")
        .agg(
            F.min(at).alias("behind_from"),
            F.max(at).alias("behind_until"),
            F.count("*").alias("behind_rows"),
            F.max("_distance").alias("greatest_distance"),
            after.alias("recovered_after"),
            F.coalesce(after <= F.lit(limit), F.lit(False)).alias("recovered"),
        )
        .drop("_next")
    )


def recovered_share(stretches: DataFrame, band: Column, out: str = "distance_band") -> DataFrame:
    """Stretches by how far behind they fell, and the share that recovered within the limit."""
    return stretches.groupBy(band.alias(out)).agg(
        F.count("*").alias("stretches"),
        F.sum("behind_rows").alias("behind_rows"),
        F.count_if(F.col("recovered")).alias("recovered"),
        percentage(F.count_if(F.col("recovered")), F.count("*"), 2).alias("recovered_pct"),
        F.count_if(F.col("recovered_after").isNull()).alias("never"),
    )


def recovery_time(
    df: DataFrame,
    key: str,
    at: str,
    behind: Column,
    keep: Sequence[str] = (),
    out: str = "recovered_after",
    width: int = 3_600_000_000,
) -> DataFrame:
    """Rows that are behind, with the time until the key's next row that is not.

    ``at`` is a whole number; ``width`` is the bucket width of the lookup.
    """
    late = df.where(behind)
    found = next_after(late, df.where(~behind), at, at, "_next", [key], width=width)
    return late.join(found, [key, at], "left").select(
        key, at, *keep, (F.col("_next") - F.col(at)).alias(out)
    )


def sample_by_stratum(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: str = "") -> DataFrame:
    """n rows per stratum in hash order, the same ones each time.

    The rank limit is applied in front of the shuffle, n rows per task.
    """
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    window = Window.partitionBy(*strata).orderBy(order, key)
    return df.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= n).drop("_place")


def trimmed_mean(df: DataFrame, keys: Sequence[str], value: str, cut: float = 0.99) -> DataFrame:
    """Mean, and mean of the values up to the ``cut`` quantile of the group."""
    limit = exact_quantiles(df, keys, value, {"cut_value": cut})
    rows = with_facts(df, limit, keys)
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.avg(F.when(F.col(value) <= F.col("cut_value"), F.col(value))).alias("trimmed_mean"),
        F.max("cut_value").alias("cut_value"),
    )


def zero_fill_report(
    counts: DataFrame, listed: DataFrame, key: str, category: str, categories: Sequence[str], count: str
) -> DataFrame:
    """Every (listed key, category) with its count, 0 when absent."""
    each = F.explode(F.array(*[F.lit(c) for c in categories])).alias(category)
    grid = listed.select(key).distinct().select(key, each)
    return grid.join(counts, [key, category], "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)))
