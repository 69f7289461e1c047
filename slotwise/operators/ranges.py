"""Ordered lookups without a non-equi join.

The latest point before a position is found inside fixed-width buckets of the
position; a bucket without one asks the same question about bucket numbers.
Positions are made distinct first, so a bucket holds at most ``2 * width`` rows
whatever the skew of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def _carry(points: DataFrame, asked: DataFrame, keys: list[str], width: int, levels: int) -> DataFrame:
    bucket = F.floor(F.col("_pos") / F.lit(width)).cast("bigint") if levels else F.lit(0).cast("bigint")
    both = points.select(*keys, "_pos", "_val", F.lit(1).alias("_kind")).unionByName(
        asked.select(*keys, "_pos", F.lit(None).cast("bigint").alias("_val"), F.lit(0).alias("_kind"))
    )
    # At equal positions the question sorts first: the point must lie before it.
    order = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_pos", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = (
        both.withColumn("_bucket", bucket)
        .withColumn("_last", F.max("_val").over(order))
        .where(F.col("_kind") == 0)
        .select(*keys, "_pos", "_bucket", "_last")
    )
    if not levels:
        return local.drop("_bucket")
    heads = points.groupBy(*keys, bucket.alias("_bucket")).agg(F.max("_val").alias("_val"))
    heads = heads.withColumnRenamed("_bucket", "_pos")
    open_ = local.where(F.col("_last").isNull()).select(*keys, F.col("_bucket").alias("_pos")).distinct()
    above = _carry(heads, open_, keys, width, levels - 1)
    above = above.select(*keys, F.col("_pos").alias("_bucket"), F.col("_last").alias("_above"))
    return local.join(above, [*keys, "_bucket"], "left").select(
        *keys, "_pos", F.coalesce("_last", "_above").alias("_last")
    )


def last_before(
    asked: DataFrame,
    points: DataFrame,
    at: str,
    point: str,
    out: str,
    keys: Sequence[str] = (),
    width: int = WIDTH,
    levels: int = 1,
) -> DataFrame:
    """Distinct (keys, at) of ``asked`` with the largest ``point`` below ``at``.

    ``at`` and ``point`` are whole numbers.  The top level is one ordered group
    per key of ``range / width ** levels`` rows at most.
    """
    keys = list(keys)
    marks = points.select(*keys, F.col(point).cast("bigint").alias("_pos")).where(F.col("_pos").isNotNull())
    marks = marks.distinct().withColumn("_val", F.col("_pos"))
    questions = asked.select(*keys, F.col(at).cast("bigint").alias("_pos"))
    questions = questions.where(F.col("_pos").isNotNull()).distinct()
    found = _carry(marks, questions, keys, width, levels)
    return found.select(*keys, F.col("_pos").alias(at), F.col("_last").alias(out))


def next_after(
    asked: DataFrame,
    points: DataFrame,
    at: str,
    point: str,
    out: str,
    keys: Sequence[str] = (),
    width: int = WIDTH,
    levels: int = 1,
) -> DataFrame:
    """Distinct (keys, at) with the smallest ``point`` above ``at``."""
    keys = list(keys)
    mirrored = last_before(
        asked.select(*keys, (-F.col(at)).alias(at)),
        points.select(*keys, (-F.col(point)).alias(point)),
        at,
        point,
        out,
        keys,
        width,
        levels,
    )
    return mirrored.select(*keys, (-F.col(at)).alias(at), (-F.col(out)).alias(out))


def range_max(asked: DataFrame, points: DataFrame, low: str, high: str, point: str, out: str, **how) -> DataFrame:
    """Distinct (low, high) with the largest ``point`` in ``low <= point < high``.

    The largest point below ``high`` is the answer unless it lies below ``low``;
    then the range holds no point and the answer is NULL.
    """
    pairs = asked.select(low, high).distinct()
    last = last_before(pairs, points, high, point, out, **how)
    return pairs.join(last, [high], "left").withColumn(
        out, F.when(F.col(out) >= F.col(low), F.col(out))
    )
