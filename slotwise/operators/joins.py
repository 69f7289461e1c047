"""Equi-join shapes.

No broadcast hints but one, behind a count: adaptive execution broadcasts a side when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and
merges, splitting partitions that a hot key makes too large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join where NULL keys match each other; the right key columns are dropped."""
    renamed = right.selectExpr(*[f"`{c}` as `_r_{c}`" if c in on else f"`{c}`" for c in right.columns])
    matched = F.expr(" and ".join(f"`{c}` <=> `_r_{c}`" for c in on))
    return left.join(renamed, matched, how).drop(*[f"_r_{c}" for c in on])


KEYS_HELD = 1 << 20  # 64-bit keys that every executor is handed, some tens of MB


def only_keys_of(rows: DataFrame, others: DataFrame, on: Sequence[str], held: int = KEYS_HELD) -> DataFrame:
    """The rows whose key may occur in ``others``; a join on ``on`` must follow.

    Keys are compared by 64-bit hashes.  How many ``others`` has is counted first, up to
    ``held``: so many go to every executor and rows are dropped at the scan, unshuffled;
    more are left to a shuffled semi join.
    """
    mark = F.xxhash64(*on)
    marks = others.select(mark.alias("_mark")).distinct()
    few = marks.limit(held + 1).count() <= held
    return rows.withColumn("_mark", mark).join(F.broadcast(marks) if few else marks, "_mark", "left_semi").drop("_mark")


def left_fill(left: DataFrame, right: DataFrame, on: Sequence[str], defaults: Mapping) -> DataFrame:
    """Left join; right columns missing on a row take their default."""
    out = left.join(right, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def membership_flag(df: DataFrame, members: DataFrame, on: Sequence[str], out: str) -> DataFrame:
    """Boolean column: are the row's key columns in ``members``?"""
    marked = members.select(*on).distinct().withColumn(out, F.lit(True))
    return df.join(marked, list(on), "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def with_every_outcome(df: DataFrame, keys: Sequence[str], outcome: str, values: Sequence) -> DataFrame:
    """Rows of the groups in which each of ``values`` occurs (controlled comparison)."""
    both = df.groupBy(*keys).agg(
        *[F.count_if(F.col(outcome) == v).alias(f"_n{i}") for i, v in enumerate(values)]
    )
    for i in range(len(values)):
        both = both.where(F.col(f"_n{i}") > 0)
    return df.join(both.select(*keys), list(keys), "left_semi")


def parent_child(
    child: DataFrame,
    parent: DataFrame,
    on: Sequence[tuple[str, str]],
    keep: Mapping[str, str],
) -> DataFrame:
    """Each child row with columns of its parent row: ``on`` pairs child and
    parent columns, ``keep`` maps parent columns to output names."""
    right = parent.select(
        *[F.col(p).alias(f"_p_{i}") for i, (_, p) in enumerate(on)],
        *[F.col(src).alias(dst) for src, dst in keep.items()],
    )
    cond = [F.col(c) == F.col(f"_p_{i}") for i, (c, _) in enumerate(on)]
    return child.join(right, cond, "inner").drop(*[f"_p_{i}" for i in range(len(on))])


def shifted_join(left: DataFrame, right: DataFrame, key: str, shift: int | Column, how: str = "inner") -> DataFrame:
    """Row N with row N + shift of the other side, as an equi-join on a moved key."""
    step = F.lit(shift) if isinstance(shift, int) else shift
    return left.join(right.withColumn(key, F.col(key) - step), [key], how)


def attach_names(
    df: DataFrame, names: DataFrame, key: Column, name_key: Column, name: str, out: str, unknown: str
) -> DataFrame:
    """Left join to the distinct (key, name) list; several names of one key
    multiply the rows, as the name list is not unique by key."""
    listed = names.select(name_key.alias("_name_key"), F.col(name).alias("_name")).distinct()
    return (
        df.join(listed, key == F.col("_name_key"), "left")
        .withColumn(out, F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.lit(unknown)))
        .drop("_name_key", "_name")
    )
