"""One-row results as scalars of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared(df: DataFrame) -> DataFrame:
    """``df`` for several uses in one plan.

    The condition always holds.  It reads every column, so column pruning leaves each use
    of ``df`` alike and Spark makes the shuffles below it once.
    """
    return df.where(F.hash(*[F.col(f"`{c}`") for c in df.columns]) >= -(1 << 31))


def one_row(df: DataFrame, **aggs: Column) -> Column:
    """Aggregates over all rows of ``df`` as a struct scalar.

    The scalar is used next to ``df`` itself, so ``df`` occurs twice in the plan.
    Reading every column keeps both occurrences alike; otherwise column pruning
    would make them differ and Spark would compute the shuffles of ``df`` twice
    instead of reusing them.
    """
    same_columns = F.max(F.hash(*[F.col(f"`{c}`") for c in df.columns]))
    parts = [col.alias(name) for name, col in aggs.items()]
    return df.agg(F.struct(*parts, same_columns.alias("_all_columns")).alias("_row")).scalar()
