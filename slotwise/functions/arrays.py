"""Array column expressions.  A NULL array counts as having no elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(arr: Column) -> Column:
    return F.coalesce(F.size(arr), F.lit(0)).cast("bigint")


def count_matching(arr: Column, value) -> Column:
    return length(F.filter(arr, lambda x: x == F.lit(value)))


def contains(arr: Column, value) -> Column:
    return F.coalesce(F.array_contains(arr, F.lit(value)), F.lit(False))
