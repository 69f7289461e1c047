"""The same records from several producers, compared field by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of difference; fixed names of this library.
MATCH = "match"
MISSING_KEY = "missing_key"
EXTRA_KEY = "extra_key"
TYPE_MISMATCH = "type_mismatch"
VALUE_MISMATCH = "value_mismatch"

# Classes of a hex field, first match wins.
HEX_FORMATS = [
    ("^$", "empty"),
    ("^0[xX]$", "bare prefix"),
    ("^0[xX]0*[0-9a-fA-F]{64}$", "prefixed, padded"),
    ("^0[xX][0-9a-fA-F]+$", "prefixed, compact"),
    ("^[0-9a-fA-F]{64}$", "unprefixed, padded"),
    ("^[0-9a-fA-F]+$", "unprefixed, compact"),
]


def majority(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per key, the larger one on ties; two partial counts,
    so no group of values is collected."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.max(F.struct(F.col("_n").alias("n"), F.col(value).alias("v")))
    return votes.groupBy(*keys).agg(best.getField("v").alias(out))


def record_diff(
    fields: DataFrame,
    record: Sequence[str],
    producer: str,
    producers: Sequence[str],
    field: str = "field",
    value: str = "value",
    kind: str | None = None,
) -> DataFrame:
    """Per (record, field, producer) how the producer differs from the majority.

    ``fields`` has one row per (record, producer, field).  A key counts as
    expected when more than half of the producers have it.  ``kind`` names a
    type column, when types are compared too.
    """
    on = [*record, field]
    facts = majority(fields, on, value, "_common")
    held = fields.groupBy(*on).agg(F.count("*").alias("_held"))
    facts = facts.join(held, on)
    if kind is not None:
        facts = facts.join(majority(fields, on, kind, "_common_kind"), on)
    each = F.explode(F.array(*[F.lit(p) for p in producers])).alias(producer)
    grid = facts.select("*", each)
    own = fields.withColumn("_present", F.lit(True)).select(
        *on, producer, value, "_present", *([kind] if kind else [])
    )
    rows = grid.join(own, [*on, producer], "left")
    expected = F.col("_held") * 2 > len(producers)
    present = F.col("_present").isNotNull()
    verdict = F.when(~present & expected, MISSING_KEY).when(present & ~expected, EXTRA_KEY).when(~present, MATCH)
    if kind is not None:
        verdict = verdict.when(~F.col(kind).eqNullSafe(F.col("_common_kind")), TYPE_MISMATCH)
    verdict = verdict.when(~F.col(value).eqNullSafe(F.col("_common")), VALUE_MISMATCH).otherwise(MATCH)
    return rows.select(*on, producer, verdict.alias("verdict"))


def diff_counts(diff: DataFrame, producer: str, field: str = "field") -> DataFrame:
    return diff.groupBy(producer, field, "verdict").agg(F.count("*").alias("records"))


def entry_count_diff(entries: DataFrame, record: Sequence[str], producer: str) -> DataFrame:
    """Producers whose number of entries of a record differs from the majority."""
    counts = entries.groupBy(*record, producer).agg(F.count("*").alias("entries"))
    common = majority(counts, record, "entries", "common_entries")
    return counts.join(common, list(record)).where(F.col("entries") != F.col("common_entries"))


def format_class(value: Column, rules: Sequence[tuple[str, str]] = HEX_FORMATS, default: str = "other") -> Column:
    out = F.when(value.isNull(), F.lit("missing"))
    for pattern, label in rules:
        out = out.when(value.rlike(pattern), F.lit(label))
    return out.otherwise(F.lit(default))


def format_census(
    df: DataFrame, keys: Sequence[str], value: str, rules: Sequence[tuple[str, str]] = HEX_FORMATS
) -> DataFrame:
    return df.groupBy(*keys, format_class(F.col(value), rules).alias("format")).agg(F.count("*").alias("rows"))
