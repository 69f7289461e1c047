"""Labels, buckets, defaults and guarded ratios as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NOISE_DIGITS = 10


def _ladder(steps: Iterable[tuple[Column, object]], default: Column) -> Column:
    steps = list(steps)
    if not steps:
        return default
    start = F.when(*steps[0])
    return reduce(lambda acc, step: acc.when(*step), steps[1:], start).otherwise(default)


def label_lookup(value: Column, mapping: Mapping, default: str | None = None) -> Column:
    """Label for each listed value; others get ``default``, or stay as they are."""
    rest = value if default is None else F.lit(default)
    return _ladder(((value == key, F.lit(label)) for key, label in mapping.items()), rest)


def label_like(
    value: Column,
    rules: Sequence[tuple[str, str]],
    default: str | None = None,
    null_label: str | None = None,
) -> Column:
    """First matching pattern wins.  NULL takes ``null_label`` when given.

    A pattern with ``%`` is a LIKE pattern, in which ``_`` stands for any one
    character; a pattern without is compared for equality.
    """
    steps = [
        (value.like(pattern) if "%" in pattern else value == pattern, F.lit(label))
        for pattern, label in rules
    ]
    if null_label is not None:
        steps.append((value.isNull(), F.lit(null_label)))
    return _ladder(steps, F.lit(default))


def range_label(value: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """``labels[i]`` for the first ``value < edges[i]``, else the last label."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    return _ladder(
        ((value < edge, F.lit(label)) for edge, label in zip(edges, labels)), F.lit(labels[-1])
    )


def position_in(value: Column, ordered: Sequence[str]) -> Column:
    """Sort key: index of the label in ``ordered``; unlisted labels go last."""
    return _ladder(((value == v, F.lit(i)) for i, v in enumerate(ordered)), F.lit(len(ordered)))


def histogram_bin(value: Column, width: int) -> Column:
    """Lower edge of the fixed-width bin."""
    return F.floor(value / F.lit(width)).cast("bigint") * F.lit(width)


def id_bucket(value: Column, size: int) -> Column:
    """Lower edge of an integer bucket, for ids of zero and above."""
    return value - value % F.lit(size)


def clamped_utilization(on_cpu_ns: Column, interval_ms: Column, cap: Column) -> Column:
    """Cores in use: CPU time over wall time, never above ``cap``."""
    return F.least(
        F.try_divide(on_cpu_ns.cast("double"), interval_ms.cast("double") * F.lit(1e6)),
        cap.cast("double"),
    )


def extract_group(value: Column, pattern: str) -> Column:
    """First capture group, '' without a match."""
    return F.regexp_extract(value, pattern, 1)


def null_default(value: Column, label) -> Column:
    """NULL becomes ``label``."""
    return F.coalesce(value, F.lit(label))


def blank_default(value: Column, label: str) -> Column:
    """NULL and '' both become ``label``."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(label))


def normalise_key(value: Column, length: int = 42) -> Column:
    return F.lower(F.substring(value.cast("string"), 1, length))


def tidy(value: Column | str, digits: int = 0) -> Column:
    """Round half up, after dropping binary noise beyond ten digits.

    Without the first step 48.35 that came out as 48.349999999999994 would round
    down on one engine or order of additions and up on another.
    """
    return F.round(F.round(value, NOISE_DIGITS), digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, NULL when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percentage(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    out = F.try_divide(numerator.cast("double") * F.lit(100.0), denominator.cast("double"))
    return out if digits is None else tidy(out, digits)
