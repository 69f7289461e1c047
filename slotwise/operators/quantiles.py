"""Exact quantiles that never gather a group in one task.

Values are counted, so that a frequent one is a single row, and laid into cells of about
equal size (``operators/cells.py``).  Count, sum and extremes of a group come from its
cells, and so does the cell that holds a wanted rank; only those cells are sorted, each
about as large as a range partition.  The counted values are shuffled by value once and
by range once; what is opened reads the first shuffle again.

Without keys, totals and opened cells are scalars of the plan: nothing is joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.operators.cells import BEFORE, HIGH as LAST, LOW as FIRST, UPTO, opened, ordered_cells, over, with_facts
from slotwise.operators.joins import null_safe_join
from slotwise.operators.scalars import shared

# Aggregates of the value itself, from the cells.
COUNT, TOTAL, MEAN = "sum(_mass)", "sum(_sum)", "sum(_sum) / sum(_mass)"
LOW, HIGH = f"min({FIRST})", f"max({LAST})"


def counted_values(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """(keys, _v, _n, sums): how many rows have each value, and ``sums`` of other columns over them.

    Rows with a NULL value are left out, with ``sums`` kept, as they count there.
    """
    rows = df.withColumns({"_v": F.col(f"`{value}`"), "_w": F.col(f"`{weight}`") if weight else F.lit(1).cast("bigint")})
    if not sums:
        rows = rows.where("_v is not null")
    added = [total.alias(name) for name, total in (sums or {}).items()]
    return rows.groupBy(*[F.col(f"`{c}`") for c in keys], "_v").agg((F.sum("_w") if weight else F.count("*")).alias("_n"), *added)


def values_at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, str],
    constants: Mapping[str, Column] | DataFrame | None = None,
    stats: Mapping[str, str] | None = None,
    weight: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Per key the value at each rank (0 is the smallest); NULL past the end.

    ``ranks`` maps an output name to an SQL expression over ``_total``, the group's row
    count, and the ``constants``: columns, or a table with one row for each value of the
    keys (or some of them) that it has.  ``stats`` are
    aggregates over cells (COUNT, TOTAL, MEAN, LOW, HIGH, sums of sums).  ``_total`` and the stats come
    out as well.  NULL values are left out.  ``weight`` names a column that says how many
    rows a row stands for; ``parts`` fixes the number of range partitions.
    """
    return at_ranks(counted_values(df, keys, value, weight), keys, ranks, constants, stats, parts)


def at_ranks(
    counted: DataFrame,
    keys: Sequence[str],
    ranks: Mapping[str, str],
    constants: Mapping[str, Column] | DataFrame | None = None,
    stats: Mapping[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``values_at_ranks`` of counted values (keys, _v, _n)."""
    group, stats = list(keys), stats or {}
    sums = {c: F.sum(c) for c in counted.columns if c not in (*group, "_v", "_n")}
    if any("_sum" in text for text in stats.values()):
        sums["_sum"] = F.expr("sum(_v * _n)")
    mass = F.coalesce(F.expr("sum(_n) filter (where _v is not null)"), F.lit(0))
    cells = ordered_cells(counted, group, ["_v"], mass, parts, **sums)
    cells = cells.selectExpr("*", f"sum(_mass) {over(group)} as _total")
    if isinstance(constants, DataFrame):
        given = [c for c in constants.columns if c not in group]
        cells = with_facts(cells, constants, [c for c in group if c in constants.columns], "left")
    else:
        given = list(constants or {})
        cells = cells.withColumns(dict(constants or {}))
    hit = " or ".join(f"({rank} >= {BEFORE} and {rank} < {BEFORE} + _mass)" for rank in ranks.values())
    facts = cells.groupBy(*[F.col(f"`{c}`") for c in group]).agg(
        F.expr(f"array_sort(collect_list(case when {hit} then struct({FIRST}, {LAST}, {BEFORE}) end)) as _open"),  # one per rank at most
        *[F.max(f"`{c}`").alias(c) for c in ("_total", *given)],
        F.min(FIRST).alias("_least"),
        *[F.expr(f"{text} as `{name}`") for name, text in stats.items()],
    )
    within, rows = [*group, "_start"], counted
    if extra := [c for c in counted.columns if c in sums]:
        rows = shared(counted).drop(*extra)
    # The least value stays in any case, so that no group is lost whose ranks are all past its end.
    rows = opened(rows, facts, group, ["_v"], "_open", also=F.col("_v").eqNullSafe(F.col("_least"))).withColumns({"_start": F.col("_cell")[FIRST], "_from": F.col("_cell")[BEFORE]})
    ranked = rows.selectExpr("*", f"_from + sum(_n) {over(within, '_v', UPTO)} as _stop")
    return ranked.groupBy(*[F.col(f"`{c}`") for c in group]).agg(
        *[F.expr(f"max(case when {rank} >= _stop - _n and {rank} < _stop then _v end) as `{name}`") for name, rank in ranks.items()],
        *[F.max(f"`{c}`").alias(c) for c in ("_total", *stats)],
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    stats: Mapping[str, str] | None = None,
    weight: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Interpolated quantiles per key, one output column per entry of ``probs``."""
    return quantiles_of(counted_values(df, keys, value, weight), keys, probs, stats, parts)


def quantiles_of(
    counted: DataFrame, keys: Sequence[str], probs: Mapping[str, float], stats: Mapping[str, str] | None = None, parts: int | None = None
) -> DataFrame:
    """``exact_quantiles`` of counted values (keys, _v, _n, sums); ``stats`` may use the sums."""
    ranks, out = {}, [f"`{name}`" for name in stats or {}]
    for name, q in probs.items():
        place = f"((_total - 1) * {q!r}D)"
        ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = f"floor{place}", f"ceil{place}"
        low, high = f"cast(`_lo_{name}` as double)", f"cast(`_hi_{name}` as double)"
        part = f"({place} - floor{place})"
        out.append(f"{low} * (1D - {part}) + {high} * {part} as `{name}`")
    picked = at_ranks(counted, keys, ranks, stats=stats, parts=parts)
    return picked.selectExpr(*[f"`{c}`" for c in keys], *out)


def summarize(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], **stats: str
) -> DataFrame:
    """Quantiles with count, sum, mean, minimum or maximum of the same column.

    All come from the counted values, so the input is read once; rows with a
    NULL value count nowhere.  Example: ``summarize(df, ["day"], "ms", {"p50":
    0.5}, blocks=COUNT, mean_ms=MEAN)``.
    """
    return exact_quantiles(df, keys, value, probs, stats)


def one_pass_quantile(value: Column, q: float) -> Column:
    """Aggregate that keeps the distinct values of a group in one task.

    For groups that are small by nature, such as the messages of one slot.
    """
    return F.percentile(value, F.lit(q))


def agg_with_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Grouped aggregates, also of other columns, plus exact quantiles of one."""
    found = exact_quantiles(df, keys, value, probs, weight=weight)
    if not aggs:
        return found
    base = df.groupBy(*keys).agg(*aggs)
    return null_safe_join(base, found, list(keys), "left") if keys else with_facts(base, found, [])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5})
