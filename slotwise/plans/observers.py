"""Two observers of one call: difference by client, hour, range and array size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import arrays
from slotwise.functions import timeparts as tp
from slotwise.functions.labels import extract_group, percentage, position_in, range_label, ratio, tidy
from slotwise.operators.aggregates import period_delta
from slotwise.operators.joins import only_keys_of
from slotwise.operators.quantiles import COUNT, MEAN, counted_values, exact_quantiles, quantiles_of
from slotwise.operators.shares import share_of_total
from slotwise.plans.outcomes import CLIENT_PATTERN
from slotwise.sources.scan import Period
from slotwise.sources.tables import EVENT_TIME, Tables

# Inner observer, machine class in node names, ranges in milliseconds, days, column names.
SOURCE = "ENGINE_SOURCE_SNOOPER"
DAY_COLUMNS = ("jan15_no_snooper_ms", "jan16_with_snooper_ms")
NODE_PATTERN = "%7870%"
RANGE_EDGES = [0, 2, 4, 6, 8, 10, 15, 20, 50]
RANGE_LABELS = ["< 0", "0-2", "2-4", "4-6", "6-8", "8-10", "10-15", "15-20", "20-50", "50+"]
CALL_DAY = Period("2026-01-26 00:00:00", "2026-01-27 00:00:00")
FETCH_DAY = Period("2026-01-16 00:00:00", "2026-01-17 00:00:00")
TWO_DAYS = Period("2026-01-15 00:00:00", "2026-01-17 00:00:00")


MEANS = {"outer_ms": "avg_cl_ms", "inner_ms": "avg_el_ms", "overhead": "avg_overhead_ms"}


def _client():
    return extract_group(F.col("meta_client_name"), CLIENT_PATTERN)


def observer_pairs(
    inner: DataFrame, outer: DataFrame, on: Sequence[str], keep: Mapping[str, Column] | None = None
) -> DataFrame:
    """The same call seen by two observers: ``outer - inner`` in ``overhead``.

    Equal rows of a side are counted before the join and ``pairs`` says how many
    pairs a row stands for, so a repeated call never lists its pairs.  Only the
    inner side is bounded in time; the call key carries the match, so the outer side's
    history is cut to the inner side's keys before it is grouped and shuffled.
    """
    kept = [col.alias(name) for name, col in (keep or {}).items()]
    left = inner.groupBy(*on, *kept, F.col("duration_ms").cast("bigint").alias("inner_ms")).agg(
        F.count("*").alias("_n")
    )
    right = only_keys_of(outer, inner, on).groupBy(*on, F.col("duration_ms").cast("bigint").alias("outer_ms")).agg(F.count("*").alias("_m"))
    return left.join(right, list(on)).withColumns(
        {"overhead": F.col("outer_ms") - F.col("inner_ms"), "pairs": F.col("_n") * F.col("_m")}
    )


def _count() -> Column:
    return F.sum("pairs")


def _sums(*values: str) -> dict[str, Column]:
    """Totals over the pairs that the quantiles of the difference count anyway; a mean divides by its own pairs."""
    return {"_pairs": F.sum("pairs")} | {f"_{v}": _total(v) for v in values}


def _mean(value: str) -> Column:
    return ratio(F.sum(F.col(value) * F.col("pairs")), F.sum("pairs"))


def _total(value: str) -> Column:
    return F.sum(F.col(value) * F.col("pairs"))


def _inner(t: Tables, table: str, period: Period, node_pattern: str | None) -> DataFrame:
    rows = t.window(table, period)
    return rows if node_pattern is None else rows.where(F.col("meta_client_name").like(node_pattern))


def _calls(t: Tables, period: Period, node_pattern, source: str | None) -> DataFrame:
    rows = _inner(t, "execution_engine_new_payload", period, node_pattern)
    if source is not None:
        rows = rows.where(F.col("source") == source)
    on = ["block_hash", "meta_client_name", "meta_network_name"]
    hour = {"hour": tp.hour(F.col(EVENT_TIME))}
    return observer_pairs(rows, t["consensus_engine_api_new_payload"], on, hour)


def _fetches(t: Tables, period: Period, node_pattern) -> DataFrame:
    on = ["versioned_hashes", "meta_client_name", "meta_network_name"]
    rows = _inner(t, "execution_engine_get_blobs", period, node_pattern)
    pairs = observer_pairs(rows, t["consensus_engine_api_get_blobs"], on)
    return pairs.withColumn("_size", arrays.length(F.col("versioned_hashes")))


def day_comparison(
    t: Tables,
    before: str = "2026-01-15",
    after: str = "2026-01-16",
    period: Period = TWO_DAYS,
    node_pattern: str | None = NODE_PATTERN,
    names: tuple[str, str] = DAY_COLUMNS,
) -> DataFrame:
    """Mean duration per client on two days, difference and change in percent."""
    rows = t.window("consensus_engine_api_get_blobs", period, EVENT_TIME)
    if node_pattern is not None:
        rows = rows.where(F.col("meta_client_name").like(node_pattern))
    rows = rows.withColumn("el_client", _client()).where(F.col("el_client") != "")
    day = tp.day(F.col(EVENT_TIME))
    parts = period_delta(F.col("duration_ms"), day == F.lit(before).cast("date"), day == F.lit(after).cast("date"))
    return (
        rows.groupBy("el_client")
        .agg(
            tidy(parts["before"], 2).alias(names[0]),
            tidy(parts["after"], 2).alias(names[1]),
            tidy(parts["delta"], 2).alias("delta_ms"),
            tidy(parts["delta_pct"], 1).alias("delta_pct"),
        )
        .orderBy("el_client")
    )


def difference_by_client(
    t: Tables, period: Period = CALL_DAY, node_pattern: str | None = NODE_PATTERN, source: str | None = SOURCE
) -> DataFrame:
    rows = _calls(t, period, node_pattern, source).withColumn("el_client", _client())
    probs = {"p50_overhead_ms": 0.5, "p95_overhead_ms": 0.95, "p99_overhead_ms": 0.99}
    named = rows.where(F.col("el_client") != "")
    counted = counted_values(named, ["el_client"], "overhead", "pairs", _sums("outer_ms", "inner_ms", "overhead"))
    stats = {c: f"sum({c})" for c in ("_pairs", "_outer_ms", "_inner_ms", "_overhead")}
    out = quantiles_of(counted, ["el_client"], probs, stats)
    return out.select(
        "el_client",
        F.col("_pairs").alias("slots"),
        *[tidy(ratio(F.col(f"_{v}"), F.col("_pairs")), 2).alias(n) for v, n in MEANS.items()],
        *[tidy(p, 2).alias(p) for p in probs],
        percentage(F.col("_overhead"), F.col("_outer_ms"), 1).alias("overhead_pct"),
    ).orderBy("el_client")


def difference_hourly(
    t: Tables, period: Period = CALL_DAY, node_pattern: str | None = NODE_PATTERN, source: str | None = SOURCE
) -> DataFrame:
    rows = _calls(t, period, node_pattern, source).withColumn("el_client", _client())
    keys, probs = ["hour", "el_client"], {"p50_overhead_ms": 0.5, "p95_overhead_ms": 0.95}
    named = rows.where(F.col("el_client") != "")
    out = exact_quantiles(
        named, keys, "overhead", probs, stats={"avg_overhead_ms": MEAN, "samples": COUNT}, weight="pairs"
    )
    shown = ["avg_overhead_ms", *probs]
    return out.select(*keys, *[tidy(c, 2).alias(c) for c in shown], "samples").orderBy(*keys)


def difference_ranges(
    t: Tables, period: Period = CALL_DAY, node_pattern: str | None = NODE_PATTERN, source: str | None = SOURCE
) -> DataFrame:
    label = range_label(F.col("overhead"), RANGE_EDGES, RANGE_LABELS).alias("overhead_range")
    counted = _calls(t, period, node_pattern, source).groupBy(label).agg(_count().alias("calls"))
    return share_of_total(counted, "calls", "pct", 1).orderBy(position_in(F.col("overhead_range"), RANGE_LABELS))


def difference_by_size(t: Tables, period: Period = FETCH_DAY, node_pattern: str | None = NODE_PATTERN) -> DataFrame:
    rows = _fetches(t, period, node_pattern).where(F.col("_size") > 0)
    return (
        rows.groupBy(F.col("_size").alias("blob_count"))
        .agg(
            _count().alias("calls"),
            tidy(_mean("inner_ms"), 2).alias("avg_el_ms"),
            tidy(_mean("outer_ms"), 2).alias("avg_cl_ms"),
            tidy(_mean("overhead"), 2).alias("overhead_ms"),
            tidy(ratio(_total("overhead"), _total("_size")), 2).alias("per_blob_ms"),
        )
        .orderBy("blob_count")
    )


def difference_per_element(
    t: Tables, period: Period = FETCH_DAY, node_pattern: str | None = NODE_PATTERN
) -> DataFrame:
    rows = _fetches(t, period, node_pattern).withColumn("el_client", _client())
    probs = {"p50_overhead_ms": 0.5, "p95_overhead_ms": 0.95}
    named = rows.where(F.col("el_client") != "")
    counted = counted_values(named, ["el_client"], "overhead", "pairs", _sums("_size", "overhead"))
    out = quantiles_of(counted, ["el_client"], probs, {c: f"sum({c})" for c in ("_pairs", "__size", "_overhead")})
    return out.select(
        "el_client",
        F.col("_pairs").alias("calls"),
        F.col("__size").alias("total_blobs"),
        tidy(ratio(F.col("_overhead"), F.col("_pairs")), 2).alias("avg_overhead_ms"),
        *[tidy(p, 2).alias(p) for p in probs],
        tidy(ratio(F.col("_overhead"), F.col("__size")), 2).alias("overhead_per_blob_ms"),
    ).orderBy("el_client")
