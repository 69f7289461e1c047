"""Arrival and dispersion of blocks by their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.labels import range_label, tidy
from slotwise.operators.aggregates import dispersion, first_seen, min_sample
from slotwise.operators.joins import membership_flag
from slotwise.operators.quantiles import COUNT, agg_with_quantiles, counted_values, quantiles_of, summarize
from slotwise.plans.arrivals import BLOCK, SEEN, sightings
from slotwise.sources.scan import Period
from slotwise.sources.tables import Tables

# Week, arrival limit, node class, size bins in KiB.
WEEK = Period("2026-04-25 00:00:00", "2026-05-02 00:00:00")
LIMIT_MS = 12000
NODE_CLASS = "individual"
EDGES_KB = [16, 32, 48, 64, 80, 96, 112, 128, 144, 160, 192, 224]
STARTS_KB = [0, *EDGES_KB]


def size_labels(numbered: bool) -> list[str]:
    """'< 16 KB', '16 - 32 KB' ... or, numbered, '00. <16 KB', '01. 16-32 KB' ..."""
    dash, less = ("-", "<") if numbered else (" - ", "< ")
    labels = [f"{less}{EDGES_KB[0]} KB"]
    labels += [f"{low}{dash}{high} KB" for low, high in zip(EDGES_KB, EDGES_KB[1:])]
    labels.append(f"{EDGES_KB[-1]}+ KB")
    return [f"{i:02d}. {label}" for i, label in enumerate(labels)] if numbered else labels


def _seen(t: Tables, period: Period) -> DataFrame:
    return sightings(t, period).where(F.col(SEEN) < LIMIT_MS)


def _individual(seen: DataFrame) -> DataFrame:
    return seen.where(F.col("classification") == NODE_CLASS)


def _blocks(t: Tables, period: Period) -> DataFrame:
    blocks = t.latest("fct_block_head", period).where(F.col("block_total_bytes_compressed").isNotNull())
    return blocks.withColumns(
        {
            "post_kb": F.col("block_total_bytes_compressed") / 1024.0,
            "pre_kb": F.col("block_total_bytes") / 1024.0,
        }
    ).select(*BLOCK, "post_kb", "pre_kb")


def _dispersed(t: Tables, period: Period) -> DataFrame:
    """Milliseconds after the first sighting by any node; 1 .. LIMIT_MS."""
    seen = _seen(t, period)
    return dispersion(seen, BLOCK, SEEN, "dispersion_ms", rows=_individual(seen))


def _by_size(rows: DataFrame, value: str, probs: dict[str, float], min_observations: int) -> DataFrame:
    label = range_label(F.col("post_kb"), EDGES_KB, size_labels(numbered=True))
    aggs = [F.avg("post_kb").alias("bin_mid_kb"), F.count("*").alias("observations")]
    out = agg_with_quantiles(rows.withColumn("bin_label", label), ["bin_label"], aggs, value, probs)
    out = out.withColumns({c: tidy(c, 0) for c in ("bin_mid_kb", *probs)})
    return min_sample(out, "observations", min_observations).orderBy("bin_label")


def arrival_by_size(t: Tables, period: Period = WEEK, min_observations: int = 1000) -> DataFrame:
    rows = _individual(_seen(t, period)).join(_blocks(t, period), BLOCK)
    return _by_size(rows, SEEN, {"p50_seen_ms": 0.5, "p95_seen_ms": 0.95, "p99_seen_ms": 0.99}, min_observations)


def dispersion_by_size(t: Tables, period: Period = WEEK, min_observations: int = 1000) -> DataFrame:
    rows = _dispersed(t, period).join(_blocks(t, period), BLOCK)
    probs = {"p50_disp_ms": 0.5, "p75_disp_ms": 0.75, "p95_disp_ms": 0.95, "p99_disp_ms": 0.99}
    return _by_size(rows, "dispersion_ms", probs, min_observations)


def dispersion_by_size_and_source(t: Tables, period: Period = WEEK, min_observations: int = 200) -> DataFrame:
    """Relay-built and local blocks side by side."""
    blocks = _blocks(t, period).where(F.col("pre_kb").isNotNull())
    blocks = membership_flag(blocks, t.latest("fct_block_mev", period), BLOCK, "_relayed")
    rows = _dispersed(t, period).join(blocks, BLOCK)
    rows = rows.select(
        range_label(F.col("post_kb"), EDGES_KB, size_labels(numbered=False)).alias("size_bin"),
        range_label(F.col("post_kb"), EDGES_KB, STARTS_KB).alias("sort_key"),
        F.when(F.col("_relayed"), "mev").otherwise("local").alias("side"),
        "pre_kb",
        "dispersion_ms",
    )
    keys, levels, sides = ["size_bin", "sort_key"], (50, 75, 95, 99), ("mev", "local")
    counted = counted_values(rows, [*keys, "side"], "dispersion_ms", sums={"_pre": F.sum("pre_kb")})
    found = quantiles_of(counted, [*keys, "side"], {f"p{q}": q / 100 for q in levels}, {"n": COUNT, "pre": "sum(_pre)"})

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    out = found.groupBy(*keys).agg(
        tidy(F.sum("pre") / F.sum("n"), 0).alias("avg_pre_kb"),
        *[F.coalesce(of(side, "n"), F.lit(0)).alias(f"{side}_n") for side in sides],
        *[tidy(of(side, f"p{q}"), 0).alias(f"{side}_p{q}") for side in sides for q in levels],
    )
    return out.where(F.col("mev_n") + F.col("local_n") >= min_observations).orderBy("sort_key")


def headline_by_source(t: Tables, period: Period = WEEK) -> DataFrame:
    """Block count and central figures per source, all from one reading of the joined blocks."""
    blocks = membership_flag(
        t.latest("fct_block_head", period), t.latest("fct_block_mev", period), BLOCK, "_relayed"
    ).withColumn("source", F.when(F.col("_relayed"), "MEV-Boost").otherwise("Local"))
    rows = blocks.join(first_seen(_seen(t, period), BLOCK, SEEN, "t_first"), BLOCK)
    # A row counts once as a block and gives one value to each measure.
    measures = rows.select(
        "source",
        F.expr(
            """stack(5, 'blocks', 1D, 'pre', cast(block_total_bytes as double),
            'post', cast(block_total_bytes_compressed as double), 'gas', cast(execution_payload_gas_used as double),
            'first', cast(t_first as double)) as (measure, value)"""
        ),
    )
    found = summarize(measures, ["source", "measure"], "value", {"p50": 0.5, "p95": 0.95}, values=COUNT)

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    return found.groupBy("source").agg(
        of("blocks", "values").alias("blocks"),
        tidy(of("pre", "p50") / 1024, 0).alias("p50_pre_kb"),
        tidy(of("post", "p50") / 1024, 0).alias("p50_post_kb"),
        tidy(of("pre", "p95") / 1024, 0).alias("p95_pre_kb"),
        tidy(of("gas", "p50") / 1e6, 1).alias("p50_gas_M"),
        tidy(of("first", "p50"), 0).alias("p50_t_first_ms"),
        tidy(of("first", "p95"), 0).alias("p95_t_first_ms"),
    ).orderBy("source")
