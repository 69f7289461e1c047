import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import final_plan, rows
from slotwise.operators import quantiles as Q
from slotwise.operators.cells import ordered_cells

PROBS = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "low": 0.0, "high": 1.0}


def _data():
    rng = random.Random(7)
    out = [("hot", rng.gauss(0, 1)) for _ in range(4000)]
    out += [("ties", float(rng.randint(0, 3))) for _ in range(500)]
    # Far outliers on both sides of a narrow bulk.
    out += [("outlier", 1e12 + rng.random()) for _ in range(500)] + [("outlier", -1e15), ("outlier", 1e18)]
    out += [("one", 5.0), (None, 1.0), (None, 2.0), ("tail", 0.0)]
    out += [("tail", 10.0 ** rng.uniform(-6, 9)) for _ in range(800)]
    return out


@pytest.mark.parametrize("parts", [None, 1, 13])
def test_exact_quantiles_match_brute_force(spark, parts):
    data = _data()
    df = spark.createDataFrame(data, "k string, v double").repartition(7)
    got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], "v", PROBS, parts=parts).collect()}
    assert set(got) == {k for k, _ in data}
    for key in got:
        values = np.array([v for k, v in data if k == key])
        for name, q in PROBS.items():
            assert got[key][name] == pytest.approx(float(np.quantile(values, q)), rel=1e-9, abs=1e-9), (key, name)


def test_null_values_and_empty_groups_are_left_out(spark):
    df = spark.createDataFrame([("a", None), ("a", 3), ("b", None)], "k string, v bigint")
    assert rows(Q.exact_quantiles(df, ["k"], "v", {"m": 0.5})) == [("a", 3.0)]


def test_summaries_come_from_counted_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 9)], "k string, v bigint")
    out = Q.summarize(df, ["k"], "v", {"m": 0.5}, n=Q.COUNT, mean=Q.MEAN, low=Q.LOW, high=Q.HIGH, total=Q.TOTAL)
    got = rows(out.select("k", "n", "mean", "low", "high", "total", "m"))
    assert got == [("a", 3, 5 / 3, 1, 2, 5, 2.0), ("b", 1, 9.0, 9, 9, 9, 9.0)]


def test_weights_stand_for_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 10, 1), ("a", 20, 2)], "k string, v bigint, w bigint")
    got = Q.exact_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.9}, weight="w").first()
    plain = [1, 1, 1, 10, 20, 20]
    assert (got["m"], got["q"]) == (np.quantile(plain, 0.5), np.quantile(plain, 0.9))


def test_without_keys_no_nested_loop(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 500).cast("double").alias("v"), F.lit(2).alias("w"))
    out = Q.summarize(df, [], "v", {"m": 0.5, "q": 0.9}, n=Q.COUNT, top=Q.HIGH)
    values = [i * 7 % 500 for i in range(1000)]
    assert rows(out.select("m", "q", "n", "top")) == [(np.quantile(values, 0.5), np.quantile(values, 0.9), 1000, 499.0)]
    assert not any(word in final_plan(out) for word in ("NestedLoop", "Cartesian"))
    both = Q.agg_with_quantiles(df, [], [F.sum("w").alias("s")], "v", {"m": 0.5})
    assert rows(both) == [(2000, np.quantile(values, 0.5))]


def test_nested_clusters_leave_no_large_cell(spark):
    """Clusters inside clusters, a millionth as wide each, between far outliers: no sorted cell holds much."""
    scales = [F.lit(1e6) + F.col("id"), F.lit(5.0) + F.col("id") / 1e9, F.lit(5.0) + F.col("id") / 1e14, F.lit(-1e15) * F.col("id")]
    each, parts = 5000, 20
    df = spark.createDataFrame([], "v double")
    for scale in scales:
        df = df.union(spark.range(each).select(scale.alias("v")))
    values = np.array([r.v for r in df.collect()])
    probs = PROBS | {"p33": 0.33, "p34": 0.34, "p60": 0.6}
    for keys, rows_of in (([], df), (["k"], df.withColumn("k", F.lit("x")))):
        got = Q.exact_quantiles(rows_of, keys, "v", probs, parts=parts).first()
        assert all(got[name] == pytest.approx(float(np.quantile(values, q)), rel=1e-12) for name, q in probs.items())
        cells = ordered_cells(Q.counted_values(rows_of, keys, "v"), keys, ["_v"], F.sum("_n"), parts).collect()
        assert len(cells) > parts // 2
        assert max(c._mass for c in cells) <= 3 * len(values) / parts
        assert sorted(c._before for c in cells)[-1] < len(values)


def test_a_frequent_value_is_one_row(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("double").alias("v"))
    assert Q.counted_values(df, [], "v").count() == 3001
    values = [float(i) if i % 10 == 0 else 7.0 for i in range(30_000)]
    got = Q.exact_quantiles(df, [], "v", PROBS, parts=8).first()
    assert all(got[name] == np.quantile(values, q) for name, q in PROBS.items())


def test_value_shuffle_is_shared_and_group_is_not_gathered(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = final_plan(Q.exact_quantiles(lines, ["l_returnflag"], "l_extendedprice", {"m": 0.5}))
    assert "ReusedExchange" in plan
    assert "percentile" not in plan
    assert "Python" not in plan and "NestedLoop" not in plan
