import random

import pytest

from helpers import final_plan, rows
from slotwise.operators import ranges


def _brute(pairs, points):
    out = {}
    for low, high in pairs:
        inside = [p for p in points if low <= p < high]
        out[(low, high)] = max(inside) if inside else None
    return out


@pytest.mark.parametrize("width,levels", [(4, 1), (4, 3), (64, 2), (4096, 1)])
def test_range_max_equals_nested_loop(spark, width, levels):
    rng = random.Random(width * 10 + levels)
    points = sorted({rng.randint(0, 3000) for _ in range(120)})
    pairs = [(low, low + rng.choice([1, 2, 3, 50, 900])) for low in (rng.randint(-5, 3000) for _ in range(300))]
    # A third of all questions fall on one position.
    pairs += [(10, 700)] * 150
    asked = spark.createDataFrame(pairs, "low bigint, high bigint")
    known = spark.createDataFrame([(p,) for p in points + points[:20]], "p bigint")
    out = ranges.range_max(asked, known, "low", "high", "p", "found", width=width, levels=levels)
    got = {(r["low"], r["high"]): r["found"] for r in out.collect()}
    assert got == _brute(pairs, points)


def test_next_after_by_key(spark):
    points = spark.createDataFrame([("a", 5), ("a", 900), ("b", 7)], "k string, t bigint")
    asked = spark.createDataFrame([("a", 5), ("a", 4), ("a", 899), ("a", 900), ("b", -3), ("c", 1)], "k string, t bigint")
    out = ranges.next_after(asked, points, "t", "t", "nxt", ["k"], width=8, levels=2)
    assert rows(out) == [("a", 4, 5), ("a", 5, 900), ("a", 899, 900), ("a", 900, None), ("b", -3, 7), ("c", 1, None)]


def test_no_nested_loop_in_plan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    asked = orders.selectExpr("o_orderkey - 5 as low", "o_orderkey as high")
    plan = final_plan(ranges.range_max(asked, orders.where("o_orderstatus = 'F'"), "low", "high", "o_orderkey", "m"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
