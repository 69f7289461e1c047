import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import final_plan, rows
from slotwise.operators import aggregates as agg
from slotwise.operators import joins, reshape, series, shares
from slotwise.operators.cells import ordered_cells


def test_shares_add_up(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 4), (None, "x", 3)], "k string, c string, n bigint")
    total = shares.share_of_total(df, "n", "pct")
    assert math.isclose(sum(r["pct"] for r in total.collect()), 100.0)
    inside = shares.share_in_group(df, ["k"], "n", "pct").groupBy("k").agg(F.round(F.sum("pct"), 9).alias("s"))
    assert [r["s"] for r in inside.collect()] == [100.0, 100.0, 100.0]


def test_rank_forms_agree_with_a_window(spark):
    data = [(b, (i * 37) % 11, f"n{i}") for b in range(5) for i in range(20)]
    df = spark.createDataFrame(data, "b int, t bigint, n string")
    member = F.col("n") == "n7"
    brute = []
    for b in range(5):
        ordered = sorted((t, n) for bb, t, n in data if bb == b)
        brute += [(b, t, n, i + 1, 20) for i, (t, n) in enumerate(ordered) if n == "n7"]
    assert rows(shares.rank_of_members(df, ["b"], ["t", "n"], member)) == sorted(brute)
    assert rows(shares.ranks_in_cells(df, ["b"], ["t", "n"], member, parts=7)) == sorted(brute)
    every = shares.ranks_in_cells(df, ["b"], ["t", "n"], F.lit(True), parts=3)
    assert [r["rank"] for r in every.orderBy("b", "t", "n").collect()] == list(range(1, 21)) * 5


def test_one_frequent_value_is_ranked_in_many_cells(spark):
    """Nine rows of ten share the first order column; no cell is larger than a few range partitions."""
    n, parts = 20_000, 16
    df = spark.range(n).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(5).alias("t"), "id")
    cells = ordered_cells(df, [], ["t", "id"], F.count("*"), parts).collect()
    assert len(cells) > parts // 2 and max(c._mass for c in cells) <= 3 * n / parts
    member = F.col("id") % 7 == 0
    for keys in ([], ["g"]):
        window = Window.partitionBy(*keys).orderBy("t", "id")
        whole = df.withColumns({"rank": F.row_number().over(window), "group_size": F.count("*").over(Window.partitionBy(*keys))})
        want = whole.where(member).select(*keys, "t", "id", "rank", "group_size")
        assert rows(shares.ranks_in_cells(df, keys, ["t", "id"], member, parts)) == rows(want)


def test_shares_and_ranks_without_keys(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n bigint")
    assert rows(shares.share_in_group(df, [], "n", "pct")) == [("a", 1, 25.0), ("b", 3, 75.0)]
    assert rows(shares.rank_of_members(df, [], ["n", "k"], F.col("k") == "b")) == [(3, "b", 2, 2)]


def test_a_member_with_several_rows_is_refused(spark):
    df = spark.createDataFrame([("g", 1, "a"), ("g", 2, "a"), ("g", 2, "b")], "g string, t int, n string")
    with pytest.raises(Exception, match="several rows of the member"):
        shares.rank_of_members(df, ["g"], ["t", "n"], F.col("n") == "a").collect()


def test_winner_on_ties_is_the_smaller_member(spark):
    df = spark.createDataFrame([(1, "z", 5), (1, "a", 5), (1, "b", 9), (2, "q", 1)], "k int, m string, v int")
    assert rows(agg.winners(df, ["k"], "m", "v", "w")) == [(1, "a"), (2, "q")]


def test_residual_of_nothing_known(spark):
    known = spark.createDataFrame([], "g string, n bigint")
    total = spark.createDataFrame([(7,)], "n bigint")
    assert rows(agg.residual_group(known, total, "g", "Other", ["n"])) == [("Other", 7)]


def test_novel_and_repeat_make_all(spark):
    df = spark.createDataFrame([("m", 1), ("m", 1), ("m", 3), ("n", 3), ("n", 0)], "m string, b bigint")
    assert rows(agg.novel_vs_repeat(df, ["m"], "b", "novel", "again")) == [(0, 1, 0), (1, 2, 0), (3, 0, 2)]


def test_zscores_of_equal_values_are_null(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r["z_score"] for r in agg.zscores(df, "v").collect()] == [None, None]


def test_class_and_colour_differ_at_two(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (2.0,), (2.1,)], "z double")
    got = df.select(agg.zscore_class(F.col("z"), ["low", "mid", "high"]), reshape.bar_colour(F.col("z"))).collect()
    assert [r[0] for r in got] == ["low", "mid", "mid", "high"]
    assert [r[1] for r in got] == ["#22c55e", "#eab308", "#ef4444", "#ef4444"]


def test_names_multiply_and_fill(spark):
    left = spark.createDataFrame([("0xA", 1), ("0xb", 2), ("0xc", 3)], "a string, n int")
    names = spark.createDataFrame([("0xa--", "x"), ("0xa", "x"), ("0xA", "y"), ("0xb", "")], "address string, name string")
    key = F.lower(F.substring("address", 1, 3))
    out = joins.attach_names(left, names, F.lower("a"), key, "name", "entity", "Unknown")
    assert rows(out.select("a", "entity")) == [("0xA", "x"), ("0xA", "y"), ("0xb", "Unknown"), ("0xc", "Unknown")]


def test_membership_and_control_groups(spark):
    df = spark.createDataFrame([(1, "S"), (1, "E"), (2, "S"), (3, "E"), (1, "S")], "k int, s string")
    assert {r["k"] for r in joins.with_every_outcome(df, ["k"], "s", ["S", "E"]).collect()} == {1}
    marked = joins.membership_flag(df, spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "in_set")
    assert marked.count() == 5 and marked.where("in_set").count() == 3


def test_null_keys_join(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert rows(joins.null_safe_join(left, right, ["k"])) == [("a", 2, 20), (None, 1, 10)]


def test_running_total_and_previous_value_across_buckets(spark):
    data = [("a", t, float(t % 7)) for t in range(0, 500, 3)] + [("b", 1000, 1.0)]
    df = spark.createDataFrame(data, "k string, t bigint, v double")
    got = {(r["k"], r["t"]): r["c"] for r in series.running_total(df, ["k"], "t", "v", "c", parts=4).collect()}
    back = {(r["k"], r["t"]): r["p"] for r in series.previous_value(df, ["k"], "t", "v", "p", parts=4).collect()}
    total, last = {}, {}
    for k, t, v in data:
        total[k] = total.get(k, 0.0) + v
        assert got[(k, t)] == pytest.approx(total[k])
        assert back[(k, t)] == last.get(k)
        last[k] = v


def test_one_busy_second_spreads_over_cells(spark):
    """All rows of the busy key lie in one second; the number of the row orders them."""
    n, parts = 12_000, 12
    df = spark.range(n).select(F.when(F.col("id") % 20 == 0, "calm").otherwise("busy").alias("k"), F.lit(7).alias("t"), "id", (F.col("id") % 13).alias("v"))
    cells = ordered_cells(df, ["k"], ["t", "id"], F.count("*"), parts).collect()
    assert max(c._mass for c in cells) <= 3 * n / parts and len(cells) >= parts // 2
    window = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumns({"c": F.sum("v").over(window), "p": F.lag("v").over(window)})
    got = series.previous_value(series.running_total(df, ["k"], "t", "v", "c", ["id"], parts), ["k"], "t", "v", "p", ["id"], parts)
    assert rows(got) == rows(want)
    alone = Window.orderBy("t", "id")
    assert rows(series.running_total(df, [], "t", "v", "c", ["id"], parts)) == rows(df.withColumn("c", F.sum("v").over(alone)))


def test_counter_restart_counts_the_new_reading(spark):
    df = spark.createDataFrame([("a", 0, 10.0), ("a", 60, 40.0), ("a", 120, 5.0)], "k string, t bigint, c double")
    out = rows(series.counter_rate(df, ["k"], "t", "c", window=120, step=60))
    assert out == [("a", 0, 0.0), ("a", 60, 30 / 120), ("a", 120, 35 / 120)]


def test_flat_stretches_have_rate_zero(spark):
    data = [("a", t, c) for t, c in [(0, 5.0), (60, 5.0), (120, 11.0), (180, 11.0), (600, 11.0)]]
    df = spark.createDataFrame(data, "k string, t bigint, c double")
    out = rows(series.counter_rate(df, ["k"], "t", "c", window=120, step=60))
    assert [r[1] for r in out] == list(range(0, 601, 60))
    assert {r[1]: r[2] for r in out if r[2]} == {120: 6 / 120, 180: 6 / 120}


def test_pivot_dense_axis_and_totals(spark):
    df = spark.createDataFrame([("d1", "a", 2), ("d1", "b", 3), ("d2", "a", 4)], "d string, c string, n bigint")
    assert rows(reshape.pivot_fill(df, ["d"], "c", "n", ["a", "b"])) == [("d1", 2, 3), ("d2", 4, 0)]
    assert rows(reshape.pivot_fill(df, ["d"], "c", "n", ["a", "b"], fill=None)) == [("d1", 2, 3), ("d2", 4, None)]
    dense = spark.createDataFrame([("k", 1, 9)], "k string, p int, n bigint")
    assert rows(reshape.dense_axis(dense, ["k"], "p", 0, 2, {"n": 0})) == [("k", 0, 0), ("k", 1, 9), ("k", 2, 0)]
    sums = spark.createDataFrame([("g", 0, 0), ("h", 1, 3)], "g string, new bigint, again bigint")
    out = reshape.group_totals(sums, ["g"], ["new", "again"], ("again", "new", "share"))
    assert rows(out) == [("g", 0, 0, 0.0), ("h", 1, 3, 0.75)]


def test_top_lists_do_not_gather_rows(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n"))
    best = shares.top_ranked(df, [F.col("n").desc(), F.col("id")], 3)
    assert rows(best) == [(6, 6, 1), (13, 6, 2), (20, 6, 3)]
    assert "TakeOrderedAndProject" in final_plan(best)
