from pyspark.sql import functions as F

from helpers import rows
from slotwise.functions import arrays
from slotwise.functions import timeparts as tp
from slotwise.functions.labels import (
    blank_default,
    histogram_bin,
    id_bucket,
    label_like,
    label_lookup,
    null_default,
    percentage,
    range_label,
    ratio,
    tidy,
)


def test_like_ladder_first_hit_wildcard_and_null(spark):
    df = spark.createDataFrame([("abc_x",), ("abcZx",), ("lido",), (None,), ("other",)], "v string")
    label = label_like(F.col("v"), [("abc_x%", "first"), ("abc%", "second"), ("lido", "exact")], "rest", "none")
    got = [r[0] for r in df.select(label).collect()]
    # The underscore stands for any character; equality patterns match whole values.
    assert got == ["first", "first", "exact", "none", "rest"]
    without_null_label = label_like(F.col("v"), [("abc%", "hit")], "rest")
    assert [r[0] for r in df.select(without_null_label).collect()] == ["hit", "hit", "rest", "rest", "rest"]


def test_null_and_label_fall_into_one_group(spark):
    """A missing entity and one already named like the default are one group."""
    df = spark.createDataFrame([(None,), ("unknown",), ("",), ("a",)], "entity string")
    one = df.withColumn("label", null_default(F.col("entity"), "unknown")).groupBy("label").count()
    assert rows(one) == [("", 1), ("a", 1), ("unknown", 2)]
    both = df.withColumn("label", blank_default(F.col("entity"), "unknown")).groupBy("label").count()
    assert rows(both) == [("a", 1), ("unknown", 3)]


def test_lookup_keeps_unlisted_values_without_default(spark):
    df = spark.createDataFrame([("x",), ("y",)], "v string")
    assert [r[0] for r in df.select(label_lookup(F.col("v"), {"x": "ex"})).collect()] == ["ex", "y"]
    assert [r[0] for r in df.select(label_lookup(F.col("v"), {"x": "ex"}, "no")).collect()] == ["ex", "no"]


def test_ranges_bins_and_buckets(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (7199,), (7200,)], "v bigint")
    assert [r[0] for r in df.select(range_label(F.col("v"), [10, 100], ["a", "b", "c"])).collect()] == list("aabcc")
    assert [r[0] for r in df.select(histogram_bin(F.col("v"), 250)).collect()] == [0, 0, 0, 7000, 7000]
    assert [r[0] for r in df.select(id_bucket(F.col("v"), 7200)).collect()] == [0, 0, 0, 0, 7200]


def test_zero_denominators_give_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a bigint, b bigint")
    got = df.select(ratio(F.col("a"), F.col("b")), percentage(F.col("a"), F.col("b"), 1)).collect()
    assert [tuple(r) for r in got] == [(None, None), (0.25, 25.0)]


def test_tidy_drops_binary_noise(spark):
    df = spark.createDataFrame([(48.349999999999994,), (48.35,), (2.675,), (-12.5,)], "v double")
    assert [r[0] for r in df.select(tidy(F.col("v"), 1)).collect()] == [48.4, 48.4, 2.7, -12.5]
    assert [r[0] for r in df.select(tidy(F.col("v"))).collect()][3] == -13.0


def test_slot_arithmetic(spark):
    df = spark.sql("select timestamp_seconds(1606824023 + 12 * 100 + 7) as t, timestamp_millis((1606824023 + 1200) * 1000L) as s")
    got = df.select(
        tp.slot_number(F.col("t")), tp.seconds_into_slot(F.col("t")), tp.sub_window(F.col("t"), F.col("s"), 200)
    ).first()
    assert tuple(got) == (100, 7, 35)
    ntz = spark.sql("select timestamp_ntz '2024-01-03 05:06:07' as t")
    labels = ntz.select(tp.hour_label(F.col("t")), tp.week(F.col("t")).cast("string"), tp.seconds(F.col("t"))).first()
    assert tuple(labels) == ("01-03 05:00", "2024-01-01", 1704258367)


def test_arrays_null_and_empty(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],), (None,)], "v array<string>")
    got = df.select(arrays.length(F.col("v")), arrays.count_matching(F.col("v"), "a"), arrays.contains(F.col("v"), "a"))
    assert [tuple(r) for r in got.collect()] == [(3, 2, True), (0, 0, False), (0, 0, False)]
