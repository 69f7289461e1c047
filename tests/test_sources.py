import pytest
from pyspark.sql import functions as F

from helpers import final_plan, planned, rows
from slotwise.sources import Period, ResultStore, latest_version, scan_window
from slotwise.sources.results import fingerprint, shared_root
from slotwise.sources.scan import Clock
from slotwise.sources.tables import Tables


def test_latest_version_with_ties(spark):
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 5), ("a", 2, 7), ("b", 1, None), ("b", None, 3)], "k string, version int, v int"
    )
    assert rows(latest_version(df, ["k"], "version", ["v"])) == [("a", 2, 7), ("b", 1, None)]


def test_latest_version_limits_before_the_shuffle(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = final_plan(latest_version(lines, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey"]))
    assert plan.count("WindowGroupLimit") >= 1


def test_period_is_half_open_and_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kept = scan_window(events, "ts", Period("2024-01-02", "2024-01-03"))
    days = {str(r[0]) for r in kept.select(F.to_date("ts")).distinct().collect()}
    assert days <= {"2024-01-02"}
    plan = planned(kept.select("user_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_declared_columns_must_be_there(spark):
    df = spark.createDataFrame([(1, "r"), (1, "r")], "slot bigint, block_root string")
    t = Tables({"fct_block_blob_count_head": df, "blob_submitter": df})
    with pytest.raises(ValueError, match="updated_date_time"):
        t.latest("fct_block_blob_count_head")
    with pytest.raises(ValueError, match="meta_network_name"):
        t.window("blob_submitter")
    t.reduced, t.network = True, None
    assert t.latest("fct_block_blob_count_head").count() == 2 == t.window("blob_submitter").count()


def test_network_filter(spark):
    df = spark.createDataFrame([("mainnet", 1), ("other", 2)], "meta_network_name string, v int")
    assert Tables({"blob_submitter": df}).window("blob_submitter").count() == 1


def test_fingerprint_ignores_whitespace_only():
    assert fingerprint(" select  1\n from t ") == fingerprint("select 1 from t")
    assert fingerprint("select 1") != fingerprint("SELECT 1")
    assert len(fingerprint("x")) == 16


def test_store_hits_bypasses_and_empty_results(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "a")], "n int, t string")

    first, second = store.materialize("q  1", build), store.materialize("q 1", build)
    assert rows(first) == rows(second) == [(1, "a")] and len(calls) == 1
    for text in ("q -- nocache", "q @nocache", "select now ( )", "select TODAY()"):
        assert store.bypasses(text)
    assert store.bypasses("q", "x.live.sql") and not store.bypasses("q", "x.sql")
    assert ResultStore(spark, "/nowhere", enabled=False).bypasses("q")
    empty = store.materialize("none", lambda: build().where("n > 5"))
    assert empty.count() == 0 and empty.columns == ["n", "t"]
    assert rows(store.result_view("demo.one", "q 1")) == rows(spark.table("demo_one"))


def test_a_refresh_that_dies_or_runs_twice_leaves_one_whole_result(spark, tmp_path):
    store, text = ResultStore(spark, str(tmp_path)), "q"
    one, two = (spark.createDataFrame([(n,)], "n int") for n in (1, 2))

    class Dies:
        write = property(lambda self: (_ for _ in ()).throw(RuntimeError("lost")))

    one.write.parquet(f"{store.path(text)}/version-dead")  # written, never published
    assert not store.stored(text)
    with pytest.raises(RuntimeError):
        store.publish(text, Dies())
    assert not store.stored(text)
    assert rows(store.materialize(text, lambda: one)) == [(1,)]
    reading = spark.read.parquet(store.published(text))
    store.publish(text, two)  # a second job switches the pointer; who reads goes on reading
    assert rows(reading) == [(1,)]
    assert rows(store.materialize(text, lambda: one)) == [(2,)]


def test_views_of_two_names_never_meet(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path))
    store.result_view("a.b_c", "select 1 as n")
    store.result_view("a.b_c", "select 1 as n")
    with pytest.raises(ValueError, match="a_b_c"):
        store.result_view("a_b.c", "select 2 as n")


def test_a_period_cuts_slots_where_there_is_no_time(spark, tmp_path):
    clock = Clock(1_606_824_023, 12)
    assert clock.slots(Period("2020-12-01 12:00:23", "2020-12-01 12:00:47")) == (0, 2)
    assert clock.slots(Period("2020-12-01 12:00:24", None)) == (1, None)
    assert clock.slots(Period("2019-01-01")) == (0, None)
    counts = spark.range(100).select(F.col("id").alias("slot"), F.lit(1).alias("blob_count"), F.lit(0).cast("timestamp").alias("updated_date_time"))
    counts.write.parquet(f"{tmp_path}/counts")
    t = Tables({"fct_block_blob_count_head": spark.read.parquet(f"{tmp_path}/counts")})
    period = Period("2020-12-01 12:02:23", "2020-12-01 12:04:23")
    cut = t.latest("fct_block_blob_count_head", period)
    assert [r.slot for r in cut.orderBy("slot").collect()] == list(range(10, 20))
    assert "PushedFilters: [IsNotNull(slot), GreaterThanOrEqual(slot,10), LessThan(slot,20)]" in planned(cut)
    t.network = "elsewhere"  # no known clock: read whole
    assert t.latest("fct_block_blob_count_head", period).count() == 100


def test_shared_root_follows_the_session(spark):
    class Named:
        """A session whose cluster names a shared folder."""

        class conf:
            @staticmethod
            def get(key, default=None):
                return "/shared/folder/" if key == "spark.checkpoint.dir" else default

    assert shared_root(Named) == "/shared/folder"

    class Unnamed:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Unnamed)
