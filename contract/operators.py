"""The operators one by one over the given tables, each with its check SQL.

"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract.registry import Given, Registry
from contract.sqltools import big, ladder, pct, quant, rnd
from slotwise.functions import arrays
from slotwise.functions import timeparts as tp
from slotwise.functions.labels import (
    blank_default,
    clamped_utilization,
    extract_group,
    histogram_bin,
    id_bucket,
    label_like,
    label_lookup,
    normalise_key,
    percentage,
    position_in,
    range_label,
    ratio,
    tidy,
)
from slotwise.operators import aggregates as agg
from slotwise.operators import joins, quantiles, ranges, reshape, shares
from slotwise.sources import Period, ResultStore, inline_rows, latest_version, scan_window, snapshot_scan
from slotwise.sources.results import shared_root

registry = Registry()
query = registry.add

# Rows of a derived chain used by several checks: order with its parent order.
PARENT_SQL = """p as (select o.o_orderkey as slot, o.o_orderkey - 1 - o.o_custkey % 5 as parent_slot, o.o_orderstatus as status
                 from orders o where o.o_orderkey - 1 - o.o_custkey % 5 >= 0)"""


def _line_final(d: Given) -> DataFrame:
    return latest_version(
        d.lineitem, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_extendedprice", "l_partkey", "l_suppkey"]
    )


def _parent_links(d: Given) -> DataFrame:
    child = d.orders.select(
        F.col("o_orderkey").alias("slot"),
        (F.col("o_orderkey") - 1 - F.col("o_custkey") % 5).alias("parent_key"),
        F.col("o_orderstatus").alias("status"),
    )
    return joins.parent_child(child, d.orders, [("parent_key", "o_orderkey")], {"o_orderkey": "parent_slot"})


# --- sources ---------------------------------------------------------------


@query(
    """select event_type, count(*) as n, {v} as total_value from events
       where ts >= timestamp '2024-01-02' and ts < timestamp '2024-01-29' and event_type <> 'error' group by 1""".format(
        v=rnd("sum(value)", 4)
    )
)
def scan_window_src1(d: Given) -> DataFrame:
    rows = scan_window(d.events, "ts", Period("2024-01-02", "2024-01-29")).where(F.col("event_type") != "error")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), tidy(F.sum("value"), 4).alias("total_value"))


@query(
    """select l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice from lineitem
       qualify row_number() over (partition by l_orderkey, l_linenumber
                                  order by l_shipdate desc, l_extendedprice desc, l_partkey desc, l_suppkey desc) = 1"""
)
def latest_version_src2(d: Given) -> DataFrame:
    return _line_final(d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")


@query("select * from orders")
def snapshot_scan_src3(d: Given) -> DataFrame:
    return snapshot_scan(d.spark, f"{d.sf_dir}/orders.parquet")


@query(
    """select r_name, zone, count(*) as nations from
       (values (0, 'south'), (1, 'west'), (2, 'east'), (3, 'north'), (9, 'none')) v(id, zone)
       join region on id = r_regionkey join nation on n_regionkey = r_regionkey group by all"""
)
def inline_rows_src4(d: Given) -> DataFrame:
    zones = [(0, "south"), (1, "west"), (2, "east"), (3, "north"), (9, "none")]
    listed = inline_rows(d.spark, zones, "r_regionkey int, zone string")
    rows = d.region.join(listed, "r_regionkey").join(d.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "zone").agg(F.count("*").alias("nations"))


def _daily_events(d: Given) -> DataFrame:
    return d.events.groupBy(tp.day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


def _results_folder(spark) -> str:
    """The session's shared folder; a folder of this run where a local session names none."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="slotwise-"))
    return f"{shared_root(spark)}/results"


DAILY_SQL = "select ts::date as day, count(*) as n from events group by 1"


@query(DAILY_SQL)
def materialize_src5(d: Given) -> DataFrame:
    """Written on the first call, read on the second."""
    store = ResultStore(d.spark, _results_folder(d.spark))
    text = f"daily events of {d.sf_dir} in {d.spark.sparkContext.applicationId}"
    store.materialize(text, lambda: _daily_events(d))
    return store.materialize(text, lambda: _daily_events(d))


@query(DAILY_SQL)
def result_view_src6(d: Given) -> DataFrame:
    store = ResultStore(d.spark, _results_folder(d.spark))
    text = f"viewed events of {d.sf_dir} in {d.spark.sparkContext.applicationId}"
    store.result_view("events.daily", text, lambda: _daily_events(d))
    return d.spark.sql("select * from events_daily")


# --- projections, filters, labels ------------------------------------------


@query(
    """select o_orderstatus, count(*) as n, count(distinct o_custkey) as customers from orders
       where o_orderstatus in ('F', 'O') and o_orderpriority not in ('5-LOW') and o_totalprice between 2000 and 490000
         and o_orderpriority like '%-%' and (o_orderpriority like '%-H%' or o_totalprice >= 3000)
         and o_orderdate is not null and o_custkey <> 0 group by 1"""
)
def predicate_filter_prj1(d: Given) -> DataFrame:
    c, priority, total = F.col, F.col("o_orderpriority"), F.col("o_totalprice")
    rows = d.orders.where(
        c("o_orderstatus").isin("F", "O")
        & ~priority.isin("5-LOW")
        & total.between(2000, 490000)
        & priority.like("%-%")
        & (priority.like("%-H%") | (total >= 3000))
        & c("o_orderdate").isNotNull()
        & (c("o_custkey") != 0)
    )
    out = rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return out.join(agg.distinct_count(rows, ["o_orderstatus"], "o_custkey", "customers"), "o_orderstatus")


@query(
    """select case l_returnflag when 'A' then 'accepted' when 'R' then 'returned' else l_returnflag end as flag, count(*) as n
       from lineitem group by 1"""
)
def label_lookup_prj2(d: Given) -> DataFrame:
    flag = label_lookup(F.col("l_returnflag"), {"A": "accepted", "R": "returned"})
    return d.lineitem.groupBy(flag.alias("flag")).agg(F.count("*").alias("n"))


@query(
    """select case when p_name like 'red%' then 'red' when p_name like '%gear' then 'gear'
            when p_name like '_lue %' then 'blue' else 'plain' end as kind, count(*) as n from part group by 1"""
)
def label_like_prj3(d: Given) -> DataFrame:
    rules = [("red%", "red"), ("%gear", "gear"), ("_lue %", "blue")]
    return d.part.groupBy(label_like(F.col("p_name"), rules, "plain").alias("kind")).agg(F.count("*").alias("n"))


PRICE_EDGES = [50000, 100000, 150000, 200000, 300000, 400000]
PRICE_LABELS = ["<50k", "50-100k", "100-150k", "150-200k", "200-300k", "300-400k", "400k+"]


@query(
    f"""select {ladder('o_totalprice', PRICE_EDGES, PRICE_LABELS)} as price_range,
        {ladder('o_totalprice', PRICE_EDGES, list(range(7)))} as range_order, count(*) as n from orders group by all"""
)
def range_bucket_prj4(d: Given) -> DataFrame:
    total = F.col("o_totalprice")
    rows = d.orders.groupBy(
        range_label(total, PRICE_EDGES, PRICE_LABELS).alias("price_range"),
        range_label(total, PRICE_EDGES, list(range(7))).alias("range_order"),
    )
    return rows.agg(F.count("*").alias("n")).orderBy("range_order")


@query("select cast(floor(value / 25) * 25 as bigint) as bin, count(*) as n from events group by 1")
def histogram_bin_prj5(d: Given) -> DataFrame:
    return d.events.groupBy(histogram_bin(F.col("value"), 25).alias("bin")).agg(F.count("*").alias("n"))


CORES = "least(l_extendedprice / (l_quantity * 1e6), 0.0015)"


@query(
    f"""select l_returnflag, {rnd(f'avg({CORES})', 8)} as mean, {rnd(quant(CORES, 0.5), 8)} as p50,
        {rnd(quant(CORES, 0.9), 8)} as p90, {rnd(f'max({CORES})', 8)} as peak from lineitem group by 1"""
)
def clamped_utilization_prj6(d: Given) -> DataFrame:
    used = clamped_utilization(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(0.0015))
    rows = d.lineitem.select("l_returnflag", used.alias("used"))
    out = quantiles.summarize(
        rows, ["l_returnflag"], "used", {"p50": 0.5, "p90": 0.9}, mean=quantiles.MEAN, peak=quantiles.HIGH
    )
    return out.select("l_returnflag", *[tidy(c, 8).alias(c) for c in ("mean", "p50", "p90", "peak")])


@query(
    """select strftime(ts, '%m-%d %H:00') as hour, ts::date as day, date_trunc('week', ts)::date as week, count(*) as n
       from events group by all"""
)
def time_bucket_prj7(d: Given) -> DataFrame:
    ts = F.col("ts")
    keys = [tp.hour_label(ts).alias("hour"), tp.day(ts).alias("day"), tp.week(ts).alias("week")]
    return d.events.groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    """select case l_orderkey % 32 when 0 then 'epoch_start' when 31 then 'epoch_end' else 'mid_epoch' end as place,
              l_orderkey % 32 as position, count(*) as n from lineitem group by all"""
)
def cycle_position_prj8(d: Given) -> DataFrame:
    key = F.col("l_orderkey")
    return d.lineitem.groupBy(tp.cycle_label(key).alias("place"), tp.cycle_position(key).alias("position")).agg(
        F.count("*").alias("n")
    )


@query(
    """select event_type, cast((epoch_ms(ts) - epoch_ms(date_trunc('hour', ts))) // 300000 as int) as window_in_hour, count(*) as n
       from events group by all"""
)
def sub_window_prj8(d: Given) -> DataFrame:
    index = tp.sub_window(F.col("ts"), tp.hour(F.col("ts")), 300_000)
    return d.events.groupBy("event_type", index.alias("window_in_hour")).agg(F.count("*").alias("n"))


@query(
    """select (cast(floor(epoch(ts)) as bigint) - 1704067200) // 12 as slot, (cast(floor(epoch(ts)) as bigint) - 1704067200) % 12 as second,
              count(*) as n from events group by all"""
)
def slot_number_prj9(d: Given) -> DataFrame:
    ts = F.col("ts")
    slot, second = tp.slot_number(ts, 1704067200).alias("slot"), tp.seconds_into_slot(ts, 1704067200).alias("second")
    return d.events.groupBy(slot, second).agg(F.count("*").alias("n"))


@query("select o_orderkey // 720 * 720 as bucket, count(*) as n from orders group by 1")
def id_bucket_prj10(d: Given) -> DataFrame:
    return d.orders.groupBy(id_bucket(F.col("o_orderkey"), 720).alias("bucket")).agg(F.count("*").alias("n"))


HOST = r"^https?://[^/?#]*\.(com|org|net)([/?#]|$)"


@query(
    f"select regexp_extract(url, '{HOST}', 1) as suffix, count(*) as n from pages where regexp_matches(url, '{HOST}') group by 1"
)
def extract_group_prj11(d: Given) -> DataFrame:
    rows = d.pages.withColumn("suffix", extract_group(F.col("url"), HOST)).where(F.col("suffix") != "")
    return rows.groupBy("suffix").agg(F.count("*").alias("n"))


@query(
    """select coalesce(l_returnflag, 'no line') as flag, count(*) as n from orders left join lineitem on o_orderkey = l_orderkey group by 1"""
)
def null_default_prj12(d: Given) -> DataFrame:
    lines = d.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    rows = d.orders.join(lines, "o_orderkey", "left")
    return rows.groupBy(blank_default(F.col("l_returnflag"), "no line").alias("flag")).agg(F.count("*").alias("n"))


@query("select lower(c_name[:12]) as short_name, count(*) as n from customer group by 1")
def normalise_key_prj13(d: Given) -> DataFrame:
    return d.customer.groupBy(normalise_key(F.col("c_name"), 12).alias("short_name")).agg(F.count("*").alias("n"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def select_distinct_prj14(d: Given) -> DataFrame:
    return d.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("select *, o_totalprice > 250000 and o_orderstatus = 'F' as is_large from orders")
def star_plus_prj15(d: Given) -> DataFrame:
    return d.orders.withColumn("is_large", (F.col("o_totalprice") > 250000) & (F.col("o_orderstatus") == "F"))


@query(
    f"""select l_suppkey, count(*) as lines, {rnd('sum(l_quantity)', 2)} as quantity, {rnd('sum(l_quantity) / count(*)', 4)} as mean_quantity
        from lineitem group by 1"""
)
def alias_reuse_prj16(d: Given) -> DataFrame:
    rows = d.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    return rows.select(
        "l_suppkey", "lines", tidy("quantity", 2).alias("quantity"), tidy(ratio(F.col("quantity"), F.col("lines")), 4).alias("mean_quantity")
    )


# --- subqueries --------------------------------------------------------------


def _customer_scores(d: Given) -> DataFrame:
    """Median order value per customer, scored over all customers."""
    orders = quantiles.summarize(d.orders, ["o_custkey"], "o_totalprice", {"middle": 0.5}, orders=quantiles.COUNT)
    return agg.zscores(orders, "middle").withColumn(
        "class", agg.zscore_class(F.col("z_score"), ["low", "usual", "high"])
    )


SCORE_SQL = """e as (select o_custkey, count(*) as orders, median(o_totalprice) as middle from orders group by 1),
       s as (select *, (middle - avg(middle) over ()) / stddev_pop(middle) over () as z from e),
       c as (select *, case when z < 0 then 'low' when z <= 2 then 'usual' else 'high' end as class from s)"""


@query(
    f"""with {SCORE_SQL} select class, count(*) as customers, {big('sum(orders)')} as orders, {rnd('avg(middle)', 2)} as mean_middle
        from c group by 1"""
)
def cte_chain_sub1(d: Given) -> DataFrame:
    """Five steps: medians, mean and deviation, score, class, summary."""
    out = _customer_scores(d).groupBy("class")
    return out.agg(
        F.count("*").alias("customers"), F.sum("orders").alias("orders"), tidy(F.avg("middle"), 2).alias("mean_middle")
    )


@query(
    f"""select lines, count(*) as orders, {rnd('avg(quantity)', 4)} as mean_quantity from
        (select l_orderkey, count(*) as lines, sum(l_quantity) as quantity from lineitem group by 1) group by 1"""
)
def derived_table_sub2(d: Given) -> DataFrame:
    per_order = d.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    return per_order.groupBy("lines").agg(
        F.count("*").alias("orders"), tidy(F.avg("quantity"), 4).alias("mean_quantity")
    )


@query(
    """select o_orderstatus, o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R') as has_return, count(*) as n
       from orders group by all"""
)
def in_subquery_value_sub3(d: Given) -> DataFrame:
    returned = d.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = joins.membership_flag(d.orders, returned, ["o_orderkey"], "has_return")
    return rows.groupBy("o_orderstatus", "has_return").agg(F.count("*").alias("n"))


# --- joins -------------------------------------------------------------------


@query(
    f"""select c_mktsegment, l_returnflag, count(*) as lines, {rnd('sum(l_extendedprice)', 2)} as value
        from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by all"""
)
def inner_join_jn1(d: Given) -> DataFrame:
    """Lines are summed per (order, flag) before the joins."""
    sums = d.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_extendedprice").alias("v")
    )
    people = d.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = sums.join(d.orders.select("o_orderkey", "o_custkey"), "o_orderkey").join(people, "o_custkey")
    return rows.groupBy("c_mktsegment", "l_returnflag").agg(
        F.sum("n").alias("lines"), tidy(F.sum("v"), 2).alias("value")
    )


def _line_counts(d: Given) -> DataFrame:
    return d.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))


@query(
    """select o_orderkey, coalesce(lines, 0) as lines from orders
       left join (select l_orderkey, count(*) as lines from lineitem group by 1) on l_orderkey = o_orderkey"""
)
def left_join_fill_jn2(d: Given) -> DataFrame:
    return joins.left_fill(d.orders.select("o_orderkey"), _line_counts(d), ["o_orderkey"], {"lines": 0})


@query(
    f"""with {PARENT_SQL} select p.slot, p.parent_slot, p.slot - p.parent_slot as distance, p.status, q.o_orderstatus as parent_status
        from p join orders q on q.o_orderkey = p.parent_slot"""
)
def parent_child_jn3(d: Given) -> DataFrame:
    rows = d.orders.select(
        F.col("o_orderkey").alias("slot"),
        (F.col("o_orderkey") - 1 - F.col("o_custkey") % 5).alias("key"),
        F.col("o_orderstatus").alias("status"),
    )
    linked = joins.parent_child(
        rows, d.orders, [("key", "o_orderkey")], {"o_orderkey": "parent_slot", "o_orderstatus": "parent_status"}
    )
    return linked.select("slot", "parent_slot", (F.col("slot") - F.col("parent_slot")).alias("distance"), "status", "parent_status")


@query(
    f"""with {PARENT_SQL} select p.slot, p.parent_slot,
          (select max(c.o_orderkey) from orders c where c.o_orderstatus = 'F' and c.o_orderkey >= p.parent_slot and c.o_orderkey < p.slot) as newest
        from p where p.slot - p.parent_slot > 1"""
)
def range_max_jn4(d: Given) -> DataFrame:
    """Small buckets, so that the carry between buckets is used on every level."""
    asked = _parent_links(d).where(F.col("slot") - F.col("parent_slot") > 1)
    points = d.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("point"))
    return ranges.range_max(asked, points, "parent_slot", "slot", "point", "newest", width=64, levels=2).select(
        "slot", "parent_slot", "newest"
    )


@query(
    """select if((o_custkey, o_orderstatus) in (select (o_custkey, o_orderstatus) from orders where o_totalprice > 400000), 'listed', 'other') as source,
              count(*) as n from orders group by 1"""
)
def membership_flag_jn5(d: Given) -> DataFrame:
    big_orders = d.orders.where(F.col("o_totalprice") > 400000)
    rows = joins.membership_flag(d.orders, big_orders, ["o_custkey", "o_orderstatus"], "in_set")
    return rows.groupBy(F.when(F.col("in_set"), "listed").otherwise("other").alias("source")).agg(F.count("*").alias("n"))


@query(
    f"""with c as (select o_custkey, count(*) as orders from orders group by 1)
        select o_custkey, orders, {rnd('(orders - avg(orders) over ()) / stddev_pop(orders) over ()', 6)} as z_score from c"""
)
def scalar_statistics_jn6(d: Given) -> DataFrame:
    """Every row against one-row statistics, read as a scalar of the plan."""
    counts = d.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return agg.zscores(counts, "orders").withColumn("z_score", tidy("z_score", 6))


@query(
    """with t as (select string_split(p_name, ' ') as words, p_brand from part)
       select a.p_brand, count(*) as pairs from t a join t b on a.words = b.words and a.p_brand = b.p_brand group by 1"""
)
def array_key_join_jn7(d: Given) -> DataFrame:
    """Rows with equal arrays are counted on both sides before the join, so the
    pairs of a group are never listed."""
    words = d.part.select(F.split("p_name", " ").alias("words"), "p_brand")
    left = words.groupBy("words", "p_brand").agg(F.count("*").alias("n"))
    right = words.groupBy("words", "p_brand").agg(F.count("*").alias("m"))
    pairs = left.join(right, ["words", "p_brand"])
    return pairs.groupBy("p_brand").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"))


@query(
    f"""with e as (select ts::date - date '2024-01-01' as day_no, event_type, value from events),
        a as (select day_no, median(value) as view_p50 from e where event_type = 'view' group by 1),
        b as (select day_no - 1 as day_no, median(value) as next_click_p50 from e where event_type = 'click' group by 1)
        select day_no, {rnd('view_p50', 4)} as view_p50, {rnd('next_click_p50', 4)} as next_click_p50 from a join b using (day_no)"""
)
def offset_join_of_aggregates_jn8_jn10(d: Given) -> DataFrame:
    start = F.lit("2024-01-01").cast("date")
    rows = d.events.withColumn("day_no", F.date_diff(tp.day(F.col("ts")), start).cast("bigint"))

    def middle(kind: str, out: str) -> DataFrame:
        return quantiles.exact_median(rows.where(F.col("event_type") == kind), ["day_no"], "value", out)

    both = joins.shifted_join(middle("view", "view_p50"), middle("click", "next_click_p50"), "day_no", 1)
    return both.select("day_no", tidy("view_p50", 4).alias("view_p50"), tidy("next_click_p50", 4).alias("next_click_p50"))


@query(
    f"""with b as (select l_orderkey from lineitem where l_returnflag in ('R', 'A') group by 1 having count(distinct l_returnflag) = 2)
        select l_returnflag, count(*) as lines, {rnd('avg(l_extendedprice)', 4)} as mean_price, {rnd('median(l_extendedprice)', 4)} as median_price
        from lineitem semi join b using (l_orderkey) where l_returnflag in ('R', 'A') group by 1"""
)
def controlled_comparison_jn9(d: Given) -> DataFrame:
    lines = d.lineitem.where(F.col("l_returnflag").isin("R", "A"))
    rows = joins.with_every_outcome(lines, ["l_orderkey"], "l_returnflag", ["R", "A"])
    out = quantiles.summarize(
        rows, ["l_returnflag"], "l_extendedprice", {"median_price": 0.5}, lines=quantiles.COUNT, mean_price=quantiles.MEAN
    )
    return out.withColumns({c: tidy(c, 4) for c in ("mean_price", "median_price")})


@query(
    """with n as (select distinct lower(s_name) as k, case when s_suppkey % 3 = 0 then '' when s_suppkey % 3 = 1 then 'trader' else 'maker' end as label
                  from supplier union select lower(s_name), 'second' from supplier where s_suppkey % 10 = 4)
       select s_suppkey, coalesce(nullif(label, ''), 'Unknown') as label from supplier left join n on lower(s_name) = k"""
)
def attach_names_jn11(d: Given) -> DataFrame:
    """A supplier with two names gives two rows."""
    key = F.col("s_suppkey")
    label = F.when(key % 3 == 0, "").when(key % 3 == 1, "trader").otherwise("maker")
    names = d.supplier.select(F.upper("s_name").alias("n_key"), label.alias("label"))
    second = d.supplier.where(key % 10 == 4).select(F.upper("s_name").alias("n_key"), F.lit("second").alias("label"))
    named = joins.attach_names(
        d.supplier, names.unionByName(second), F.lower("s_name"), normalise_key(F.col("n_key")), "label", "named", "Unknown"
    )
    return named.select("s_suppkey", F.col("named").alias("label"))


@query("select o_orderkey, count(*) as lines from orders join lineitem on o_orderkey = l_orderkey group by 1")
def left_made_inner_jn12(d: Given) -> DataFrame:
    return d.orders.select("o_orderkey").join(_line_counts(d), "o_orderkey")


@query(
    """select coalesce(p_brand, 'unknown') as brand, count(distinct l_suppkey) as suppliers
       from lineitem left join (select p_partkey - p_partkey % 2 as k, p_brand from part) on l_partkey = k group by 1"""
)
def multi_match_join_jn13(d: Given) -> DataFrame:
    """Two brands per even key, none for odd keys; pairs are distinct before the join."""
    lines = d.lineitem.select(F.col("l_partkey").alias("k"), "l_suppkey").distinct()
    brands = d.part.select((F.col("p_partkey") - F.col("p_partkey") % 2).alias("k"), "p_brand")
    rows = lines.join(brands, "k", "left").withColumn("brand", F.coalesce("p_brand", F.lit("unknown")))
    return agg.distinct_count(rows, ["brand"], "l_suppkey", "suppliers")


# --- aggregations --------------------------------------------------------------


@query(
    f"""select l_returnflag, l_linestatus, count(*) as n, {rnd('sum(l_quantity)', 2)} as quantity, {rnd('avg(l_extendedprice)', 4)} as mean_price,
        min(l_extendedprice) as min_price, max(l_extendedprice) as max_price from lineitem group by all"""
)
def grouped_basic_ag1(d: Given) -> DataFrame:
    price = F.col("l_extendedprice")
    return d.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"),
        tidy(F.sum("l_quantity"), 2).alias("quantity"),
        tidy(F.avg(price), 4).alias("mean_price"),
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
    )


@query(
    f"""select l_suppkey, count(*) filter (l_returnflag = 'R') as returned, {rnd("avg(l_quantity) filter (l_returnflag = 'A')", 4)} as mean_accepted,
        min(l_extendedprice) filter (l_linestatus = 'O') as min_open, max(l_extendedprice) filter (l_linestatus = 'F') as max_final
        from lineitem group by 1"""
)
def conditional_agg_ag2(d: Given) -> DataFrame:
    flag, status, price = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_extendedprice")
    return d.lineitem.groupBy("l_suppkey").agg(
        F.count_if(flag == "R").alias("returned"),
        tidy(agg.conditional(F.avg, F.col("l_quantity"), flag == "A"), 4).alias("mean_accepted"),
        agg.conditional(F.min, price, status == "O").alias("min_open"),
        agg.conditional(F.max, price, status == "F").alias("max_final"),
    )


@query("select l_returnflag, count(distinct l_partkey) as parts from lineitem group by 1")
def exact_distinct_ag3(d: Given) -> DataFrame:
    return agg.distinct_count(d.lineitem, ["l_returnflag"], "l_partkey", "parts")


QS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@query(
    "select l_returnflag, l_linestatus, "
    + ", ".join(f"{rnd(quant('l_extendedprice', q), 4)} as {n}" for n, q in QS.items())
    + " from lineitem group by all"
)
def quantiles_ag4(d: Given) -> DataFrame:
    out = quantiles.exact_quantiles(d.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice", QS)
    return out.withColumns({n: tidy(n, 4) for n in QS})


@query(
    f"""select l_linestatus, {rnd(quant('l_extendedprice', 0.5) + " filter (l_returnflag = 'A')", 4)} as a_p50,
        {rnd(quant('l_extendedprice', 0.9) + " filter (l_returnflag = 'A')", 4)} as a_p90,
        {rnd(quant('l_extendedprice', 0.5) + " filter (l_returnflag = 'R')", 4)} as r_p50,
        {rnd(quant('l_extendedprice', 0.9) + " filter (l_returnflag = 'R')", 4)} as r_p90 from lineitem group by 1"""
)
def conditional_quantiles_ag5(d: Given) -> DataFrame:
    """Quantiles per (group, category) in one go, then one row per group."""
    rows = d.lineitem.where(F.col("l_returnflag").isin("A", "R"))
    found = quantiles.exact_quantiles(rows, ["l_linestatus", "l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9})
    cells = [
        tidy(F.max(F.when(F.col("l_returnflag") == flag, F.col(p))), 4).alias(f"{flag.lower()}_{p}")
        for flag in ("A", "R")
        for p in ("p50", "p90")
    ]
    return found.groupBy("l_linestatus").agg(*cells)


FIRST_SQL = "f as (select l_orderkey, min(l_shipdate) as ship, arg_min(l_suppkey, (l_shipdate, l_suppkey)) as first_supplier from lineitem group by 1)"


@query(f"with {FIRST_SQL} select l_orderkey, first_supplier from f")
def arg_extreme_ag6(d: Given) -> DataFrame:
    return agg.winners(d.lineitem, ["l_orderkey"], "l_suppkey", "l_shipdate", "first_supplier")


@query("select o_custkey, min(o_orderpriority) as any_priority from orders group by 1")
def any_value_ag7(d: Given) -> DataFrame:
    """A fixed member of the group: its smallest value."""
    return d.orders.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("any_priority"))


@query(f"with {SCORE_SQL} select o_custkey, orders, {rnd('middle', 4)} as middle, {rnd('z', 6)} as z_score, class from c")
def zscore_classify_ag8(d: Given) -> DataFrame:
    return _customer_scores(d).select(
        "o_custkey", "orders", tidy("middle", 4).alias("middle"), tidy("z_score", 6).alias("z_score"), "class"
    )


@query(
    f"select l_returnflag, {rnd('sum(l_extendedprice * l_discount) / sum(l_extendedprice)', 8)} as discount_rate from lineitem group by 1"
)
def ratio_of_sums_ag9(d: Given) -> DataFrame:
    rate = agg.ratio_of_sums(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice"))
    return d.lineitem.groupBy("l_returnflag").agg(tidy(rate, 8).alias("discount_rate"))


@query("select lines, count(*) as orders from (select count(*) as lines from lineitem group by l_orderkey) group by 1")
def histogram_of_counts_ag10(d: Given) -> DataFrame:
    return agg.counts_of_counts(d.lineitem, ["l_orderkey"], "lines", "orders")


@query(
    """with h as (select user_id, date_trunc('hour', ts) as h, count(distinct event_type) as kinds from events group by all),
       m as (select user_id, max(kinds) as most from h group by 1) select most, count(*) as users from m group by 1"""
)
def three_level_counts_ag10(d: Given) -> DataFrame:
    hourly = agg.distinct_count(d.events.withColumn("h", tp.hour(F.col("ts"))), ["user_id", "h"], "event_type", "kinds")
    most = hourly.groupBy("user_id").agg(F.max("kinds").alias("most"))
    return most.groupBy("most").agg(F.count("*").alias("users"))


@query("select o_custkey, count(*) as orders from orders group by 1 having count(*) >= 12 and min(o_totalprice) > 5000")
def min_sample_ag11(d: Given) -> DataFrame:
    out = d.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.min("o_totalprice").alias("low"))
    return agg.min_sample(out, "orders", 12).where(F.col("low") > 5000).drop("low")


@query(
    f"""select count(*) as n, {rnd('avg(value)', 6)} as mean, min(value) as low, max(value) as high,
        {rnd(quant('value', 0.05), 4)} as p05, {rnd(quant('value', 0.95), 4)} as p95 from events"""
)
def global_agg_ag12(d: Given) -> DataFrame:
    out = quantiles.summarize(
        d.events,
        [],
        "value",
        {"p05": 0.05, "p95": 0.95},
        n=quantiles.COUNT,
        mean=quantiles.MEAN,
        low=quantiles.LOW,
        high=quantiles.HIGH,
    )
    return out.select("n", tidy("mean", 6).alias("mean"), "low", "high", tidy("p05", 4).alias("p05"), tidy("p95", 4).alias("p95"))


SEGMENT_SQL = f"""select case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment else 'Other' end as segment,
        count(*) filter (o_orderstatus = 'F') as final, count(*) as total,
        {pct("count(*) filter (o_orderstatus = 'F')", 'count(*)', 4)} as final_pct
        from orders left join customer on c_custkey = o_custkey group by 1"""


def _residual(d: Given) -> DataFrame:
    named = d.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    named = named.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    counts = [F.count_if(F.col("o_orderstatus") == "F").alias("final"), F.count("*").alias("total")]
    known = d.orders.join(named, "o_custkey").groupBy("segment").agg(*counts)
    out = agg.residual_group(known, d.orders.agg(*counts), "segment", "Other", ["final", "total"])
    return out.withColumn("final_pct", percentage(F.col("final"), F.col("total"), 4))


@query(SEGMENT_SQL)
def residual_group_ag13(d: Given) -> DataFrame:
    return _residual(d)


@query(
    """with g as (select l_orderkey, count(*) filter (l_returnflag = 'R') as r, count(*) as n from lineitem group by 1)
       select case when r = n then 'all' when r = 0 then 'none' else 'mixed' end as status, count(*) as orders from g group by 1"""
)
def outcome_status_ag14(d: Given) -> DataFrame:
    flag = F.col("l_returnflag")
    sums = d.lineitem.groupBy("l_orderkey").agg(F.count_if(flag == "R").alias("r"), F.count_if(flag != "R").alias("o"))
    status = agg.outcome_status(F.col("r"), F.col("o"), "all", "none", "mixed")
    return sums.groupBy(status.alias("status")).agg(F.count("*").alias("orders"))


A15, B15 = "avg(value) filter (ts < '2024-01-16')", "avg(value) filter (ts >= '2024-01-16')"


@query(
    f"""select event_type, {rnd(A15, 4)} as first_half, {rnd(B15, 4)} as second_half, {rnd(f'{B15} - {A15}', 4)} as delta,
        {pct(f'{B15} - {A15}', A15, 4)} as delta_pct from events group by 1"""
)
def period_delta_ag15(d: Given) -> DataFrame:
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    parts = agg.period_delta(F.col("value"), F.col("ts") < middle, F.col("ts") >= middle)
    names = {"before": "first_half", "after": "second_half", "delta": "delta", "delta_pct": "delta_pct"}
    return d.events.groupBy("event_type").agg(*[tidy(parts[k], 4).alias(v) for k, v in names.items()])


@query(
    f"""with x as (select l_orderkey, l_returnflag, l_extendedprice - min(l_extendedprice) over (partition by l_orderkey) as above from lineitem)
        select l_returnflag, count(*) as lines, {rnd('avg(above)', 4)} as mean_above, {rnd(quant('above', 0.5), 4)} as p50, {rnd(quant('above', 0.95), 4)} as p95
        from x where above > 0 and l_returnflag <> 'R' group by 1"""
)
def first_seen_dispersion_ag16(d: Given) -> DataFrame:
    """The minimum is over all lines, the measured rows leave one flag out."""
    kept = d.lineitem.where(F.col("l_returnflag") != "R")
    rows = agg.dispersion(d.lineitem, ["l_orderkey"], "l_extendedprice", "above", rows=kept)
    probs = {"p50": 0.5, "p95": 0.95}
    out = quantiles.summarize(rows, ["l_returnflag"], "above", probs, lines=quantiles.COUNT, mean_above=quantiles.MEAN)
    return out.withColumns({c: tidy(c, 4) for c in ("mean_above", *probs)})


LIMITS17 = (400000, 300000, 200000, 100000)


@query(
    "select cast(year(o_orderdate) as int) as year, count(*) as orders, "
    + ", ".join(f"count(*) filter (o_totalprice >= {x}) as over_{x}" for x in LIMITS17)
    + ", "
    + ", ".join(f"{pct(f'count(*) filter (o_totalprice >= {x})', 'count(*)', 2)} as pct_{x}" for x in LIMITS17)
    + " from orders group by 1"
)
def threshold_rates_ag17(d: Given) -> DataFrame:
    rates = agg.threshold_rates(F.col("o_totalprice"), LIMITS17, "over_{}", "pct_{}")
    return d.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("orders"), *rates)


@query(
    """with b as (select hour(ts)::bigint as bin, min(hour(ts)::bigint) over (partition by user_id, event_type) as f from events)
       select bin, count(*) filter (bin <= f) as novel, count(*) filter (bin > f) as repeats from b group by 1"""
)
def novel_vs_repeat_ag18(d: Given) -> DataFrame:
    rows = d.events.select("user_id", "event_type", F.hour("ts").cast("bigint").alias("bin"))
    return agg.novel_vs_repeat(rows, ["user_id", "event_type"], "bin", "novel", "repeats")


@query(
    f"""with {FIRST_SQL} select date_trunc('month', ship)::date as month, count(*) filter (first_supplier = 7) as wins, count(*) as total_blocks,
        {pct('count(*) filter (first_supplier = 7)', 'count(*)', 2)} as win_rate_pct from f group by 1"""
)
def win_rate_ag19(d: Given) -> DataFrame:
    best = F.min(F.struct(F.col("l_shipdate").alias("at"), F.col("l_suppkey").alias("s")))
    won = d.lineitem.groupBy("l_orderkey").agg(best.alias("b")).select(
        tp.month(F.col("b.at")).alias("month"), F.col("b.s").alias("winner")
    )
    return agg.win_rate(won, ["month"], "winner", 7)


@query(
    f"""with x as (select l_returnflag, l_extendedprice - p_retailprice * l_quantity as diff from lineitem join part on l_partkey = p_partkey)
        select l_returnflag, count(*) as n, {rnd('avg(diff)', 4)} as mean, {rnd(quant('diff', 0.5), 4)} as p50, {rnd(quant('diff', 0.95), 4)} as p95,
        {rnd(quant('diff', 0.99), 4)} as p99 from x group by 1"""
)
def observer_difference_ag20(d: Given) -> DataFrame:
    prices = d.part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = d.lineitem.join(prices, "l_partkey").withColumn(
        "diff", F.col("l_extendedprice") - F.col("p_retailprice") * F.col("l_quantity")
    )
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    out = quantiles.summarize(rows, ["l_returnflag"], "diff", probs, n=quantiles.COUNT, mean=quantiles.MEAN)
    return out.withColumns({c: tidy(c, 4) for c in ("mean", *probs)})


# --- windows, order, sets ------------------------------------------------------


@query(
    f"select event_type, count(*) as n, {pct('count(*)', '(select count(*) from events)', 4)} as pct from events group by 1"
)
def share_of_total_wn1(d: Given) -> DataFrame:
    return shares.share_of_total(d.events.groupBy("event_type").agg(F.count("*").alias("n")), "n", "pct", 4)


@query(
    f"""with c as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all)
        select *, {pct('n', 'sum(n) over (partition by o_orderpriority)', 4)} as pct from c"""
)
def share_in_group_wn2(d: Given) -> DataFrame:
    counted = d.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return shares.share_in_group(counted, ["o_orderpriority"], "n", "pct", 4)


@query(
    f"""with r as (select *, row_number() over (partition by l_partkey order by l_extendedprice, l_orderkey, l_linenumber, l_shipdate) as rk,
              count(*) over (partition by l_partkey) as n from lineitem)
        select l_partkey, l_orderkey, l_linenumber, rk as rank, n as group_size, {rnd('(n - rk + 1) * 100.0::double / n', 6)} as percentile
        from r where l_suppkey = 7"""
)
def rank_percentile_wn3(d: Given) -> DataFrame:
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_shipdate"]
    ranked = shares.ranks_in_cells(d.lineitem, ["l_partkey"], order, F.col("l_suppkey") == 7)
    place = (F.col("group_size") - F.col("rank") + 1) * 100.0 / F.col("group_size")
    return ranked.select("l_partkey", "l_orderkey", "l_linenumber", "rank", "group_size", tidy(place, 6).alias("percentile"))


@query(
    f"""with {SCORE_SQL} select o_custkey, orders, {rnd('z', 6)} as z_score, row_number() over (order by orders desc, o_custkey) as rank
        from c qualify rank <= 25 order by z_score desc"""
)
def topn_by_rank_wn4(d: Given) -> DataFrame:
    rows = _customer_scores(d).select("o_custkey", "orders", tidy("z_score", 6).alias("z_score"))
    return shares.top_ranked(rows, [F.col("orders").desc(), F.col("o_custkey")], 25).orderBy(F.col("z_score").desc())


@query("select o_custkey, count(*) as orders from orders group by 1 order by orders desc, o_custkey limit 15")
def top_k_so1(d: Given) -> DataFrame:
    counts = d.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return shares.top_k(counts, [F.col("orders").desc(), F.col("o_custkey")], 15)


PRIORITIES = ["1-URGENT", "3-MEDIUM", "2-HIGH", "5-LOW", "4-NOT SPECIFIED"]


@query("select o_orderpriority, count(*) as n from orders group by 1")
def custom_order_so2(d: Given) -> DataFrame:
    counts = d.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.orderBy(position_in(F.col("o_orderpriority"), PRIORITIES))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by all")
def multi_key_order_so3(d: Given) -> DataFrame:
    counts = d.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return counts.orderBy("o_orderstatus", F.col("n").desc(), "o_orderpriority")


METRICS = {
    "Mean total": "avg(o_totalprice)",
    "Smallest total": "min(o_totalprice)",
    "Largest total": "max(o_totalprice)",
    "Mean of urgent": "avg(case when o_orderpriority = '1-URGENT' then o_totalprice end)",
    "Mean of final": "avg(case when o_orderstatus = 'F' then o_totalprice end)",
    "Mean customer": "avg(o_custkey)",
}


@query(" union all ".join(f"select '{k}' as metric, {rnd(v, 4)} as value from orders" for k, v in METRICS.items()))
def union_metrics_st1(d: Given) -> DataFrame:
    total = F.col("o_totalprice")
    metrics = {
        "Mean total": F.avg(total),
        "Smallest total": F.min(total),
        "Largest total": F.max(total),
        "Mean of urgent": agg.conditional(F.avg, total, F.col("o_orderpriority") == "1-URGENT"),
        "Mean of final": agg.conditional(F.avg, total, F.col("o_orderstatus") == "F"),
        "Mean customer": F.avg("o_custkey"),
    }
    rounded = {k: tidy(v, 4) for k, v in metrics.items()}
    return agg.union_metrics(d.orders, rounded, "metric", "value").orderBy("metric")


@query(SEGMENT_SQL)
def union_residual_st2(d: Given) -> DataFrame:
    return _residual(d).orderBy(F.col("total").desc(), "segment")


# --- arrays --------------------------------------------------------------------


@query("select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) group by 1")
def explode_group_ar1(d: Given) -> DataFrame:
    words = d.part.select(F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query(
    """select p_brand, cast(sum(len(list_filter(string_split(p_name, ' '), lambda w: w = 'red'))) as bigint) as reds from part group by 1"""
)
def count_matching_ar2(d: Given) -> DataFrame:
    return d.part.groupBy("p_brand").agg(F.sum(arrays.count_matching(F.split("p_name", " "), "red")).alias("reds"))


@query("select p_brand, count(*) as n from part where list_contains(string_split(p_name, ' '), 'red') group by 1")
def contains_ar3(d: Given) -> DataFrame:
    return d.part.where(arrays.contains(F.split("p_name", " "), "red")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query(
    """select lang, cast(sum(len(string_split(text, ' '))) as bigint) as words, count(*) as docs from documents
       where len(string_split(text, ' ')) > 1 group by 1"""
)
def array_length_ar4(d: Given) -> DataFrame:
    rows = d.documents.withColumn("size", arrays.length(F.split("text", " "))).where(F.col("size") > 1)
    return rows.groupBy("lang").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))


# --- reshaping -------------------------------------------------------------------

KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "select ts::date as day, "
    + ", ".join(f"count(*) filter (event_type = '{k}') as {k}" for k in KINDS)
    + " from events group by 1"
)
def pivot_fill_rs1(d: Given) -> DataFrame:
    counts = d.events.groupBy(tp.day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"))
    return reshape.pivot_fill(counts, ["day"], "event_type", "n", KINDS).orderBy("day")


@query(
    """with k as (select distinct user_id, event_type from events), c as (select user_id, event_type, hour(ts) as hour, count(*) as n from events group by all)
       select k.user_id, k.event_type, cast(h.hour as int) as hour, coalesce(n, 0) as n from k, range(24) h(hour)
       left join c on c.user_id = k.user_id and c.event_type = k.event_type and c.hour = h.hour"""
)
def dense_axis_rs2(d: Given) -> DataFrame:
    counts = d.events.groupBy("user_id", "event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return reshape.dense_axis(counts, ["user_id", "event_type"], "hour", 0, 23, {"n": 0})


@query("select distinct c_mktsegment from customer")
def choices_rs3(d: Given) -> DataFrame:
    return reshape.choices(d.customer, "c_mktsegment")


@query(
    f"""select c_nationkey, count(*) as customers, {rnd('sum(c_acctbal)', 2)} as balance from customer where c_mktsegment = 'BUILDING' group by 1"""
)
def select_group_rs3(d: Given) -> DataFrame:
    rows = reshape.select_group(d.customer, "c_mktsegment", "BUILDING")
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("customers"), tidy(F.sum("c_acctbal"), 2).alias("balance"))


@query(
    f"""select l_suppkey, count(*) as n, {rnd('avg(l_extendedprice)', 4)} as mean from lineitem where l_returnflag = 'R' group by 1"""
)
def split_wide_rs4(d: Given) -> DataFrame:
    """Both sides in one wide table, one of them under neutral names."""
    parts = []
    for side, flag in (("returned", "R"), ("accepted", "A")):
        holds = F.col("l_returnflag") == flag
        parts.append(F.count_if(holds).alias(f"{side}_n"))
        parts.append(tidy(agg.conditional(F.avg, F.col("l_extendedprice"), holds), 4).alias(f"{side}_mean"))
    wide = d.lineitem.groupBy("l_suppkey").agg(*parts)
    return reshape.split_wide(wide, ["l_suppkey"], "returned", ["n", "mean"]).where(F.col("n") > 0)


@query(
    """with c as (select o_custkey, o_orderstatus, count(*) as n from orders group by all),
       t as (select o_custkey, cast(sum(n) as bigint) as total from c group by 1 order by total desc, o_custkey limit 15)
       select o_custkey, o_orderstatus, n, total from c join t using (o_custkey)"""
)
def top_n_across_rs5(d: Given) -> DataFrame:
    counts = d.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return reshape.top_n_across(counts, "o_custkey", "o_orderstatus", "n", 15)


@query(
    f"""with w as (select hour(ts) as hour, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'click') as click from events group by 1)
        select *, {pct('view', '(select sum(view) from w)', 4)} as view_pct, {pct('click', '(select sum(click) from w)', 4)} as click_pct from w"""
)
def share_of_column_rs6(d: Given) -> DataFrame:
    kind = F.col("event_type")
    wide = d.events.groupBy(F.hour("ts").cast("bigint").alias("hour")).agg(
        F.count_if(kind == "view").alias("view"), F.count_if(kind == "click").alias("click")
    )
    return reshape.share_of_columns(wide, ["view", "click"])


@query(
    f"""with x as (select o_orderstatus, o_totalprice as y, coalesce(n, 0) as x from orders
                  left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey)
        select o_orderstatus, {rnd('regr_slope(y, x)', 4)} as slope, {rnd('regr_intercept(y, x)', 4)} as intercept, {rnd('sqrt(regr_r2(y, x))', 6)} as r,
        {rnd('corr(y, x)', 6)} as corr, min(x)::double as min_x, max(x)::double as max_x, count(*) as points from x group by 1"""
)
def linear_fit_rs7(d: Given) -> DataFrame:
    rows = joins.left_fill(d.orders, _line_counts(d), ["o_orderkey"], {"lines": 0})
    fit = reshape.linear_fit(rows, ["o_orderstatus"], "lines", "o_totalprice")
    return fit.withColumns(
        {"slope": tidy("slope", 4), "intercept": tidy("intercept", 4), "r": tidy("r", 6), "corr": tidy("corr", 6)}
    )


@query(
    f"""select o_custkey, count(*) filter (o_orderstatus = 'F') as final, count(*) filter (o_orderstatus = 'P') as pending,
        {rnd("coalesce(count(*) filter (o_orderstatus = 'F') / nullif(count(*) filter (o_orderstatus in ('F', 'P')), 0), 0)", 6)} as final_share
        from orders group by 1"""
)
def group_totals_rs8(d: Given) -> DataFrame:
    status = F.col("o_orderstatus")
    long = d.orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.count_if(status == "F").alias("final"), F.count_if(status == "P").alias("pending")
    )
    out = reshape.group_totals(long, ["o_custkey"], ["final", "pending"], ("final", "pending", "final_share"))
    return out.withColumn("final_share", tidy("final_share", 6))


@query(
    f"""with {SCORE_SQL}, b as (select o_custkey, orders, {rnd('z', 2)} as z_score from c)
        select *, case when z_score < 0 then '#22c55e' when z_score >= 2 then '#ef4444' else '#eab308' end as bar_color,
        {rnd('(z_score + 3) / 8 * 100', 1)} as bar_width_pct, row_number() over (order by orders desc, o_custkey) as rank
        from b qualify rank <= 30"""
)
def score_bar_rs9(d: Given) -> DataFrame:
    rows = _customer_scores(d).select("o_custkey", "orders", tidy("z_score", 2).alias("z_score"))
    best = shares.top_ranked(rows, [F.col("orders").desc(), F.col("o_custkey")], 30)
    z = F.col("z_score")
    return best.withColumns({"bar_color": reshape.bar_colour(z), "bar_width_pct": reshape.bar_width(z)}).orderBy(z.desc())
