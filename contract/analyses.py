"""The described analyses over the given tables, each with its check SQL.

"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract.registry import Given, Registry
from contract.sqltools import ladder, pct, quant, rnd
from slotwise.functions import timeparts as tp
from slotwise.functions.labels import range_label, ratio, tidy
from slotwise.operators import aggregates as agg
from slotwise.operators import quantiles, series
from slotwise.plans import measures, records, voter_sets

registry = Registry()
query = registry.add


# --- set overlap -------------------------------------------------------------------

OVERLAP_SQL = """m as (select date_trunc('month', l_shipdate)::date as month, l_suppkey, bool_or(l_returnflag = 'A') as a, bool_or(l_returnflag = 'R') as r
                       from lineitem where l_returnflag in ('A', 'R') group by all),
       o as (select month, count(*) filter (a and r) as in_both, count(*) filter (a and not r) as only_left, count(*) filter (r and not a) as only_right,
             count(*) filter (a and r) / count(*) as jaccard from m group by 1)"""


def _overlap(d: Given) -> DataFrame:
    lines = d.lineitem.withColumn("month", tp.month(F.col("l_shipdate")))
    left, right = (lines.where(F.col("l_returnflag") == flag) for flag in ("A", "R"))
    return voter_sets.set_overlap(left, right, ["month"], "l_suppkey")


@query(f"with {OVERLAP_SQL} select month, in_both, only_left, only_right, {rnd('jaccard', 6)} as jaccard from o")
def set_overlap_pa1(d: Given) -> DataFrame:
    return _overlap(d).withColumn("jaccard", tidy("jaccard", 6))


@query(
    f"""with {OVERLAP_SQL} select {rnd('avg(jaccard)', 6)} as mean, {rnd('max(jaccard)', 6)} as max, count(*) as groups,
        {rnd(quant('jaccard', 0.5), 6)} as median, {rnd(quant('jaccard', 0.75), 6)} as p75, {rnd(quant('jaccard', 0.9), 6)} as p90 from o"""
)
def overlap_summary_pa1(d: Given) -> DataFrame:
    out = voter_sets.overlap_summary(_overlap(d), "jaccard", {"median": 0.5, "p75": 0.75, "p90": 0.9})
    return out.select("groups", *[tidy(c, 6).alias(c) for c in ("mean", "max", "median", "p75", "p90")])


JACCARD_EDGES, JACCARD_LABELS = [0.5, 0.8, 0.9, 0.95, 0.99], ["<0.5", "0.5-0.8", "0.8-0.9", "0.9-0.95", "0.95-0.99", "0.99+"]


@query(
    f"""with {OVERLAP_SQL} select {ladder('jaccard', JACCARD_EDGES, JACCARD_LABELS)} as bucket, count(*) as groups,
        {pct('count(*)', '(select count(*) from o)', 2)} as pct from o group by 1"""
)
def overlap_buckets_pa1(d: Given) -> DataFrame:
    return voter_sets.overlap_buckets(_overlap(d), JACCARD_EDGES, JACCARD_LABELS)


# --- bitfields ------------------------------------------------------------------------


@query(
    """with c as (select ts::date as day, event_type, max(bit_count(user_id) - 1) as best from events group by all)
       select day, cast(sum(best) as bigint) as voters from c group by 1"""
)
def estimated_voters_pa2(d: Given) -> DataFrame:
    rows = d.events.withColumn("day", tp.day(F.col("ts")))
    return voter_sets.estimated_voters(rows, ["day"], "event_type", F.bit_count("user_id"), "voters")


@query(
    """with o as (select o_orderkey, o_custkey, lpad(hex(o_custkey), 6, '0') as bits from orders)
       select o_orderkey, cast(bit_count(o_custkey) as int) as set_bits from o"""
)
def popcount_pa2(d: Given) -> DataFrame:
    bits = F.concat(F.lit("0x"), F.lpad(F.hex("o_custkey"), 6, "0"))
    return d.orders.select("o_orderkey", voter_sets.popcount(bits).alias("set_bits"))


@query(
    """with o as (select o_orderkey, o_custkey from orders), i as (select unnest(range(24)) as i),
       v as (select o_orderkey, i, (o_custkey >> (16 - i // 8 * 8)) & 255 as byte from o, i)
       select o_orderkey, concat('v', i) as voter from v where (byte >> (i % 8)) & 1 = 1"""
)
def decode_voters_pa2(d: Given) -> DataFrame:
    committee = F.array(*[F.lit(f"v{i}") for i in range(24)])
    rows = d.orders.select("o_orderkey", F.lpad(F.hex("o_custkey"), 6, "0").alias("bits"), committee.alias("committee"))
    return voter_sets.decode_voters(rows, "bits", "committee", "voter", ["o_orderkey"])


# --- time to a share --------------------------------------------------------------------

REACH_SQL = """n as (select count(distinct user_id) as users from events),
       f as (select ts::date as day, user_id, min(epoch_us(ts)) as first from events group by all),
       r as (select *, row_number() over (partition by day order by first) as rk, count(*) over (partition by day) as seen from f),
       g as (select day, max(first) filter (rk = (select cast(ceil(users * 0.5::double) as bigint) from n)) as reached, max(seen) as voters
             from r group by day)"""


def _reach(d: Given, share: float = 0.5) -> DataFrame:
    users = agg.distinct_count(d.events, [], "user_id", "users").scalar()
    rows = d.events.select(tp.day(F.col("ts")).alias("day"), "user_id", tp.micros(F.col("ts")).alias("at"))
    return voter_sets.time_to_share(rows, ["day"], "user_id", "at", share, users, "reached")


@query(f"with {REACH_SQL} select day, make_timestamp(reached) as reached_at, voters from g")
def time_to_share_pa3(d: Given) -> DataFrame:
    out = _reach(d)
    return out.select("day", F.timestamp_micros("reached").alias("reached_at"), "voters")


@query(
    f"""with {REACH_SQL}, w as (select greatest(ceil((reached - epoch_us(day::timestamp)) / 3600000000), 0) as cell from g),
        x as (select unnest(range(25)) as c)
        select c * 3600 as at, {pct('(select count(*) from w where cell <= c)', '(select count(*) from w)', 4)} as reached_pct from x"""
)
def reached_curve_pa3(d: Given) -> DataFrame:
    start = tp.seconds(F.col("day"))
    waited = _reach(d).withColumn("waited", (F.col("reached") - start * 1_000_000) / F.lit(1e6))
    return voter_sets.reached_curve(waited, "waited", 3600, 24)


PLACE_SQL = """c as (select ts::date as day, event_type, max(bit_count(user_id) - 1) as best from events group by all),
       e as (select day, sum(best) as expected from c group by 1),
       f as (select ts::date as day, event_type as place, user_id, min(epoch_us(ts)) as first from events group by all),
       r as (select *, row_number() over (partition by day, place order by first) as rk, count(*) over (partition by day, place) as seen from f),
       g as (select day, place, max(first) filter (rk = cast(ceil(expected * 0.9::double) as bigint)) as reached, max(seen) as voters
             from r left join e using (day) group by all)"""


def _reach_by_place(d: Given) -> DataFrame:
    """When each place had seen 0.9 of the voters expected on a day, which are estimated for that day."""
    rows = d.events.select(
        tp.day(F.col("ts")).alias("day"), F.col("event_type").alias("place"), "user_id", tp.micros(F.col("ts")).alias("at")
    )
    expected = voter_sets.estimated_voters(rows, ["day"], "place", F.bit_count("user_id"), "expected")
    return voter_sets.time_to_share(rows, ["day", "place"], "user_id", "at", 0.9, expected, "reached")


@query(f"with {PLACE_SQL} select day, place, make_timestamp(reached) as reached_at, voters from g")
def time_to_share_by_place_pa3(d: Given) -> DataFrame:
    return _reach_by_place(d).select("day", "place", F.timestamp_micros("reached").alias("reached_at"), "voters")


@query(
    f"""with {PLACE_SQL}, w as (select place, greatest(ceil((reached - epoch_us(day::timestamp)) / 3600000000), 0) as cell from g),
        x as (select distinct place, c from w, (select unnest(range(25)) as c) as grid)
        select x.place, c * 3600 as at, {pct('count(*) filter (cell <= c)', 'count(*)', 4)} as reached_pct from x join w using (place) group by x.place, c"""
)
def reached_curve_by_place_pa3(d: Given) -> DataFrame:
    waited = _reach_by_place(d).withColumn("waited", (F.col("reached") - tp.seconds(F.col("day")) * 1_000_000) / F.lit(1e6))
    return voter_sets.reached_curve(waited, "waited", 3600, 24, keys=["place"])


# --- verdicts, inclusion, drift -----------------------------------------------------------


@query(
    f"""with v as (select o_totalprice > 250000 as large, coalesce(n, 0) > 4 as many from orders
                  left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey)
        select large, many, count(*) as cells, {pct('count(*)', '(select count(*) from v)', 4)} as pct from v group by all"""
)
def agreement_matrix_pa4(d: Given) -> DataFrame:
    lines = d.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = d.orders.join(lines, "o_orderkey", "left")
    return voter_sets.agreement_matrix(
        rows, F.col("o_totalprice") > 250000, F.coalesce(F.col("n"), F.lit(0)) > 4, ("large", "many")
    )


@query(
    f"""with f as (select l.l_orderkey, l.l_shipdate, (select min(e.l_shipdate) from lineitem e
                          where e.l_orderkey = l.l_orderkey and e.l_shipdate > l.l_shipdate) as next from lineitem l),
        x as (select cast(year(l_shipdate) as int) as year, date_diff('day', l_shipdate, next) as delay from f)
        select year, count(*) as subjects, count(*) filter (delay is null) as never, {rnd('avg(delay)', 4)} as avg_delay,
        {pct('count(*) filter (delay <= 31)', 'count(*)', 4)} as within_pct, {rnd(quant('delay', 0.95), 4)} as p95_delay from x group by 1"""
)
def first_inclusion_pa5(d: Given) -> DataFrame:
    """Every line of an order asks for the order's next shipment: many subjects and events per key."""
    lines = d.lineitem.select("l_orderkey", F.unix_date(F.col("l_shipdate").cast("date")).alias("shipped"))
    events = lines.withColumnRenamed("shipped", "next")
    rows = voter_sets.first_inclusion(lines, events, ["l_orderkey"], "shipped", "next", F.col("next") - F.col("shipped"))
    rows = rows.withColumn("year", F.year(F.date_from_unix_date(F.col("shipped").cast("int"))))
    out = voter_sets.inclusion_report(rows, ["year"], "delay", 31, {"p95_delay": 0.95})
    return out.withColumns({"avg_delay": tidy("avg_delay", 4), "p95_delay": tidy("p95_delay", 4)})


@query(
    f"""with o as (select date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as day, o_orderkey from orders),
        l as (select l_orderkey, date_diff('day', date '1970-01-01', cast(l_shipdate as date)) as shipped from lineitem),
        t as (select day, count(*) as members from o group by 1),
        f as (select day, members, (select min(shipped) from l where shipped > day) as first_at from t),
        h as (select day, count(distinct o_orderkey) as included from o join f using (day)
              join l on l_orderkey = o_orderkey and shipped = first_at group by 1)
        select day, members, first_at, coalesce(included, 0) as included,
               {pct('coalesce(included, 0)', 'members', 4)} as included_share from f left join h using (day)"""
)
def first_following_share_pa5(d: Given) -> DataFrame:
    """Orders of a day as members, shipping days as events: who is in the first one after it."""
    day = F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("day")
    orders = d.orders.select("o_orderkey", day)
    lines = d.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("at")
    )
    members = orders.join(lines, "o_orderkey")
    return voter_sets.first_following_share(orders, lines, members, "day", "at", ["o_orderkey"])


DRIFT_EDGES, DRIFT_LABELS = [0.01, 0.02, 0.05, 0.1], ["<1%", "1-2%", "2-5%", "5-10%", "10%+"]
DRIFT_SQL = """m as (select date_trunc('month', l_shipdate) as month, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'R') as b
                     from lineitem group by 1)"""


def _monthly_flags(d: Given) -> DataFrame:
    flag = F.col("l_returnflag")
    return d.lineitem.groupBy(tp.month(F.col("l_shipdate")).alias("month")).agg(
        F.count_if(flag == "A").alias("a"), F.count_if(flag == "R").alias("b")
    )


@query(
    f"""with {DRIFT_SQL}, c as (select {ladder('abs(a - b) / nullif(a, 0)', DRIFT_EDGES, DRIFT_LABELS)} as drift_range,
           {ladder('abs(a - b) / nullif(a, 0)', DRIFT_EDGES, list(range(5)))} as range_order, count(*) as slots from m group by all)
        select *, {pct('slots', '(select sum(slots) from c)', 4)} as pct,
               {pct('sum(slots) over (order by range_order)', '(select sum(slots) from c)', 4)} as cumulative_pct from c"""
)
def drift_histogram_pa6(d: Given) -> DataFrame:
    return measures.drift_histogram(_monthly_flags(d), "a", "b", DRIFT_EDGES, DRIFT_LABELS)


@query(
    f"""with {DRIFT_SQL} select cast(sign(b - a) as int) as direction, count(*) as slots, {pct('count(*)', '(select count(*) from m)', 4)} as pct
        from m group by 1"""
)
def drift_direction_pa6(d: Given) -> DataFrame:
    return measures.drift_direction(_monthly_flags(d), "a", "b")


LIMITS7 = (10, 25, 50, 100)


@query(
    "select event_type, count(*) as rows, "
    + ", ".join(f"count(*) filter (value >= {x}) as over_{x}" for x in LIMITS7)
    + ", "
    + ", ".join(f"{pct(f'count(*) filter (value >= {x})', 'count(*)', 4)} as pct_over_{x}" for x in LIMITS7)
    + f", {rnd(quant('value', 0.5), 4)} as p50, {rnd(quant('value', 0.95), 4)} as p95 from events group by 1"
)
def threshold_exceedance_pa7(d: Given) -> DataFrame:
    out = measures.threshold_exceedance(d.events, ["event_type"], "value", LIMITS7, {"p50": 0.5, "p95": 0.95})
    return out.withColumns({"p50": tidy("p50", 4), "p95": tidy("p95", 4)})


@query(
    f"""with s as (select o_orderstatus, coalesce(v, 0) / o_totalprice as share from orders
                  left join (select l_orderkey, sum(l_extendedprice) as v from lineitem group by 1) on l_orderkey = o_orderkey)
        select o_orderstatus, count(*) as subjects, count(*) filter (share = 0) as without_support, count(*) filter (share >= 0.4) as over_0,
        count(*) filter (share >= 1) as over_1, count(*) filter (share >= 5) as over_2, {rnd('max(share)', 6)} as max_share,
        {rnd('avg(share)', 6)} as mean_share, {rnd('median(share)', 6)} as median_share from s group by 1"""
)
def orphan_support_pa8(d: Given) -> DataFrame:
    value = d.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("v"))
    rows = d.orders.join(value, "o_orderkey", "left")
    share = ratio(F.coalesce(F.col("v"), F.lit(0.0)), F.col("o_totalprice"))
    out = voter_sets.orphan_support(rows, share, ["o_orderstatus"], [0.4, 1, 5])
    return out.withColumns({c: tidy(c, 6) for c in ("max_share", "mean_share", "median_share")})


# --- recovery, records, samples ---------------------------------------------------------------


@query(
    """select event_id, user_id, epoch_us(ts) as at,
       (select min(epoch_us(n.ts)) from events n where n.user_id = e.user_id and n.ts > e.ts and n.event_type <> 'error') - epoch_us(ts) as recovered_after
       from events e where event_type = 'error'"""
)
def recovery_time_pa9(d: Given) -> DataFrame:
    rows = d.events.withColumn("at", tp.micros(F.col("ts")))
    return measures.recovery_time(rows, "user_id", "at", F.col("event_type") == "error", keep=["event_id"])


STRETCH_SQL = """b as (select user_id, epoch_us(ts) as t, cast(floor(value / 40) as bigint) as distance,
             (select min(epoch_us(n.ts)) from events n where n.user_id = e.user_id and n.ts > e.ts and n.event_type <> 'error') as nxt
             from events e where event_type = 'error'),
       s as (select user_id, min(t) as behind_from, max(t) as behind_until, count(*) as behind_rows, max(distance) as greatest_distance,
             nxt - min(t) as recovered_after, coalesce(nxt - min(t) <= 43200000000, false) as recovered from b group by user_id, nxt)"""
BAND_EDGES, BAND_LABELS = [1, 4], ["0", "1-3", "4+"]


def _stretches(d: Given) -> DataFrame:
    rows = d.events.withColumn("at", tp.micros(F.col("ts")))
    distance = F.floor(F.col("value") / 40)
    return measures.behind_stretches(rows, "user_id", "at", F.col("event_type") == "error", distance, limit=43_200_000_000)


@query(f"with {STRETCH_SQL} select * from s")
def behind_stretches_pa9(d: Given) -> DataFrame:
    return _stretches(d)


@query(
    f"""with {STRETCH_SQL} select {ladder('greatest_distance', BAND_EDGES, BAND_LABELS)} as distance_band, count(*) as stretches,
        cast(sum(behind_rows) as bigint) as behind_rows, count(*) filter (recovered) as recovered,
        {pct('count(*) filter (recovered)', 'count(*)', 2)} as recovered_pct, count(*) filter (recovered_after is null) as never from s group by 1"""
)
def recovered_share_pa9(d: Given) -> DataFrame:
    return measures.recovered_share(_stretches(d), range_label(F.col("greatest_distance"), BAND_EDGES, BAND_LABELS))


KINDS = ["click", "error", "purchase", "signup", "view"]
FIELDS_SQL = """f as (select user_id, event_type, arg_min(cast(floor(value / 40) as bigint), (ts, event_id)) as v,
             arg_min(cast(json_extract_string(props, '$.k') as bigint) // 25, (ts, event_id)) as k from events group by all),
       l as (select user_id, event_type, 'value' as field, cast(v as varchar) as value, if(v > 2, 'long', 'short') as kind from f
             union all select user_id, event_type, 'k', cast(k as varchar), 'short' from f where k > 0)"""


def _fields(d: Given) -> DataFrame:
    """Two fields of each user's first event of every type, in long form."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    first = F.min(
        F.struct(
            "ts",
            "event_id",
            F.floor(F.col("value") / 40).cast("bigint").alias("v"),
            F.floor(k / 25).cast("bigint").alias("k"),
        )
    )
    rows = d.events.groupBy("user_id", "event_type").agg(first.alias("f"))
    pairs = F.array(
        F.struct(F.lit("value").alias("field"), F.col("f.v").alias("value")),
        F.struct(F.lit("k").alias("field"), F.col("f.k").alias("value")),
    )
    long = rows.select("user_id", "event_type", F.inline(pairs))
    long = long.where((F.col("field") == "value") | (F.col("value") > 0))
    kind = F.when((F.col("field") == "value") & (F.col("value") > 2), "long").otherwise("short")
    return long.select("user_id", "event_type", "field", F.col("value").cast("string").alias("value"), kind.alias("kind"))


@query(
    f"""with {FIELDS_SQL},
        held as (select user_id, field, count(*) as held from l group by all),
        mv as (select user_id, field, value as common from l group by user_id, field, value
               qualify row_number() over (partition by user_id, field order by count(*) desc, value desc) = 1),
        mk as (select user_id, field, kind as common_kind from l group by user_id, field, kind
               qualify row_number() over (partition by user_id, field order by count(*) desc, kind desc) = 1),
        p as (select unnest({KINDS}) as event_type),
        g as (select * from held join mv using (user_id, field) join mk using (user_id, field), p),
        x as (select g.event_type, g.field,
                case when l.user_id is null and held * 2 > 5 then 'missing_key' when l.user_id is not null and held * 2 <= 5 then 'extra_key'
                     when l.user_id is null then 'match' when l.kind <> common_kind then 'type_mismatch'
                     when l.value <> common then 'value_mismatch' else 'match' end as verdict
              from g left join l on l.user_id = g.user_id and l.field = g.field and l.event_type = g.event_type)
        select event_type, field, verdict, count(*) as records from x group by all"""
)
def record_diff_pa10(d: Given) -> DataFrame:
    diff = records.record_diff(_fields(d), ["user_id"], "event_type", KINDS, kind="kind")
    return records.diff_counts(diff, "event_type")


@query(
    f"""with {FIELDS_SQL}, e as (select user_id, event_type, count(*) as entries from l group by all),
        m as (select user_id, entries as common_entries from e group by user_id, entries
              qualify row_number() over (partition by user_id order by count(*) desc, entries desc) = 1)
        select user_id, event_type, entries, common_entries from e join m using (user_id) where entries <> common_entries"""
)
def entry_count_diff_pa10(d: Given) -> DataFrame:
    return records.entry_count_diff(_fields(d), ["user_id"], "event_type")


URL_FORMATS = [
    ("^$", "empty"),
    ("^https?://[^?#]*[?]", "query"),
    ("^https?://[^?#]*#", "fragment"),
    ("^https?://[^?#]*/$", "folder"),
    ("[.]html$", "page"),
    ("^https://", "plain secure"),
    ("^http://", "plain"),
]


@query(
    "select split_part(url, '://', 1) as scheme, case "
    + " ".join(f"when regexp_matches(url, '{p}') then '{v}'" for p, v in URL_FORMATS)
    + " else 'other' end as format, count(*) as rows from pages group by all"
)
def format_census_pa11(d: Given) -> DataFrame:
    rows = d.pages.withColumn("scheme", F.split_part("url", F.lit("://"), F.lit(1)))
    return records.format_census(rows, ["scheme"], "url", URL_FORMATS)


@query(
    """select o_orderstatus, o_orderkey from orders
       qualify row_number() over (partition by o_orderstatus order by md5(concat('s1', o_orderkey)), o_orderkey) <= 20"""
)
def sample_by_stratum_pa12(d: Given) -> DataFrame:
    rows = d.orders.select("o_orderstatus", "o_orderkey")
    return measures.sample_by_stratum(rows, ["o_orderstatus"], "o_orderkey", 20, seed="s1")


# --- rates, trimmed means, gaps, zero rows -------------------------------------------------------


RATES_SQL = """e as (select user_id, cast(floor(epoch(ts)) as bigint) as t, value, row_number() over (partition by user_id order by ts, event_id) as rn from events),
        g as (select user_id, value, unnest(range(cast(ceil(t / 3600.0::double) as bigint) * 3600, t + 21600, 3600)) as step_at from e where rn > 1),
        a as (select user_id, unnest(range(cast(ceil(min(t) / 3600.0::double) as bigint) * 3600, max(t) + 1, 3600)) as step_at from e group by 1),
        r as (select user_id, step_at, coalesce(sum(value), 0) / 21600 as rate from a left join g using (user_id, step_at) group by all)"""


def _rates(d: Given) -> DataFrame:
    """The running total per user is the counter; rates over six hours, hourly, also where nothing happened."""
    rows = d.events.select("user_id", "event_id", tp.micros(F.col("ts")).alias("us"), tp.seconds(F.col("ts")).alias("t"), "value")
    total = series.running_total(rows, ["user_id"], "us", "value", "counter", ties=["event_id"])
    return series.counter_rate(total, ["user_id"], "t", "counter", window=21600, step=3600, ties=["us", "event_id"])


@query(f"with {RATES_SQL} select user_id, step_at, {rnd('rate', 8)} as rate from r")
def counter_rate_pa13(d: Given) -> DataFrame:
    return _rates(d).withColumn("rate", tidy("rate", 8))


@query(
    f"""with {RATES_SQL} select step_at // 86400 as day, count(*) as steps, {rnd('avg(rate)', 6)} as mean_rate,
        {rnd(quant('rate', 0.95), 6)} as p95_rate from r group by 1"""
)
def counter_rate_daily_pa13(d: Given) -> DataFrame:
    """Mean and 95th percentile of the rate over a day, over all steps of all users."""
    rows = _rates(d).withColumn("day", F.floor(F.col("step_at") / 86400))
    out = quantiles.summarize(rows, ["day"], "rate", {"p95_rate": 0.95}, steps=quantiles.COUNT, mean_rate=quantiles.MEAN)
    return out.withColumns({c: tidy(c, 6) for c in ("mean_rate", "p95_rate")})


@query(
    f"""with q as (select event_type, {quant('value', 0.99)} as cut from events group by 1)
        select event_type, {rnd('avg(value)', 6)} as mean, {rnd('avg(value) filter (value <= cut)', 6)} as trimmed_mean, {rnd('max(cut)', 6)} as cut_value
        from events join q using (event_type) group by 1"""
)
def trimmed_mean_pa14(d: Given) -> DataFrame:
    out = measures.trimmed_mean(d.events, ["event_type"], "value")
    return out.withColumns({c: tidy(c, 6) for c in ("mean", "trimmed_mean", "cut_value")})


def _gap_sql(low: str) -> str:
    return f"""with b as (select ts::date as day, count(distinct user_id) as baseline from events group by 1),
        c as (select ts::date as day, event_type, count(distinct user_id) as members from events group by all),
        x as (select event_type, members, baseline - members as gap from c join b using (day) where not ({low}))
        select event_type, count(*) as slots, {rnd('avg(members)', 4)} as mean_members, {rnd('avg(gap)', 4)} as mean_gap,
        {rnd(quant('members', 0.5), 4)} as median_members, {rnd(quant('members', 0.9), 4)} as p90_members,
        {rnd(quant('members', 0.99), 4)} as p99_members from x group by 1"""


def _gap(d: Given, low=None) -> DataFrame:
    rows = d.events.withColumn("day", tp.day(F.col("ts")))
    out = voter_sets.source_gap(rows, "day", "event_type", "user_id", low)
    names = ["mean_members", "mean_gap", "median_members", "p90_members", "p99_members"]
    return out.withColumns({c: tidy(c, 4) for c in names})


@query(_gap_sql("false"))
def source_gap_pa15(d: Given) -> DataFrame:
    return _gap(d)


@query(_gap_sql("baseline < 130"))
def source_gap_without_outages_pa15(d: Given) -> DataFrame:
    return _gap(d, F.col("baseline") < 130)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@query(
    f"""with p as (select unnest({PRIORITIES}) as o_orderpriority),
        c as (select r_name, o_orderpriority, count(*) as orders from orders join customer on c_custkey = o_custkey
              join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all)
        select r_name, o_orderpriority, coalesce(orders, 0) as orders from region cross join p left join c using (r_name, o_orderpriority)"""
)
def zero_fill_report_pa16(d: Given) -> DataFrame:
    places = d.customer.join(d.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        d.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    per_customer = d.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    rows = per_customer.join(places.select(F.col("c_custkey").alias("o_custkey"), "r_name"), "o_custkey")
    counts = rows.groupBy("r_name", "o_orderpriority").agg(F.sum("n").alias("orders"))
    return measures.zero_fill_report(counts, d.region, "r_name", "o_orderpriority", PRIORITIES, "orders")
