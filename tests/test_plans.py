import random
import re

from pyspark.sql import functions as F

from contract.derived import DerivedTables
from helpers import final_plan, planned, rows
from slotwise.operators.joins import only_keys_of
from slotwise.plans import block_size, call_frames, catalogue, gossip, measures, observers, parents, records, scores, voter_sets, votes
from slotwise.plans.refresh import refresh
from slotwise.sources import Period, ResultStore
from slotwise.sources.tables import Tables

ALL = Period()


class Reduced(Tables):
    """Tables of one network that hold one row per key."""

    reduced, network = True, None


def _chain(spark):
    """Slots 1..8: 4 missed, 5 on 3 (only a missed slot between), 6 orphaned on 5,
    7 on 5, 8 built on 3 although 5 and 7 are canonical."""
    blocks = [
        (1, "r1", "r0", "canonical"),
        (2, "r2", "r1", "canonical"),
        (3, "r3", "r2", "canonical"),
        (5, "r5", "r3", "canonical"),
        (6, "r6", "r5", "orphaned"),
        (7, "r7", "r5", "canonical"),
        (8, "r8", "r3", "orphaned"),
    ]
    df = spark.createDataFrame(blocks, "slot bigint, block_root string, parent_root string, status string")
    df = df.withColumn("slot_start_date_time", F.timestamp_seconds(1606824023 + F.col("slot") * 12))
    entities = spark.createDataFrame(
        [(2, "lido"), (3, None), (5, "csm_operator7_lido"), (6, "solo_stakers"), (8, "a_lido")], "slot bigint, entity string"
    )
    entities = entities.withColumn("slot_start_date_time", F.timestamp_seconds(1606824023 + F.col("slot") * 12))
    return Reduced({"fct_block": df, "fct_block_proposer_entity": entities})


def test_missed_slots_are_not_stale_parents(spark):
    links = parents.blocks_with_parent(_chain(spark), ALL, ALL)
    got = {r["proposed_slot"]: (r["parent_distance"], r["latest_canonical_slot"], r["is_truly_stale"]) for r in links.collect()}
    assert got == {
        2: (1, None, False),
        3: (1, None, False),
        5: (2, 3, False),
        6: (1, None, False),
        7: (2, 5, False),
        8: (5, 7, True),
    }
    table = {r["parent_distance"]: r for r in parents.distances(_chain(spark), ALL, ALL).collect()}
    assert (table[1]["truly_stale_or_normal"], table[1]["missed_slots_only"]) == (3, 0)
    assert (table[2]["truly_stale_or_normal"], table[2]["missed_slots_only"]) == (0, 2)
    assert (table[5]["truly_stale_or_normal"], table[5]["missed_slots_only"]) == (1, 0)


def test_one_history_serves_period_and_lookback(spark, tmp_path):
    """Blocks of hour two on parents of hour one: one scan and one reduction of the blocks."""
    blocks = spark.range(1, 600).select(
        F.col("id").alias("slot"),
        F.concat(F.lit("r"), "id").alias("block_root"),
        F.concat(F.lit("r"), F.col("id") - F.when(F.col("id") % 7 == 0, 3).otherwise(1)).alias("parent_root"),
        F.when(F.col("id") % 11 == 0, "orphaned").otherwise("canonical").alias("status"),
        F.timestamp_seconds(1606824023 + F.col("id") * 12).alias("slot_start_date_time"),
        F.lit(0).cast("timestamp").alias("updated_date_time"),
    )
    blocks.write.parquet(f"{tmp_path}/blocks")
    t = Tables({"fct_block": spark.read.parquet(f"{tmp_path}/blocks")})
    t.network = None
    period, lookback = Period("2020-12-01 13:00:23", "2020-12-01 13:30:23"), Period("2020-12-01 12:30:23")
    links = parents.blocks_with_parent(t, period, lookback)
    got = {(r.proposed_slot, r.parent_slot, r.latest_canonical_slot, r.is_truly_stale) for r in links.collect()}
    want = set()
    for slot in range(300, 450):
        parent = slot - (3 if slot % 7 == 0 else 1)
        newest = max((s for s in range(parent, slot) if s % 11), default=None) if slot - parent > 1 else None
        want.add((slot, parent, newest, newest is not None and newest > parent))
    assert got == want
    plan = final_plan(links).split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") >= 1
    bounds = r"slot_start_date_time#\d+ >= 2020-12-01 12:30:23.+slot_start_date_time#\d+ < 2020-12-01 13:30:23.+\n.+ColumnarToRow"
    assert re.search(bounds, plan)


def test_outer_observer_is_cut_to_the_inner_keys_before_its_shuffle(spark):
    outer = spark.range(50_000).select((F.col("id") % 10_000).alias("k"), F.lit(5).alias("duration_ms"))
    inner = spark.createDataFrame([(3, 1), (3, 2), (77, 4), (None, 9)], "k bigint, duration_ms int")
    cut = only_keys_of(outer, inner, ["k"])
    assert cut.count() == 10 and "LeftSemi, BuildRight" in planned(cut)
    assert planned(cut).count("Exchange hashpartitioning") == 1  # of the inner keys alone
    assert only_keys_of(outer, inner, ["k"], held=1).count() == 10
    pairs = observers.observer_pairs(inner, outer, ["k"])
    assert rows(pairs.select("k", "overhead", "pairs")) == [(3, 3, 5), (3, 4, 5), (77, 1, 5)]


def test_results_follow_the_period_with_and_without_slot_numbers(spark, sf_dir):
    """Side tables cut by slots give what the whole history gives, for a part of the time."""
    for name in ("attester_accuracy_by_blobs", "proposer_votes_by_blobs", "score_vote_impact", "stale_parents_by_group"):
        period = {"period": Period("2020-12-01 12:10:23", "2020-12-01 16:10:23")}
        if name.startswith("stale"):
            period["lookback"] = Period("2020-12-01 12:00:23")
        cut, whole = DerivedTables(spark, sf_dir), DerivedTables(spark, sf_dir)
        whole.clocks = {}
        found = rows(catalogue.run(name, cut, spark, **period))
        assert found, name
        assert found == rows(catalogue.run(name, whole, spark, **period))


def test_entity_groups_of_parents(spark):
    got = {r["entity_group"]: r["total_blocks"] for r in parents.by_group(_chain(spark), ALL, ALL).collect()}
    assert got == {"Lido Professional": 2, "Lido CSM": 1, "Solo Stakers": 1, "Unknown": 2}


def _arrivals(spark, per_entity):
    seen, entity, slot = [], [], 0
    for name, times in per_entity.items():
        for ms in times:
            slot += 1
            seen.append((slot, f"b{slot}", "n1", ms))
            entity.append((slot, name))
    at = F.timestamp_seconds(1606824023 + F.col("slot") * 12)
    s = spark.createDataFrame(seen, "slot bigint, block_root string, node_id string, seen_slot_start_diff bigint")
    e = spark.createDataFrame(entity, "slot bigint, entity string")
    return Reduced(
        {
            "fct_block_first_seen_by_node": s.withColumn("slot_start_date_time", at),
            "fct_block_proposer_entity": e.withColumn("slot_start_date_time", at),
        }
    )


def test_sample_filter_before_or_after_scoring(spark):
    """The early filter changes mean and deviation, the late one only the list."""
    t = _arrivals(spark, {"small": [9000], "a": [1000] * 10, "b": [2000] * 10, None: [3000] * 10})
    late = {r["entity"]: r["z_score"] for r in scores.chart(t, ALL).collect()}
    early = {r["entity"]: r["z_score"] for r in scores.lowest(t, ALL).collect()}
    assert set(late) == {"a", "b", "unknown"} and early == {"a": -1.22}
    assert late["a"] != early["a"]


def test_size_labels():
    assert block_size.size_labels(True)[:2] == ["00. <16 KB", "01. 16-32 KB"]
    assert block_size.size_labels(False)[-2:] == ["192 - 224 KB", "224+ KB"]
    assert len(block_size.size_labels(True)) == len(block_size.STARTS_KB) == 13


def test_operation_addresses_and_names():
    assert call_frames.address(10) == "0x000000000000000000000000000000000000000a"
    assert call_frames.names_of([11], "bls12_") == {call_frames.address(11): "g1add"}


def test_callers_join_reduced_frames(spark):
    frames = [
        # block, tx, id, parent, depth, target, opcodes, gas, version
        (1, "t", 0, None, 0, "0xcaller", 9, 100, 1),
        (1, "t", 1, 0, 1, call_frames.address(5), 0, 30, 1),
        (1, "t", 1, 0, 1, call_frames.address(5), 0, 50, 2),
        (1, "t", 2, 0, 1, call_frames.address(5), 0, 70, 1),
        (1, "t", 3, 0, 1, call_frames.address(5), 4, 70, 1),
        (1, "t", 4, 0, 1, call_frames.address(5), 0, 0, 1),
    ]
    schema = (
        "block_number bigint, transaction_hash string, call_frame_id bigint, parent_call_frame_id bigint, "
        "depth int, target_address string, opcode_count bigint, gas bigint, updated_date_time int"
    )
    t = Reduced({"int_transaction_call_frame": spark.createDataFrame(frames, schema)})
    got = rows(call_frames.callers(t, [5], blocks=(1, 1), count="modexp_calls"))
    assert got == [("0xcaller", 2, 120, 60.0, 50, 70)]


def test_behind_peers(spark):
    genesis = 1606824023
    status = [
        ("outbound", 1, 12 * 1 + 5, 9, 10),
        ("outbound", 1, 12 * 2 + 6, 10, 10),
        ("inbound", 1, 12 * 3 + 6, 9, 10),
        ("outbound", 1, 12 * 4 + 2, 9, 10),
        ("outbound", 1, 12 * 5 + 7, None, 10),
        ("outbound", 2, 12 * 1 + 8, 10, 10),
        ("outbound", 3, 12 * 1 + 8, 1, 10),
    ]
    s = spark.createDataFrame(
        status, "direction string, peer_id_unique_key bigint, sec bigint, response_head_slot bigint, request_head_slot bigint"
    ).withColumn("event_date_time", F.timestamp_seconds(genesis + F.col("sec")))
    beats = spark.createDataFrame(
        [(1, "prysm/v5"), (2, "prysm"), (3, "teku")], "remote_peer_id_unique_key bigint, remote_agent_implementation string"
    ).withColumn("event_date_time", F.timestamp_seconds(F.lit(genesis)))
    msgs = spark.createDataFrame(
        [(1, 1, 5000), (1, 1, 13000), (2, 1, 11500), (2, 9, 5000)],
        "peer_id_unique_key bigint, slot bigint, propagation_slot_start_diff bigint",
    ).withColumn("slot_start_date_time", F.timestamp_seconds(genesis + F.col("slot") * 12))
    t = Reduced(
        {
            "libp2p_handle_status": s,
            "libp2p_synthetic_heartbeat": beats,
            "libp2p_gossipsub_aggregate_and_proof": msgs,
        }
    )
    got = {(r["state"], r["behavior"]): (r["cnt"], r["pct"]) for r in gossip.behind_state_behaviour(t, ALL).collect()}
    assert got == {
        ("Caught behind", "Peak and tail"): (1, 100.0),
        ("Had block", "Sent nothing"): (2, 100.0),
    }
    classes = {r["category"]: (r["peer_count"], r["total_msgs"]) for r in gossip.behind_classes(t, ALL).collect()}
    assert classes == {"Often (40-80%)": (1, 2), "Rarely (<10%)": (1, 1)}


def test_vote_groups_take_the_newest_known_source(spark):
    nodes = spark.createDataFrame(
        [(1, "rocketpool", 1), (1, "solo_stakers", 2), (1, "exchange", 3), (2, "exchange", 1)],
        "validator_index bigint, source string, updated_date_time int",
    )
    votes_df = spark.createDataFrame(
        [(1, 1, 0), (1, 2, 0), (2, 1, 3), (2, 2, None)], "slot bigint, attesting_validator_index bigint, slot_distance bigint"
    ).withColumn("slot_start_date_time", F.timestamp_seconds(F.lit(1606824023)))
    t = Reduced({"dim_node": nodes, "fct_attestation_correctness_by_validator_head": votes_df})
    got = rows(votes.attester_accuracy(t, ALL))
    assert got == [("Other", 1, 1, 100.0), ("Solo Stakers", 1, 2, 50.0)]


def test_set_overlap_invariants(spark):
    rng = random.Random(5)
    left = [(rng.randint(0, 3), rng.randint(0, 40)) for _ in range(200)]
    right = [(rng.randint(0, 4), rng.randint(0, 40)) for _ in range(200)]
    out = voter_sets.set_overlap(
        spark.createDataFrame(left, "g int, m int"), spark.createDataFrame(right, "g int, m int"), ["g"], "m"
    )
    for r in out.collect():
        a, b = ({m for g, m in side if g == r["g"]} for side in (left, right))
        assert (r["in_both"], r["only_left"], r["only_right"]) == (len(a & b), len(a - b), len(b - a))
        assert abs(r["jaccard"] - len(a & b) / len(a | b)) < 1e-12


def test_bitfields(spark):
    df = spark.createDataFrame([("0x0381", ["a", "b", "c", "d", "e", "f", "g", "h", "i"])], "bits string, committee array<string>")
    # 0x03: bits 0 and 1 of byte 0; 0x81: bits 0 and 7 of byte 1, of which bit 8 has a member.
    got = rows(voter_sets.decode_voters(df, "bits", "committee", "voter", []))
    assert got == [("a",), ("b",), ("i",)]
    long = spark.createDataFrame([("0x" + "ff" * 20,), ("",), ("0x0",)], "b string")
    assert [r[0] for r in long.select(voter_sets.popcount(F.col("b"))).collect()] == [160, 0, 0]


def test_never_reached_groups_stay_in_the_curve(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.5), ("c", None), ("d", 99.0)], "g string, w double")
    curve = [(r["at"], r["reached_pct"]) for r in voter_sets.reached_curve(df, "w", 1, 3).orderBy("at").collect()]
    assert curve == [(0, 25.0), (1, 25.0), (2, 50.0), (3, 50.0)]


def test_record_diff_kinds(spark):
    long = [
        ("r", "p1", "x", "1"), ("r", "p2", "x", "1"), ("r", "p3", "x", "2"),
        ("r", "p1", "y", "7"), ("r", "p2", "z", "1"), ("r", "p3", "z", "1"),
    ]
    df = spark.createDataFrame(long, "rec string, prod string, field string, value string")
    diff = records.record_diff(df, ["rec"], "prod", ["p1", "p2", "p3"])
    got = {(r["field"], r["prod"]): r["verdict"] for r in diff.collect()}
    assert got[("x", "p3")] == records.VALUE_MISMATCH and got[("x", "p1")] == records.MATCH
    assert got[("y", "p1")] == records.EXTRA_KEY and got[("y", "p2")] == records.MATCH
    assert got[("z", "p1")] == records.MISSING_KEY


def test_hex_format_classes(spark):
    values = ["", "0x", "0x1f", "0x" + "0" * 62 + "1f", "1f", "0" * 64, "zz", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(records.format_class(F.col("v"))).collect()]
    assert got == [
        "empty", "bare prefix", "prefixed, compact", "prefixed, padded",
        "unprefixed, compact", "unprefixed, padded", "other", "missing",
    ]


def test_samples_repeat(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("s"), "id")
    one = rows(measures.sample_by_stratum(df, ["s"], "id", 10, "seed"))
    assert one == rows(measures.sample_by_stratum(df.repartition(5), ["s"], "id", 10, "seed")) and len(one) == 20
    assert one != rows(measures.sample_by_stratum(df, ["s"], "id", 10, "other"))


def test_catalogue_is_complete_and_refreshes(spark, sf_dir, tmp_path):
    from contract.derived import DerivedTables

    assert sorted(catalogue.CATALOGUE) == list(range(1, 98)) and len(catalogue.BY_NAME) == 97
    store = ResultStore(spark, str(tmp_path))
    names = ["cpu_reference_figures", "reorgs_daily"]
    assert refresh(spark, DerivedTables(spark, sf_dir), store, "2026-01-01", names) == names
    assert spark.table("result_cpu_reference_figures").count() == 6


def test_refresh_makes_results_of_other_tables_anew(spark, tmp_path):
    def tables(source, n):
        day = spark.range(n).select(F.lit("2026-01-01").cast("date").alias("day_start_date"), F.lit(2).alias("depth"))
        t = Reduced({"fct_reorg_daily": day.withColumns({"reorg_count": F.lit(n), "meta_network_name": F.lit("mainnet")})})
        t.source = source
        return t

    class Counting(ResultStore):
        made = 0

        def materialize(self, text, build=None, file_name=""):
            self.made += not self.stored(text)
            return spark.range(1)

        def stored(self, text):
            seen = text in self.texts
            self.texts.add(text)
            return seen

    store = Counting(spark, str(tmp_path))
    store.texts = set()
    for source, network, params in [("a", "mainnet", {}), ("b", "mainnet", {}), ("b", "other", {}), ("b", "other", {"x": 1})] * 2:
        t = tables(source, 1)
        t.network = network
        refresh(spark, t, store, "2026-01-01", ["reorgs_daily"], {"reorgs_daily": params})
    assert store.made == 4


def test_inclusion_answers_each_subject_of_a_key(spark):
    subjects = spark.createDataFrame([("a", 1, 1), ("a", 1, 5), ("a", 2, 5), ("a", 1, 10), (None, 1, 0)], "k string, s int, at0 bigint")
    events = spark.createDataFrame([("a", 1, 2), ("a", 1, 10), ("a", 2, 9), ("b", 1, 3)], "k string, s int, at1 bigint")
    out = voter_sets.first_inclusion(subjects, events, ["k", "s"], "at0", "at1", F.col("at1") - F.col("at0"))
    got = {(r["k"], r["s"], r["at0"]): r["delay"] for r in out.collect()}
    assert got == {("a", 1, 1): 1, ("a", 1, 5): 5, ("a", 2, 5): 4, ("a", 1, 10): None, (None, 1, 0): None}


def test_share_in_the_first_following_event(spark):
    subjects = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (4, "x")], "slot bigint, voter string")
    events = spark.createDataFrame([(1,), (3,), (4,)], "included bigint")
    members = spark.createDataFrame([(1, "x", 3), (1, "x", 3), (1, "y", 4), (1, "z", 3)], "slot bigint, voter string, included bigint")
    out = voter_sets.first_following_share(
        subjects, events.withColumnRenamed("included", "at"), members.withColumnRenamed("included", "at"), "slot", "at", ["voter"]
    )
    got = {r["slot"]: (r["members"], r["first_at"], r["included"], r["included_share"]) for r in out.collect()}
    assert got == {1: (3, 3, 2, 66.6667), 4: (1, None, 0, 0.0)}


def test_call_differences_keep_the_published_observer(spark):
    hour = F.lit("2026-01-26 05:00:00").cast("timestamp")

    def calls(rows, schema):
        base = {"meta_network_name": F.lit("mainnet"), "meta_client_name": F.lit("n-geth-7870-1"), "event_date_time": hour}
        return spark.createDataFrame(rows, schema).withColumns(base)

    outer = calls([("h1", 30), ("h2", 50)], "block_hash string, duration_ms bigint")
    inner = [("h1", 10, observers.SOURCE), ("h2", 20, observers.SOURCE)]
    results = []
    for more in ([], [("h1", 500, "ENGINE_SOURCE_OTHER"), ("h2", 1, None)]):
        t = Reduced(
            {
                "execution_engine_new_payload": calls(inner + more, "block_hash string, duration_ms bigint, source string"),
                "consensus_engine_api_new_payload": outer,
            }
        )
        results.append([rows(f(t)) for f in (observers.difference_by_client, observers.difference_hourly, observers.difference_ranges)])
    assert results[0] == results[1] and all(results[0])


def test_members_of_the_first_event_are_cut_before_they_are_counted_once(spark):
    subjects = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "start long, member_key long")
    events = spark.createDataFrame([(2,), (3,)], "at long")
    members = spark.createDataFrame([(1, 10, 2), (1, 10, 2), (1, 11, 3), (2, 12, 3), (2, None, 3)], "start long, member_key long, at long")
    found = voter_sets.first_following_share(subjects, events, members, "start", "at", ["member_key"])
    assert sorted((r.start, r.members, r.first_at, r.included) for r in found.collect()) == [(1, 2, 2, 1), (2, 1, 3, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    once = next(i for i, line in enumerate(plan) if "Aggregate [" in line and "member_key" in line)
    assert once < next(i for i, line in enumerate(plan) if "Join Inner" in line)
