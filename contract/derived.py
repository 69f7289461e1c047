"""Event tables derived from the whole given tables.

Every table is one SELECT over given tables, valid in Spark and DuckDB but for
the few calls in ``DIALECTS``.  Nothing is sampled or cut, so the work of a
query grows with the data it is pointed at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotwise.functions.timeparts import GENESIS, SLOT_SECONDS
from slotwise.plans.cpu import CONSENSUS_NODES
from slotwise.plans.sentinels import EMPTY_BLOB_HASH
from slotwise.sources.tables import SPECS, VERSION, Tables

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

DIALECTS = {
    "spark": {
        "ms": lambda x: f"timestamp_millis(cast({x} as bigint))",
        "list": lambda *xs: f"array({', '.join(xs)})",
        "none": lambda: "cast(array() as array<string>)",
        "each": lambda *xs: f"explode(array({', '.join(xs)}))",
        "without": lambda *xs: f"* except ({', '.join(xs)})",
    },
    "duckdb": {
        "ms": lambda x: f"epoch_ms(cast({x} as bigint))",
        "list": lambda *xs: f"[{', '.join(xs)}]",
        "none": lambda: "cast([] as varchar[])",
        "each": lambda *xs: f"unnest([{', '.join(xs)}])",
        "without": lambda *xs: f"* exclude ({', '.join(xs)})",
    },
}

CLIENTS = ["prysm", "lighthouse", "teku", "nimbus", "lodestar", "grandine", ""]
ENGINES = ["geth", "besu", "nethermind", "reth", "erigon", "ethrex"]
AGENTS = ["prysm", "lighthouse", "erigon", "teku", "nimbus", "lodestar", "grandine", "prysm-dev", "rust", ""]


# Tables with two versions of every key: a column and what its older version said.
OLDER = {
    "fct_block": ("status", "'pending'"),
    "fct_block_head": ("block_total_bytes", "block_total_bytes + 4096"),
    "fct_block_mev": ("block_root", "block_root"),
    "fct_block_proposer_entity": ("entity", "'unassigned'"),
    "fct_block_blob_count_head": ("blob_count", "blob_count + 1"),
    "fct_attestation_correctness_head": ("votes_head", "cast(0 as bigint)"),
    "fct_engine_new_payload_by_el_client": ("avg_duration_ms", "avg_duration_ms + 1000"),
}
NEWEST_MS, DAY_MS = 1_780_000_000_000, 86_400_000


def _case(expr: str, values: list[str], last: str | None = None) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    tail = "" if last is None else f" else {last}"
    return f"case {expr} {whens}{tail} end"


def texts(dialect: str) -> dict[str, str]:
    """SELECT of each derived table; base tables stand in braces."""
    d, out = DIALECTS[dialect], _newest(dialect)
    for name, (column, older) in OLDER.items():
        out[name] = f"""
            select {d['without'](column, 'age')}, case when age = 1 then {older} else {column} end as {column},
                   {d['ms'](f'{NEWEST_MS} - age * {DAY_MS}')} as {VERSION}
            from (select *, {d['each']('0', '1')} as age from ({out[name]}) as latest) as versions"""
    return out


def _newest(dialect: str) -> dict[str, str]:
    d = DIALECTS[dialect]

    def slot_ms(slot: str) -> str:
        return f"({GENESIS} + {slot} * {SLOT_SECONDS}) * 1000"

    line_time = f"{d['ms'](slot_ms('l_orderkey'))} as slot_start_date_time"
    order_time = f"{d['ms'](slot_ms('o_orderkey'))} as slot_start_date_time"
    version = f"cast(l_shipdate as timestamp) as {VERSION}"
    net = "'mainnet' as meta_network_name"
    cents = "cast(floor(l_extendedprice) as bigint)"
    total = "cast(floor(o_totalprice) as bigint)"
    node = (
        "case when l_linenumber = 7 then 'utility-mainnet-other' else "
        f"concat('utility-mainnet-prysm-', {_case('l_linenumber - 1', ENGINES)}, "
        "case when l_linenumber = 6 then '-001' else '-7870-001' end) end as meta_client_name"
    )
    part_hash = [f"concat('h', cast(l_orderkey as string), '-{k}')" for k in range(3)]
    fetched = (
        f"case l_linenumber % 3 when 0 then {d['list'](part_hash[0])} "
        f"when 1 then {d['list'](*part_hash[:2])} else {d['list'](*part_hash)} end as versioned_hashes"
    )
    sent_hash = [f"concat('h', cast(o_orderkey as string), '-{k}')" for k in range(3)]
    sentinel = f"'{EMPTY_BLOB_HASH}'"
    sent = (
        f"case when o_orderpriority = '5-LOW' then {d['none']()} "
        f"when o_orderpriority = '1-URGENT' then {d['list'](sent_hash[0], sentinel, sent_hash[1], sentinel)} "
        f"when o_orderpriority = '2-HIGH' then {d['list'](sentinel)} "
        f"when o_orderpriority = '3-MEDIUM' then {d['list'](*sent_hash[:2])} "
        f"else {d['list'](*sent_hash)} end as blob_hashes"
    )
    root = "concat('b', cast(l_orderkey as string))"
    order_root = "concat('b', cast(o_orderkey as string))"
    status = (
        "case when l_returnflag = 'N' then 'SUCCESS' when l_returnflag = 'R' then 'EMPTY' "
        "when l_linestatus = 'O' then 'SUCCESS' else 'PARTIAL' end as status"
    )
    fetch_time = f"{d['ms'](slot_ms('l_orderkey') + ' + l_linenumber * 300')} as event_date_time"
    entity = _case(
        "o_custkey % 16",
        ["solo_stakers", "rocketpool", "csm_operator1_lido", "csm_operator2", "lido", "p2p_lido", "x_lido"],
        "case when o_custkey % 16 = 7 then null else concat('pool-', cast(o_custkey % 23 as string)) end",
    )
    cpu_nodes = list(CONSENSUS_NODES)

    return {
        "libp2p_gossipsub_aggregate_and_proof": f"""
            select {net}, l_orderkey as slot, {line_time}, l_suppkey as peer_id_unique_key,
                   {cents} % 24500 as propagation_slot_start_diff,
                   concat('m', cast(l_partkey as string)) as message_id
            from {{lineitem}}""",
        "libp2p_gossipsub_beacon_block": f"""
            select {net}, l_orderkey as slot, {line_time},
                   cast(floor(l_extendedprice / 8) as bigint) % 12500 as propagation_slot_start_diff
            from {{lineitem}}""",
        "libp2p_synthetic_heartbeat": f"""
            select {net}, l_suppkey as remote_peer_id_unique_key, {fetch_time},
                   {_case('l_suppkey % 10', AGENTS)} as remote_agent_implementation,
                   concat('v', cast((l_suppkey + l_linenumber) % 4 as string)) as remote_agent_version,
                   case when l_linenumber = 7 then null
                        else concat('10.0.0.', cast(l_suppkey % 37 as string)) end as remote_ip
            from {{lineitem}}""",
        "libp2p_handle_status": f"""
            select {net}, l_suppkey as peer_id_unique_key,
                   {d['ms'](slot_ms('l_orderkey') + ' + (l_linenumber + 2) * 1000')} as event_date_time,
                   case when l_returnflag = 'R' then 'inbound' else 'outbound' end as direction,
                   l_orderkey as request_head_slot,
                   case when l_tax = 0 then null
                        when l_quantity * 2 < l_suppkey % 97 then l_orderkey - 1
                        else l_orderkey end as response_head_slot
            from {{lineitem}}""",
        "canonical_beacon_block_execution_transaction": f"""
            select {net}, {order_time},
                   concat('0xAB', lpad(cast(o_custkey % 211 as string), 38, '0')) as `from`, {sent}
            from {{orders}}""".replace("`", '"' if dialect == "duckdb" else "`"),
        "blob_submitter": f"""
            select {net}, concat('0xab', lpad(cast(s_suppkey as string), 38, '0'), '-raw') as address,
                   case when s_suppkey % 9 = 0 then '' else concat('rollup-', cast(s_nationkey as string)) end as name
            from {{supplier}}
            union all
            select {net}, concat('0xAB', lpad(cast(s_suppkey as string), 38, '0')) as address,
                   case when s_suppkey % 5 = 0 then 'second-name'
                        when s_suppkey % 9 = 0 then ''
                        else concat('rollup-', cast(s_nationkey as string)) end as name
            from {{supplier}}""",
        "consensus_engine_api_get_blobs": f"""
            select {net}, l_orderkey as slot, {root} as block_root, {line_time}, {fetch_time}, {node}, {status},
                   cast(l_linenumber - 1 as bigint) as requested_count,
                   case when l_returnflag = 'R' then cast(0 as bigint)
                        else cast(l_linenumber - 1 as bigint) end as returned_count,
                   {fetched}, {cents} % 400 as duration_ms
            from {{lineitem}}""",
        "execution_engine_get_blobs": f"""
            select {net}, {fetch_time}, {node}, {fetched},
                   {cents} % 400 - l_suppkey % 60 + 5 as duration_ms
            from {{lineitem}}""",
        "consensus_engine_api_new_payload": f"""
            select {net}, {node}, {root} as block_hash, {cents} % 400 as duration_ms
            from {{lineitem}}""",
        "execution_engine_new_payload": f"""
            select {net}, {node}, {root} as block_hash, {fetch_time},
                   {cents} % 400 - l_suppkey % 60 + 5 as duration_ms,
                   case when l_returnflag = 'A' then 'NODE' else 'PROXY' end as source
            from {{lineitem}}""",
        "beacon_api_eth_v1_events_head": f"""
            select {net}, l_orderkey as slot, {root} as block, {line_time}, {node},
                   {cents} % 5000 as propagation_slot_start_diff
            from {{lineitem}}""",
        "mev_relay_proposer_payload_delivered": f"""
            select {net}, o_orderkey as slot, {order_time}
            from {{orders}} where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
        "cpu_utilization": f"""
            select {net}, {_case('l_suppkey % 5', ['lighthouse', 'prysm', 'lodestar', 'nimbus'], "'geth'")} as client_type,
                   {_case('l_partkey % 4', cpu_nodes)} as meta_client_name,
                   {d['ms'](slot_ms('l_orderkey') + ' + l_partkey % 62 * 200')} as window_start,
                   l_orderkey as wallclock_slot,
                   {d['ms'](slot_ms('l_orderkey'))} as wallclock_slot_start_date_time,
                   cast(floor(l_extendedprice * 3000) as bigint) as total_on_cpu_ns,
                   cast(200 as bigint) as interval_ms, cast(1 as int) as system_cores
            from {{lineitem}}""",
        "fct_block": f"""
            select o_orderkey as slot, {order_root} as block_root,
                   concat('b', cast(o_orderkey - 1 - o_custkey % 5 as string)) as parent_root,
                   case when o_orderstatus = 'F' then 'canonical' else 'orphaned' end as status, {order_time}
            from {{orders}}""",
        "fct_block_head": f"""
            select o_orderkey as slot, {order_root} as block_root, {total} as block_total_bytes,
                   case when o_orderpriority = '5-LOW' then null
                        else cast(floor(o_totalprice / 2) as bigint) end as block_total_bytes_compressed,
                   o_custkey * 1000 + {total} as execution_payload_gas_used, {order_time}
            from {{orders}}""",
        "fct_block_mev": f"""
            select o_orderkey as slot, {order_root} as block_root, {order_time}
            from {{orders}} where o_orderpriority in ('1-URGENT', '2-HIGH')""",
        "fct_block_first_seen_by_node": f"""
            select l_orderkey as slot, {root} as block_root,
                   concat('node-', cast(l_linenumber as string)) as node_id,
                   {cents} % 13000 as seen_slot_start_diff,
                   case when l_returnflag = 'R' then 'corporate' else 'individual' end as classification,
                   {_case('l_suppkey % 7', CLIENTS)} as meta_consensus_implementation, {line_time}, {version}
            from {{lineitem}}""",
        "fct_block_proposer_entity": f"""
            select o_orderkey as slot, {entity} as entity, {order_time} from {{orders}}""",
        "fct_block_blob_count_head": """
            select o_orderkey as slot, o_custkey % 7 as blob_count
            from {orders} where o_orderpriority <> '4-NOT SPECIFIED'""",
        "fct_attestation_correctness_head": f"""
            select o_orderkey as slot,
                   case when o_orderpriority = '5-LOW' and o_orderstatus = 'P' then null
                        else 29500 - {total} % 6000 end as votes_head,
                   cast(29500 as bigint) as votes_max, {order_time}
            from {{orders}}""",
        "fct_attestation_correctness_canonical": f"""
            select 29500 - {total} % 7000 as votes_head, {total} % 5000 as votes_other,
                   case when o_custkey % 11 = 0 then cast(28000 as bigint) else cast(29500 as bigint) end as votes_max,
                   {order_time}
            from {{orders}}""",
        "fct_attestation_correctness_by_validator_head": f"""
            select l_orderkey as slot, l_partkey as attesting_validator_index,
                   case when l_returnflag = 'N' then cast(0 as bigint)
                        when l_returnflag = 'A' then cast(l_linenumber - 1 as bigint)
                        when l_linestatus = 'O' then cast(2 as bigint) end as slot_distance,
                   {line_time}, {version}
            from {{lineitem}}""",
        "dim_node": f"""
            select p_partkey - p_partkey % 2 as validator_index,
                   {_case('p_size % 6', ['solo_stakers', 'rocketpool', 'csm_operator_1', 'csm_operator_2', 'lido'], "'coinbase'")} as source,
                   {d['ms'](slot_ms('p_partkey'))} as {VERSION}
            from {{part}}""",
        "fct_attestation_participation_rate_daily": """
            select cast(o_orderdate as date) as day_start_date, count(*) as slot_count,
                   avg(o_totalprice) / 5000 as avg_participation_rate,
                   (min(o_totalprice) + max(o_totalprice)) / 10000 as p50_participation_rate,
                   max(o_totalprice) / 5000 as p05_participation_rate,
                   min(o_totalprice) / 5000 as min_participation_rate
            from {orders} group by cast(o_orderdate as date)""",
        "fct_reorg_daily": """
            select cast(o_orderdate as date) as day_start_date, cast(o_custkey % 8 as int) as depth,
                   count(*) as reorg_count
            from {orders} group by cast(o_orderdate as date), cast(o_custkey % 8 as int)""",
        "fct_engine_new_payload_by_el_client": f"""
            select l_orderkey as slot, {_case('l_linenumber % 6', ENGINES)} as meta_execution_implementation,
                   round(avg(l_quantity), 3) as avg_duration_ms, max(l_quantity) as max_duration_ms,
                   count(*) as observation_count, {line_time}
            from {{lineitem}} group by l_orderkey, {_case('l_linenumber % 6', ENGINES)}""",
        "int_transaction_call_frame": f"""
            select l_orderkey as block_number, concat('t', cast(l_orderkey as string)) as transaction_hash,
                   cast(l_linenumber as bigint) as call_frame_id,
                   cast(l_linenumber - 1 as bigint) as parent_call_frame_id,
                   cast(l_linenumber - 1 as int) as depth,
                   concat('0x', lpad(lower(hex(l_suppkey % 24)), 40, '0')) as target_address,
                   case when l_linestatus = 'O' then cast(0 as bigint) else cast(5 as bigint) end as opcode_count,
                   {cents} % 1500 as gas, {version}
            from {{lineitem}}""",
    }


_OPENED: dict[tuple[str, str], DataFrame] = {}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read once per application."""
    at = (spark.sparkContext.applicationId, f"{sf_dir.rstrip('/')}/{name}.parquet")
    if at not in _OPENED:
        _OPENED[at] = spark.read.parquet(at[1])
    return _OPENED[at]


class DerivedTables(Tables):
    """Derived tables, each made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self.source = sf_dir

    def __missing__(self, name: str) -> DataFrame:
        text = texts("spark")[name]
        bases = {b: given(self.spark, self.sf_dir, b) for b in BASE_TABLES if f"{{{b}}}" in text}
        self[name] = self.spark.sql(text, **bases)
        return self[name]


def duckdb_ctes(names) -> str:
    """``a as (...), b as (...)`` for the named derived tables; ``x_final`` is the
    newest row per key of ``x``."""
    all_texts, out = texts("duckdb"), []
    for name in names:
        base = name.removesuffix("_final")
        if base not in [n for n, _ in out]:
            text = all_texts[base].format(**{b: b for b in BASE_TABLES})
            if base in OLDER:  # the check reads the newest row per key
                keys = ", ".join(SPECS[base].keys)
                text = f"select * from ({text}) qualify row_number() over (partition by {keys} order by {VERSION} desc) = 1"
            out.append((base, text))
        if name.endswith("_final"):
            spec = SPECS[base]
            text = f"select * from {base}"
            if VERSION in all_texts[base]:
                order = ", ".join(f"{c} desc nulls last" for c in (VERSION, *spec.ties))
                text += f" qualify row_number() over (partition by {', '.join(spec.keys)} order by {order}) = 1"
            out.append((name, text))
    return ",\n".join(f"{n} as ({text})" for n, text in out)
