"""Views of the given tables in the shapes that journal queries read.

Each view is one SELECT in a small common dialect (``dialect.render``), so that Spark and the checking
engine read the same definition; only the journal's sequence number is made by an operator of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.functions.dialect import render
from rillway.operators.ordered import running, with_sequence

_HUB = lambda h: f"D(60 + 240 * ({h} % 3))", lambda h: f"D(case when {h} < 3 then 60 else 340 end)"
_X, _Y = _HUB

VIEWS = {
    "journal": """select seq, event_id, rn, user_id, event_type, value, at_ms, concat('S', user_id, '-', IDIV(rn - 1, 8)) as subject,
        case event_type when 'signup' then 'task_created' when 'error' then 'vehicle_offline' when 'purchase' then 'task_assigned' else 'task_event' end as kind,
        case when event_id % 12 < 8 then case (rn - 1) % 8 when 0 then 'ASSIGN' when 1 then 'DISPATCH' when 2 then 'ENQUEUE' when 3 then 'PROCEED' when 4 then 'START' when 5 then 'PAUSE' when 6 then 'RESUME' else 'RECOVER' end
             when event_id % 12 = 8 then 'COMPLETE' when event_id % 12 = 9 then 'REQUEUE' when event_id % 12 = 10 then 'PAUSE' else 'FAIL' end as event,
        substr(md5(STR(event_id)), 1, 16) as trace_id
        from (select *, MS(ts) as at_ms, row_number() over (partition by user_id order by ts, event_id) as rn from {events_seq}) e""",
    "messages": """select seq, event_id, 'fleet.events' as topic, part as partition, off, k as key, concat('fleet.events-', part, '-', off) as msg_id, at_ms, failed, size from {events_off}""",
    "tasks_in": f"""select task_id, cust, priority, created_ms, state, {_X("ho")} as ox, {_Y("ho")} as oy, {_X("hd")} as dx, {_Y("hd")} as dy, price
        from (select o_orderkey as task_id, o_custkey as cust, 6 - cast(substr(o_orderpriority, 1, 1) as int) as priority, MS(o_orderdate) as created_ms,
        case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'PENDING' else 'EXECUTING' end as state, o_custkey % 6 as ho, (o_custkey + 1 + o_orderkey % 5) % 6 as hd, o_totalprice as price from {{orders}}) o""",
    "vehicles_in": f"""select vehicle_id, {_X("h")} + vehicle_id % 7 as vx, {_Y("h")} as vy, (bal + 1000.0) / 110.0 as battery, vehicle_id % 11 <> 0 as online,
        case nation % 3 when 0 then 'IDLE' when 1 then 'EXECUTING' else 'CHARGING' end as vstate
        from (select s_suppkey as vehicle_id, s_suppkey % 6 as h, s_acctbal as bal, s_nationkey as nation from {{supplier}}) s""",
    "resources": "select distinct l_suppkey % 26 as resource, 1 + (l_suppkey % 26) % 3 as capacity from {lineitem}",
    "holders": """select resource, vehicle, priority from (select l_suppkey % 26 as resource, l_orderkey as vehicle, max(1 + l_linenumber % 5) as priority, row_number() over (partition by l_suppkey % 26 order by l_orderkey) as rn
        from {lineitem} where l_linestatus = 'F' group by l_suppkey % 26, l_orderkey) h where rn <= 3 and rn <= 1 + resource % 3 - case when resource % 4 = 0 then 1 else 0 end""",
    "failures": "select msg_id, key, 2 * seq + 20 * k as arrival from {messages} cross join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (19)) as t(k) where failed and k <= event_id % 20",
    "requests": """select l_suppkey % 26 as resource, l_orderkey as vehicle, max(1 + l_linenumber % 5) as priority, min(MS(l_shipdate)) as requested_ms, min(l_orderkey * 10 + l_linenumber) as seq
        from {lineitem} where l_linestatus = 'O' group by l_suppkey % 26, l_orderkey""",
    "spans": "select conv_id as trace_id, turn as span_id, case when turn > 0 then turn - 1 end as parent_id, role as name, 1000 * turn as start_ms, cast(length(text) as bigint) as duration_ms from {conversations}",
    "readings": "select event_type as rule, user_id as subject, value, MS(ts) as at_ms, event_id from {events}",
    "traffic_log": """select l_suppkey as resource, l_orderkey % 40 as vehicle, 1 + l_linenumber % 5 as priority, MS(l_shipdate) as at_ms, l_orderkey * 10 + l_linenumber as id,
        case when l_orderkey % 97 = 0 then 'release_all' else case (l_orderkey + l_linenumber) % 5 when 2 then 'release' when 4 then 'release_resource' else 'request' end end as op from {lineitem}""",
    "waits": "select c_custkey as waiter, B(H64(STR(c_custkey)) % (select count(*) from {customer})) + 1 as holder from {customer}",
    "yard_waits": "select c_custkey as waiter, IDIV(c_custkey, 6) * 6 + (c_custkey * k + k) % 6 as holder from {customer} cross join (values (5), (7)) as t(k) where c_custkey % 4 <> 3 or k = 5",
    "silence_plan": "select user_id % 40 as vehicle, IDIV(MS(ts), 60000) as start, event_id % 900 as duration, event_id as line from {events} where event_type = 'error'",
    "submissions": "select concat(user_id, ':', event_type) as command, MS(ts) as at_ms, event_id, event_id % 5 = 0 as fails, event_id % 5 <> 1 as confirmed from {events}",
    "hash_commands": """select concat('h', user_id % 50) as key, seq, MS(ts) as at_ms, case event_id % 6 when 0 then 'hset' when 1 then 'hget' when 2 then 'hset' when 3 then 'hlen' when 4 then 'exists' else 'hdel' end as op,
        concat('f', IDIV(event_id, 6) % 5) as field, case when event_id % 6 in (0, 2) then STR(event_id % 100) end as value from {events_seq}""",
    "lane_loads": """select a, b, B(count(*) % 7) as load from (select substr('ABCDEF', cast(1 + (ox - 60) / 240 + case when oy > 200 then 3 else 0 end as int), 1) as a, substr('ABCDEF', cast(1 + (dx - 60) / 240 + case when dy > 200 then 3 else 0 end as int), 1) as b
        from {tasks_in} where state = 'EXECUTING') h group by a, b""",
    "admission_log": "select seq, partition, at_ms, case when event_id % 4 = 0 then 'drain' else 'publish' end as op, case when event_id % 4 = 0 and event_id % 160 > 0 then IDIV(event_id, 4) % 7 end as budget from {messages}",
    "dedup_ops": """select concat('g', user_id % 16) as store, event_id as ord, MS(ts) as at_ms, concat('m', IDIV(event_id, 16) % 23) as key,
        case event_id % 7 when 0 then 'claim' when 1 then 'mark' when 2 then 'release' when 3 then 'check_and_set' when 4 then 'seen' when 5 then 'claim' else case when event_id % 3 = 0 then 'forget' else 'mark' end end as op from {events}""",
    "records": """select seq, event_id, user_id, at_ms, concat('T', user_id, '-', IDIV(rn - 1, 8)) as task_id, kind,
        case when kind in ('task_assigned', 'vehicle_event', 'vehicle_offline', 'vehicle_online') then concat('V', user_id + event_id % 3) when kind = 'task_requeued' and event_id % 4 = 0 then concat('V', user_id) else '' end as vehicle_id,
        case when kind = 'vehicle_event' then case event_id % 7 when 0 then 'CHARGE' when 1 then 'CHARGE_DONE' when 2 then 'FAULT' when 3 then 'REPAIR' when 4 then 'REPAIR_DONE' when 5 then 'RECOVER' else 'MAINTAIN' end
             when kind <> 'task_event' then null when event_id % 3 < 2 then case (rn - 1) % 8 when 2 then 'DISPATCH' when 3 then 'ENQUEUE' when 4 then 'PROCEED' when 5 then 'START' when 6 then 'PAUSE' else 'RESUME' end
             else case event_id % 11 when 0 then 'START' when 1 then 'PAUSE' when 2 then 'RESUME' when 3 then 'RECOVER' when 4 then 'COMPLETE' when 5 then 'CANCEL' when 6 then 'FAIL' when 7 then 'REQUEUE' when 8 then 'COMPLETE' when 9 then 'ENQUEUE' else 'PROCEED' end end as event
        from (select *, MS(ts) as at_ms, case when rn % 8 = 1 and event_id % 9 > 0 then 'task_created' when rn % 8 = 2 then 'task_assigned' when event_id % 10 < 6 then 'task_event' when event_id % 10 = 6 then 'task_requeued' when event_id % 10 = 7 then 'task_assigned'
              when event_id % 10 = 8 then 'vehicle_event' when event_id % 20 = 9 then 'vehicle_offline' else 'vehicle_online' end as kind from (select *, row_number() over (partition by user_id order by ts, event_id) as rn from {events_seq}) e) k""",
    "task_commands": """select 8 * seq + 1 + k as ord, task_id, case event_id % 3 when 0 then 'PAUSE' when 1 then 'RESUME' else 'CANCEL' end as event, concat('C', IDIV(event_id, 3) % 2) as command, at_ms
        from {records} cross join (values (0), (1), (2)) as t(k) where event_id % 5 = 1 and k <= event_id % 4""",
    "deliveries": "select *, 2 * seq as arrival from {messages} union all select *, 2 * seq + 15 as arrival from {messages} where event_id % 7 = 0",
    "commands": """select concat('k', user_id % 60) as key, seq, MS(ts) as at_ms, case event_id % 9 when 0 then 'set' when 1 then 'incr' when 2 then 'get' when 3 then 'expire' when 4 then 'ttl' when 5 then 'exists' when 6 then 'incr' when 7 then 'persist' else case when event_id % 4 = 0 then 'delete' else 'get' end end as op,
        case when event_id % 9 = 0 then STR(event_id % 100) end as value, case when event_id % 9 = 3 or event_id % 18 = 0 then cast((event_id % 5) * 7200000 as bigint) end as ttl_ms, concat('f', event_id % 3) as field, event_id from {events_seq}""",
}
NEEDS = {"journal": ["events_seq"], "journal_lean": ["events"], "messages": ["events_off"], "failures": ["messages"], "traffic_log": ["lineitem"], "waits": ["customer"], "yard_waits": ["customer"], "silence_plan": ["events"], "submissions": ["events"], "hash_commands": ["events_seq"], "tasks_in": ["orders"], "vehicles_in": ["supplier"], "resources": ["lineitem"], "holders": ["lineitem"], "requests": ["lineitem"], "spans": ["conversations"], "readings": ["events"], "deliveries": ["messages"], "records": ["events_seq"], "dedup_ops": ["events"], "admission_log": ["messages"], "lane_loads": ["tasks_in"], "task_commands": ["records"], "commands": ["events_seq"]}
#: The journal without its sequence numbers, for what does not read them.
VIEWS["journal_lean"] = VIEWS["journal"].replace("select seq, ", "select ", 1).replace("{events_seq}", "{events}")
SEQUENCE = "select *, row_number() over (order by ts, event_id) as seq from events"
_ROUTED = "select ts, event_id, STR(user_id) as k, cast(H64(STR(user_id)) % 4 as bigint) as part, MS(ts) as at_ms, event_type = 'error' as failed, length(props) as size from {events}"
OFFSETS = f"select *, row_number() over (order by ts, event_id) as seq, row_number() over (partition by part order by ts, event_id) - 1 as off from ({_ROUTED}) r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "events_seq":
        return with_sequence(table(spark, sf_dir, "events"), ["ts", "event_id"])
    if name == "events_off":
        one = F.lit(1).cast("long")
        routed = spark.sql(render(_ROUTED, "spark"), events=table(spark, sf_dir, "events"))
        return running(routed, ["ts", "event_id"], {"seq": ([], one), "off": (["part"], one)}).withColumn("off", F.col("off") - 1)
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    return spark.sql(render(VIEWS[name], "spark"), **{n: view(spark, sf_dir, n) for n in NEEDS[name]})


def with_clause(names: list[str]) -> str:
    """The views' definitions for the checking engine, dependencies first."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        if name == "events_seq":
            done[name] = SEQUENCE
        elif name == "events_off":
            done[name] = render(OFFSETS, "check")
        elif name in VIEWS:
            for n in NEEDS[name]:
                add(n)
            done[name] = render(VIEWS[name], "check")

    for n in names:
        add(n)
    return ", ".join(f"{n} as ({t})" for n, t in done.items())
