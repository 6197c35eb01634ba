"""All registered journal queries with the SQL that must give the same rows.

Plain relational queries are one text for both engines. Folds, plans and graph walks run through the
operators here, and are checked against recursive SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.functions import scalars as fn
from rillway.functions.dialect import render
from rillway.operators import dispatch, fsm, kv, liveness, ordered, traffic
from rillway.sources import generate, io
from rillway.sources.views import view, with_clause
from rillway.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _tables(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def _check(text: str, recursive: bool = False) -> str:
    names, body = _tables(text), render(text, "check")
    views = with_clause(names)
    extra = body.startswith("with ")
    if extra:
        body = body.removeprefix("with ").removeprefix("recursive ")
    head = f"with {'recursive ' if recursive else ''}{views}" if views else f"with {'recursive ' if recursive else ''}" if extra else ""
    return f"{head}{', ' if views and extra else ' ' if head else ''}{body}"


def plain(name: str, text: str) -> None:
    """One text for both engines. Where it reads no sequence number, Spark's journal makes none."""
    ORACLE_SQL[name] = _check(text)
    if not re.search(r"\bseq\b", text):
        text = text.replace("{journal}", "{journal_lean}")
    QUERIES[name] = lambda spark, d: spark.sql(render(text, "spark"), **{t: view(spark, d, t) for t in _tables(text)})


def built(name: str, oracle: str | None = None, recursive: bool = False):
    """A query through an operator, with SQL to check it where given."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = _check(oracle, recursive)
        return f

    return add


# journal ------------------------------------------------------------------------------------------------
plain("journal_slice", "select seq, kind, subject, at_ms from {journal} where seq > 100 and seq <= 400")
plain("journal_get", "select seq, kind, subject, at_ms, trace_id from {journal} where seq = 42")
plain("journal_by_subject", "select seq, subject, kind, event from {journal} where user_id = 7")
plain("journal_by_trace", "select seq, subject, kind, trace_id from {journal} where trace_id like 'a%'")
plain("journal_kind_counts", "select kind, count(*) as n from {journal} group by kind")
plain("journal_head", "select max(seq) as head, count(*) as n from {journal}")
plain("journal_digest", "select subject, SHA(LAGG(concat('[', seq, ',\"', kind, '\",', at_ms, ']'), '', seq)) as digest from {journal} group by subject")
plain("journal_codec", """select seq, concat('[', seq, ',"', kind, '","', subject, '",', at_ms, ',"', trace_id, '"]') as line from {journal}""")

# bus ----------------------------------------------------------------------------------------------------
plain("msg_route", "select key, STR(H64(key)) as hash, B(H64(key) % 4) as partition, count(*) as n from {messages} group by key")
plain("msg_offsets", "select seq, partition, off, msg_id from {messages}")
plain("bus_read_log", "select partition, off, key, msg_id from {messages} where topic = 'fleet.events' and partition = 2")
plain("bus_read_range", "select partition, off, key from {messages} where off between 20 and 20 + 50 - 1")
plain("bus_replay_keys", "select partition, off, key from {messages} where off >= 10 and off <= 900 and key in ('1', '2', '3', '5', '8', '13')")
plain("partition_size", "select partition, B(sum(size)) as bytes, count(*) as n from {messages} group by partition")
plain("topic_offsets_rollup", "select topic, partition, B(max(off) + 1) as head, count(*) as n from {messages} group by rollup (topic, partition)")
plain("partitions_used", "select topic, count(distinct partition) as used from {messages} group by topic")
plain("committed_prefix_sql", "select partition, B(max(off) + 1) as head, B(coalesce(min(case when failed then off end), max(off) + 1)) as committed from {messages} group by partition")
plain("group_lag", "select B(sum(greatest(head - committed, 0))) as lag, B(max(head - committed)) as worst from (select partition, max(off) + 1 as head, coalesce(min(case when failed then off end), max(off) + 1) as committed from {messages} group by partition) c")
plain("lag_by_partition", "select partition, B(greatest(head - committed, 0)) as lag, head > committed as has_gap from (select partition, max(off) + 1 as head, coalesce(min(case when failed then off end), max(off) + 1) as committed from {messages} group by partition) c")

@built("dlq_attempts", "select f.msg_id, f.arrival, (select count(*) from {failures} g where g.msg_id = f.msg_id and g.arrival <= f.arrival) as attempt, (select count(*) from {failures} g where g.msg_id = f.msg_id and g.arrival <= f.arrival) > 3 as dead from {failures} f")
def _(spark, d):
    return ordered.attempts(view(spark, d, "failures"), ["msg_id"], [F.col("arrival")]).select("msg_id", "arrival", "attempt", "dead")


@built("dlq_records", "select msg_id, min(key) as key, B(4) as attempts from {failures} group by msg_id having count(*) > 3")
def _(spark, d):
    """A message is dead at the first attempt beyond the retries; what fails after that is not read again."""
    tried = ordered.attempts(view(spark, d, "failures"), ["msg_id"], [F.col("arrival")])
    return tried.where(F.col("dead") & (F.col("attempt") == S.MAX_RETRIES + 1)).select("msg_id", "key", F.col("attempt").alias("attempts"))


plain("poll_batch", "select fresh, partition, off from (select case when failed then 0 else 1 end as fresh, partition, off from {messages}) p order by fresh, partition, off limit 64")

#: A message raises the lag when it is published and lowers it when it is acknowledged, 50 messages later; failed ones never are.
_LAG = "select partition, at_ms, IDIV(at_ms, 86400000) as day, 2 * seq as place, B(1) as step, true as published from {messages} union all select partition, at_ms, IDIV(at_ms, 86400000), 2 * seq + 101, B(-1), false from {messages} where not failed"


def _lag(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(render(_LAG, "spark"), messages=view(spark, d, "messages"))


@built("lag_series_peak", f"select day, B(max(lag)) as peak from (select day, (select 1) * sum(step) over (order by place rows unbounded preceding) as lag from ({_LAG}) l) s group by day")
def _(spark, d):
    return ordered.running(_lag(spark, d), ["place"], {"lag": ([], F.col("step"))}).groupBy("day").agg(F.max("lag").alias("peak"))


@built("backpressure", f"select partition, B(count_if(published and lag >= 20)) as refused, B(count_if(published)) as n from (select partition, published, sum(step) over (partition by partition order by place rows unbounded preceding) as lag from ({_LAG}) l) s group by partition")
def _(spark, d):
    lagged = ordered.running(_lag(spark, d), ["place"], {"lag": (["partition"], F.col("step"))})
    return lagged.groupBy("partition").agg(F.count_if(F.col("published") & (F.col("lag") >= 20)).alias("refused"), F.count_if("published").alias("n"))


plain("bus_stats", "select topic, count(*) as messages, count(distinct key) as keys, B(count_if(failed)) as failed, B(sum(size)) as bytes from {messages} where topic not like '__dlq__%' group by topic")
plain("message_trace", "select msg_id, coalesce(case when event_id % 3 = 0 then substr(md5(STR(event_id)), 1, 8) end, '') as trace_id from {messages}")


#: A message is sent again while it is dead, three times at most; its attempts stand at four then, so one failure kills it.
_REDRIVE = """with recursive f as (select msg_id, count(*) as n from {failures} group by msg_id having count(*) > 3),
 st(msg_id, round, rest, dead) as (select msg_id, B(0), n - 4, true from f union all select msg_id, round + 1, greatest(rest - 1, 0), rest > 0 from st where dead and round < 3)
 select f.msg_id, n as failures, max(round) as redrives, not arg_max(dead, round) as recovered from st join f on f.msg_id = st.msg_id group by f.msg_id, n"""


@built("dlq_redrive", _REDRIVE, True)
def _(spark, d):
    return ordered.redriven(view(spark, d, "failures"), ["msg_id"])


_CRASH = """with m as (select partition, off, failed from {messages} where off < 300), h as (select partition, min(off) as hole from m where failed group by partition)
 select m.partition, B(max(off) + 1) as cursor, B(min(coalesce(hole, off + 1 + 300))) as resume, B(max(off) + 1 - min(hole)) as again, B(count_if(not failed and off > hole)) as suppressed from m join h on h.partition = m.partition group by m.partition"""


@built("crash_recovery", _CRASH)
def _(spark, d):
    return ordered.crash_recovery(view(spark, d, "messages").select("partition", F.col("off").alias("offset"), (~F.col("failed")).alias("acked")), 300)


@built("dedup_first", "select msg_id, arrival from (select msg_id, arrival, row_number() over (partition by msg_id order by arrival) as rn from {deliveries} where not failed) d where rn = 1")
def _(spark, d):
    return ordered.first_successful(view(spark, d, "deliveries"), ["msg_id"], [F.col("arrival")], ~F.col("failed")).select("msg_id", "arrival")


@built("committed_prefix", "select partition, B(max(off) + 1) as head, B(coalesce(min(case when failed then off end), max(off) + 1)) as committed from {messages} group by partition")
def _(spark, d):
    return ordered.committed(view(spark, d, "messages").select("partition", F.col("off").alias("offset"), (~F.col("failed")).alias("acked")))


_GAP = """with a as (select partition, off, off + case when event_id % 10 = 0 then 4 else 0 end as arr from {messages}),
 t as (select partition, off, (arr, off) < max((arr, off)) over (partition by partition order by off rows between unbounded preceding and 1 preceding) as early from a)
 select partition, B(max(off) + 1) as expected, B(count_if(early)) as late from t group by partition"""


@built("gap_detect", _GAP)
def _(spark, d):
    m = view(spark, d, "messages").withColumnRenamed("off", "offset")
    at = F.col("offset") + F.when(F.col("event_id") % 10 == 0, 4).otherwise(0)
    return ordered.out_of_order(m.select("partition", "offset", at.alias("arr"), F.col("offset").alias("o")), "partition", ["arr", "o"])


# state machines -----------------------------------------------------------------------------------------
def _moves(moves: list[tuple[str, str, str]]) -> str:
    return "(values " + ", ".join(f"('{a}', '{e}', '{t}')" for a, e, t in moves) + ") as m(f, e, t)"


def _fold(name: str, events: str, moves: list, initial: str) -> str:
    """A recursive fold over ``events`` (subject, ord, at_ms, event): one row per step."""
    return f"""{name}_ev as materialized (select *, row_number() over (partition by subject order by ord) as n from ({events}) x),
 {name}_mv as materialized (select * from {_moves(moves)}),
 {name}(subject, n, ord, at_ms, event, from_state, state, ps, qs, accepted) as (
  select distinct subject, B(0), B(0), B(0), '', '', '{initial}', cast([] as varchar[]), cast([] as varchar[]), true from {name}_ev
  union all
  select subject, n, ord, at_ms, event, state, coalesce(tgt, state),
   case when tgt is null then ps when event = 'PAUSE' then list_append(ps, state) when event = 'RECOVER' then ps[1:len(ps) - 1] when event = 'REQUEUE' then cast([] as varchar[]) else ps end,
   case when tgt is null then qs when event = 'ENQUEUE' then list_append(qs, state) when event = 'PROCEED' then qs[1:len(qs) - 1] when event = 'REQUEUE' then cast([] as varchar[]) else qs end, tgt is not null
  from (select s.subject, e.n, e.ord, e.at_ms, e.event, s.state, s.ps, s.qs, case m.t when '{S.RESUME}' then s.ps[-1] when '{S.QUEUE}' then s.qs[-1] else m.t end as tgt
   from {name} s join {name}_ev e on e.subject = s.subject and e.n = s.n + 1 left join {name}_mv m on m.f = s.state and m.e = e.event) q)"""


_TASKS = "with recursive " + _fold("st", "select subject, seq as ord, at_ms, event from {journal}", S.TASK_MOVES, "PENDING")


def _folded(spark: SparkSession, d: str, key: list[str] | None = None) -> DataFrame:
    # a subject's events are those of one user, so the place among the user's orders them
    return fsm.fold_fsm(view(spark, d, "journal_lean"), key or ["subject"], F.col("rn"), F.col("event"), F.col("at_ms"))


@built("fsm_final_state", _TASKS + " select subject, arg_max(state, n) as state, B(arg_max(len(ps), n)) as paused, B(arg_max(len(qs), n)) as queued from st group by subject", True)
def fsm_final_state(spark, d):
    return _folded(spark, d).select("subject", "state", F.size("pause_stack").cast("long").alias("paused"), F.size("queue_stack").cast("long").alias("queued"))


@built("task_state_counts", _TASKS + " select state, count(*) as n from (select subject, arg_max(state, n) as state from st group by subject) f group by state", True)
def _(spark, d):
    return _folded(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@built("fsm_history", _TASKS + " select subject, B(n) as n, event, from_state, state as to_state from st where n > 0 and accepted", True)
def _(spark, d):
    return fsm.steps(_folded(spark, d), ["subject"]).where("accepted").select("subject", "n", "event", "from_state", "to_state")


@built("fsm_rejections", _TASKS + " select concat(from_state, '<-', event) as reason, count(*) as n from st where n > 0 and not accepted group by 1", True)
def _(spark, d):
    return fsm.steps(_folded(spark, d), ["subject"]).where("NOT accepted").groupBy(F.concat("from_state", F.lit("<-"), "event").alias("reason")).agg(F.count("*").alias("n"))


@built("fsm_transition_stats", _TASKS + " select event, state as to_state, count(*) as n from st where n > 0 and accepted group by grouping sets ((event), (state), ())", True)
def _(spark, d):
    steps = fsm.steps(_folded(spark, d), ["subject"]).where("accepted")
    return steps.groupingSets([["event"], ["to_state"], []], "event", "to_state").agg(F.count("*").alias("n"))


_TIMES = """, tm as (select subject, arg_max(state, n) as state, min_by(at_ms, n) as created_ms, max(case when accepted and event = 'ASSIGN' then at_ms end) as assigned_ms, min(case when accepted and event = 'START' then at_ms end) as started_ms, max(case when accepted and event in ('COMPLETE', 'CANCEL', 'FAIL') then at_ms end) as finished_ms from st where n > 0 group by subject)"""


@built("task_timings", _TASKS + _TIMES + " select subject, state, B(created_ms) as created_ms, B(assigned_ms) as assigned_ms, B(started_ms) as started_ms, B(finished_ms) as finished_ms from tm", True)
def _(spark, d):
    return fsm.timings(_folded(spark, d), ["subject"])


@built("task_timing_distribution", _TASKS + _TIMES + """ select metric, count(v) as count, B(min(v)) as min, round(avg(D(v)), 3) as mean, B(percentile_disc(0.5) within group (order by v)) as p50, B(percentile_disc(0.95) within group (order by v)) as p95, B(percentile_disc(0.99) within group (order by v)) as p99, B(max(v)) as max
 from (select 'service' as metric, finished_ms - assigned_ms as v from tm union all select 'start' as metric, started_ms - assigned_ms as v from tm union all select 'dispatch', assigned_ms - created_ms from tm union all select 'cycle', finished_ms - created_ms from tm) u where v is not null group by metric""", True)
def _(spark, d):
    t = fsm.timings(_folded(spark, d), ["subject"])
    long = t.select(F.expr("stack(4, 'service', finished_ms - assigned_ms, 'start', started_ms - assigned_ms, 'dispatch', assigned_ms - created_ms, 'cycle', finished_ms - created_ms) as (metric, v)")).where("v IS NOT NULL")
    return ordered.percentiles(long, ["metric"], "v")


@built("replay_tasks", _TASKS + _TIMES + """ select subject, state, case when state in ('PENDING', 'COMPLETED', 'FAILED', 'CANCELLED') then '' else concat('V', B(split_part(substr(subject, 2), '-', 1)) % 40) end as vehicle, B(coalesce(assigned_ms, 0)) as assigned_ms, B(coalesce(finished_ms, 0)) as finished_ms from tm""", True)
def _(spark, d):
    user = F.split_part(F.substring("subject", 2, 1 << 20), F.lit("-"), F.lit("1").cast("int")).cast("long")
    held = F.when(F.col("state").isin("PENDING", *S.TERMINAL), "").otherwise(F.concat(F.lit("V"), (user % 40).cast("string")))
    return fsm.timings(_folded(spark, d), ["subject"]).select("subject", "state", held.alias("vehicle"), F.coalesce("assigned_ms", F.lit(0)).alias("assigned_ms"), F.coalesce("finished_ms", F.lit(0)).alias("finished_ms"))


@built("lifecycle_fingerprint", _TASKS + _TIMES + """ select user_id, SHA(concat('[', LAGG(concat('["', subject, '","', state, '",', coalesce(assigned_ms, 0), ',', coalesce(finished_ms, 0), ']'), ',', subject), ']')) as fingerprint, count(*) as n
 from (select tm.*, split_part(substr(subject, 2), '-', 1) as user_id from tm) f group by user_id""", True)
def _(spark, d):
    t = fsm.timings(_folded(spark, d), ["subject"]).withColumn("user_id", F.split_part(F.substring("subject", 2, 1 << 20), F.lit("-"), F.lit("1").cast("int")))
    row = fn.canonical_json(fn.quoted(F.col("subject")), fn.quoted(F.col("state")), F.coalesce("assigned_ms", F.lit(0)).cast("string"), F.coalesce("finished_ms", F.lit(0)).cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("subject", row.alias("r"))))
    return t.groupBy("user_id").agg(fn.digest(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x["r"]), ","), F.lit("]"))).alias("fingerprint"), F.count("*").alias("n"))


@built("no_duplicate_effect", _TASKS + " select subject, B(count_if(accepted and event in ('COMPLETE', 'CANCEL', 'FAIL'))) as ends, B(count_if(accepted and event = 'COMPLETE')) as completes from st where n > 0 group by subject having count_if(accepted and event in ('COMPLETE', 'CANCEL', 'FAIL')) >= 1", True)
def _(spark, d):
    ends = F.col("accepted") & F.col("event").isin("COMPLETE", "CANCEL", "FAIL")
    return fsm.steps(_folded(spark, d), ["subject"]).groupBy("subject").agg(F.count_if(ends).alias("ends"), F.count_if(F.col("accepted") & (F.col("event") == "COMPLETE")).alias("completes")).where("ends >= 1")


#: The state that all events lead to, and the one that remains where failed deliveries were never handled.
_TWO = "with recursive " + _fold("st", "select subject, seq as ord, at_ms, event from {journal}", S.TASK_MOVES, "PENDING") + ", " + _fold("su", "select subject, seq as ord, at_ms, event from {journal} where event_type <> 'error'", S.TASK_MOVES, "PENDING")
_ENDS = ", la as (select subject, arg_max(state, n) as state, arg_max(len(ps), n) as paused, arg_max(len(qs), n) as queued, count_if(n > 0 and accepted) as accepted from st group by subject), lb as (select subject, arg_max(state, n) as state, arg_max(len(ps), n) as paused, arg_max(len(qs), n) as queued, count_if(n > 0 and accepted) as accepted from su group by subject)"


def _two(spark: SparkSession, d: str) -> DataFrame:
    log = view(spark, d, "journal_lean")
    fold = lambda rows: fsm.state_json(fsm.fold_fsm(rows, ["subject"], F.col("rn"), F.col("event"), F.col("at_ms")), ["subject"])
    return fold(log).join(fold(log.where("event_type <> 'error'")).withColumnRenamed("body", "other"), "subject", "full")


@built("live_vs_replay_diff", _TWO + _ENDS + " select coalesce(la.subject, lb.subject) as subject, la.state as live, lb.state as replay from la full join lb on la.subject = lb.subject where la.state is distinct from lb.state", True)
def _(spark, d):
    state = lambda c: F.get_json_object(c, "$.state")
    return _two(spark, d).select("subject", state("body").alias("live"), state("other").alias("replay")).where("NOT (live <=> replay)")


@built("json_path_diff", _TWO + _ENDS + """, pa as (select subject, unnest(['accepted', 'paused', 'queued', 'state']) as path, unnest([STR(accepted), STR(paused), STR(queued), state]) as v from la),
 pb as (select subject, unnest(['accepted', 'paused', 'queued', 'state']) as path, unnest([STR(accepted), STR(paused), STR(queued), state]) as v from lb)
 select coalesce(pa.subject, pb.subject) as subject, coalesce(pa.path, pb.path) as path, pa.v as live, pb.v as replay from pa full join pb on pa.subject = pb.subject and pa.path = pb.path where pa.v is distinct from pb.v""", True)
def _(spark, d):
    return _two(spark, d).select("subject", F.explode(fn.json_diff(F.col("body"), F.col("other"))).alias("x")).select("subject", "x.path", F.col("x.left").alias("live"), F.col("x.right").alias("replay"))


@built("verify_replay", _TASKS + ", f as (select subject, arg_max(state, n) as state from st group by subject), g as (select STR(sum(H64(concat(subject, ':', state)))) as fp, count(*) as n from f) select (select count(*) from {journal}) as records, n as subjects, fp as live_fingerprint, fp as replay_fingerprint, true as consistent from g", True)
def _(spark, d):
    """The journal is appended to a file of lines and read back from there; the fold of what was read must give the
    same fingerprint. A fingerprint is the sum of the hashes of all subjects' ends, so no order and no gathering is needed."""
    log = view(spark, d, "journal")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.PAYLOAD if f.name != "event"]
    path = jobs.shared(spark, "journal")
    io.append_journal(log.select("seq", "kind", "subject", "at_ms", F.struct(F.col("event"), *empty).alias("payload"), "trace_id"), path)
    back = io.read_journal(spark, path).withColumn("event", F.col("payload.event"))

    def print_of(rows: DataFrame, name: str) -> DataFrame:
        ends = fsm.fold_fsm(rows, ["subject"], F.col("seq"), F.col("event"), F.col("at_ms")).select(F.concat("subject", F.lit(":"), "state").alias("t"), F.size("steps").cast("long").alias("k"))
        return ends.agg(F.sum("k").alias("records"), F.count("*").alias("subjects"), F.sum(fn.stable_hash(F.col("t"))).cast("string").alias(name))

    live, again = print_of(log, "live_fingerprint"), print_of(back, "replay_fingerprint").select("replay_fingerprint")
    return live.crossJoin(again).select("records", "subjects", "live_fingerprint", "replay_fingerprint", (F.col("live_fingerprint") == F.col("replay_fingerprint")).alias("consistent"))


_VEHICLES = _TASKS + ", " + _fold("vs", f"""select concat('V', B(split_part(substr(subject, 2), '-', 1)) % 40) as subject, 2 * ord as ord, at_ms, case event {' '.join(f"when '{k}' then '{v}'" for k, v in S.TASK_TO_VEHICLE.items())} end as event from st where n > 0 and accepted
 union all select concat('V', user_id % 40), 2 * seq + 1, at_ms, case kind when 'vehicle_offline' then 'HEARTBEAT_TIMEOUT' else 'ONLINE' end from {{journal}} where kind in ('vehicle_offline', 'task_created')""", S.VEHICLE_MOVES, "IDLE")


def _vehicles(spark: SparkSession, d: str) -> DataFrame:
    """Vehicles are few and their logs long, so they are folded as streams of sorted rows."""
    vehicle = lambda user: F.concat(F.lit("V"), (user % 40).cast("string"))
    log = view(spark, d, "journal")
    folded = fsm.fold_fsm(log, ["subject", "user_id"], F.col("seq"), F.col("event"), F.col("at_ms"))
    made = fsm.derived_vehicle_events(folded, ["subject", "user_id"], vehicle(F.col("user_id"))).select("vehicle_id", (2 * F.col("order")).alias("o"), "event")
    live = log.where("kind in ('vehicle_offline', 'task_created')").select(vehicle(F.col("user_id")).alias("vehicle_id"), (2 * F.col("seq") + 1).alias("o"), F.when(F.col("kind") == "vehicle_offline", "HEARTBEAT_TIMEOUT").otherwise("ONLINE").alias("event"))
    return fsm.fold_long(made.unionByName(live), "vehicle_id", F.col("o"), F.col("event"), S.VEHICLE_MOVES, "IDLE")


@built("replay_vehicles", _VEHICLES + " select subject as vehicle_id, arg_max(state, n) as state, B(count_if(n > 0 and accepted)) as accepted, B(count_if(not accepted)) as rejected from vs group by subject", True)
def _(spark, d):
    return _vehicles(spark, d)


@built("vehicle_state_counts", _VEHICLES + " select state, count(*) as n from (select subject, arg_max(state, n) as state from vs group by subject) f group by state", True)
def _(spark, d):
    return _vehicles(spark, d).groupBy("state").agg(F.count("*").alias("n"))


@built("fsm_table", _TASKS + f", taken as (select from_state, count(*) as moves from st where n > 0 and accepted group by from_state) select f as from_state, string_agg(e, '|' order by e) as events, count(*) as n, coalesce(max(moves), 0) as moves from {_moves(S.TASK_MOVES)} left join taken on taken.from_state = f group by f", True)
def _(spark, d):
    """Legal events of each state, and how often the journal left it."""
    taken = fsm.steps(_folded(spark, d), ["subject"]).where("accepted").groupBy("from_state").agg(F.count("*").alias("moves"))
    table = spark.createDataFrame(S.TASK_MOVES, "from_state string, event string, to_state string").groupBy("from_state").agg(F.array_join(F.array_sort(F.collect_list("event")), "|").alias("events"), F.count("*").alias("n"))
    return table.join(taken, "from_state", "left").select("from_state", "events", "n", F.coalesce("moves", F.lit(0)).alias("moves"))


@built("fsm_consistency", _TASKS + f" select state as target, count(*) as n from st where n > 0 and accepted and state not in (select f from {_moves(S.TASK_MOVES)}) group by state", True)
def _(spark, d):
    """States that the journal reached and that have no moves of their own: the terminal ones, and no other."""
    moves = spark.createDataFrame(S.TASK_MOVES, "target string, e string, t string").select("target").distinct()
    reached = fsm.steps(_folded(spark, d), ["subject"]).where("accepted").select(F.col("to_state").alias("target"))
    return reached.join(F.broadcast(moves), "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


@built("fsm_allowed_events", _TASKS + f", cur as (select subject, arg_max(state, n) as state from st group by subject) select subject, count(e) as allowed, count(e) = 0 as terminal from cur left join {_moves(S.TASK_MOVES)} on f = state group by subject", True)
def _(spark, d):
    moves = spark.createDataFrame(S.TASK_MOVES, "state string, event string, to_state string")
    return _folded(spark, d).select("subject", "state").join(F.broadcast(moves), "state", "left").groupBy("subject").agg(F.count("event").alias("allowed"), (F.count("event") == 0).alias("terminal"))


@built("fsm_consistency", f"select t as target, count(*) as n from {_moves(S.VEHICLE_MOVES)} where t not in (select f from {_moves(S.VEHICLE_MOVES)}) group by t")
def _(spark, d):
    moves = spark.createDataFrame(S.VEHICLE_MOVES, "f string, e string, target string")
    return moves.join(moves.select(F.col("f").alias("target")).distinct(), "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


# tasks and vehicles -------------------------------------------------------------------------------------
plain("tasks_by_state", "select task_id, priority, created_ms from {tasks_in} where state in ('PENDING', 'EXECUTING')")
plain("task_lookup", "select task_id, cust, priority, state from {tasks_in} where task_id = 33")
plain("task_projection", "select task_id, case priority when 1 then 'LOW' when 2 then 'NORMAL' when 3 then 'HIGH' when 4 then 'URGENT' when 5 then 'CRITICAL' else concat('P', priority) end as label, ox, oy, dx, dy, sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) as leg from {tasks_in}")
plain("open_tasks", "select state, count(*) as n from {tasks_in} where state not in ('COMPLETED', 'FAILED', 'CANCELLED') group by state")
plain("overdue_tasks", "select priority, count(*) as n from {tasks_in} where state not in ('COMPLETED', 'FAILED', 'CANCELLED') and 900000000000 > created_ms + 120000 group by priority")
plain("completion_rate", "select coalesce(avg(case when state = 'COMPLETED' then D(1) else D(0) end), D(0)) as rate, count(*) as n from {tasks_in}")
plain("gantt_rows", "select task_id, created_ms from {tasks_in} order by created_ms, task_id limit 28")

@built("pending_order", "select task_id, B(row_number() over (order by priority desc, created_ms, task_id)) as place from {tasks_in} where state = 'PENDING'")
def _(spark, d):
    """Places within each priority, shifted by the tasks of higher ones."""
    pending = view(spark, d, "tasks_in").where("state = 'PENDING'").select("task_id", "priority", "created_ms")
    return ordered.placed(pending, [], "priority", ["created_ms", "task_id"], "place").select("task_id", "place")


plain("vehicle_projection", "select vehicle_id, D(vx) as vx, D(vy) as vy, battery, online, vstate from {vehicles_in}")
plain("fleet_stats", "select vstate, count(*) as n, B(count_if(online)) as online, B(count_if(online and vstate = 'IDLE' and battery >= 20)) as dispatchable from {vehicles_in} group by vstate")
plain("vehicle_candidates", "select vehicle_id, battery from {vehicles_in} where online and vstate = 'IDLE' and battery >= 20")
plain("vehicles_at_hub", "select vehicle_id from {vehicles_in} where sqrt((vx - 60.0) * (vx - 60.0) + (vy - 60.0) * (vy - 60.0)) <= 3.0")
plain("recharge_events", "select vehicle_id, case when battery < 30 and vstate = 'IDLE' then 'CHARGE' when battery >= 85 and vstate = 'CHARGING' then 'CHARGE_DONE' end as event from {vehicles_in} where (battery < 30 and vstate = 'IDLE') or (battery >= 85 and vstate = 'CHARGING')")
plain("duplicate_creates", "select count(*) as created, count(distinct subject) as subjects, B(count(*) - count(distinct subject)) as repeats from {journal} where kind = 'task_created'")
plain("first_create_wins", "select subject, min(seq) as seq from {journal} where kind = 'task_created' group by subject")
plain("no_task_lost", "select count(*) as lost from (select distinct subject from {journal} where kind = 'task_created') c where not exists (select 1 from {journal} j where j.subject = c.subject and j.kind = 'task_event')")


@built("no_loss_verdict", "select (select count(*) from (select subject from {journal} where kind = 'task_created' except select subject from {journal} where kind = 'task_event') a) as lost, (select count(*) from (select subject from {journal} where kind = 'task_event' except select subject from {journal} where kind = 'task_created') b) as unknown, (select count(*) from {journal} where kind = 'task_created') - (select count(distinct subject) from {journal} where kind = 'task_created') as repeated, false as sound")
def _(spark, d):
    """Both directions and the repeats in one pass over the subjects."""
    kinds = view(spark, d, "journal_lean").groupBy("subject").agg(F.count_if(F.col("kind") == "task_created").alias("made"), F.count_if(F.col("kind") == "task_event").alias("seen"))
    out = kinds.agg(F.count_if(F.expr("made > 0 AND seen = 0")).alias("lost"), F.count_if(F.expr("made = 0 AND seen > 0")).alias("unknown"), F.sum(F.greatest(F.col("made") - 1, F.lit(0))).alias("repeated"))
    return out.withColumn("sound", (F.col("lost") == 0) & (F.col("unknown") == 0) & (F.col("repeated") == 0))


#: An overdue task fails now, whatever its deadline was, and its vehicle gives up what it holds and waits for.
plain("deadline_events", """select t.task_id, t.state as from_state, 'FAIL' as event, B(900000000000) as at_ms, B(t.deadline_ms) as deadline_ms, B(900000000000 - t.deadline_ms) as overdue_ms, coalesce(h.n, 0) + coalesce(r.n, 0) as released
 from (select *, created_ms + 120000 + 90000 * (1 + task_id % 3) as deadline_ms from {tasks_in}) t left join (select vehicle, count(*) as n from {holders} group by vehicle) h on h.vehicle = t.task_id left join (select vehicle, count(*) as n from {requests} group by vehicle) r on r.vehicle = t.task_id
 where t.state not in ('COMPLETED', 'FAILED', 'CANCELLED') and 900000000000 > t.deadline_ms""")
plain("snapshot_brief", "select 'task' as kind, state, count(*) as n from {tasks_in} group by state union all select 'vehicle' as kind, vstate as state, count(*) as n from {vehicles_in} group by vstate")
plain("no_loss_sets", "select count(*) as missing from (select subject from {journal} where kind = 'task_assigned' except select subject from {journal} where kind = 'task_created') x")
plain("snapshot_tasks", "select task_id, cust, priority, created_ms, state from {tasks_in}")
#: A sum of hashes needs no order and no gathering: vehicles with what they carry, and tasks with their ends.
plain("full_fingerprint", """select part, hub, STR(sum(H64(line))) as fingerprint, count(*) as n from (
 select 'vehicle' as part, v.vehicle_id % 6 as hub, concat('[', v.vehicle_id, ',"', vstate, '",', case when online then 'true' else 'false' end, ',', B(round(vx * 1000)), ',', B(round(vy * 1000)), ',', B(round(battery * 100)), ',', coalesce(STR(p.task_id), ''), ']') as line
 from {vehicles_in} v left join (select cust % 97 + 1 as vid, min(task_id) as task_id from {tasks_in} where state = 'EXECUTING' group by 1) p on p.vid = v.vehicle_id
 union all select 'task', cust % 6, concat('[', task_id, ',"', state, '",', priority, ',', created_ms, ',', case when state = 'EXECUTING' then STR(cust % 97 + 1) else '' end, ']') from {tasks_in}) l group by part, hub""")
plain("hub_vehicle_scores", "select ox, oy, vehicle_id, round(50.0 + 0.5 * battery - sqrt((vx - ox) * (vx - ox) + (vy - oy) * (vy - oy)), 6) as score from (select distinct ox, oy from {tasks_in}) o cross join {vehicles_in} v where online and vstate = 'IDLE' and battery >= 20")
plain("task_of_vehicle", "select v.vehicle_id, min(t.task_id) as task_id from {vehicles_in} v join (select task_id, cust % 97 + 1 as vid from {tasks_in} where state = 'EXECUTING') t on t.vid = v.vehicle_id where v.online group by v.vehicle_id")


@built("best_vehicle", """with v as (select * from {vehicles_in} where online and vstate = 'IDLE' and battery >= 20), o as (select distinct ox, oy from {tasks_in}),
 b as (select ox, oy, vehicle_id, 0.5 * battery - sqrt((vx - ox) * (vx - ox) + (vy - oy) * (vy - oy)) as val, row_number() over (partition by ox, oy order by 0.5 * battery - sqrt((vx - ox) * (vx - ox) + (vy - oy) * (vy - oy)) desc, vehicle_id) as rn, count(*) over (partition by ox, oy) as c from v cross join o)
 select t.task_id, b.vehicle_id, round(1000.0 * t.priority + 50.0 + b.val, 6) as score, b.c as candidates from {tasks_in} t join b on b.ox = t.ox and b.oy = t.oy and b.rn = 1 where t.state = 'PENDING'""")
def _(spark, d):
    return dispatch.best_vehicle(view(spark, d, "tasks_in").where("state = 'PENDING'"), view(spark, d, "vehicles_in")).withColumn("score", F.round("score", 6))


@built("preempt_victims", """with run as (select t.task_id, t.priority, t.created_ms as assigned_ms, v.vehicle_id from {tasks_in} t join {vehicles_in} v on v.vehicle_id = t.cust % 97 + 1 where t.state = 'EXECUTING' and v.online),
 p as (select rp, task_id, vehicle_id, row_number() over (partition by rp order by r.priority, r.assigned_ms desc, r.task_id) as rn from (values (3), (4), (5)) q(rp) join run r on r.priority < q.rp)
 select t.task_id, p.task_id as victim, p.vehicle_id from {tasks_in} t join p on p.rp = t.priority and p.rn = 1 where t.state = 'PENDING' and t.priority >= 3""")
def _(spark, d):
    tasks, fleet = view(spark, d, "tasks_in"), view(spark, d, "vehicles_in")
    running = tasks.where("state = 'EXECUTING'").withColumn("vehicle_id", F.col("cust") % 97 + 1).join(fleet.select("vehicle_id", "online"), "vehicle_id").select("task_id", "priority", F.col("created_ms").alias("assigned_ms"), "vehicle_id", "online", F.lit(0).alias("preempted"))
    return dispatch.victims(tasks.where("state = 'PENDING'").select("task_id", "priority"), running)


_PLAN = """with recursive w as materialized (select * from {vehicles_in} where online), v as materialized (select * from w where vstate = 'IDLE' and battery >= 20),
 q as materialized (select *, row_number() over (order by priority desc, created_ms, task_id) as n from {tasks_in} where state = 'PENDING' qualify n <= (select count(*) from {vehicles_in})),
 r as materialized (select t.task_id as victim, t.priority, t.created_ms as assigned_ms, w.vehicle_id, w.vx, w.vy, w.battery, w.vstate, w.battery >= 20 as fit from {tasks_in} t join w on w.vehicle_id = t.cust % 97 + 1 where t.state = 'EXECUTING'),
 c as materialized (select q.n, q.task_id, 0 as kind, v.vehicle_id, 1000.0 * q.priority + 50.0 + 0.5 * v.battery - sqrt((v.vx - q.ox) * (v.vx - q.ox) + (v.vy - q.oy) * (v.vy - q.oy)) as score, B(0) as victim, B(0) as a, B(0) as b from q cross join v
  union all select q.n, q.task_id, 1, r.vehicle_id, 1000.0 * q.priority + case when vstate = 'IDLE' and fit then 50.0 else 0.0 end + 0.5 * r.battery - sqrt((r.vx - q.ox) * (r.vx - q.ox) + (r.vy - q.oy) * (r.vy - q.oy)), r.victim, r.priority, -r.assigned_ms from q join r on r.priority < q.priority and q.priority >= 3),
 p(n, taken, gone, task_id, vehicle_id, score, victim) as (select B(0), cast([] as bigint[]), cast([] as bigint[]), B(0), B(0), D(0), B(0)
  union all select n, list_append(taken, vehicle_id), list_append(gone, victim), task_id, vehicle_id, score, victim from (select c.n, p.taken, p.gone, c.task_id, c.vehicle_id, c.score, c.victim,
   row_number() over (order by c.kind, c.a, c.b, c.victim, c.score desc, c.vehicle_id) as rn from p join c on c.n = p.n + 1 where case c.kind when 0 then not list_contains(p.taken, c.vehicle_id) else not list_contains(p.gone, c.victim) end) z where rn = 1)"""


def _running(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "tasks_in").where("state = 'EXECUTING'").select("task_id", "priority", F.col("created_ms").alias("assigned_ms"), F.lit(0).alias("preempted"), (F.col("cust") % 97 + 1).alias("vehicle_id"))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return dispatch.plan_greedy(view(spark, d, "tasks_in").where("state = 'PENDING'"), view(spark, d, "vehicles_in"), _running(spark, d))


@built("plan_greedy", _PLAN + " select B(n) as step, task_id, vehicle_id, round(score, 6) as score, nullif(victim, 0) as victim from p where n > 0", True)
def _(spark, d):
    return _plan(spark, d).withColumn("score", F.round("score", 6))


@built("preemption_rate", _PLAN + " select B(count_if(victim > 0)) as preemptions, count(*) as assigned, D(count_if(victim > 0)) / count(*) as rate from p where n > 0", True)
def _(spark, d):
    return _plan(spark, d).agg(F.count("victim").alias("preemptions"), F.count("*").alias("assigned"), (F.count("victim") / F.count("*")).alias("rate"))


# traffic ------------------------------------------------------------------------------------------------
_FREE = "fs as (select r.resource, B(r.capacity) as capacity, B(count(h.vehicle)) as held, B(greatest(r.capacity - count(h.vehicle), 0)) as free from {resources} r left join {holders} h on h.resource = r.resource group by r.resource, r.capacity), rk as (select *, B(row_number() over (partition by resource order by priority desc, requested_ms, seq, vehicle)) as rank from {requests})"


def _traffic(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return view(spark, d, "requests"), view(spark, d, "resources"), view(spark, d, "holders")


@built("free_resources", f"with {_FREE} select resource, held, free from fs where free > 0")
def _(spark, d):
    _, r, h = _traffic(spark, d)
    return traffic.free_slots(r, h).where("free > 0").select("resource", "held", "free")


@built("grants", f"with {_FREE} select rk.resource, rk.vehicle, rk.rank from rk join fs on fs.resource = rk.resource where rk.rank <= fs.free")
def _(spark, d):
    return traffic.grants(*_traffic(spark, d)).select("resource", "vehicle", "rank")


@built("conflicts", f"with {_FREE} select fs.resource, (select min(vehicle) from {{holders}} h where h.resource = fs.resource) as winner, rk.vehicle as loser, rk.rank from fs join rk on rk.resource = fs.resource where fs.free = 0")
def _(spark, d):
    return traffic.conflicts(*_traffic(spark, d))


@built("wait_for_graph", f"with {_FREE} select distinct q.vehicle as waiter, h.vehicle as holder from {{requests}} q join fs on fs.resource = q.resource and fs.free = 0 join {{holders}} h on h.resource = q.resource where not exists (select 1 from {{holders}} x where x.resource = q.resource and x.vehicle = q.vehicle)")
def _(spark, d):
    return traffic.wait_for(*_traffic(spark, d))


_OPS = """ops as materialized (select resource, vehicle, priority, at_ms, id, op from {traffic_log} where op <> 'release_all'
  union all select a.resource, l.vehicle, l.priority, l.at_ms, l.id, 'release_resource' from {traffic_log} l join (select distinct vehicle, resource from {traffic_log} where op = 'request') a on a.vehicle = l.vehicle where l.op = 'release_all'),
 ev as materialized (select *, row_number() over (partition by resource order by at_ms, id) as n from ops)"""
#: Holders, the queue (rank first, vehicle last) and counters, one request after another.
_REQUESTS = f"""with recursive {_OPS},
 st(resource, n, h, q, requests, grants, blocks, releases) as (select distinct resource, B(0), cast([] as bigint[]), cast([] as struct(p bigint, a bigint, i bigint, v bigint)[]), B(0), B(0), B(0), B(0) from ev
 union all select resource, n, case when admitted then list_append(h2, q2[1].v) else h2 end, case when admitted then q2[2:] else q2 end, requests + case when op = 'request' then 1 else 0 end, grants + case when admitted then 1 else 0 end,
  blocks + case when op = 'request' and not held and not (admitted and q2[1].v = vehicle) then 1 else 0 end, releases + case when op <> 'request' and held then 1 else 0 end
  from (select *, len(q2) > 0 and len(h2) < 1 + resource % 3 and (op = 'request' and not held or op <> 'request' and (held or len(q2) < len(q))) as admitted
   from (select s.resource, e.n, e.op, e.vehicle, s.q, s.requests, s.grants, s.blocks, s.releases, list_contains(s.h, e.vehicle) as held,
     case when e.op = 'request' then s.h else list_filter(s.h, lambda x: x <> e.vehicle) end as h2,
     case when e.op = 'request' and not list_contains(s.h, e.vehicle) then list_sort(list_append(list_filter(s.q, lambda x: x.v <> e.vehicle), {{'p': B(-e.priority), 'a': coalesce(list_filter(s.q, lambda x: x.v = e.vehicle)[1].a, e.at_ms), 'i': coalesce(list_filter(s.q, lambda x: x.v = e.vehicle)[1].i, e.id), 'v': B(e.vehicle)}}))
      when e.op = 'release_resource' then list_filter(s.q, lambda x: x.v <> e.vehicle) else s.q end as q2
     from st s join ev e on e.resource = s.resource and e.n = s.n + 1) y) z)
 select resource, array_to_string(list_sort(arg_max(h, n)), ',') as holders, array_to_string(list_transform(arg_max(q, n), lambda x: x.v), ',') as waiting, B(max(requests)) as requests, B(max(grants)) as grants, B(max(blocks)) as blocks, B(max(releases)) as releases from st group by resource"""


@built("traffic_requests", _REQUESTS, True)
def _(spark, d):
    log = view(spark, d, "traffic_log")
    capacity = log.select("resource").distinct().withColumn("capacity", 1 + F.col("resource") % 3)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return traffic.fold_requests(log, capacity).select("resource", text("holders"), text("waiting"), "requests", "grants", "blocks", "releases")


_CYCLES = "with recursive eg as materialized (select distinct waiter, holder from {waits} where waiter <> holder), pt(root, tip, path) as (select waiter, holder, [waiter, holder] from eg where holder > waiter union all select p.root, e.holder, list_append(p.path, e.holder) from pt p join eg e on e.waiter = p.tip where e.holder > p.root and not list_contains(p.path, e.holder)), cy as (select distinct p.path from pt p join eg e on e.waiter = p.tip and e.holder = p.root)"


def _cycles(spark: SparkSession, d: str) -> DataFrame:
    return traffic.cycles(view(spark, d, "waits"))


@built("deadlock_cycles", _CYCLES + " select array_to_string(path, '>') as cycle, B(len(path)) as n from cy", True)
def _(spark, d):
    return _cycles(spark, d).select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), F.size("cycle").cast("long").alias("n"))


@built("deadlock_victim", _CYCLES + ", u as (select path, unnest(path) as v from cy) select array_to_string(path, '>') as cycle, B(arg_min(v, v % 5 * 1000000000 + v)) as victim from u group by path", True)
def _(spark, d):
    found = _cycles(spark, d).withColumn("victim", traffic.victim(F.col("cycle"), lambda v: v % 5).cast("long"))
    return found.withColumn("cycle", F.array_join(F.col("cycle").cast("array<string>"), ">"))


#: Cycles of groups that wait for one another, broken one by one in their order.
_BREAKS = _CYCLES.replace("{waits}", "{yard_waits}") + """, on_ as materialized (select path, row_number() over (order by path) as n from cy),
 br(n, gone, broken, victim) as (select B(0), cast([] as bigint[]), false, B(0) union all
  select n, case when meets then gone else list_append(gone, v) end, not meets, v from (select o.n, b.gone, list_has_any(o.path, b.gone) as meets, B(list_sort(list_transform(o.path, lambda x: {{'p': x % 5, 'v': x}}))[1].v) as v from br b join on_ o on o.n = b.n + 1) z)
 select array_to_string(o.path, '>') as cycle, b.victim, B(b.victim % 5) as victim_priority from br b join on_ o on o.n = b.n where b.broken""".replace("{{", "{").replace("}}", "}")


@built("deadlock_breaks", _BREAKS, True)
def _(spark, d):
    found = traffic.cycles(view(spark, d, "yard_waits"))
    priority = view(spark, d, "customer").select(F.col("c_custkey").alias("vehicle"), (F.col("c_custkey") % 5).alias("priority"))
    return traffic.breaks(found, priority).select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"), F.col("victim").cast("long").alias("victim"), "victim_priority")


_HUBS = "(values " + ", ".join(f"('{h}', {x}, {y})" for h, x, y in S.HUBS) + ") as h(hub, x, y)"
_LANES = "(values " + ", ".join(f"('{a}', '{b}'), ('{b}', '{a}')" for a, b in S.ROADS) + ") as l(a, b)"


#: Ways over lanes of cost c, on which no hub comes twice.
_WAYS = f"""rt(s, g, cost, path, seen) as (select hub, hub, D(0), hub, [hub] from {_HUBS} union all select r.s, ln.b, r.cost + ln.c, concat(r.path, '>', ln.b), list_append(r.seen, ln.b) from rt r join ln on ln.a = r.g where not list_contains(r.seen, ln.b))"""
_LENGTHS = f"select l.a, l.b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as c from {_LANES} join (select * from {_HUBS}) p on p.hub = l.a join (select * from {_HUBS}) q on q.hub = l.b"
_RT = _check(f"with recursive ln as ({_LENGTHS}), {_WAYS} select 1", True).removeprefix("with recursive ").removesuffix(" select 1")


@built("route_shortest", f"with recursive ln as (select w.a, w.b, w.c + {S.CONGESTION} * coalesce(d.load, 0) as c from ({_LENGTHS}) w left join {{lane_loads}} d on d.a = w.a and d.b = w.b), {_WAYS} select s as start, g as goal, min(cost) as cost, arg_min(path, (cost, path)) as path from rt group by s, g", True)
def _(spark, d):
    """Cheapest ways under the load that the tasks under way put on the lanes."""
    return traffic.routes(spark, view(spark, d, "lane_loads"))


_AT = lambda x, y: f"(select hub from {_HUBS} order by ({x} - x) * ({x} - x) + ({y} - y) * ({y} - y), hub limit 1)"


@built("task_trips", f"with recursive {_RT}, best as materialized (select s, g, min(cost) as cost, arg_min(path, (cost, path)) as path from rt group by s, g), go as (select t.task_id, v.vehicle_id, {_AT('v.vx', 'v.vy')} as a, {_AT('t.ox', 't.oy')} as b, {_AT('t.dx', 't.dy')} as c from {{tasks_in}} t join {{vehicles_in}} v on v.vehicle_id = t.cust % 97 + 1 where t.state = 'EXECUTING' and v.online and v.vstate not in ('PAUSED', 'RECOVERING')) select task_id, vehicle_id, case when b = c then p.path else concat(p.path, substr(q.path, 2)) end as route, round(p.cost + q.cost, 6) as cost from go join best p on p.s = a and p.g = b join best q on q.s = b and q.g = c", True)
def _(spark, d):
    active = view(spark, d, "tasks_in").where("state = 'EXECUTING'").withColumn("vehicle_id", F.col("cust") % 97 + 1)
    moving = view(spark, d, "vehicles_in").where("online AND vstate NOT IN ('PAUSED', 'RECOVERING')").select("vehicle_id", "vx", "vy")
    driven = active.join(moving, "vehicle_id").select("task_id", "vehicle_id", "vx", "vy", "ox", "oy", "dx", "dy")
    return traffic.trips(driven, traffic.routes(spark)).select("task_id", "vehicle_id", F.array_join("route", ">").alias("route"), F.round("cost", 6).alias("cost"))


plain("nearest_hub", f"select vehicle_id, hub from (select v.vehicle_id, h.hub, row_number() over (partition by v.vehicle_id order by (v.vx - h.x) * (v.vx - h.x) + (v.vy - h.y) * (v.vy - h.y), h.hub) as rn from {{vehicles_in}} v cross join {_HUBS}) n where rn = 1")
plain("contended_union", "select distinct vehicle, resource from (select vehicle, resource from {holders} union select vehicle, resource from {requests}) u where resource <> 3")
plain("blocked_on", "select vehicle, count(*) as n, min(resource) as first from {requests} group by vehicle")
#: What is seen whenever a request is blocked: its own queue, which is the one that grew, and all that wait.
_PEAKS = _REQUESTS[: _REQUESTS.rindex(" select resource, array_to_string")] + """, ch as (select s.resource, e.at_ms, e.id, len(s.q) as depth, len(s.q) - lag(len(s.q), 1, 0) over (partition by s.resource order by s.n) as change, s.blocks > lag(s.blocks, 1, 0) over (partition by s.resource order by s.n) as blocked from st s join ev e on e.resource = s.resource and e.n = s.n where s.n > 0),
 su as (select *, sum(change) over (order by at_ms, id, resource rows unbounded preceding) as waiting from ch)
 select B(max(depth) filter (blocked)) as deepest, B(max(waiting) filter (blocked)) as most_waiting, B(count_if(blocked)) as blocks from su"""


@built("queue_depth_peak", _PEAKS, True)
def _(spark, d):
    log = view(spark, d, "traffic_log")
    capacity = log.select("resource").distinct().withColumn("capacity", 1 + F.col("resource") % 3)
    seen = traffic.pressure(log, capacity).where("blocked")
    return seen.agg(F.max("depth").alias("deepest"), F.max("waiting").alias("most_waiting"), F.count("*").alias("blocks"))


plain("holder_priority", "select vehicle, max(priority) as priority from (select vehicle, priority from {holders} union all select vehicle, priority from {requests}) p group by vehicle")
plain("traffic_snapshot", "select resource, LAGG(STR(vehicle), ',', vehicle) as held_by, count(*) as n from {holders} group by resource")

# observability ------------------------------------------------------------------------------------------
@built("percentiles_nearest_rank", "select rule, percentile_disc(0.5) within group (order by value) as p50, percentile_disc(0.95) within group (order by value) as p95, percentile_disc(0.99) within group (order by value) as p99, min(value) as p0, max(value) as p100 from {readings} group by rule")
def _(spark, d):
    return ordered.percentiles(view(spark, d, "readings"), ["rule"], "value", (0, 50, 95, 99, 100)).select("rule", "p50", "p95", "p99", "p0", "p100")


@built("histogram_summary", "select rule, count(*) as n, min(value) as low, round(avg(value), 3) as mean, percentile_disc(0.95) within group (order by value) as p95, max(value) as high from {readings} group by rule")
def _(spark, d):
    return ordered.percentiles(view(spark, d, "readings"), ["rule"], "value", (95,)).select("rule", F.col("count").alias("n"), F.col("min").alias("low"), "mean", "p95", F.col("max").alias("high"))


plain("histogram_capped", "select rule, count(*) as n, B(min(event_id)) as oldest from (select rule, event_id, row_number() over (partition by rule order by at_ms desc, event_id desc) as rn from {readings}) h where rn <= 200 group by rule")
plain("counters", "select rule, count(*) as n, round(sum(value), 2) as total from {readings} group by rule")
plain("gauge_last_and_peak", "select rule, max_by(value, at_ms * 1000000 + event_id) as last, max(value) as peak from {readings} group by rule")
plain("metrics_snapshot", "select 'counter' as type, rule as name, D(count(*)) as value from {readings} group by rule union all select 'gauge' as type, rule as name, max(value) as value from {readings} group by rule")
plain("log_event_counts", "select rule as event, count(*) as n from {readings} group by rule")
plain("log_level_filter", "select event_id, case rule when 'error' then 'ERROR' when 'purchase' then 'WARNING' else 'INFO' end as level from {readings} where case rule when 'error' then 3 when 'purchase' then 2 else 1 end >= 2")
plain("alerts_by_rule_severity", "select rule, severity, count(*) as n from (select rule, case when value > 90 then 'CRITICAL' else 'WARNING' end as severity from {readings} where value > 50) a group by grouping sets ((rule), (severity))")
plain("trace_summary", "select trace_id, count(*) as spans, B(sum(duration_ms)) as duration_ms, LAGG(name, '>', start_ms * 100000 + span_id) as path from {spans} group by trace_id")
plain("trace_parent_chain", "select c.trace_id, c.span_id, p.name as parent, B(c.duration_ms - coalesce(p.duration_ms, 0)) as longer from {spans} c left join {spans} p on p.trace_id = c.trace_id and p.span_id = c.parent_id")
plain("slowest_spans", "select trace_id, span_id, duration_ms from {spans} order by duration_ms desc, trace_id, span_id limit 20")
plain("trace_union", "select trace_id, source, count(*) as n from (select trace_id, 'span' as source from {spans} union all select user_id as trace_id, 'journal' as source from {journal}) u group by trace_id, source")
plain("tracer_eviction", "select trace_id, n from (select trace_id, count(*) as n, row_number() over (order by trace_id desc) as rn from {spans} group by trace_id) t where rn <= 50")

_COOL = """with recursive ev as materialized (select rule, subject, at_ms, value, row_number() over (partition by rule, subject order by at_ms, value) as n from {readings}),
 st(rule, subject, n, at_ms, value, last, fired) as (select distinct rule, subject, B(0), B(0), D(0), cast(null as bigint), false from ev union all
 select s.rule, s.subject, e.n, e.at_ms, e.value, case when e.value > 50 and (s.last is null or e.at_ms - s.last >= 86400000) then e.at_ms else s.last end, e.value > 50 and (s.last is null or e.at_ms - s.last >= 86400000) from st s join ev e on e.rule = s.rule and e.subject = s.subject and e.n = s.n + 1)
 select rule, subject, at_ms, value from st where fired"""


@built("alerts_cooldown", _COOL, True)
def _(spark, d):
    return ordered.cooldown(view(spark, d, "readings"), ["rule", "subject"], F.col("at_ms"), F.col("value"), 50.0, 86_400_000)


# liveness -----------------------------------------------------------------------------------------------
plain("stale_vehicles", "select subject, B(1706745600000 - max(at_ms)) as silent_ms from {readings} where at_ms <= 1706745600000 group by subject having 1706745600000 - max(at_ms) > 5000")
plain("offline_intervals", "select subject, at_ms + 5000 as offline_ms, nxt as online_ms from (select subject, at_ms, lead(at_ms) over (partition by subject order by at_ms, event_id) as nxt from {readings}) g where nxt - at_ms > 86400000")
plain("heartbeat_asof", "select subject, max_by(rule, at_ms * 1000000 + event_id) as rule, B(max(at_ms)) as at_ms from {readings} where at_ms <= 1705300000000 group by subject")
#: What a vehicle's plan does at each line, with the tick at which its silence ends.
_SILENCE = """with recursive w as materialized (select vehicle, start, duration, line, row_number() over (partition by vehicle order by start, line) as n, line = min(line) over (partition by vehicle) as first, lead(line) over (partition by vehicle order by line) as following from {silence_plan}),
 st(vehicle, n, start, until, lost, ended, opened, shut) as (select distinct vehicle, B(0), B(0), cast(null as bigint), B(-1), cast(null as bigint), false, false from w union all
 select vehicle, n, start, case when opens then case when at_once then null else start + greatest(duration, 1) end when passed then until else null end, case when opens and at_once then following else lost_now end,
  case when not passed then until end, opens, opens and at_once
  from (select *, not passed and not (coalesce(until = start, false) and first) as opens, duration <= 0 and following is not null as at_once
   from (select s.vehicle, e.n, e.start, e.duration, e.first, e.following, s.until, case when s.start = e.start then s.lost else -1 end as lost_now, coalesce(e.start < s.until, false) or (s.start = e.start and e.line = s.lost) as passed from st s join w e on e.vehicle = s.vehicle and e.n = s.n + 1) y) z)
 select vehicle, B(start) as tick, 'silent' as phase from st where opened union all select vehicle, B(start), 'resume' from st where shut union all select vehicle, B(ended), 'resume' from st where ended is not null
 union all select vehicle, B(arg_max(coalesce(until, -1), n)), 'resume' from st group by vehicle having arg_max(coalesce(until, -1), n) >= 0"""


@built("silence_windows", _SILENCE, True)
def _(spark, d):
    return liveness.silence(view(spark, d, "silence_plan"))


#: Rules of the query: name, metric, threshold, severity, comparison, cooldown ms.
_RULES = [("big_purchase", "purchase", 70.0, "ERROR", ">", 3_600_000), ("any_purchase", "purchase", 30.0, "WARNING", ">", 86_400_000), ("idle_click", "click", 5.0, "INFO", "<", 0), ("no_metric", "unheard", 0.0, "INFO", ">", 0)]
_RULED = f"""with recursive ru(rule, metric, threshold, severity, comparison, cooldown_ms) as (values {", ".join(map(str, _RULES))}),
 ev as materialized (select u.rule, u.severity, r.subject, r.value, D(u.threshold) as threshold, r.at_ms, B(u.cooldown_ms) as cooldown_ms, row_number() over (partition by u.rule, r.subject order by r.at_ms, r.value) as n from {{readings}} r join ru u on u.metric = r.rule where case when u.comparison = '<' then r.value < u.threshold else r.value > u.threshold end),
 st(rule, subject, n, last, fired) as (select rule, subject, n, at_ms, true from ev where n = 1 union all select s.rule, s.subject, e.n, case when e.at_ms - s.last >= e.cooldown_ms then e.at_ms else s.last end, e.at_ms - s.last >= e.cooldown_ms from st s join ev e on e.rule = s.rule and e.subject = s.subject and e.n = s.n + 1)
 select e.rule, e.severity, e.subject, e.value, e.threshold, e.at_ms from st s join ev e on e.rule = s.rule and e.subject = s.subject and e.n = s.n where s.fired"""


@built("alerts_by_rules", _RULED, True)
def _(spark, d):
    return liveness.alerts(view(spark, d, "readings").withColumnRenamed("rule", "metric"), spark.createDataFrame(_RULES, liveness.RULES))

# key-value store ----------------------------------------------------------------------------------------
_KV = """with recursive ev as materialized (select *, row_number() over (partition by key order by seq) as n from {commands}),
 st(key, n, op, present, val, exp, result, seq) as (select distinct key, B(0), '', false, cast(null as varchar), cast(null as bigint), cast(null as varchar), B(0) from ev union all
 select key, n, op, case when op in ('set', 'incr') then true when op = 'delete' then false when op = 'expire' and coalesce(ttl_ms, 0) <= 0 then false else alive end,
  case when op = 'set' then value when op = 'incr' then cast(cast(coalesce(case when alive then val end, '0') as bigint) + 1 as varchar) when op = 'delete' or (op = 'expire' and coalesce(ttl_ms, 0) <= 0) or not alive then null else val end,
  case when op = 'set' then at_ms + ttl_ms when op in ('delete', 'persist') or not alive then null when op = 'expire' then case when coalesce(ttl_ms, 0) <= 0 then null else at_ms + ttl_ms end else exp end,
  case when op = 'set' then 'OK' when op = 'get' then case when alive then val end when op in ('exists', 'delete', 'expire') then case when alive then '1' else '0' end when op = 'persist' then case when alive and exp is not null then '1' else '0' end
   when op = 'incr' then cast(cast(coalesce(case when alive then val end, '0') as bigint) + 1 as varchar) when op = 'ttl' then case when not alive then '-2' when exp is null then '-1' else cast(cast(ceil((exp - at_ms) / 1000.0) as bigint) as varchar) end end, seq
 from (select e.key, e.n, e.op, e.value, e.ttl_ms, e.at_ms, e.seq, s.val, s.exp, s.present and (s.exp is null or s.exp > e.at_ms) as alive from st s join ev e on e.key = s.key and e.n = s.n + 1) z)"""


def _store(spark: SparkSession, d: str) -> DataFrame:
    log = view(spark, d, "commands").select("key", F.col("seq").alias("order"), "at_ms", "op", "field", "value", "ttl_ms")
    return kv.run_commands(log)


@built("kv_results", _KV + " select key, seq, op, result from st where n > 0", True)
def _(spark, d):
    return _store(spark, d).select("key", F.col("order").alias("seq"), "op", "result")


@built("kv_live_snapshot", _KV + ", f as (select key, arg_max(present, n) as present, arg_max(coalesce(val, ''), n) as val, arg_max(coalesce(exp, -1), n) as exp from st group by key) select key, val as value, B(exp) as expires_ms from f where present and (exp = -1 or exp > 1706000000000)", True)
def _(spark, d):
    now = F.lit(1706000000000)
    return kv.final_entries(_store(spark, d)).where(F.col("kind").isNotNull() & fn.live(F.col("expires_ms"), now)).select("key", "value", F.coalesce("expires_ms", F.lit(-1)).cast("long").alias("expires_ms"))


@built("kv_ttl", _KV + ", f as (select key, arg_max(present, n) as present, arg_max(coalesce(exp, -1), n) as exp from st group by key) select key, B(case when not present or (exp >= 0 and exp <= 1706000000000) then -2 when exp = -1 then -1 else ceil((exp - 1706000000000) / 1000.0) end) as ttl from f", True)
def _(spark, d):
    return kv.final_entries(_store(spark, d)).select("key", fn.ttl_seconds(F.col("kind").isNotNull(), F.col("expires_ms"), F.lit(1706000000000)).alias("ttl"))


@built("kv_keys_glob", "select distinct key from {commands} where key like 'k1_'")
def _(spark, d):
    return view(spark, d, "commands").where(fn.glob(F.col("key"), "k1?")).select("key").distinct()


# publishing in order: what is refused holds back all that follows in its subject; the oracle counts from the first refusal
@built("flush_subject", "select subject, B(count_if(seq < stop)) as published, B(count_if(seq >= stop)) as held_back from (select subject, seq, coalesce(min(case when event_id % 13 = 0 then seq end) over (partition by subject), 9000000000000000000) as stop from {journal}) f group by subject")
def _(spark, d):
    return ordered.flush(view(spark, d, "journal"), ["subject"], F.col("seq"), F.col("event_id") % 13 == 0).groupBy("subject").agg(F.count_if("published").alias("published"), F.count_if(~F.col("published")).alias("held_back"))


plain("kv_hash_fields", "select key, field, max_by(STR(event_id), seq) as value, count(*) as sets from {commands} group by key, field")
plain("cache_projection", "select concat('veh:', vehicle_id) as key, concat(vstate, '|', online) as value from {vehicles_in} union all select concat('task:', task_id) as key, concat(state, '|', priority) as value from {tasks_in}")
plain("cache_lost_keys", "select key from {commands} where op = 'set' except select key from {commands} where op = 'set' and seq > (select max(seq) - 300 from {commands})")


@built("command_outcomes", "select command, event_id, case when exists (select 1 from {submissions} e where e.command = s.command and not e.fails and e.confirmed and (e.at_ms, e.event_id) < (s.at_ms, s.event_id)) then 'duplicate' when fails then 'failed' when not confirmed then 'unconfirmed' else 'applied' end as outcome from {submissions} s")
def _(spark, d):
    return ordered.command_outcomes(view(spark, d, "submissions"), ["command"], ["at_ms", "event_id"], F.col("fails"), F.col("confirmed")).select("command", "event_id", "outcome")


_HASHES = """with w as (select *, last_value(case op when 'hset' then concat('+', value) when 'hdel' then '-' end ignore nulls) over (partition by key, field order by seq rows between unbounded preceding and 1 preceding) as prev from {hash_commands}),
 x as (select *, coalesce(prev like '+%', false) as present from w),
 y as (select *, coalesce(sum(case when op = 'hset' and not present then 1 when op = 'hdel' and present then -1 else 0 end) over (partition by key order by seq rows between unbounded preceding and 1 preceding), 0) as size from x)
 select key, seq, op, case op when 'hset' then case when present then '0' else '1' end when 'hget' then case when present then substr(prev, 2) end when 'hdel' then case when present then '1' else '0' end when 'hlen' then STR(B(size)) else case when size > 0 then '1' else '0' end end as result from y"""


@built("kv_hash_results", _HASHES)
def _(spark, d):
    log = view(spark, d, "hash_commands").select("key", F.col("seq").alias("order"), "at_ms", "op", "field", "value", F.lit(None).cast("long").alias("ttl_ms"))
    return kv.run_commands(log).select("key", F.col("order").alias("seq"), "op", "result")


plain("idempotency_eviction", "select msg_id, arrival from (select msg_id, max(arrival) as arrival, row_number() over (order by max(arrival) desc, msg_id) as rn from {deliveries} where not failed group by msg_id) e where rn <= 500")

# faults, scenarios ---------------------------------------------------------------------------------------
#: The draws of the fault plan: a stable hash of the seed, the values and what is drawn.
_DRAW = lambda what: f"D(H64(concat('7:', {what})) % 1099511627776) / D(1099511627776)"
_FAULTS = f"""with c as (select partition, off, msg_id, copy from {{messages}} cross join (values (0), (1)) as t(copy) where copy = 0 or {_DRAW("msg_id, ':dup'")} < 0.3),
 f as (select *, {_DRAW("msg_id, ':', copy, ':drop'")} < 0.2 as dropped, B(floor({_DRAW("msg_id, ':', copy, ':late'")} * 4)) as late, msg_id like '%-7' or {_DRAW("msg_id, ':', copy + 1")} < 0.1 as fails from c)"""


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of the log under the fault plan; each copy is an attempt."""
    messages = view(spark, d, "messages").select("partition", F.col("off").alias("offset"), "msg_id")
    return generate.perturbed(messages, 7, duplicate=0.3, drop=0.2, window=4).withColumn("attempt", F.col("copy") + 1)


@built("fault_perturb", _FAULTS + " select partition, B(count_if(not dropped)) as delivered, B(count_if(not dropped and copy = 1)) as duplicated, B(count_if(not dropped and late > 0)) as late, B(sum(case when not dropped then off + late end)) as arrivals from f group by partition")
def _(spark, d):
    return _delivered(spark, d).groupBy("partition").agg(F.count("*").alias("delivered"), F.count_if(F.col("copy") == 1).alias("duplicated"), F.count_if(F.col("arrival") > F.col("offset")).alias("late"), F.sum("arrival").alias("arrivals"))


@built("fault_counts", _FAULTS + """ select fault, count(*) as n, min(msg_id) as first from (select msg_id, unnest([case when copy = 1 and not dropped then 'duplicate' end, case when late > 0 and not dropped then 'late' end, case when msg_id like '%-7' and not dropped then 'poison' when fails and not dropped then 'failure' end]) as fault from f) x where fault is not null group by fault""")
def _(spark, d):
    """How often each injected fault fired, and the least id that it hit."""
    got = _delivered(spark, d)
    poison = [r.msg_id for r in got.where("msg_id LIKE '%-7'").select("msg_id").distinct().limit(100).collect()]
    fails = generate.failing(got, 7, 0.1, poison)
    fired = F.array_compact(F.array(F.when(F.col("copy") == 1, "duplicate"), F.when(F.col("arrival") > F.col("offset"), "late"), F.when(F.col("msg_id").isin(poison), "poison").when(fails, "failure")))
    return got.select("msg_id", F.explode(fired).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"), F.min("msg_id").alias("first"))


plain("scenario_headline", "select event_type as scenario, count(*) as events, B(max(seq)) as head, count(distinct subject) as subjects, round(avg(value), 3) as mean from {journal} group by event_type")
plain("event_samples", "select event_type as scenario, LAGG(concat(kind, '=', n), ',', kind) as kinds from (select event_type, kind, count(*) as n from {journal} group by event_type, kind) k group by event_type")

# streaming ------------------------------------------------------------------------------------------------
for _name, (_job, _sql) in jobs.JOBS.items():
    built(_name, _sql, _sql is not None and "recursive" in _sql)(_job)
del _name, _job, _sql

ORACLE_SQL["stream_fsm"] = _check("with recursive " + _fold("st", "select concat('U', user_id) as subject, epoch_us(ts) as ord, 0 as at_ms, case event_id % 5 when 0 then 'ASSIGN' when 1 then 'DISPATCH' when 2 then 'START' when 3 then 'COMPLETE' else 'REQUEUE' end as event from {events}", S.TASK_MOVES, "PENDING") + " select subject, arg_max(state, n) as state, B(count_if(n > 0 and accepted)) as accepted from st group by subject", True)
