"""Operators on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.functions import scalars as fn
from rillway.operators import dispatch, fsm, kv, liveness, ordered, traffic
from rillway.operators.fsm import move


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("key", "want"), [("k", 10152434533701879956), ("task-0001", 4917764230982328310)])
def test_stable_hash(spark, key, want):
    assert int(one(spark, fn.stable_hash(F.lit(key)))) == want
    assert one(spark, fn.partition_for_key(F.lit(key))) == want % 4


def test_scalars(spark):
    assert one(spark, fn.priority_label(F.lit(3))) == "HIGH" and one(spark, fn.priority_label(F.lit(9))) == "P9"
    assert one(spark, fn.padded_id("T", F.lit(123456))) == "T123456"
    assert list(one(spark, fn.rotated(F.array(F.lit(3), F.lit(1), F.lit(2))))) == [1, 2, 3]
    moved = one(spark, fn.move_towards(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), F.lit(10.0)))
    assert (moved.x, moved.y, moved.moved) == (3.0, 4.0, 5.0)
    ttl = lambda e, t: one(spark, fn.ttl_seconds(F.lit(True), F.lit(e).cast("long"), F.lit(t)))
    assert [ttl(None, 0), ttl(5000, 4999), ttl(5000, 5000)] == [-1, 1, -2]
    assert one(spark, fn.glob(F.lit("veh:1"), "veh:?")) and not one(spark, fn.glob(F.lit("VEH:1"), "veh:*"))
    assert one(spark, fn.bay_capacity(F.lit(12))) == 4


def journal(spark, rows):
    return spark.createDataFrame(rows, "subject string, seq long, event string")


def final(spark, events, moves=S.TASK_MOVES, initial="PENDING"):
    df = journal(spark, [("T", i, e) for i, e in enumerate(events)])
    return fsm.fold_fsm(df, ["subject"], F.col("seq"), F.col("event"), F.col("seq"), moves, initial).first()


@pytest.mark.parametrize(
    ("events", "state"),
    [
        (["ASSIGN", "DISPATCH", "ENQUEUE", "PROCEED", "START", "COMPLETE"], "COMPLETED"),
        (["ASSIGN", "DISPATCH", "PAUSE", "RESUME", "RECOVER"], "ENROUTE"),
        (["ASSIGN", "DISPATCH", "ENQUEUE", "PAUSE", "RESUME", "RECOVER", "PROCEED"], "ENROUTE"),
        (["COMPLETE", "ASSIGN", "ASSIGN"], "ASSIGNED"),
        (["ASSIGN", "PAUSE", "REQUEUE", "ASSIGN", "PROCEED"], "ASSIGNED"),
    ],
)
def test_fold(spark, events, state):
    assert final(spark, events).state == state


def test_fold_equals_stream_step(spark):
    r = random.Random(1)
    names = sorted({e for _, e, _ in S.TASK_MOVES})
    logs = {f"T{i}": r.choices(names, k=r.randint(1, 25)) for i in range(60)}
    df = journal(spark, [(k, i, e) for k, v in logs.items() for i, e in enumerate(v)])
    got = {x.subject: (x.state, list(x.pause_stack), list(x.queue_stack), sum(s.accepted for s in x.steps)) for x in fsm.fold_fsm(df, ["subject"], F.col("seq"), F.col("event"), F.col("seq")).collect()}
    for k, events in logs.items():
        state, pause, queue, n = "PENDING", [], [], 0
        for e in events:
            state, pause, queue, ok = move(state, pause, queue, e, {(a, x): t for a, x, t in S.TASK_MOVES})
            n += ok
        assert got[k] == (state, pause, queue, n)


def test_every_state_can_end():
    ends = {s for s, _, _ in S.TASK_MOVES}
    assert {t for _, _, t in S.TASK_MOVES} - ends - {S.QUEUE, S.RESUME} == set(S.TERMINAL)
    assert len(S.TASK_MOVES) == 35 and len(S.VEHICLE_MOVES) == 45


def test_sequence_is_gap_free(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 13).alias("a"), "id")
    got = ordered.with_sequence(df, ["a", "id"]).orderBy("a", "id").collect()
    assert [r.seq for r in got] == list(range(1, 1001))
    assert ordered.with_sequence(df.limit(0), ["a", "id"]).count() == 0


def test_committed_prefix(spark):
    acks = spark.createDataFrame([(0, i, i != 2) for i in range(5)] + [(1, i, True) for i in range(3)], "partition int, offset long, acked boolean")
    assert {r.partition: (r.head, r.committed) for r in ordered.committed(acks).collect()} == {0: (5, 2), 1: (3, 3)}


def test_cooldown_rule(spark):
    df = spark.createDataFrame([("r", t, 50.0) for t in (0, 500, 1000)], "rule string, at long, v double")
    assert [r.at_ms for r in ordered.cooldown(df, ["rule"], F.col("at"), F.col("v"), 10.0, 1000).collect()] == [0, 1000]


@pytest.mark.parametrize("values", [[7.0], [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0], [5.0, 1.0, 5.0, 1.0], [float(i) for i in range(1, 101)]])
def test_nearest_rank(spark, values):
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    r = ordered.percentiles(df, ["k"], "v").first()
    for p in (50, 95, 99):
        assert r[f"p{p}"] == sorted(values)[max(0, -(-p * len(values) // 100) - 1)]


def test_deadlock_cycles(spark):
    edges = [(1, 2), (2, 1), (3, 4), (4, 5), (5, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = traffic.cycles(spark.createDataFrame(edges, "waiter long, holder long")).collect()
    assert sorted(list(r.cycle) for r in got) == [[1, 2], [3, 4, 5]]


def test_long_deadlock_cycle(spark):
    ring = [(i, (i + 1) % 40) for i in range(40)]
    got = traffic.cycles(spark.createDataFrame([*ring, (39, 38)], "waiter long, holder long")).collect()
    assert sorted(list(r.cycle) for r in got) == [list(range(40)), [38, 39]]


def walks(n, seed):
    """Who waits for whom, one for each of n but a few, and the cycles by walking."""
    rng = random.Random(seed)
    to = {v: rng.randrange(n) for v in range(n) if v % 50}
    to = {v: w for v, w in to.items() if v != w}
    seen, found = {}, set()
    for start in to:
        path, v = [], start
        while v in to and v not in seen:
            seen[v] = start
            path.append(v)
            v = to[v]
        if v in path:
            ring = path[path.index(v) :]
            at = ring.index(min(ring))
            found.add(tuple(ring[at:] + ring[:at]))
    return to, found


def few_cuts(monkeypatch):
    calls, cut = [], traffic.cut
    monkeypatch.setattr(traffic, "cut", lambda df: (calls.append(1), cut(df))[1])
    return calls


@pytest.mark.parametrize("seed", [1, 5])
def test_single_waits_take_few_rounds(spark, monkeypatch, seed):
    """Steps are doubled some times before they are stored, and vehicles on no cycle fall away."""
    calls = few_cuts(monkeypatch)
    to, want = walks(3000, seed)
    got = traffic.cycles(spark.createDataFrame(list(to.items()), "waiter long, holder long")).collect()
    assert sorted(tuple(r.cycle) for r in got) == sorted(want) and want and len(calls) <= 4


def test_victims_of_single_waits(spark, monkeypatch):
    calls = few_cuts(monkeypatch)
    to, want = walks(3000, 2)
    found = traffic.cycles(spark.createDataFrame(list(to.items()), "waiter long, holder long"))
    priority = F.map_from_entries(F.transform("cycle", lambda v: F.struct(v, (v % 5).cast("int"))))
    got = {tuple(r.cycle): r.v for r in found.withColumn("v", traffic.victim(F.col("cycle"), priority)).collect()}
    assert got == {c: min(c, key=lambda v: (v % 5, v)) for c in want} and want and len(calls) <= 4


@pytest.mark.parametrize("few", [0, 700])
def test_single_waits_dealt_or_broadcast(spark, monkeypatch, few):
    """Rounds that deal their rows, and a change to rounds that broadcast them, find what a walk finds."""
    monkeypatch.setattr(traffic, "FEW", few)
    to, want = walks(3000, 4)
    to |= {5000 + i: 5000 + (i + 1) % 150 for i in range(150)}
    got = traffic.cycles(spark.createDataFrame(list(to.items()), "waiter long, holder long")).collect()
    assert sorted(tuple(r.cycle) for r in got) == sorted([*want, tuple(range(5000, 5150))])


def test_single_waits_take_few_tasks(spark):
    """Where Spark joins no small partitions, a round does not run all of them for every doubling."""
    to, want = walks(3000, 2)
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few tasks", "")
        got = traffic.cycles(spark.createDataFrame(list(to.items()), "waiter long, holder long")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few tasks") for s in told.getJobInfo(j).stageIds}
    tasks = sum(x.numCompletedTasks for x in map(told.getStageInfo, stages) if x)
    assert sorted(tuple(r.cycle) for r in got) == sorted(want) and 0 < tasks <= 500, tasks


def test_victim_makes_no_map_per_vehicle(spark):
    """A map that the query makes from a cycle would be made again for each of its vehicles."""
    from rillway.plans import registry

    plan = registry.QUERIES["deadlock_victim"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "array_min" in plan


def test_routes(spark):
    r = {(x.start, x.goal): (x.path, x.cost) for x in traffic.routes(spark).collect()}
    assert r["A", "F"] == ("A>B>C>F", 760.0) and r["A", "A"] == ("A", 0.0) and len(r) == 36


def test_greedy_plan(spark):
    tasks = spark.createDataFrame([(1, 1, 0, 0.0, 0.0), (2, 3, 100, 0.0, 0.0), (3, 3, 50, 0.0, 0.0)], "task_id long, priority int, created_ms long, ox double, oy double")
    fleet = spark.createDataFrame([(1, 5.0, 0.0, 100.0, True, "IDLE"), (2, 90.0, 0.0, 100.0, True, "IDLE"), (3, 1.0, 0.0, 10.0, True, "IDLE")], "vehicle_id long, vx double, vy double, battery double, online boolean, vstate string")
    assert [(r.task_id, r.vehicle_id, r.victim) for r in dispatch.plan_greedy(tasks, fleet).orderBy("step").collect()] == [(3, 1, None), (2, 2, None)]


def results(spark, log):
    ran = kv.run_commands(spark.createDataFrame(log, "key string, order int, at_ms long, op string, field string, value string, ttl_ms long")).collect()
    return {k: [r.result for r in sorted(ran, key=lambda r: r.order) if r.key == k] for k in {r.key for r in ran}}


def test_store(spark):
    log = [("a", 1, 0, "set", None, "5", 1000), ("a", 2, 999, "ttl", None, None, None), ("a", 3, 1000, "get", None, None, None), ("a", 4, 1001, "incr", None, None, None), ("a", 5, 1002, "hset", "f", "1", None),
           ("h", 1, 0, "hset", "f", "1", None), ("h", 2, 1, "hset", "f", "2", None), ("h", 3, 2, "hget", "f", None, None), ("h", 4, 3, "hdel", "f", None, None), ("h", 5, 4, "exists", None, None, None), ("h", 6, 5, "set", None, "x", None), ("h", 7, 6, "incr", None, None, None)]
    got = results(spark, log)
    assert got["a"] == ["OK", "1", None, "1", "WRONGTYPE"]
    assert got["h"] == ["1", "0", "2", "1", "0", "OK", "NOTINT"]


def test_fold_of_a_long_log(spark):
    """Beyond one chunk of the gathering fold, and exactly at its edge."""
    r = random.Random(4)
    names = sorted({e for _, e, _ in S.VEHICLE_MOVES})
    table = {(a, e): t for a, e, t in S.VEHICLE_MOVES}
    for n in (63, 64, 65, 500):
        events = r.choices(names, k=n)
        state, pause, queue, steps = "IDLE", [], [], []
        for e in events:
            before = state
            state, pause, queue, ok = move(state, pause, queue, e, table)
            steps.append((e, before, state, ok))
        got = final(spark, events, S.VEHICLE_MOVES, "IDLE")
        assert got.state == state and [(s.event, s.from_state, s.to_state, s.accepted) for s in got.steps] == steps and [s.n for s in got.steps] == list(range(1, n + 1))


def requests(spark, rows):
    return spark.createDataFrame([(r, i, i, op, v, p) for i, (op, v, r, p) in enumerate(rows)], "resource long, at_ms long, id long, op string, vehicle long, priority int")


def test_requests_queue_and_release(spark):
    """A slot goes to the highest priority, then the earliest; leaving the queue is not the same as letting go."""
    one = spark.createDataFrame([(1, 1), (2, 2)], "resource long, capacity long")
    run = lambda rows: {x.resource: x for x in traffic.fold_requests(requests(spark, rows), one).collect()}
    got = run([("request", 1, 1, 2), ("request", 2, 1, 2), ("request", 3, 1, 5), ("request", 1, 1, 9), ("release", 1, 1, 0)])[1]
    assert (got.holders, got.waiting, got.requests, got.grants, got.blocks, got.releases) == ([3], [2], 4, 2, 2, 1)
    got = run([("request", 1, 1, 2), ("request", 2, 1, 2), ("request", 3, 1, 2), ("request", 3, 1, 7), ("release_resource", 2, 1, 0), ("release", 9, 1, 0)])[1]
    assert (got.holders, got.waiting, got.conflicts) == ([1], [3], 3)
    both = run([("request", 1, 1, 2), ("request", 2, 1, 2), ("request", 1, 2, 2), ("request", 2, 2, 2), ("request", 3, 2, 2), ("release_all", 1, 1, 0)])
    assert both[1].holders == [2] and both[2].holders == [2, 3] and not both[1].waiting and not both[2].waiting
    assert traffic.fold_requests(requests(spark, [("request", 1, 1, 2)]).limit(0), one).count() == 0


def test_plan_preempts(spark):
    """Without a free vehicle an urgent task takes that of the least running one; the next that finds none ends."""
    ask = "task_id long, priority int, created_ms long, ox double, oy double"
    fleet = spark.createDataFrame([(1, 0.0, 0.0, 90.0, True, "EXECUTING"), (2, 0.0, 0.0, 90.0, True, "EXECUTING"), (3, 0.0, 0.0, 90.0, False, "EXECUTING")], "vehicle_id long, vx double, vy double, battery double, online boolean, vstate string")
    running = spark.createDataFrame([(11, 1, 5, 0, 1), (12, 1, 9, 0, 2), (13, 1, 20, 0, 3), (14, 1, 30, 2, 1)], "task_id long, priority int, assigned_ms long, preempted int, vehicle_id long")
    plan = lambda *tasks: [(r.task_id, r.vehicle_id, r.victim) for r in dispatch.plan_greedy(spark.createDataFrame(list(tasks), ask), fleet, running).orderBy("step").collect()]
    assert plan((1, 5, 0, 0.0, 0.0), (2, 3, 0, 0.0, 0.0), (3, 3, 1, 0.0, 0.0)) == [(1, 2, 12), (2, 1, 11)]
    assert plan((1, 2, 0, 0.0, 0.0)) == [] and plan((1, 1, 0, 0.0, 0.0), (2, 4, 0, 0.0, 0.0)) == [(2, 2, 12)]


@pytest.mark.parametrize("seed", range(4))
def test_running_sums(spark, seed):
    """Ranges, parts, ties and nulls against plain Python."""
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(40)]) if seed else 7, i, r.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long")
    got = {x.id: (x.n, x.s) for x in ordered.running(df, ["at", "id"], {"n": ([], F.lit(1).cast("long")), "s": (["k"], F.col("v"))}).collect()}
    n, sums = 0, {}
    for k, _, i, v in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        n, sums[k] = n + 1, sums.get(k, 0) + v
        assert got[i] == (n, sums[k])


def test_early_messages_equal_a_holding_reader(spark):
    r = random.Random(3)
    rows = []
    for p in range(3):
        for o in range(200):
            if not (p == 1 and o == 150):
                rows.append((p, o, o + r.choice((0, 0, 0, 5, 12)), o))
    rows += [(0, 17, 400, 17)]  # a redelivery counts for nothing
    got = {x.partition: (x.expected, x.late) for x in ordered.out_of_order(spark.createDataFrame(rows, "partition long, offset long, arr long, o long"), "partition", ["arr", "o"]).collect()}
    for p in range(3):
        expected, held, late = 0, set(), 0
        for _, o in sorted((a, o) for q, o, a, _ in rows if q == p):
            if o > expected:
                late += o not in held
                held.add(o)
            elif o == expected:
                expected += 1
                while expected in held:
                    expected += 1
        assert got[p] == (expected, late)


def test_trimmed_chains_keep_cycles(spark):
    edges = [(i, i + 1) for i in range(1200)] + [(2000, 2001), (2001, 2002), (2002, 2000), (1200, 2000), (2002, 5000)]
    got = traffic.cycles(spark.createDataFrame(edges, "waiter long, holder long")).collect()
    assert [list(x.cycle) for x in got] == [[2000, 2001, 2002]]


def test_hash_commands(spark):
    log = [("h", i, i, op, f, v, None) for i, (op, f, v) in enumerate([("hset", "b", "1"), ("hset", "a", "2"), ("hkeys", None, None), ("hgetall", None, None), ("hdel", "a", None), ("hkeys", None, None), ("hdel", "b", None), ("hgetall", None, None), ("exists", None, None)])]
    assert results(spark, log)["h"] == ["1", "1", "a,b", "a=2,b=1", "1", "b", "1", "", "0"]


def test_score_reasons(spark):
    got = one(spark, fn.score_reasons(F.lit(3), F.lit(80.0), F.lit(12.5), F.lit(10.0), F.lit("IDLE")))
    assert list(got) == ["priority=HIGH(+3000.0)", "distance=12.5m(-12.5)", "battery=80.0%(+40.0)", "state=IDLE(+50.0)", "waiting=10.0s(+0.2)"]


def test_json_diff(spark):
    got = one(spark, fn.json_diff(F.lit('{"a": 1, "b": "x", "c": [1]}'), F.lit('{"a": 2, "b": "x", "d": null}')))
    assert [tuple(x) for x in got] == [("a", "1", "2"), ("c", "[1]", None)]
    assert list(one(spark, fn.json_diff(F.lit(None).cast("string"), F.lit("{}")))) == []


def test_fold_of_sorted_rows_equals_the_gathered_one(spark):
    r = random.Random(7)
    names = sorted({e for _, e, _ in S.VEHICLE_MOVES})
    rows = [(k, i, r.choice(names)) for k in ("a", "b", None, "c") for i in range(r.randint(1, 300))]
    df = journal(spark, rows)
    long = {x.subject: (x.state, x.accepted, x.rejected) for x in fsm.fold_long(df, "subject", F.col("seq"), F.col("event"), S.VEHICLE_MOVES, "IDLE").collect()}
    for x in fsm.fold_fsm(df, ["subject"], F.col("seq"), F.col("event"), F.col("seq"), S.VEHICLE_MOVES, "IDLE").collect():
        n = sum(s.accepted for s in x.steps)
        assert long[x.subject] == (x.state, n, len(x.steps) - n)
    assert len(long) == 4 and fsm.fold_long(df.limit(0), "subject", F.col("seq"), F.col("event")).count() == 0


def test_cooldown_of_many_keys(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 5000), float(r.randint(0, 20))) for _ in range(800)]
    want = []
    for k in ("a", "b", None):
        last = None
        for _, t, v in sorted((x for x in rows if x[0] == k), key=lambda x: x[1:]):
            if v > 10 and (last is None or t - last >= 300):
                last = t
                want.append((k or "", t, v))
    got = ordered.cooldown(spark.createDataFrame(rows, "rule string, at long, v double"), ["rule"], F.col("at"), F.col("v"), 10.0, 300)
    assert sorted((x.rule or "", x.at_ms, x.value) for x in got.collect()) == sorted(want)


def test_final_entries(spark):
    log = [("a", 1, 0, "set", None, "5", 1000), ("b", 1, 0, "hset", "f", "1", None), ("b", 2, 0, "hset", "g", "2", None), ("c", 1, 0, "set", None, "1", None), ("c", 2, 0, "delete", None, None, None),
           (None, 1, 0, "incr", None, None, None), ("d", 1, 0, "set", None, "1", None), ("d", 2, 5, "expire", None, None, 0), ("e", 1, 0, "unheard", None, None, None), ("f", 1, 0, "hset", None, "1", None)]
    schema = "key string, order int, at_ms long, op string, field string, value string, ttl_ms long"
    got = {r.key: tuple(r)[1:] for r in kv.final_entries(kv.run_commands(spark.createDataFrame(log, schema))).collect()}
    none = (None, None, None, None)
    assert got == {"a": ("string", "5", None, 1000), "b": ("hash", None, {"f": "1", "g": "2"}, None), "c": none, None: ("string", "1", None, None), "d": none, "e": none, "f": ("hash", None, {"": "1"}, None)}
    assert kv.run_commands(spark.createDataFrame([], schema)).count() == 0


def test_one_key_over_many_batches(spark):
    log = spark.range(30_000).select(F.lit("k").alias("key"), F.col("id").alias("order"), F.col("id").alias("at_ms"), F.lit("incr").alias("op"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("long").alias("ttl_ms"))
    ran = kv.run_commands(log)
    assert ran.where("result = order + 1").count() == 30_000
    assert [r.value for r in kv.final_entries(ran).collect()] == ["30000"]


@pytest.mark.parametrize("seed", range(4))
def test_breaks_equal_one_at_a_time(spark, seed):
    draw = random.Random(seed)
    n = 9
    edges = sorted({(a, draw.randrange(n)) for a in range(n) for _ in range(2)})
    found = traffic.cycles(spark.createDataFrame(edges, "waiter long, holder long"))
    priority = {v: draw.randrange(3) for v in range(n - 1)}
    left, want = sorted(list(r.cycle) for r in found.collect()), []
    while left:
        victim = min(left[0], key=lambda v: (priority.get(v, 0), v))
        want.append((left[0], victim, priority.get(victim, 0)))
        left = [c for c in left if victim not in c]
    got = traffic.breaks(found, spark.createDataFrame(list(priority.items()), "vehicle long, priority int")).collect()
    assert want and sorted((list(r.cycle), r.victim, r.victim_priority) for r in got) == want


def test_no_cycle_no_break(spark):
    none = spark.createDataFrame([], "cycle array<long>")
    assert traffic.breaks(none, spark.createDataFrame([], "vehicle long, priority int")).count() == 0


def ticked(plan, last):
    silent, out = {}, []
    for tick in range(last):
        for vehicle, start, duration in plan:
            if tick == start and vehicle not in silent:
                silent[vehicle] = start + duration
                out.append((vehicle, tick, "silent"))
            elif vehicle in silent and tick >= silent[vehicle]:
                del silent[vehicle]
                out.append((vehicle, tick, "resume"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_silence_equals_ticks(spark, seed):
    draw = random.Random(seed)
    plan = [(draw.randrange(4), draw.randrange(14), draw.randrange(5)) for _ in range(40)]
    df = spark.createDataFrame([(*p, i) for i, p in enumerate(plan)] + [(9, None, 3, 90), (9, 2, None, 91)], "vehicle long, start long, duration long, line long")
    assert sorted(map(tuple, liveness.silence(df).collect())) == ticked(plan, 40)


def test_alerts_by_rules(spark):
    readings = spark.createDataFrame([("m", "a", 5.0, 0), ("m", "a", 6.0, 5), ("m", "a", 7.0, 10), ("m", "b", 1.0, 3), ("m", None, 9.0, 4), ("m", "a", None, 50), ("other", "a", 9.0, 1)], "metric string, subject string, value double, at_ms long")
    rules = spark.createDataFrame([("high", "m", 4.0, "ERROR", ">", 10), ("low", "m", 2.0, "INFO", "<", 0)], liveness.RULES)
    got = {(r.rule, r.severity, r.subject, r.at_ms) for r in liveness.alerts(readings, rules).collect()}
    assert got == {("high", "ERROR", "a", 0), ("high", "ERROR", "a", 10), ("high", "ERROR", None, 4), ("low", "INFO", "b", 3)}


def test_flush_holds_back_the_rest(spark):
    rows = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, None), (None, 1, True), (None, 2, False)], "subject string, seq long, no boolean")
    got = {(r.subject, r.seq): r.published for r in ordered.flush(rows, ["subject"], F.col("seq"), F.col("no")).collect()}
    assert got == {("a", 1): True, ("a", 2): False, ("a", 3): False, ("b", 1): True, (None, 1): False, (None, 2): False}


def test_trip_goes_by_way_of_the_origin(spark):
    driven = spark.createDataFrame([(1, 60.0, 60.0, 540.0, 60.0, 540.0, 340.0), (2, 0.0, 0.0, 60.0, 61.0, 61.0, 60.0)], "task_id long, vx double, vy double, ox double, oy double, dx double, dy double")
    got = {r.task_id: (list(r.route), r.cost) for r in traffic.trips(driven, traffic.routes(spark)).collect()}
    assert got == {1: (["A", "B", "C", "F"], 760.0), 2: (["A"], 0.0)}


@pytest.mark.parametrize("times", ["outlier", "tied", "even", "nulls"])
def test_ranges_hold_about_as_much(spark, monkeypatch, times):
    """One far-off value, or one value that half of the rows have, does not crowd the rows into one range."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 400)
    at = {"outlier": F.when(F.col("id") == 0, 0).otherwise(10**12 + F.col("id")), "tied": F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")), "even": F.col("id"), "nulls": F.when(F.col("id") % 3 > 0, F.col("id"))}[times]
    df = spark.range(20_000).select("id", at.cast("long").alias("at")).withColumn("v", F.col("id") % 5)
    dealt, _ = ordered.ranged(df, ["at", "id"])
    sizes = [r["count"] for r in dealt.where("at IS NOT NULL").groupBy("_range").count().collect()]
    assert max(sizes) <= 2.5 * 20_000 / 64
    got = {r.id: r.s for r in ordered.running(df, ["at", "id"], {"s": ([], F.col("v"))}).collect()}
    total, rows = 0, sorted(map(tuple, df.select("at", "id", "v").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for _, i, v in rows:
        total += v
        assert got[i] == total


def test_no_rows_to_range(spark):
    df = spark.createDataFrame([], "at long, id long")
    assert ordered.with_sequence(df, ["at", "id"]).count() == 0


def test_release_alls_are_not_dealt_to_every_resource(spark):
    """One vehicle asks for 60 resources and then releases all of them 200 times, and asks again."""
    log = [(r, 1, 1, r, r, "request") for r in range(60)] + [(0, 1, 1, 100 + i, 100 + i, "release_all") for i in range(200)] + [(5, 1, 1, 400, 400, "request"), (7, 2, 1, 401, 401, "request")]
    rows = spark.createDataFrame(log, "resource long, vehicle long, priority long, at_ms long, id long, op string")
    capacity = spark.range(60).selectExpr("id as resource", "1L as capacity")
    assert traffic._by_resource(rows, capacity).count() <= len(log) + 60
    got = {r.resource: (r.holders, r.requests, r.grants, r.releases) for r in traffic.fold_requests(rows, capacity).collect()}
    assert got == {r: ([1], 2, 2, 1) if r == 5 else ([2], 2, 2, 1) if r == 7 else ([], 1, 1, 1) for r in range(60)}
