"""The applier, commands, idempotency stores, liveness and expiry on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.operators import admission, applier, compare, dispatch, fsm, idempotency, ordered, traffic, verify, yard
from rillway.operators.kv import apply as kv_apply
from rillway.operators.kv import GONE
from rillway.sources import io
from rillway.streaming import collectors, stores

RECORD = "seq long, kind string, task_id string, vehicle_id string, event string, command string, at_ms long"


def records(spark, rows):
    return spark.createDataFrame([(i, *(list(r) + [None] * (5 - len(r))), i) for i, r in enumerate(rows)], RECORD)


def created(task="T1", vehicle="A1"):
    return [("task_created", task), ("task_assigned", task, vehicle), ("task_event", task, None, "DISPATCH")]


def test_ten_pauses_are_one_effect(spark):
    sent = [("command", "T1", None, a, "C1") for a in ("PAUSE", "RESUME") for _ in range(10)]
    log = records(spark, created() + sent)
    tasks = applier.fold_tasks(log)
    got = {r.event: (r.sent, r.applied, r.duplicate) for r in applier.command_effects(tasks).collect()}
    assert got == {"PAUSE": (10, 1, 9), "RESUME": (10, 1, 9)}
    (v,) = applier.fold_vehicles(applier.vehicle_records(tasks, log)).collect()
    assert (v.pause_commands, v.resume_commands, v.payload, v.state) == (1, 1, "T1", "RECOVERING")


def test_command_that_has_no_effect_may_be_sent_again(spark):
    log = records(spark, [("command", "T1", None, "PAUSE", "C1"), *created()[:1], ("command", "T1", None, "PAUSE", "C1"), *created()[1:], ("command", "T1", None, "PAUSE", "C1"), ("command", "T1", None, "PAUSE", "C1")])
    steps = applier.task_steps(applier.fold_tasks(log)).where("kind = 'command'").orderBy("seq").collect()
    assert [r.outcome for r in steps] == ["failed", "unconfirmed", "applied", "duplicate"]


def test_applier_couples_tasks_and_vehicles(spark):
    rows = [*created(), ("task_created", "T1"), ("task_requeued", "T1"), ("task_event", "T9", None, "START"), ("task_assigned", "T1", "A2"), ("task_event", "T1", None, "START"), ("task_event", "T1", None, "COMPLETE"),
            ("vehicle_offline", None, "A1"), ("vehicle_offline", None, "A1"), ("vehicle_online", None, "A1"), ("vehicle_event", None, "A1", "CHARGE"), ("task_created", "T2"), ("task_assigned", "T2", "A1")]
    log = records(spark, rows)
    tasks = applier.fold_tasks(log)
    got = {r.task_id: (r.present, r.state, r.vehicle_id, r.preempted) for r in tasks.collect()}
    assert got == {"T1": (True, "COMPLETED", "", 1), "T9": (False, "PENDING", "", 0), "T2": (True, "ASSIGNED", "A1", 0)}
    v = {r.vehicle_id: r for r in applier.fold_vehicles(applier.vehicle_records(tasks, log)).collect()}
    # a charging vehicle refuses the task, so it is bound but not loaded
    assert (v["A1"].state, v["A1"].payload, v["A1"].offline_events, v["A1"].reconnects, v["A1"].rejected) == ("CHARGING", "", 1, 1, 1)
    # it may not start before it is dispatched, but what frees it and is counted does not ask that
    assert (v["A2"].state, v["A2"].payload, v["A2"].tasks_completed, v["A2"].rejected) == ("ASSIGNED", "", 1, 2)


def test_store_evicts_the_oldest_mark_and_forgets_what_is_old(spark):
    ops = [("check_and_set", "a"), ("check_and_set", "b"), ("mark", "a"), ("check_and_set", "c"), ("claim", "b"), ("claim", "b"), ("release", "b"), ("release", "b"), ("seen", "a"), ("forget", "a"), ("seen", "a"), (None, "a")]
    rows = [("s", i, i, op, k) for i, (op, k) in enumerate(ops)] + [("s", 99, 1000, "seen", "c")]
    out = idempotency.run_store(spark.createDataFrame(rows, "store string, order long, at_ms long, op string, key string"), 2, 500).orderBy("order").collect()
    assert [r.result for r in out] == [True, True, True, True, True, False, True, False, True, True, False, None, False]
    assert [r.evicted for r in out if r.evicted] == ["b"] and out[-1].expired == 1


def drained(stream, out):
    stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data").collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_liveness_goes_on_after_a_restart(spark, tmp_path, seed):
    """Two runs from one checkpoint, a file per micro-batch, give what a plain walk gives."""
    rng = random.Random(seed)
    beats = sorted((rng.randrange(1, 400), f"v{rng.randrange(5)}") for _ in range(120))
    timeout, check, cooldown = 10, 4, 60
    want = set()
    for v in {b[1] for b in beats}:
        times, alerted = sorted(t for t, x in beats if x == v), None
        for t, after in zip(times, [*times[1:], None], strict=True):
            found = stores.found_silent(t, timeout, check)
            if (found < beats[-1][0]) if after is None else found < after:
                alert = alerted is None or found - alerted >= cooldown
                alerted = found if alert else alerted
                want.add((v, "vehicle_offline", found, found - t, alert))
                want |= {(v, "vehicle_online", after, None, False)} if after is not None else set()
    (folder := tmp_path / "in").mkdir()
    read = spark.readStream.schema("at_ms long, vehicle_id string").option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = read.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", "1 millisecond")
    got = []
    with stores.rocksdb(spark):
        for part in (beats[:60], beats[60:]):
            for i in range(0, 60, 20):
                spark.createDataFrame(part[i : i + 20], "at_ms long, vehicle_id string").coalesce(1).write.mode("append").parquet(str(folder))
            got = drained(stores.liveness(stream.select("ts", "vehicle_id", "at_ms"), timeout, check, cooldown), tmp_path)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sweeps_over_several_batches(spark, tmp_path):
    rng = random.Random(7)
    ops = [("set", None, "1", 40), ("set", None, "1", None), ("expire", None, None, 15), ("get", None, None, None), ("persist", None, None, None), ("hset", "f", "2", None), ("delete", None, None, None)]
    log = [(f"k{rng.randrange(4)}", i, t, *rng.choice(ops)) for i, t in enumerate(sorted(rng.randrange(1, 600) for _ in range(150)))]
    period, want = 25, []
    for k in {r[0] for r in log}:
        entry, mine = GONE, [r for r in log if r[0] == k]
        for r, after in zip(mine, [*mine[1:], None], strict=True):
            entry, _ = kv_apply(entry, r[2], *r[3:])
            due = None if entry.kind is None or entry.expires_ms is None else -(-entry.expires_ms // period) * period
            if due is not None and due <= (log[-1][2] - 1 if after is None else after[2]):
                want.append((due, k, entry.expires_ms))
                entry = GONE
    schema = "key string, order long, at_ms long, op string, field string, value string, ttl_ms long"
    for i in range(0, 150, 50):
        spark.createDataFrame(log[i : i + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with stores.rocksdb(spark):
        got = drained(stores.expiries(read.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", "1 millisecond"), period), tmp_path)
    assert sorted(map(tuple, got)) == sorted(want)


def test_idempotency_state_survives_batches(spark, tmp_path):
    rng = random.Random(3)
    log = [(f"s{rng.randrange(2)}", i, 10 * i, rng.choice(["claim", "mark", "release", "check_and_set", "seen", "forget"]), f"k{rng.randrange(6)}") for i in range(200)]
    schema = "store string, order long, at_ms long, op string, key string"
    for i in range(0, 200, 50):
        spark.createDataFrame(log[i : i + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with stores.rocksdb(spark):
        got = drained(stores.idempotency(read, 3, 300), tmp_path)
    want = idempotency.run_store(spark.createDataFrame(log, schema), 3, 300).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_admission_equals_a_walk(spark, monkeypatch, seed):
    """Refusals feed back on the level; many small ranges are composed and walked."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 40)
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, "a", "b"]), rng.choice(["publish"] * 3 + ["drain"]), rng.choice([0, 1, 2, 9, None])) for i in range(3000)]
    got = {r.i: (r.level, r.moved, r.refused) for r in admission.admitted(spark.createDataFrame(rows, "i long, p string, op string, budget long"), ["p"], ["i"], 15).collect()}
    level = {}
    for i, p, op, budget in rows:
        x = level.get(p, 0)
        y = (x if x >= 15 else x + 1) if op == "publish" else max(0, x - (x if budget is None else budget))
        assert got[i] == (x, y - x, op == "publish" and x >= 15)
        level[p] = y


def test_admission_keeps_ranges_whole(spark, monkeypatch):
    """Rows of a range lie in several partitions of the input, and those that Spark shuffles are not coalesced."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 400)
    rows = [(i, "ab"[i % 2], "drain" if i % 7 == 0 else "publish", i % 5) for i in range(4000)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        log = spark.createDataFrame(rows, "i long, p string, op string, budget long").repartition(6)
        got = {r.i: (r.level, r.moved) for r in admission.admitted(log, ["p"], ["i"], 15).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    level = {"a": 0, "b": 0}
    for i, p, op, budget in rows:
        x = level[p]
        level[p] = min(x + 1, 15) if op == "publish" else max(0, x - budget)
        assert got[i] == (x, level[p] - x)


def test_clamps_compose():
    rng = random.Random(4)
    for _ in range(500):
        steps = [(rng.randrange(-9, 9), *sorted((rng.randrange(-5, 20), rng.randrange(-5, 20)))) for _ in range(6)]
        whole = steps[0]
        for s in steps[1:]:
            whole = admission.composed(whole, s)
        for x in range(-3, 25):
            y = x
            for a, b, c in steps:
                y = min(max(y + a, b), c)
            assert y == min(max(x + whole[0], whole[1]), whole[2])


def simple_cycles(waits):
    """All simple cycles of more than one vehicle, by plain search."""
    out = set()

    def walk(path):
        for w in waits.get(path[-1], ()):
            if w == path[0] and len(path) > 1:
                at = path.index(min(path))
                out.add(tuple(path[at:] + path[:at]))
            elif w not in path:
                walk([*path, w])

    for v in waits:
        walk([v])
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_breaks_with_regrant_equal_one_at_a_time(spark, seed):
    """Random yards against a walk that recomputes waits, cycles and grants after each break."""
    rng = random.Random(seed)
    capacity, holds, asks = {}, [], []
    for y in range(12):
        for k in range(5):
            r = f"{y:02d}-{k}"
            capacity[r] = rng.choice([1, 1, 2])
            vs = rng.sample(range(y * 10, y * 10 + 6), 4)
            n = rng.randint(1, capacity[r])
            holds += [(r, v, rng.randint(1, 3)) for v in vs[:n]]
            asks += [(r, v, rng.randint(1, 3), rng.randrange(3), len(asks) + i) for i, v in enumerate(vs[n:])]
    want = []
    held, queue = {r: {} for r in capacity}, {r: [] for r in capacity}
    for r, v, p in holds:
        held[r][v] = p
    for r, v, p, at, seq in asks:
        queue[r].append((v, p, at, seq))
    while True:
        waits = {}
        for r in capacity:
            if len(held[r]) >= capacity[r]:
                for v, *_ in queue[r]:
                    waits.setdefault(v, set()).update(held[r])
        cycles = simple_cycles(waits)
        if not cycles:
            break
        rank = {v: max([h[v] for h in held.values() if v in h] + [p for q in queue.values() for w, p, *_ in q if w == v] + [0]) for v in cycles[0]}
        victim = min(cycles[0], key=lambda v: (rank[v], v))
        want.append((">".join(map(str, cycles[0])), victim, rank[victim]))
        for r in sorted(capacity):
            if held[r].pop(victim, None) is not None:
                queue[r].sort(key=lambda x: (-x[1], x[2], x[3], x[0]))
                while queue[r] and len(held[r]) < capacity[r]:
                    v, p, *_ = queue[r].pop(0)
                    held[r][v] = p
        for r in capacity:
            queue[r] = [x for x in queue[r] if x[0] != victim]
    got = yard.broken(
        spark.createDataFrame(list(capacity.items()), "resource string, capacity long"), spark.createDataFrame(holds, "resource string, vehicle long, priority long"),
        spark.createDataFrame(asks, "resource string, vehicle long, priority long, requested_ms long, seq long"),
    ).collect()
    assert sorted((r.cycle, r.victim, r.victim_priority) for r in got) == sorted(want) and want
    tasks = spark.createDataFrame([(v, f"T{v}", v % 2 == 0) for v in range(200)], "vehicle_id long, task_id string, open boolean")
    breaks = spark.createDataFrame(got)
    assert {r.task_id for r in yard.requeued(breaks, tasks).collect()} == {f"T{w[1]}" for w in want if w[1] % 2 == 0}


def test_merkle_finds_where_journals_part(spark):
    rows = [(i, f"k{i % 3}", None if i % 5 == 0 else i) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "seq long, kind string, at_ms long")
    tree = lambda d: compare.merkle(d, ["seq", "kind", "at_ms"], leaf=16, fan=4)
    shuffled = df.orderBy(F.rand(3)).repartition(7)
    assert compare.parting(tree(df), tree(shuffled)).count() == 0
    other = df.where("seq <> 100").withColumn("kind", F.when(F.col("seq") == 300, "z").otherwise(F.col("kind")))
    got = compare.parting(tree(df), tree(other)).collect()
    assert {r.node for r in got if r.level == 0} == {100 // 16, 300 // 16} and max(r.level for r in got) == 3 and all(r.side == "both" for r in got)
    assert tree(df.limit(0)).count() == 0
    (root,) = tree(df).where("level = 3").collect()
    assert (root.low, root.high, root.records) == (1, 399, 399)


def test_tree_diff_goes_to_the_leaves(spark):
    left = [(1, '{"a":{"b":[1,{"c":null}]},"d":"x"}'), (2, "[1]"), (3, None), (4, "no json"), (5, "7")]
    right = [(1, '{"a":{"b":[1,{"c":2}],"n":[]}}'), (2, '{"0":1}'), (3, None), (4, "no json"), (6, "8")]
    frames = [spark.createDataFrame(x, "id long, j string") for x in (left, right)]
    got = {(r.id, r.path): (r["left"], r["right"]) for r in compare.tree_diff(*frames, ["id"], "j").collect()}
    assert got == {(1, "$.a.b[1].c"): ("null", "2"), (1, "$.a.n"): (None, "[]"), (1, "$.d"): ('"x"', None), (2, "$[0]"): ("1", None), (2, "$.0"): (None, "1"), (5, "$"): ("7", None), (6, "$"): (None, "8")}


def test_a_changed_record_breaks_the_replay(spark, tmp_path):
    """What is read back gives the state that was written, and another one once a record differs."""
    empty = ", ".join(f"null as {f.name}" for f in S.PAYLOAD if f.name != "event")
    log = spark.createDataFrame([(i, "T1", e) for i, e in enumerate(["ASSIGN", "DISPATCH", "START", "COMPLETE"], 1)], "seq long, subject string, event string")
    io.append_journal(log.selectExpr("seq", "'task_event' as kind", "subject", "seq as at_ms", f"struct(event, {empty}) as payload", "'' as trace_id"), str(tmp_path / "j"))
    back = io.read_journal(spark, str(tmp_path / "j")).withColumn("event", F.col("payload.event"))
    state = lambda d: fsm.fold_fsm(d, ["subject"], F.col("seq"), F.col("event"), F.col("at_ms")).first().state
    assert state(back) == "COMPLETED" and state(back.withColumn("event", F.when(F.col("seq") == 3, "FAIL").otherwise(F.col("event")))) == "FAILED"


@pytest.mark.parametrize("seed", [1, 2])
def test_pressure_equals_a_walk(spark, seed):
    """Deepest queue and most that wait, over all resources, at every block of a random log."""
    rng = random.Random(seed)
    log = [(rng.randrange(4), i, i, rng.choice(["request"] * 4 + ["release", "release_resource"]), rng.randrange(7), rng.randint(1, 3)) for i in range(400)]
    held, queue, want = {r: set() for r in range(4)}, {r: [] for r in range(4)}, []
    for r, at, i, op, v, p in log:
        blocked = op == "request" and v not in held[r]
        if op == "request" and v not in held[r]:
            old = next((w for w in queue[r] if w[3] == v), None)
            queue[r] = [w for w in queue[r] if w[3] != v] + [(-p, *(old[1:3] if old else (at, i)), v)]
        elif op != "request":
            was, waited = v in held[r], op == "release_resource" and any(w[3] == v for w in queue[r])
            held[r].discard(v)
            queue[r] = [w for w in queue[r] if w[3] != v] if op == "release_resource" else queue[r]
            if not (was or waited):
                continue
        queue[r].sort()
        while queue[r] and len(held[r]) < 1 + r % 2:
            held[r].add(queue[r].pop(0)[3])
        if blocked and v not in held[r]:
            want.append((i, len(queue[r]), sum(map(len, queue.values()))))
    rows = spark.createDataFrame(log, "resource long, at_ms long, id long, op string, vehicle long, priority long")
    capacity = spark.createDataFrame([(r, 1 + r % 2) for r in range(4)], "resource long, capacity long")
    got = traffic.pressure(rows, capacity).where("blocked").orderBy("id").collect()
    assert [(x.id, x.depth, x.waiting) for x in got] == want and want


def test_cycles_of_single_waits(spark):
    """Doubling finds what a walk finds: cycles of any length, chains into them, chains that end, many at once."""
    rng = random.Random(6)
    waits = {v: rng.choice([w for w in range(300) if w != v]) for v in range(250)}
    waits |= {1000 + i: 1000 + (i + 1) % 37 for i in range(37)} | {2000: 2001, 2001: 2000}
    want = set()
    for v in waits:
        path = []
        while v in waits and v not in path:
            path.append(v)
            v = waits[v]
        if v in path:
            cycle = path[path.index(v) :]
            at = cycle.index(min(cycle))
            want.add(tuple(cycle[at:] + cycle[:at]))
    got = traffic.cycles(spark.createDataFrame(list(waits.items()), "waiter long, holder long")).collect()
    assert sorted(tuple(r.cycle) for r in got) == sorted(want) and len(want) >= 2


@pytest.mark.parametrize("documents", [None, 3])
@pytest.mark.parametrize("backend", ["memory", "redis"])
def test_store_dumps_round_trip(spark, tmp_path, documents, backend):
    rows = [("a", "string", "1", None, None), ("b", "hash", None, {"f": "x", "g": "y"}, 12_300), ("c", "string", "é", None, 11_000), ("gone", "string", "2", None, 10_000), ("none", None, None, None, None)]
    df = spark.createDataFrame(rows, "key string, kind string, value string, fields map<string,string>, expires_ms long")
    io.dump_store(df, str(tmp_path / "d"), 10_000, backend, "fleet:", documents)
    got = {r.key: (r.kind, r.value, r.fields, r.expires_ms) for r in io.load_store(spark, str(tmp_path / "d"), 500, "fleet:").collect()}
    left = 3_000 if backend == "redis" else 2_300
    assert got == {"a": ("string", "1", None, None), "b": ("hash", None, {"f": "x", "g": "y"}, 500 + left), "c": ("string", "é", None, 1_500)}
    assert [r.key for r in io.load_store(spark, str(tmp_path / "d"), 0, "fleet:", "hash").collect()] == ["b"]
    assert io.load_store(spark, str(tmp_path / "d"), 0, "other:").count() == 0
    if documents is None:
        plan = io.load_store(spark, str(tmp_path / "d"), 0, "fleet:", "hash")._jdf.queryExecution().toString()
        assert "StringStartsWith(key,fleet:)" in plan
    with pytest.raises(ValueError):
        io.dump_store(df, str(tmp_path / "d"), 0, "other")


def test_collectors_count_each_batch(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(10 * i + k, k % 2 == 0) for k in range(4 + i)], "id long, bad boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("id long, bad boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows, seen = collectors.collected(read, {"n": F.count("*"), "bad": F.count_if("bad")}, "collected")
    got = seen.orderBy("batch").collect()
    assert [r.batch for r in got] == [0, 1, 2] and sum(r.n for r in got) == rows.count() == 15 and sum(r.bad for r in got) == 8
    assert sorted(r.input_rows for r in got) == [4, 5, 6]


def test_running_tasks_of_a_plan_are_bounded(spark):
    """A plan looks at as many running tasks as there are vehicles, and picks the same victims as with all."""
    fleet = spark.createDataFrame([(v, 0.0, 0.0, 90.0, v != 3, "EXECUTING") for v in range(1, 6)], "vehicle_id long, vx double, vy double, battery double, online boolean, vstate string")
    tasks = spark.createDataFrame([(100 + i, 5, i, 1.0, 1.0) for i in range(9)], "task_id long, priority int, created_ms long, ox double, oy double")
    running = spark.createDataFrame([(i, 1 + i % 3, 50 * i, 0, 1 + i % 6) for i in range(60)], "task_id long, priority int, assigned_ms long, preempted int, vehicle_id long")
    got = [(r.step, r.victim) for r in dispatch.plan_greedy(tasks, fleet, running).orderBy("step").collect()]
    able = sorted((1 + i % 3, -50 * i, i) for i in range(60) if 1 + i % 6 in (1, 2, 4, 5))
    assert got == [(k + 1, t[2]) for k, t in enumerate(able[:5])]


def test_verdict_has_teeth(spark):
    """A copy with another record, a task that nobody created and a second end each break their scenario alone."""
    rows = [(f"task_{k}", f"{s}{t}", *more) for s in "ab" for t in range(2) for k, *more in (("created",), ("assigned", "V1"), ("event", None, "DISPATCH"), ("event", None, "START"), ("event", None, "COMPLETE"), ("created",))]
    log = records(spark, rows)
    copy = log.where("NOT (task_id = 'b1' AND event = 'COMPLETE')")
    fold, scenario = applier.fold_tasks, F.substring("task_id", 1, 1)
    got = {r.scenario: (r.created, r.duplicates, r.lost, r.open, r.most_ends, r.differing, r.consistent) for r in verify.verdicts(log, fold(log), fold(log), scenario).collect()}
    assert got == {"a": (4, 2, 0, 0, 1, 0, True), "b": (4, 2, 0, 0, 1, 0, True), None: (8, 4, 0, 0, 1, 0, True)}
    got = {r.scenario: (r.differing, r.consistent) for r in verify.verdicts(log, fold(log), fold(copy), scenario).collect()}
    assert got == {"a": (0, True), "b": (1, False), None: (1, False)}
    got = {r.scenario: (r.lost, r.consistent) for r in verify.verdicts(log.where("task_id <> 'a0'"), fold(log), fold(log), scenario).collect()}
    assert got == {"a": (1, False), "b": (0, True), None: (1, False)}
