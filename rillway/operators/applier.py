"""The applier: what a journal of seven kinds of records makes of tasks, vehicles and commands.

Task state never depends on vehicle state, so a journal is replayed in two keyed folds. The first goes through
each task's records, assigns and frees its vehicle, and says at each accepted record which vehicle it concerns.
The second goes through what concerns each vehicle, from tasks and from the vehicle itself, in the journal's
order. Commands are records of the first fold: whether one took effect is what the fold says of its event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.functions.folds import gathering_fold
from rillway.functions.scalars import literal_map
from rillway.operators.fsm import move

STEP = "struct<seq:bigint,at_ms:bigint,kind:string,event:string,vehicle_id:string,command:string,from_state:string,to_state:string,accepted:boolean,outcome:string>"
VEHICLE = "vehicle_id string, state string, online boolean, payload string, tasks_completed long, pause_commands long, resume_commands long, offline_events long, reconnects long, accepted long, rejected long"
VEHICLE_TABLE = {(a, e): t for a, e, t in S.VEHICLE_MOVES}


def fold_tasks(records: DataFrame) -> DataFrame:
    """(task_id, present, state, vehicle_id, preempted, steps) from ``records``: seq, kind, task_id, vehicle_id,
    event, command, at_ms, of which those whose kind begins with task, and commands, are read.

    The first task_created makes the task, later ones change nothing. Records of a task that is not there yet are
    dropped; a command to it fails. An assignment binds the vehicle it names; task_requeued frees the vehicle
    it names or else the one assigned, as do COMPLETE, CANCEL, FAIL and REQUEUE. A command, told apart by its
    event and id, is applied if its event is accepted and unconfirmed if not, and then may be sent again; one
    that was applied makes all later ones duplicates, which do nothing. vehicle_id of a step is the vehicle that
    it concerns, empty if none; null vehicles and commands are empty. One task's records must fit a row.
    """
    table = literal_map({f"{a}|{e}": t for a, e, t in S.TASK_MOVES})
    words = F.expr("cast(array() as array<string>)")
    text = F.lit("")
    start = {"present": F.lit(False), "state": F.lit("PENDING"), "pause": words, "queue": words, "vehicle": text, "preempted": F.lit(0).cast("long"), "done": words}

    def step(acc: Column, x: Column) -> Column:
        kind = x["kind"]
        created, assigned, requeued, command = (kind == k for k in ("task_created", "task_assigned", "task_requeued", "command"))
        event = F.when(assigned, "ASSIGN").when(requeued, "REQUEUE").otherwise(x["event"])
        name = F.concat(event, F.lit(":"), x["command"])
        again = command & F.array_contains(acc["done"], name)
        raw = F.when(acc["present"] & ~created & ~again, table[F.concat(acc["state"], F.lit("|"), event)])
        to = F.when(raw == S.RESUME, F.try_element_at(acc["pause"], F.lit(-1))).when(raw == S.QUEUE, F.try_element_at(acc["queue"], F.lit(-1))).otherwise(raw)
        ok = to.isNotNull()

        def stack(name: str, push: str, pop: str) -> Column:
            s = acc[name]
            popped = F.when(F.size(s) > 0, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)
            return F.when(~ok, s).when(event == push, F.concat(s, F.array(acc["state"]))).when(event == pop, popped).when(event == "REQUEUE", words).otherwise(s)

        about = F.when(assigned | (requeued & (x["vehicle_id"] != "")), x["vehicle_id"]).otherwise(acc["vehicle"])
        held = F.when(~ok, acc["vehicle"]).when(assigned, x["vehicle_id"]).when(event.isin(*S.FREES), text).otherwise(acc["vehicle"])
        outcome = F.when(~command, text).when(~acc["present"], "failed").when(again, "duplicate").when(ok, "applied").otherwise("unconfirmed")
        made = F.struct(x["seq"].alias("seq"), x["at_ms"].alias("at_ms"), kind.alias("kind"), event.alias("event"), F.when(ok, about).otherwise(text).alias("vehicle_id"), x["command"].alias("command"), acc["state"].alias("from_state"), F.coalesce(to, acc["state"]).alias("to_state"), (ok | (created & ~acc["present"])).alias("accepted"), outcome.alias("outcome"))
        return F.struct(
            (acc["present"] | created).alias("present"), F.coalesce(to, acc["state"]).alias("state"), stack("pause", "PAUSE", "RECOVER").alias("pause"), stack("queue", "ENQUEUE", "PROCEED").alias("queue"), held.alias("vehicle"),
            (acc["preempted"] + (ok & requeued).cast("long")).alias("preempted"), F.when(command & ok, F.concat(acc["done"], F.array(name))).otherwise(acc["done"]).alias("done"), F.concat(acc["steps"], F.array(made)).alias("steps"),
        )

    read = F.struct(F.col("seq").cast("long").alias("seq"), "kind", F.coalesce("vehicle_id", text).alias("vehicle_id"), "event", F.coalesce("command", text).alias("command"), F.col("at_ms").cast("long").alias("at_ms"))
    log = records.where(F.col("kind").startswith("task_") | (F.col("kind") == "command")).groupBy("task_id").agg(F.array_sort(F.collect_list(read)).alias("log"))
    s = log.select("task_id", gathering_fold(F.col("log"), start, "steps", STEP, step).alias("s"))
    return s.select("task_id", F.col("s.present").alias("present"), F.col("s.state").alias("state"), F.col("s.vehicle").alias("vehicle_id"), F.col("s.preempted").alias("preempted"), F.col("s.steps").alias("steps"))


def task_steps(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", F.explode("steps").alias("x")).select("task_id", "x.*")


def task_rows(tasks: DataFrame) -> DataFrame:
    """One row per task that is there, with its times and what they come to.

    assigned_ms is that of the latest assignment, started_ms of the first START, finished_ms of the latest end, 0
    where there was none; dispatch_ms, cycle_ms and service_ms are null where one of their ends is 0. transitions
    counts what the task's states accepted."""
    moved = lambda *e: F.filter("steps", lambda x: x["accepted"] & x["event"].isin(*e))
    at = lambda steps, i: F.coalesce(F.try_element_at(steps, F.lit(i))["at_ms"], F.lit(0))
    made = F.filter("steps", lambda x: (x["kind"] == "task_created") & x["accepted"])
    taken = F.filter("steps", lambda x: x["accepted"] & (x["kind"] != "task_created"))
    rows = tasks.where("present").select(
        "task_id", "state", F.col("vehicle_id").alias("assigned_vehicle"), "preempted", at(made, 1).alias("created_ms"), at(moved("ASSIGN"), -1).alias("assigned_ms"), at(moved("START"), 1).alias("started_ms"),
        at(moved("COMPLETE", "CANCEL", "FAIL"), -1).alias("finished_ms"), F.size(taken).cast("long").alias("transitions"),
    )
    between = lambda a, b, *needed: F.when(F.greatest(*(F.col(c) == 0 for c in needed), F.lit(False)), None).otherwise(F.col(b) - F.col(a))
    return rows.withColumns({"dispatch_ms": between("created_ms", "assigned_ms", "assigned_ms"), "cycle_ms": between("created_ms", "finished_ms", "finished_ms"), "service_ms": between("assigned_ms", "finished_ms", "assigned_ms", "finished_ms")})


def vehicle_records(tasks: DataFrame, records: DataFrame) -> DataFrame:
    """(vehicle_id, seq, kind, event, task_id): all that concerns vehicles, in the kinds that ``fold_vehicles`` reads."""
    made = task_steps(tasks).where("accepted AND vehicle_id <> ''").select("vehicle_id", "seq", F.when(F.col("kind") == "command", "task_event").otherwise(F.col("kind")).alias("kind"), "event", "task_id")
    own = records.where(F.col("kind").startswith("vehicle_")).select("vehicle_id", F.col("seq").cast("long").alias("seq"), "kind", "event", F.lit("").alias("task_id"))
    return made.unionByName(own)


def fold_vehicles(log: DataFrame) -> DataFrame:
    """The vehicles of ``vehicle_records``, one row each, IDLE, online and empty before their first record.

    An accepted ASSIGN loads the task. What frees the vehicle unloads it, and COMPLETE, PAUSE and RESUME are
    counted, whether or not the vehicle accepts the event. vehicle_offline and vehicle_online do nothing to a
    vehicle that is so already. Logs stream through in order, one vehicle after another, and hold one state.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, v = None, None
        for batch in batches:
            out = []
            for vehicle, _, kind, event, task in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v is None or vehicle != now:
                    if v is not None:
                        out.append(v.row(now))
                    now, v = vehicle, _Vehicle()
                v.apply(kind, event, task)
            yield _rows(out)
        if v is not None:
            yield _rows([v.row(now)])

    rows = log.select("vehicle_id", "seq", "kind", "event", "task_id")
    return rows.repartition("vehicle_id").sortWithinPartitions("vehicle_id", "seq").mapInArrow(run, VEHICLE)


class _Vehicle:
    def __init__(self) -> None:
        self.state, self.pause, self.queue, self.online, self.payload = "IDLE", [], [], True, ""
        self.counts = dict.fromkeys(("completed", "paused", "resumed", "offline", "reconnects", "accepted", "rejected"), 0)

    def move(self, event: str | None) -> bool:
        self.state, self.pause, self.queue, ok = move(self.state, self.pause, self.queue, event, VEHICLE_TABLE)
        self.counts["accepted" if ok else "rejected"] += 1
        return ok

    def apply(self, kind: str, event: str | None, task: str) -> None:
        if kind == "task_assigned":
            self.payload = task if self.move("ASSIGN") else self.payload
        elif kind in ("vehicle_offline", "vehicle_online"):
            if self.online == (kind == "vehicle_offline"):
                self.online = not self.online
                self.counts["reconnects" if self.online else "offline"] += 1
                self.move("ONLINE" if self.online else "HEARTBEAT_TIMEOUT")
        elif kind == "vehicle_event":
            self.move(event)
        elif event != "ASSIGN" and event in S.TASK_TO_VEHICLE:
            self.move(S.TASK_TO_VEHICLE[event])
            counted = {"COMPLETE": "completed", "PAUSE": "paused", "RESUME": "resumed"}.get(event)
            if counted:
                self.counts[counted] += 1
            if event in S.FREES:
                self.payload = ""

    def row(self, vehicle: str | None) -> tuple:
        return (vehicle, self.state, self.online, self.payload, *self.counts.values())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 7]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in VEHICLE.split(", ")])


def command_effects(tasks: DataFrame) -> DataFrame:
    """(task_id, event, command, sent, applied, duplicate, unconfirmed, failed) per command."""
    sent = task_steps(tasks).where("kind = 'command'")
    each = (F.count_if(F.col("outcome") == o).alias(o) for o in ("applied", "duplicate", "unconfirmed", "failed"))
    return sent.groupBy("task_id", "event", "command").agg(F.count("*").alias("sent"), *each)
