"""Ordered folds of state machines with two stacks, as Catalyst expressions.

One subject's events are gathered, sorted and folded by ``aggregate``; no Python runs. The fold keeps the
state, both stacks and one step per event, accepted or not, so histories, rejections and counts are all
read from the same pass. Subjects whose logs do not fit a row go through ``fold_long``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.functions.folds import gathering_fold
from rillway.functions.scalars import literal_map

STEP = "struct<n:bigint,order:bigint,at_ms:bigint,event:string,from_state:string,to_state:string,accepted:boolean>"


def fold_fsm(events: DataFrame, key: list[str], order: Column, event: Column, at_ms: Column, moves: list[tuple[str, str, str]] = S.TASK_MOVES, initial: str = "PENDING") -> DataFrame:
    """(key..., state, pause_stack, queue_stack, steps). Illegal events, and PROCEED or RECOVER on an empty
    stack, change nothing and leave a step with accepted = false."""
    table = literal_map({f"{a}|{e}": t for a, e, t in moves})
    nothing = F.expr("cast(array() as array<string>)")
    start = {"state": F.lit(initial), "pause": nothing, "queue": nothing, "n": F.lit(0).cast("long")}

    def step(acc: Column, x: Column) -> Column:
        raw = table[F.concat(acc["state"], F.lit("|"), x["event"])]
        to = F.when(raw == S.RESUME, F.try_element_at(acc["pause"], F.lit(-1))).when(raw == S.QUEUE, F.try_element_at(acc["queue"], F.lit(-1))).otherwise(raw)
        ok = to.isNotNull()

        def stack(name: str, push: str, pop: str) -> Column:
            s = acc[name]
            popped = F.when(F.size(s) > 0, F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)
            return F.when(~ok, s).when(x["event"] == push, F.concat(s, F.array(acc["state"]))).when(x["event"] == pop, popped).when(x["event"] == "REQUEUE", nothing).otherwise(s)

        made = F.struct((acc["n"] + 1).alias("n"), x["order"].alias("order"), x["at_ms"].alias("at_ms"), x["event"].alias("event"), acc["state"].alias("from_state"), F.coalesce(to, acc["state"]).alias("to_state"), ok.alias("accepted"))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), stack("pause", "PAUSE", "RECOVER").alias("pause"), stack("queue", "ENQUEUE", "PROCEED").alias("queue"), (acc["n"] + 1).alias("n"), F.concat(acc["steps"], F.array(made)).alias("steps"))

    log = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order.cast("long").alias("order"), event.alias("event"), at_ms.cast("long").alias("at_ms")))).alias("log"))
    folded = log.select(*key, gathering_fold(F.col("log"), start, "steps", STEP, step).alias("s"))
    return folded.select(*key, F.col("s.state").alias("state"), F.col("s.pause").alias("pause_stack"), F.col("s.queue").alias("queue_stack"), F.col("s.steps").alias("steps"))


def fold_long(events: DataFrame, key: str, order: Column, event: Column, moves: list[tuple[str, str, str]] = S.TASK_MOVES, initial: str = "PENDING") -> DataFrame:
    """(key, state, accepted, rejected) for subjects of any number of events, with the moves of ``fold_fsm``.

    Logs stream through in order, one subject after another; only a state and its two stacks are held.
    """
    table = {(a, e): t for a, e, t in moves}
    rows = events.select(F.col(key).cast("string").alias("key"), order.cast("long").alias("order"), event.alias("event"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, pause, queue, n = None, initial, [], [], [0, 0]
        for batch in batches:
            out = []
            for subject, e in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (subject,) != now:
                    if now is not None:
                        out.append((now[0], state, *n))
                    now, state, pause, queue, n = (subject,), initial, [], [], [0, 0]
                state, pause, queue, ok = move(state, pause, queue, e, table)
                n[not ok] += 1
            yield _ends(out)
        if now is not None:
            yield _ends([(now[0], state, *n)])

    done = rows.repartition("key").sortWithinPartitions("key", "order", "event").mapInArrow(run, "key string, state string, accepted long, rejected long")
    return done.withColumnRenamed("key", key)


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "state", "accepted", "rejected"])


def move(state: str, pause: list[str], queue: list[str], event: str, table: dict) -> tuple[str, list[str], list[str], bool]:
    """One step: (state, pause stack, queue stack, was the event accepted)."""
    to = table.get((state, event))
    to = (pause[-1] if pause else None) if to == S.RESUME else (queue[-1] if queue else None) if to == S.QUEUE else to
    if to is None:
        return state, pause, queue, False
    pause = [*pause, state] if event == "PAUSE" else pause[:-1] if event == "RECOVER" else [] if event == "REQUEUE" else pause
    queue = [*queue, state] if event == "ENQUEUE" else queue[:-1] if event == "PROCEED" else [] if event == "REQUEUE" else queue
    return to, pause, queue, True


def steps(folded: DataFrame, key: list[str]) -> DataFrame:
    return folded.select(*key, F.explode("steps").alias("x")).select(*key, "x.*")


def timings(folded: DataFrame, key: list[str]) -> DataFrame:
    """First event seen, last ASSIGN, first START, last end among accepted events; null where unset."""
    ok = lambda *e: F.filter("steps", lambda x: x["accepted"] & x["event"].isin(*e))
    at = lambda a, i: F.try_element_at(a, F.lit(i))["at_ms"]
    return folded.select(*key, "state", at(F.col("steps"), 1).alias("created_ms"), at(ok("ASSIGN"), -1).alias("assigned_ms"), at(ok("START"), 1).alias("started_ms"), at(ok("COMPLETE", "CANCEL", "FAIL"), -1).alias("finished_ms"))


def state_json(folded: DataFrame, key: list[str]) -> DataFrame:
    """(key..., body): what a subject's lifecycle has come to, as a JSON object."""
    body = F.to_json(F.struct("state", F.size("pause_stack").alias("paused"), F.size("queue_stack").alias("queued"), F.size(F.filter("steps", lambda x: x["accepted"])).alias("accepted")))
    return folded.select(*key, body.alias("body"))


def derived_vehicle_events(folded: DataFrame, key: list[str], vehicle: Column) -> DataFrame:
    """What accepted task events mean for the vehicle: the second of the two folds of a replay."""
    mapped = literal_map(S.TASK_TO_VEHICLE)
    return steps(folded, key).where("accepted").select("order", vehicle.alias("vehicle_id"), mapped[F.col("event")].alias("event"), "at_ms").where("event IS NOT NULL")
