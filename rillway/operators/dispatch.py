"""Dispatch: eligibility, scores, best vehicle, victims and the sequential greedy plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.functions.scalars import distance, score


def dispatchable(floor: float = S.BATTERY_FLOOR) -> Column:
    return F.col("online") & (F.col("vstate") == "IDLE") & (F.col("battery") >= floor)


def candidates(tasks: DataFrame, vehicles: DataFrame, weights: dict[str, float] | None = None, floor: float = S.BATTERY_FLOOR) -> DataFrame:
    """Every pending task with every eligible vehicle. The pairing is the operator's meaning; what it takes
    as tasks is a planning round, and vehicles are one fleet, so callers keep both small."""
    free = vehicles.where(dispatchable(floor))
    pairs = tasks.join(free, F.col("battery") >= floor, "inner")
    far = distance(F.col("vx"), F.col("vy"), F.col("ox"), F.col("oy"))
    return pairs.withColumn("distance", far).withColumn("score", score(F.col("priority"), F.lit(1), F.col("battery"), F.col("distance"), F.lit(0.0), weights or {}))


def best_vehicle(tasks: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Top candidate per task without pairing them all: priority, idle and aging terms are equal for one
    task, so per origin hub the order of vehicles is fixed and one arg-min per hub serves all its tasks."""
    origins = tasks.select("ox", "oy").distinct()
    free = vehicles.where(dispatchable())
    value = 0.5 * F.col("battery") - distance(F.col("vx"), F.col("vy"), F.col("ox"), F.col("oy"))
    per = free.join(origins, F.lit(True)).groupBy("ox", "oy").agg(F.min_by(F.struct("vehicle_id", value.alias("value")), F.struct((-value).alias("a"), F.col("vehicle_id").alias("b"))).alias("v"), F.count("*").alias("n"))
    return tasks.join(per, ["ox", "oy"]).select("task_id", F.col("v.vehicle_id").alias("vehicle_id"), (1000.0 * F.col("priority") + 50.0 + F.col("v.value")).alias("score"), F.col("n").alias("candidates"))


def pending_order() -> list[Column]:
    return [F.col("priority").desc(), F.col("created_ms").asc(), F.col("task_id").asc()]


def victims(requests: DataFrame, running: DataFrame, most: int = S.PREEMPT_MOST) -> DataFrame:
    """Per urgent request the running task to give way: least priority, then latest assigned, then least id.

    The choice depends on the request's priority alone, so it is made once per priority class.
    """
    classes = requests.where(F.col("priority") >= S.PREEMPT_FROM).select(F.col("priority").alias("rp")).distinct()
    met = classes.join(running.where(F.col("online") & (F.col("preempted") < most)), F.col("priority") < F.col("rp"))
    pick = met.groupBy("rp").agg(F.min(F.struct("priority", (-F.col("assigned_ms")).alias("late"), "task_id", "vehicle_id")).alias("v"))
    return requests.join(pick, F.col("priority") == F.col("rp")).select("task_id", F.col("v.task_id").alias("victim"), F.col("v.vehicle_id").alias("vehicle_id"))


PLAN = "step long, task_id long, vehicle_id long, score double, victim long"


def plan_greedy(tasks: DataFrame, vehicles: DataFrame, running: DataFrame | None = None, most: int = S.PREEMPT_MOST) -> DataFrame:
    """One planning round: (step, task, vehicle, score, victim). Tasks in pending order each take the best
    free vehicle left; without one, an urgent task takes that of the running task of least priority, latest
    assigned, then least id. The first task that finds neither ends the round.

    ``running`` has task_id, priority, assigned_ms, preempted, vehicle_id. Sequential by meaning: a round plans
    at most one task per vehicle, so one task reads the first of these, the fleet, and of the running tasks, as many
    as there are vehicles at most, those that would give way first. Vehicles are put in order
    once per place of origin, and a pointer per place skips those taken; no task is paired with all vehicles.
    """
    fleet = vehicles.count()
    first = tasks.orderBy(*pending_order()).limit(fleet)
    none = lambda kind: F.lit(None).cast(kind)
    asks = first.select(F.lit("task").alias("kind"), F.col("task_id").cast("long").alias("id"), F.col("priority").cast("long").alias("priority"), F.col("created_ms").cast("long").alias("ms"), F.col("ox").cast("double").alias("x"), F.col("oy").cast("double").alias("y"), none("double").alias("battery"), none("long").alias("vehicle"))
    own = vehicles.select(F.when(dispatchable(), "free").when(F.col("online"), "busy").alias("kind"), F.col("vehicle_id").cast("long").alias("id"), none("long"), none("long"), F.col("vx").cast("double"), F.col("vy").cast("double"), F.col("battery").cast("double"), none("long")).where("kind IS NOT NULL")
    every = asks.union(own)
    if running is not None:
        online = vehicles.where("online").select("vehicle_id")
        able = running.where(F.col("preempted") < most).join(online, "vehicle_id", "left_semi")
        every = every.union(able.orderBy("priority", F.desc("assigned_ms"), "task_id").limit(fleet).select(F.lit("running"), F.col("task_id").cast("long"), F.col("priority").cast("long"), F.col("assigned_ms").cast("long"), none("double"), none("double"), none("double"), F.col("vehicle_id").cast("long")))

    def run(table: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("task", "free", "busy", "running")}
        for r in table.to_pylist():
            rows[r["kind"]].append(r)
        at = {v["id"]: v for v in (*rows["free"], *rows["busy"])}
        far = lambda v, t: ((v["x"] - t["x"]) ** 2 + (v["y"] - t["y"]) ** 2) ** 0.5
        left = sorted((r for r in rows["running"] if r["vehicle"] in at), key=lambda r: (r["priority"], -r["ms"], r["id"]))
        orders, taken, out = {}, set(), []
        for t in sorted(rows["task"], key=lambda t: (-t["priority"], t["ms"], t["id"])):
            place = (t["x"], t["y"])
            if place not in orders:
                orders[place] = iter(sorted(rows["free"], key=lambda v: (far(v, t) - 0.5 * v["battery"], v["id"])))
            vehicle = next((v for v in orders[place] if v["id"] not in taken), None)
            victim, idle = None, S.WEIGHTS["idle"]
            if vehicle is None and t["priority"] >= S.PREEMPT_FROM and left and left[0]["priority"] < t["priority"]:
                victim, idle = left.pop(0), 0.0
                vehicle = at[victim["vehicle"]]
                idle = S.WEIGHTS["idle"] if vehicle["kind"] == "free" else 0.0
            if vehicle is None:
                break
            taken.add(vehicle["id"])
            value = S.WEIGHTS["priority"] * t["priority"] + idle + S.WEIGHTS["battery"] * vehicle["battery"] - S.WEIGHTS["distance"] * far(vehicle, t)
            out.append((len(out) + 1, t["id"], vehicle["id"], value, victim and victim["id"]))
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["step", "task_id", "vehicle_id", "score", "victim"])

    return every.groupBy().applyInArrow(run, PLAN)
