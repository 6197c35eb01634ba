"""Seeded fleets, tasks and fault plans, as DataFrames.

Draws come from hashes of the seed and the row, so any number of executors makes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.functions.scalars import padded_id, stable_hash

#: Shares of the priorities 1 to 5, in hundredths.
PRIORITY_SHARES = (10, 45, 25, 15, 5)


def draw(seed: int, *what: Column | str) -> Column:
    """Uniform in [0, 1): the stable hash of the seed and the values, which other engines can work out as well."""
    name = F.concat_ws(":", F.lit(str(seed)), *(F.col(w).cast("string") if isinstance(w, str) else w.cast("string") for w in what))
    return (stable_hash(name) % F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def fleet(spark: SparkSession, count: int) -> DataFrame:
    """Vehicles dealt to hubs in turn, 12 metres further out in x and y each lap."""
    hubs = F.array(*(F.struct(F.lit(h).alias("hub"), F.lit(x).alias("x"), F.lit(y).alias("y")) for h, x, y in S.HUBS))
    i = F.col("id")
    at = F.get(hubs, (i % len(S.HUBS)).cast("int"))
    return spark.range(count).select(padded_id("AGV-", i + 1, 2).alias("vehicle_id"), at["hub"].alias("hub"), (at["x"] + 12.0 * F.floor(i / len(S.HUBS))).alias("x"), (at["y"] + 12.0 * F.floor(i / len(S.HUBS))).alias("y"), (100.0 - 3.0 * (i % 5)).alias("battery"))


def _hops() -> list[tuple[str, str, int]]:
    """Roads on the way between every two hubs, at least 1: on this grid the shortest way has the fewest."""
    near = {h: {b for a, b in [*S.ROADS, *[(b, a) for a, b in S.ROADS]] if a == h} for h, _, _ in S.HUBS}
    out = []
    for h in near:
        seen, edge, n = {h}, {h}, 0
        while edge:
            edge, n = {b for a in edge for b in near[a]} - seen, n + 1
            seen |= edge
            out += [(h, b, n) for b in sorted(edge)]
    return out


def tasks(spark: SparkSession, count: int, seed: int, interval_ms: int = 1000) -> DataFrame:
    """Tasks between two different hubs with weighted priorities, loads and deadlines."""
    n = len(S.HUBS)
    names = F.array(*(F.lit(h) for h, _, _ in S.HUBS))
    start = F.floor(draw(seed, "id", F.lit("o")) * n).cast("int")
    goal = ((start + 1 + F.floor(draw(seed, "id", F.lit("d")) * (n - 1))) % n).cast("int")
    level, edge, at = F.lit(5), 0, draw(seed, "id", F.lit("p")) * 100
    for i, share in reversed(list(enumerate(PRIORITY_SHARES))):
        edge = sum(PRIORITY_SHARES[: i + 1])
        level = F.when(at < edge, F.lit(i + 1)).otherwise(level)
    created = F.col("id") * interval_ms
    hops = {(a, b): n for a, b, n in _hops()}
    legs = F.create_map(*(F.lit(v) for (a, b), n in hops.items() for v in (f"{a}>{b}", n)))[F.concat(F.get(names, start), F.lit(">"), F.get(names, goal))]
    return spark.range(count).select(
        padded_id("T", F.col("id") + 1).alias("task_id"), F.get(names, start).alias("origin_hub"), F.get(names, goal).alias("destination_hub"), level.alias("priority"),
        (50.0 + 1750.0 * draw(seed, "id", F.lit("w"))).alias("payload_kg"), created.alias("created_ms"), (created + ((120_000 + 90_000 * legs) * (1.6 + 1.6 * draw(seed, "id", F.lit("t")))).cast("long")).alias("deadline_ms"),
    )


def perturbed(messages: DataFrame, seed: int, duplicate: float = 0.0, drop: float = 0.0, window: int = 1) -> DataFrame:
    """Faults at the point of delivery: copies, late arrivals within a window, losses. The log stays intact."""
    twice = messages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(draw(seed, "msg_id", F.lit("dup")) < duplicate, 1).otherwise(0))))
    kept = twice.where(draw(seed, "msg_id", "copy", F.lit("drop")) >= drop)
    return kept.withColumn("arrival", F.col("offset") + F.floor(draw(seed, "msg_id", "copy", F.lit("late")) * window))


def failing(messages: DataFrame, seed: int, rate: float, poison: list[str] | None = None) -> Column:
    """Does the handler fail? Poisoned ids always do."""
    return F.col("msg_id").isin(poison or []) | (draw(seed, "msg_id", "attempt") < rate)


def scenarios(spark: SparkSession) -> DataFrame:
    """The six standard scenarios: vehicles, tasks and what is switched on."""
    rows = [("baseline", 12, 50, "none"), ("overload", 6, 70, "burst, lag limit"), ("fault-injection", 10, 50, "duplicate, reorder, drop, crash, timeout, poison"), ("deadlock", 10, 50, "hold and wait"), ("cache-expiry", 12, 50, "expiry"), ("offline-recovery", 12, 50, "outages")]
    return spark.createDataFrame(rows, "scenario string, vehicles int, tasks int, faults string")
