"""Deadlocks broken with regrant: freed slots go to the next waiter, which changes who waits for whom.

Vehicles and resources that are linked, by a hold or a request, make a yard. What happens in one yard touches no
other, so yards are told apart by their components and each is worked off in one task, one break after another.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.operators.cut import cut

BREAKS = "yard string, turn long, cycle string, victim long, victim_priority long, freed string, promoted string"


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id that each end of ``edges`` (a, b) is linked with, directly or over others. Labels
    fall to the least of the neighbours' and then to the label of that label, so rounds are few."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("low"))
        met = label.join(near, F.col("id") == F.col("a")).select("id", F.least("label", "low").alias("low"), F.col("label").alias("old"))
        jump = met.alias("x").join(met.select(F.col("id").alias("at"), F.col("low").alias("next")).alias("y"), F.col("x.low") == F.col("y.at"))
        now = cut(jump.select("x.id", F.least("x.low", "y.next").alias("label"), "x.old"))
        if now.where("label <> old").isEmpty():
            return now.select("id", "label")
        label = now.select("id", "label")


def first_cycle(waits: dict[int, list[int]]) -> list[int]:
    """The first of all simple cycles of more than one vehicle, each begun at its least vehicle, in the order of
    their lists; empty if there is none. Neighbours are tried in order, and only while they can lead back."""
    for start in sorted(waits):
        back, grown = {start}, True
        while grown:
            grown = False
            for v, to in waits.items():
                if v > start and v not in back and any(w in back for w in to):
                    back.add(v)
                    grown = True
        path, tries = [start], [iter(sorted(waits[start]))]
        while tries:
            for w in tries[-1]:
                if w > start and w in back and w not in path:
                    path.append(w)
                    if start in waits.get(w, ()):
                        return path
                    tries.append(iter(sorted(waits.get(w, ()))))
                    break
            else:
                tries.pop()
                path.pop()
    return []


class Yard:
    """Holders and queues of one yard: resource -> vehicle -> priority, and resource -> requests in order."""

    def __init__(self, capacity: dict[str, int], holds: list[tuple[str, int, int]], requests: list[tuple[str, int, int, int, int]]) -> None:
        self.capacity, self.holders, self.queue = capacity, {r: {} for r in capacity}, {r: [] for r in capacity}
        for r, v, priority in holds:
            self.holders[r][v] = priority
        for r, v, priority, at, seq in requests:
            self.queue[r].append((-priority, at, seq, v))
        for q in self.queue.values():
            q.sort()

    def waits(self) -> dict[int, list[int]]:
        """Who waits for whom: for the holders of a full resource, unless one holds it oneself."""
        out: dict[int, set[int]] = {}
        for r, q in self.queue.items():
            if len(self.holders[r]) >= self.capacity[r]:
                for *_, v in q:
                    if v not in self.holders[r]:
                        out.setdefault(v, set()).update(self.holders[r])
        return {v: sorted(to) for v, to in out.items()}

    def priority(self, vehicle: int) -> int:
        held = [h[vehicle] for h in self.holders.values() if vehicle in h]
        return max([0, *held, *(-p for q in self.queue.values() for p, _, _, v in q if v == vehicle)])

    def release_all(self, vehicle: int) -> tuple[list[str], list[str]]:
        """(what is freed, who is promoted where)."""
        freed, promoted = [], []
        for r in sorted(self.holders):
            if self.holders[r].pop(vehicle, None) is not None:
                freed.append(r)
                while self.queue[r] and len(self.holders[r]) < self.capacity[r]:
                    p, _, _, v = self.queue[r].pop(0)
                    self.holders[r][v] = -p
                    promoted.append(f"{r}>{v}")
        for r in sorted(self.queue):
            kept = [x for x in self.queue[r] if x[3] != vehicle]
            if len(kept) < len(self.queue[r]):
                self.queue[r] = kept
                freed.append(f"queue:{r}")
        return sorted(freed), promoted

    def breaks(self) -> list[tuple]:
        out = []
        while cycle := first_cycle(self.waits()):
            victim = min(cycle, key=lambda v: (self.priority(v), v))
            row = (">".join(map(str, cycle)), victim, self.priority(victim))
            freed, promoted = self.release_all(victim)
            out.append((len(out) + 1, *row, ",".join(freed), ",".join(promoted)))
        return out


def broken(resources: DataFrame, holders: DataFrame, requests: DataFrame) -> DataFrame:
    """The breaks (yard, turn, cycle, victim, victim_priority, freed, promoted) until no vehicle waits in a circle.

    ``resources`` has resource and capacity, ``holders`` resource, vehicle and priority, ``requests`` also
    requested_ms and seq. The victim is the vehicle of least priority, then least id, of the first cycle; it loses
    its holds and requests, and each freed slot goes to the first in its queue: by priority, then time, sequence
    and vehicle. A victim's task goes back to be planned: ``requeued``. A yard is named by the least of its
    members; one yard's holds and requests are held in one task.
    """
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    held = holders.select(F.col("resource").cast("string"), F.col("vehicle").cast("long"), F.col("priority").cast("long"), F.lit(None).cast("long").alias("requested_ms"), F.lit(None).cast("long").alias("seq"))
    asked = requests.select(F.col("resource").cast("string"), F.col("vehicle").cast("long"), F.col("priority").cast("long"), F.col("requested_ms").cast("long"), F.col("seq").cast("long"))
    rows = cut(held.withColumn("holds", F.lit(True)).unionByName(asked.withColumn("holds", F.lit(False))).join(resources.select(F.col("resource").cast("string"), F.col("capacity").cast("long")), "resource"))
    yards = components(rows.select(name("r", "resource").alias("a"), name("v", "vehicle").alias("b")))
    met = rows.join(yards, name("v", "vehicle") == F.col("id")).select(F.col("label").alias("yard"), "resource", "vehicle", "priority", "requested_ms", "seq", "holds", "capacity")
    # nobody waits in a circle where nobody holds and waits
    both = met.groupBy("yard", "vehicle").agg(F.count_if("holds").alias("h"), F.count_if(~F.col("holds")).alias("w")).where("h > 0 AND w > 0").groupBy("yard").count().where("count > 1")

    def work(group: pa.Table) -> pa.Table:
        r = group.to_pylist()
        yard = Yard({x["resource"]: x["capacity"] for x in r}, [(x["resource"], x["vehicle"], x["priority"]) for x in r if x["holds"]], [(x["resource"], x["vehicle"], x["priority"], x["requested_ms"], x["seq"]) for x in r if not x["holds"]])
        cols = list(zip(*((r[0]["yard"], *b) for b in yard.breaks()), strict=True)) or [()] * 7
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(BREAKS.split(", "), cols, types, strict=True)})

    return met.join(both.select("yard"), "yard", "left_semi").groupBy("yard").applyInArrow(work, BREAKS)


def requeued(breaks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, vehicle_id, note): the open task of each victim, least id, which is to be planned again. ``tasks``
    has task_id, vehicle_id and open."""
    least = tasks.where("open").groupBy(F.col("vehicle_id").cast("long").alias("vehicle_id")).agg(F.min("task_id").alias("task_id"))
    victims = breaks.select(F.col("victim").alias("vehicle_id")).distinct()
    return victims.join(least, "vehicle_id").select("task_id", "vehicle_id", F.lit("deadlock break").alias("note"))
