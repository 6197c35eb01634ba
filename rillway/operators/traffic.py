"""Mutual exclusion: grants, conflicts, wait-for graph, deadlock cycles and routes."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.functions.scalars import rotated
from rillway.operators.cut import cut
from rillway.operators.ordered import placed, ranged, running


def ranked(requests: DataFrame) -> DataFrame:
    """Requests with their rank at their resource: priority, then time, then order of asking, then vehicle."""
    return placed(requests, ["resource"], "priority", ["requested_ms", "seq", "vehicle"], "rank")


def free_slots(resources: DataFrame, holders: DataFrame) -> DataFrame:
    held = holders.groupBy("resource").agg(F.count("*").alias("held"))
    return resources.join(held, "resource", "left").select("resource", "capacity", F.coalesce("held", F.lit(0)).cast("long").alias("held")).withColumn("free", F.greatest(F.col("capacity") - F.col("held"), F.lit(0)).cast("long"))


def grants(requests: DataFrame, resources: DataFrame, holders: DataFrame) -> DataFrame:
    return ranked(requests).join(free_slots(resources, holders), "resource").where(F.col("rank") <= F.col("free"))


def conflicts(requests: DataFrame, resources: DataFrame, holders: DataFrame) -> DataFrame:
    """(resource, winner, loser, rank) of full resources with waiters: the winner is the least holder."""
    full = free_slots(resources, holders).where("free = 0").select("resource")
    winner = holders.groupBy("resource").agg(F.min("vehicle").alias("winner"))
    return ranked(requests).join(full.join(winner, "resource"), "resource").select("resource", "winner", F.col("vehicle").alias("loser"), "rank")


def wait_for(requests: DataFrame, resources: DataFrame, holders: DataFrame) -> DataFrame:
    """(waiter, holder): the resource is full and the waiter does not hold it."""
    full = free_slots(resources, holders).where("free = 0").select("resource")
    waiting = requests.join(full, "resource", "left_semi").join(holders, ["resource", "vehicle"], "left_anti")
    return waiting.select("resource", F.col("vehicle").alias("waiter")).join(holders.select("resource", F.col("vehicle").alias("holder")), "resource").select("waiter", "holder").distinct()


def until_all(log: DataFrame) -> DataFrame:
    """The requests and releases of ``log``, its requests with until_ms and until_id: the next release_all of their
    vehicle, null where there is none. Other release_alls find neither a place held nor a wait, so that they need
    no rows of their own, and one of a vehicle that uses many resources is not dealt to all of them.

    The log is dealt to ranges of time; what comes first in the ranges after one is a row per range and vehicle.
    """
    all_ = F.when(F.col("op") == "release_all", F.struct(F.col("at_ms").alias("until_ms"), F.col("id").alias("until_id")))
    dealt, _ = ranged(log, ["at_ms", "id"])
    after = Window.partitionBy("_of").orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    firsts = dealt.groupBy(F.col("vehicle").alias("_of"), F.col("_range").alias("_at")).agg(F.min(all_).alias("_first"))
    later = firsts.select("_of", "_at", F.min("_first").over(after).alias("_later"))
    ahead = Window.partitionBy("_range", "vehicle").orderBy("at_ms", "id").rowsBetween(0, Window.unboundedFollowing)
    met = dealt.withColumn("_next", F.min(all_).over(ahead)).where("op <> 'release_all'").join(later, F.col("vehicle").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
    until = F.when(F.col("op") == "request", F.coalesce("_next", "_later")).alias("_until")
    return met.select(*log.columns, until).select(*log.columns, "_until.until_ms", "_until.until_id")


OUTCOME = "resource long, holders array<long>, waiting array<long>, requests long, grants long, blocks long, conflicts long, releases long"


def fold_requests(log: DataFrame, resources: DataFrame) -> DataFrame:
    """State and counters per resource after its log of request, release, release_resource and release_all.

    ``log`` has resource, at_ms, id (which breaks ties), op, vehicle and priority; ``resources`` has resource
    and capacity. A request of a holder changes nothing, one of a waiter changes its priority; slots go to the
    highest priority, then the earliest, then the least id. release frees a slot, release_resource leaves the
    queue as well; either lets the next in. The log streams through in order, one resource after another, and
    only the holders and the queue of one resource are held, so its length does not matter.
    """
    names = [f.split()[0] for f in OUTCOME.split(", ")]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] + [pa.int64()] * 5

    def ends(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place = None, None
        for batch in batches:
            out = []
            for resource, capacity, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if resource != now:
                    if place and place.used:
                        place.upto(None)
                        out.append((now, *place.row()))
                    now, place = resource, None
                if capacity is not None:
                    place = _Place(capacity)
                elif place:
                    place.event(*event)
            yield ends(out)
        if place and place.used:
            place.upto(None)
            yield ends([(now, *place.row())])

    return _by_resource(log, resources).mapInArrow(run, OUTCOME)


class _Place:
    """Holders and queue of one resource; a queue's entries sort by rank, the vehicle last. ``due`` has the
    release_alls to come of the vehicles that asked, the earliest first."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.used = capacity, False
        self.holders, self.queue, self.due = set(), [], []
        self.n = dict.fromkeys(("requests", "grants", "blocks", "conflicts", "releases"), 0)

    def upto(self, at: tuple[int, int] | None) -> list[tuple]:
        """Handles the release_alls before ``at``, or all: (at_ms, id, depth, change, blocked) of each that changes the queue."""
        out = []
        while self.due and (at is None or self.due[0][:2] < at):
            *when, vehicle = heappop(self.due)
            before = len(self.queue)
            self.apply(*when, "release_resource", vehicle, None)
            if len(self.queue) != before:
                out.append((*when, len(self.queue), len(self.queue) - before, False))
        return out

    def event(self, at_ms: int, ident: int, op: str, vehicle: int, priority: int, until_ms: int | None, until_id: int | None) -> list[tuple]:
        """Handles the release_alls that are due and then one event, and tells what ``upto`` tells of all of them,
        and of a request that is blocked."""
        self.used, out, before = True, self.upto((at_ms, ident)), len(self.queue)
        blocked = self.apply(at_ms, ident, op, vehicle, priority)
        if until_ms is not None and (until_ms, until_id, vehicle) not in self.due:
            heappush(self.due, (until_ms, until_id, vehicle))
        if blocked or len(self.queue) != before:
            out.append((at_ms, ident, len(self.queue), len(self.queue) - before, blocked))
        return out

    def admit(self) -> None:
        while self.queue and len(self.holders) < self.capacity:
            self.holders.add(self.queue.pop(0)[-1])
            self.n["grants"] += 1

    def apply(self, at_ms: int, ident: int, op: str, vehicle: int, priority: int | None) -> bool:
        """Handles one event; was it a request that is blocked?"""
        if op == "request":
            self.n["requests"] += 1
            if vehicle in self.holders:
                return False
            old = next((w for w in self.queue if w[-1] == vehicle), None)
            if old:
                self.queue.remove(old)
            insort(self.queue, (-priority, *(old[1:3] if old else (at_ms, ident)), vehicle))
            self.admit()
            if vehicle in self.holders:
                return False
            self.n["blocks"] += 1
            self.n["conflicts"] += bool(self.holders)
            return True
        held, waited = vehicle in self.holders, False
        if held:
            self.holders.remove(vehicle)
            self.n["releases"] += 1
        if op == "release_resource":
            waited = any(w[-1] == vehicle for w in self.queue)
            self.queue = [w for w in self.queue if w[-1] != vehicle]
        if held or waited:
            self.admit()
        return False

    def row(self) -> tuple:
        return (sorted(self.holders), [w[-1] for w in self.queue], *self.n.values())


def _by_resource(log: DataFrame, resources: DataFrame) -> DataFrame:
    """The log by resource in order, before it a row with the resource's capacity. Rows and capacities come by a union:
    Spark would take the shuffle of a join for the one asked for here, and then read it map by map where it
    broadcasts the capacities, which takes resources apart."""
    rows = until_all(log.select("resource", "at_ms", "id", "op", "vehicle", "priority"))
    met = rows.unionByName(resources.select("resource", F.col("capacity").cast("long").alias("capacity")), allowMissingColumns=True)
    sorted_ = met.repartition("resource").sortWithinPartitions("resource", F.col("capacity").isNull(), "at_ms", "id")
    return sorted_.select("resource", "capacity", "at_ms", "id", "op", "vehicle", "priority", "until_ms", "until_id")


def queue_changes(log: DataFrame, resources: DataFrame) -> DataFrame:
    """(resource, at_ms, id, depth, change, blocked) per event of ``fold_requests`` that changes its queue or blocks:
    the depth of the queue after it, by how much it changed, and whether the event is a request that is blocked."""
    names = ["resource", "at_ms", "id", "depth", "change", "blocked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == "blocked" else pa.int64()) for c, k in zip(cols, names, strict=True)], names=names)

        now, place = None, None
        for batch in batches:
            out = []
            for resource, capacity, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if resource != now:
                    if place:
                        out += [(now, *x) for x in place.upto(None)]
                    now, place = resource, None
                if capacity is not None:
                    place = _Place(capacity)
                elif place:
                    out += [(now, *x) for x in place.event(*event)]
            yield told(out)
        if place:
            yield told([(now, *x) for x in place.upto(None)])

    return _by_resource(log, resources).mapInArrow(run, "resource long, at_ms long, id long, depth long, change long, blocked boolean")


def pressure(log: DataFrame, resources: DataFrame) -> DataFrame:
    """``queue_changes`` with waiting, how many wait at all resources together after each event. What is seen
    whenever a request is blocked has its maxima in the deepest queue and the most that wait."""
    return running(cut(queue_changes(log, resources)), ["at_ms", "id", "resource"], {"waiting": ([], F.col("change"))})


def trimmed(edges: DataFrame) -> DataFrame:
    """``edges`` without nodes that nobody waits for or that wait for nobody, as long as that removes a tenth."""
    n = edges.count()
    while n:
        ends = edges.select(F.col("waiter").alias("holder")).distinct()
        starts = edges.select(F.col("holder").alias("waiter")).distinct()
        edges = cut(edges.join(ends, "holder", "left_semi").join(starts, "waiter", "left_semi").select("waiter", "holder"))
        was, n = n, edges.count()
        if 10 * n > 9 * was:
            break
    return edges


def cycles(edges: DataFrame) -> DataFrame:
    """Simple cycles of two or more, each turned to start at its least vehicle, as arrays.

    Where everyone waits for one vehicle at most, steps are multiplied (``single_cycles``). Else ends of chains are
    trimmed off as long as that pays, and nodes that do not reach themselves are dropped by squaring the
    reachability relation. Paths then grow from the least node of a cycle only, until none is left; a path
    repeats no node, so the nodes bound the rounds.
    """
    edges = cut(edges.where("waiter <> holder").distinct())
    n, most = _waits(edges)
    if most > 1:
        edges = trimmed(edges)
        n, most = _waits(edges)
    if most <= 1:
        return single_cycles(edges, n)
    reach, n = edges, edges.count()
    while n:
        hop = reach.alias("p").join(reach.alias("q"), F.col("p.holder") == F.col("q.waiter")).select("p.waiter", "q.holder")
        reach = cut(reach.union(hop).distinct())
        if (m := reach.count()) == n:
            break
        n = m
    loops = reach.where("waiter = holder").select("waiter")
    edges = cut(edges.join(loops, "waiter", "left_semi").join(loops.withColumnRenamed("waiter", "holder"), "holder", "left_semi").select("waiter", "holder"))
    paths = edges.where("holder > waiter").select(F.col("waiter").alias("root"), F.col("holder").alias("tip"), F.array("waiter", "holder").alias("path"))
    found = None
    while True:
        grown = paths.join(edges, F.col("tip") == F.col("waiter"))
        closed = cut(grown.where("holder = root").select("path"))
        found = closed if found is None else found.unionByName(closed)
        paths = cut(grown.where("holder > root AND NOT array_contains(path, holder)").select("root", F.col("holder").alias("tip"), F.concat("path", F.array("holder")).alias("path")))
        if paths.isEmpty():
            break
    return found.select(rotated(F.col("path")).alias("cycle")).distinct()


def _waits(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and the most of one waiter."""
    n, most = edges.groupBy("waiter").count().agg(F.sum("count"), F.max("count")).first()
    return n or 0, most or 0


#: Up to so many vehicles a round broadcasts their rows (3 MB, less than Spark broadcasts unasked) instead of dealing them; rows of a task.
FEW, TASK_ROWS = 100_000, 25_000
#: By what a round multiplies the steps: where rows are broadcast, and where they are dealt.
LEGS, DEALT_LEGS = 8, 4


def single_cycles(edges: DataFrame, n: int) -> DataFrame:
    """``cycles`` where no waiter has two holders; ``edges`` has ``n`` rows.

    A row per vehicle holds where ``steps`` waits lead, and the least vehicle met on the way with its distance.
    A round puts some such walks end to end, and of the vehicles only those are kept where such a walk ends, which
    all on a cycle are: the others fall away, soon most of them. Once there are no more vehicles than steps, a walk
    that ends at a vehicle left has gone round, so what is left is on a cycle and has met the whole of it. Each leg
    meets the same rows, which Spark deals or broadcasts once a round.
    """

    def side(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if n <= FEW else rows

    def ended(rows: DataFrame) -> DataFrame:
        return rows.join(side(rows.select(F.col("holder").alias("waiter"))), "waiter", "left_semi")

    at, steps = edges.select("waiter", "holder", F.col("waiter").alias("low"), F.lit(0).cast("long").alias("d")), 1
    while n > steps:
        legs, far = LEGS if n <= FEW else DEALT_LEGS, at
        for k in range(1, legs):
            # who waits for nobody ends a walk; whoever leads there is on no cycle
            least = F.least(F.struct("p.low", "p.d"), F.struct(F.col("q.low"), (F.col("q.d") + k * steps).alias("d")))
            met = far.alias("p").join(side(at).alias("q"), F.col("p.holder") == F.col("q.waiter"))
            far = met.select("p.waiter", "q.holder", least.alias("m")).select("waiter", "holder", F.col("m.low").alias("low"), F.col("m.d").alias("d"))
        at = cut(ended(far).coalesce(-(-n // TASK_ROWS)))
        n, steps = at.count(), steps * legs
    members = F.array_sort(F.collect_list(F.struct((-F.col("d")).alias("d"), "waiter")))
    rest = F.transform(F.filter(members, lambda x: x["d"] < 0), lambda x: x["waiter"])
    return ended(at).groupBy("low").agg(F.concat(F.array("low"), rest).alias("cycle")).select("cycle")


def victim(cycle: Column, priority: Column | Callable[[Column], Column]) -> Column:
    """Of a cycle the vehicle of least priority, then least id; ``priority`` is a map by vehicle, or a function of the
    vehicle. A map that is made from the cycle would be made again for each of its vehicles."""
    of = (lambda v: F.coalesce(priority[v], F.lit(0))) if isinstance(priority, Column) else priority
    return F.array_min(F.transform(cycle, lambda v: F.struct(of(v).alias("p"), v.alias("v"))))["v"]


def routes(spark, congestion: DataFrame | None = None) -> DataFrame:
    """(start, goal, path, cost) of least cost over the hub graph, ties to the least path, by relaxation.

    Distances settle in at most as many rounds as there are hubs less one.
    """
    hubs = spark.createDataFrame(S.HUBS, "hub string, x double, y double")
    roads = spark.createDataFrame([*S.ROADS, *[(b, a) for a, b in S.ROADS]], "a string, b string")
    h = lambda s: hubs.select(F.col("hub").alias(s), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y"))
    lanes = roads.join(F.broadcast(h("a")), "a").join(F.broadcast(h("b")), "b")
    lanes = lanes.select("a", "b", F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2).alias("cost"))
    if congestion is not None:
        lanes = lanes.join(congestion, ["a", "b"], "left").select("a", "b", (F.col("cost") + S.CONGESTION * F.coalesce("load", F.lit(0))).alias("cost"))
    best = hubs.select(F.col("hub").alias("start"), F.col("hub").alias("goal"), F.lit(0.0).alias("cost"), F.col("hub").alias("path"))
    for _ in range(len(S.HUBS) - 1):
        step = best.alias("p").join(F.broadcast(lanes.alias("l")), F.col("p.goal") == F.col("l.a")).select("start", F.col("b").alias("goal"), (F.col("p.cost") + F.col("l.cost")).alias("cost"), F.concat("path", F.lit(">"), F.col("b")).alias("path"))
        best = best.unionByName(step).groupBy("start", "goal").agg(F.min(F.struct("cost", "path")).alias("m")).select("start", "goal", "m.cost", "m.path")
    return best


def breaks(found: DataFrame, priority: DataFrame) -> DataFrame:
    """(cycle, victim, victim_priority) of the cycles that are broken, one after another, until none is left.

    ``found`` has cycle, an array turned to start at its least vehicle; ``priority`` has vehicle and priority,
    and who has none counts as 0. The least cycle goes first: its vehicle of least priority, then least id, gives
    way, and with it goes each cycle that holds it. Cycles without a common vehicle do not touch each other, so a
    round breaks every cycle that is the least of all those it meets, and gives what one at a time would.
    """
    members = found.select("cycle", F.explode("cycle").alias("vehicle")).join(priority.select("vehicle", "priority"), "vehicle", "left").select("cycle", "vehicle", F.coalesce("priority", F.lit(0)).cast("long").alias("priority"))
    left, out = cut(members.distinct()), None
    while not left.isEmpty():
        least = left.groupBy("vehicle").agg(F.min("cycle").alias("first"))
        firsts = left.join(least, "vehicle").groupBy("cycle").agg(F.bool_and(F.col("cycle") == F.col("first")).alias("first"), F.min(F.struct("priority", "vehicle")).alias("v"))
        broken = cut(firsts.where("first").select("cycle", F.col("v.vehicle").alias("victim"), F.col("v.priority").alias("victim_priority")))
        out = broken if out is None else out.unionByName(broken)
        gone = left.join(broken.select(F.col("victim").alias("vehicle")).distinct(), "vehicle", "left_semi").select("cycle").distinct()
        left = cut(left.join(gone, "cycle", "left_anti"))
    return out if out is not None else left.select("cycle", F.col("vehicle").alias("victim"), F.col("priority").alias("victim_priority"))


def nearest_hub(x: Column, y: Column) -> Column:
    """The hub at the least distance, then the least name."""
    return F.array_min(F.array(*(F.struct(((x - hx) * (x - hx) + (y - hy) * (y - hy)).alias("d"), F.lit(h).alias("hub")) for h, hx, hy in S.HUBS)))["hub"]


def trips(driven: DataFrame, lanes: DataFrame) -> DataFrame:
    """``driven`` (vx, vy, ox, oy, dx, dy: vehicle, origin and destination) with ``route``, the hubs from the
    vehicle's hub by way of the origin's to the destination's, and its cost.

    ``lanes`` is ``routes``: 36 rows whatever the number of tasks, so both looks at it are broadcast.
    """
    at = driven.withColumns({"_s": nearest_hub(F.col("vx"), F.col("vy")), "_o": nearest_hub(F.col("ox"), F.col("oy")), "_d": nearest_hub(F.col("dx"), F.col("dy"))})
    leg = lambda a, b, n: F.broadcast(lanes.select(F.col("start").alias(a), F.col("goal").alias(b), F.split("path", ">").alias(f"_p{n}"), F.col("cost").alias(f"_c{n}")))
    met = at.join(leg("_s", "_o", 1), ["_s", "_o"]).join(leg("_o", "_d", 2), ["_o", "_d"])
    whole = F.concat("_p1", F.slice("_p2", F.lit(2), F.size("_p2")))
    return met.select(*driven.columns, whole.alias("route"), (F.col("_c1") + F.col("_c2")).alias("cost"))
