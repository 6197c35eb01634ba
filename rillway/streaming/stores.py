"""Keyed state with lists, maps and event-time timers: idempotency stores, liveness, expiry of a key-value store.

Each operator takes a stream and gives the stream of its rows; ``transformWithState`` keeps the state in RocksDB,
so it is not bound to memory, and a query that is started again from its checkpoint goes on where it stopped.
Rows of one key in one micro-batch are sorted by their time; a micro-batch is bounded by the source's admission
options. Spark drops rows that are not later than the watermark, so where times of two micro-batches may be equal
the watermark must stand at least a millisecond behind; timers fire up to the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rillway.operators.idempotency import RESULTS, Store
from rillway.operators.kv import GONE, Entry, apply

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIVENESS = "vehicle_id string, kind string, at_ms long, silent_ms long, alert boolean"
EXPIRIES = "sweep_ms long, key string, expired_ms long"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB; the session is left as it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _struct(**fields: object) -> StructType:
    return StructType([StructField(k, t) for k, t in fields.items()])


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    rows = [f for f in frames if len(f)]
    return (pd.concat(rows).sort_values(by, kind="stable").itertuples(index=False) if rows else iter(()))


class _Idempotency(StatefulProcessor):
    def __init__(self, capacity: int, ttl_ms: int | None) -> None:
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        key, at = _struct(key=StringType()), _struct(at=LongType())
        self.done = handle.getListState("done", _struct(key=StringType(), at=LongType()))
        self.inflight = handle.getMapState("inflight", key, at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        store = Store(self.capacity, self.ttl_ms)
        store.done = {k: at for k, at in self.done.get()} if self.done.exists() else {}
        before = {k[0]: v[0] for k, v in self.inflight.iterator()} if self.inflight.exists() else {}
        store.inflight, marks = dict(before), list(store.done.items())
        out = [(r.store, r.order, r.at_ms, r.op, r.key, *store.apply(r.op, r.key, r.at_ms)) for r in _in_order(rows, ["at_ms", "order"])]
        if list(store.done.items()) != marks:
            self.done.put([*store.done.items()]) if store.done else self.done.clear()
        for k in before.keys() - store.inflight.keys():
            self.inflight.removeKey((k,))
        for k, at in store.inflight.items():
            if before.get(k) != at:
                self.inflight.updateValue((k,), (at,))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in RESULTS.split(", ")])

    def close(self) -> None:
        pass


def idempotency(log: DataFrame, capacity: int, ttl_ms: int | None) -> DataFrame:
    """``operators.idempotency.run_store`` on a stream of operations: done keys as a list, oldest mark first, and
    claims as a map. The list is what evicts, and is never longer than ``capacity``."""
    return log.groupBy("store").transformWithStateInPandas(_Idempotency(capacity, ttl_ms), outputStructType=RESULTS, outputMode="Append", timeMode="None")


def found_silent(last: int, timeout_ms: int, check_ms: int) -> int:
    """When a vehicle last heard of at ``last`` is found silent: at the first check more than the timeout later."""
    return ((last + timeout_ms) // check_ms + 1) * check_ms


class _Liveness(StatefulProcessor):
    def __init__(self, timeout_ms: int, check_ms: int, cooldown_ms: int) -> None:
        self.timeout_ms, self.check_ms, self.cooldown_ms = timeout_ms, check_ms, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # last heartbeat, 1 while online, last alert (-1: none), the timer that is set
        self.state = handle.getValueState("vehicle", _struct(last=LongType(), online=LongType(), alerted=LongType(), timer=LongType()))

    def _silent(self, v: list[int], vehicle: str, at: int) -> tuple:
        alert = v[2] < 0 or at - v[2] >= self.cooldown_ms
        v[1], v[2] = 0, at if alert else v[2]
        return (vehicle, "vehicle_offline", at, at - v[0], alert)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        v = list(self.state.get()) if self.state.exists() else None
        out = []
        timer = v[3] if v else None
        for r in _in_order(rows, ["at_ms"]):
            v = v or [r.at_ms, 1, -1, 0]
            if r.at_ms < v[0]:
                continue
            if v[1] and (found := found_silent(v[0], self.timeout_ms, self.check_ms)) < r.at_ms:
                out.append(self._silent(v, key[0], found))
            if not v[1]:
                out.append((key[0], "vehicle_online", r.at_ms, None, False))
                v[1] = 1
            v[0] = r.at_ms
        if v:
            v[3] = found_silent(v[0], self.timeout_ms, self.check_ms)
            if v[3] != timer:
                if timer:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(v[3])
            self.state.update(tuple(v))
        yield _liveness(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        v, out = list(self.state.get()), []
        if v[1] and v[3] == expiredTimerInfo.getExpiryTimeInMs():
            out.append(self._silent(v, key[0], v[3]))
            self.state.update((v[0], v[1], v[2], 0))
        yield _liveness(out)

    def close(self) -> None:
        pass


def _liveness(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[f.split()[0] for f in LIVENESS.split(", ")])
    return frame.astype({"silent_ms": "Int64", "at_ms": "int64"})


def liveness(heartbeats: DataFrame, timeout_ms: int, check_ms: int, cooldown_ms: int) -> DataFrame:
    """vehicle_offline, vehicle_online and whether an alert fires, from a stream of vehicle_id, at_ms and ts, the
    event time with its watermark.

    A vehicle is found silent by an event-time timer at the first check, every ``check_ms``, at which it has not
    been heard of for more than ``timeout_ms``; a heartbeat at that very time comes first. The next heartbeat
    brings it back online. Alerts of a vehicle are at least ``cooldown_ms`` apart. Heartbeats older than the last
    one of their vehicle change nothing.
    """
    return heartbeats.groupBy("vehicle_id").transformWithStateInPandas(_Liveness(timeout_ms, check_ms, cooldown_ms), outputStructType=LIVENESS, outputMode="Append", timeMode="EventTime")


class _Sweeps(StatefulProcessor):
    def __init__(self, period_ms: int) -> None:
        self.period_ms = period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getMapState("fields", _struct(field=StringType()), _struct(value=StringType()))
        self.entry = handle.getValueState("entry", _struct(kind=StringType(), value=StringType(), expires=LongType(), timer=LongType()))

    def _sweep(self, entry: Entry) -> int | None:
        return None if entry.kind is None or entry.expires_ms is None else -(-entry.expires_ms // self.period_ms) * self.period_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.entry.get() if self.entry.exists() else (None, None, None, None)
        fields = {k[0]: v[0] for k, v in self.fields.iterator()} if held[0] == "hash" else None
        entry, timer, out = Entry(held[0], held[1], fields, held[2]), held[3], []
        for r in _in_order(rows, ["at_ms", "order"]):
            if (sweep := self._sweep(entry)) is not None and sweep <= r.at_ms:
                out.append((sweep, key[0], entry.expires_ms))
                entry = GONE
            command = [None if pd.isna(x) else x for x in (r.op, r.field, r.value, r.ttl_ms)]
            entry, _ = apply(entry, int(r.at_ms), *command[:3], None if command[3] is None else int(command[3]))
        self._keep(entry, timer)
        if entry.fields != fields:
            self.fields.clear()
            for f, v in (entry.fields or {}).items():
                self.fields.updateValue((f,), (v,))
        yield pd.DataFrame(out, columns=["sweep_ms", "key", "expired_ms"])

    def _keep(self, entry: Entry, timer: int | None) -> None:
        if (sweep := self._sweep(entry)) != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if sweep is not None:
                self.handle.registerTimer(sweep)
        self.entry.update((entry.kind, entry.value, entry.expires_ms, sweep)) if entry.kind else self.entry.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, _, expires, timer = self.entry.get() if self.entry.exists() else (None, None, None, None)
        due = kind is not None and timer == expiredTimerInfo.getExpiryTimeInMs()
        if due:
            self.entry.clear()
            self.fields.clear()
        yield pd.DataFrame([(timer, key[0], expires)] if due else [], columns=["sweep_ms", "key", "expired_ms"])

    def close(self) -> None:
        pass


def expiries(commands: DataFrame, period_ms: int) -> DataFrame:
    """(sweep_ms, key, expired_ms): the keys that each sweep, every ``period_ms``, finds expired and removes, from a
    stream of key, order, at_ms, op, field, value, ttl_ms and ts, the event time with its watermark.

    An expired key that a command touches before the sweep is removed then and not reported; commands at the time
    of a sweep come after it. Entries follow ``operators.kv``.
    """
    return commands.groupBy("key").transformWithStateInPandas(_Sweeps(period_ms), outputStructType=EXPIRIES, outputMode="Append", timeMode="EventTime")
