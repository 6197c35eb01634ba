"""Two-phase idempotency: claim, mark, release, with a bounded memory of what is done."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULTS = "store string, order long, at_ms long, op string, key string, result boolean, expired long, evicted string"


class Store:
    """The claims of one store. ``done`` maps keys to when they were marked, oldest mark first; ``inflight`` maps
    claimed keys to when they were claimed. ``capacity`` bounds done; after ``ttl_ms`` both are forgotten."""

    def __init__(self, capacity: int, ttl_ms: int | None) -> None:
        self.capacity, self.ttl_ms, self.done, self.inflight = capacity, ttl_ms, {}, {}

    def expire(self, now: int) -> int:
        """Forgets what is too old; how many done keys that were. Marks are in order of time, claims need not be."""
        if self.ttl_ms is None:
            return 0
        old = [k for k, at in self.done.items() if at <= now - self.ttl_ms]
        for k in old:
            del self.done[k]
        self.inflight = {k: at for k, at in self.inflight.items() if at > now - self.ttl_ms}
        return len(old)

    def mark(self, key: str, now: int) -> str | None:
        """A done key moves to the end; the key that this evicts, if any."""
        self.inflight.pop(key, None)
        self.done.pop(key, None)
        self.done[key] = now
        if len(self.done) <= self.capacity:
            return None
        oldest = next(iter(self.done))
        del self.done[oldest]
        return oldest

    def apply(self, op: str, key: str, now: int) -> tuple[bool | None, int, str | None]:
        """(result, done keys that expired, key that was evicted); any other op changes nothing and gives null."""
        expired = self.expire(now) if op in ("claim", "check_and_set", "seen") else 0
        known = key in self.done or key in self.inflight
        match op:
            case "seen":
                return known, expired, None
            case "claim" | "check_and_set":
                if known:
                    return False, expired, None
                self.inflight[key] = now
                return True, expired, self.mark(key, now) if op == "check_and_set" else None
            case "mark":
                return True, 0, self.mark(key, now)
            case "release":
                return self.inflight.pop(key, None) is not None, 0, None
            case "forget":
                gone = self.done.pop(key, None) is not None
                return (self.inflight.pop(key, None) is not None) or gone, 0, None
        return None, 0, None


def run_store(log: DataFrame, capacity: int, ttl_ms: int | None) -> DataFrame:
    """One row per operation (store, order, at_ms, op, key, result, expired, evicted) of ``log``: store, order,
    at_ms, op, key. Logs stream through in order, one store after another; a store holds at most ``capacity``
    done keys and what is claimed. Each store has its own capacity: keys are dealt to stores by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or row[0] != now:
                    now, held = row[0], Store(capacity, ttl_ms)
                out.append((*row, *held.apply(row[3], row[4], row[2])))
            yield results(out)

    rows = log.select("store", F.col("order").cast("long").alias("order"), F.col("at_ms").cast("long").alias("at_ms"), "op", "key")
    return rows.repartition("store").sortWithinPartitions("store", "at_ms", "order").mapInArrow(run, RESULTS)


def results(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()]
    cols = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in RESULTS.split(", ")])
