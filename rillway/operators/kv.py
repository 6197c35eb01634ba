"""A key-value store with expiry as a fold over its command log, one key at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMMAND = ["order", "at_ms", "op", "field", "value", "ttl_ms"]
STRINGS, HASHES = ("get", "incr"), ("hset", "hget", "hdel", "hlen", "hkeys", "hgetall")


class Entry(NamedTuple):
    kind: str | None = None
    value: str | None = None
    fields: dict | None = None
    expires_ms: int | None = None


GONE = Entry()


def run_commands(log: DataFrame, key: str = "key") -> DataFrame:
    """One row per command: (key, order, op, result, last, kind, value, fields, expires_ms).

    ``log``: key, order, at_ms, op, field, value, ttl_ms; op is one of set, get, exists, delete, incr, hset, hget,
    hdel, hlen, hkeys, hgetall, expire, persist, ttl, and any other changes nothing and gives null. An entry is
    gone when at_ms reaches its expiry. A string command on a hash, or the reverse, gives WRONGTYPE and changes
    nothing; incr of a value that is no integer gives NOTINT; set drops an old expiry unless it brings one,
    expire of zero or less deletes, and the last hdel deletes the key. A null field is the empty one.

    The last command of a key has last = true and the key's entry after it; kind is null if there is none. Logs
    stream through in order, one key after another, and only the entry of one key is held, so a log may be of any
    length; one key's commands run one after another by meaning.
    """
    rows = log.select(F.col(key).alias("key"), F.col("order").cast("long").alias("order"), F.col("at_ms").cast("long").alias("at_ms"), "op", "field", F.col("value").cast("string").alias("value"), F.col("ttl_ms").cast("long").alias("ttl_ms"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, order long, op string, result string, last boolean, kind string, value string, fields map<string,string>, expires_ms long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entry, kind = None, GONE, None
        for batch in batches:
            kind, out = batch.column(0).type, []
            for k, order, *command in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None:
                    last = held[0] != k
                    out.append((*held, last, *(entry if last else GONE)))
                    entry = GONE if last else entry
                entry, result = apply(entry, *command)
                held = (k, order, command[1], result)
            yield _rows(out, kind)
        if held is not None:
            yield _rows([(*held, True, *entry)], kind)

    return rows.repartition("key").sortWithinPartitions("key", *COMMAND).mapInArrow(run, schema).withColumnRenamed("key", key)


def final_entries(commands: DataFrame, key: str = "key") -> DataFrame:
    """(key, kind, value, fields, expires_ms) after the last command of each key."""
    return commands.where("last").select(key, "kind", "value", "fields", "expires_ms")


def _rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    text, whole = pa.string(), pa.int64()
    types = [kind, whole, text, text, pa.bool_(), text, text, pa.map_(text, text), whole]
    cols = list(zip(*out, strict=True)) or [()] * len(types)
    cols[7] = [None if f is None else list(f.items()) for f in cols[7]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "order", "op", "result", "last", "kind", "value", "fields", "expires_ms"])


def integer(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"\s*[+-]?[0-9]+\s*", text) else None


def apply(entry: Entry, at_ms: int, op: str, field: str | None, value: str | None, ttl_ms: int | None) -> tuple[Entry, str | None]:
    """One command: (the entry after it, its result)."""
    alive = entry.kind is not None and (entry.expires_ms is None or entry.expires_ms > at_ms)
    now = entry if alive else GONE
    flag = lambda c: "1" if c else "0"
    if (op in STRINGS and now.kind == "hash") or (op in HASHES and now.kind == "string"):
        return now, "WRONGTYPE"
    held, field = now.fields or {}, field or ""
    match op:
        case "set":
            return Entry("string", value, None, None if ttl_ms is None else at_ms + ttl_ms), "OK"
        case "get":
            return now, now.value
        case "exists":
            return now, flag(alive)
        case "delete":
            return GONE, flag(alive)
        case "incr":
            number = 0 if now.value is None else integer(now.value)
            if number is None:
                return now, "NOTINT"
            by = integer(value)
            total = str(number + (1 if by is None else by))
            return now._replace(kind="string", value=total), total
        case "expire":
            return (now._replace(expires_ms=at_ms + ttl_ms) if alive else GONE) if (ttl_ms or 0) > 0 else GONE, flag(alive)
        case "persist":
            return now._replace(expires_ms=None), flag(now.expires_ms is not None)
        case "ttl":
            return now, "-2" if not alive else "-1" if now.expires_ms is None else str(-((at_ms - now.expires_ms) // 1000))
        case "hset":
            return now._replace(kind="hash", fields=held | {field: value}), flag(field not in held)
        case "hget":
            return now, held.get(field)
        case "hdel":
            less = {f: v for f, v in held.items() if f != field}
            return now._replace(fields=less) if less else GONE, flag(field in held)
        case "hlen":
            return now, str(len(held))
        case "hkeys":
            return now, ",".join(sorted(held))
        case "hgetall":
            return now, ",".join(f"{f}={v}" for f, v in sorted(held.items()) if v is not None)
    return now, None
