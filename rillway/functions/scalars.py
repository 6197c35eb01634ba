"""Scalar expressions: everything here is a Column built from Spark's own functions."""

from __future__ import annotations

import fnmatch
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillway import schemas as S


def stable_hash(key: Column) -> Column:
    """The first eight bytes of MD5, big-endian and unsigned: decimal(20,0), as it exceeds a long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def partition_for_key(key: Column, partitions: int = S.PARTITIONS) -> Column:
    return (stable_hash(key) % F.lit(partitions)).cast("long")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs.items())))


def priority_label(priority: Column) -> Column:
    return F.coalesce(literal_map(S.PRIORITY_LABELS)[priority.cast("int")], F.concat(F.lit("P"), priority.cast("string")))


def padded_id(prefix: str, number: Column, width: int = 4) -> Column:
    """Zero-padded to the width, never cut."""
    return F.format_string(f"{prefix}%0{width}d", number)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def move_towards(x: Column, y: Column, tx: Column, ty: Column, step: Column) -> Column:
    """Struct of the new x, y and the way gone; never beyond the target."""
    d = distance(x, y, tx, ty)
    gone = F.least(d, step)
    part = F.when(d > 0, gone / d).otherwise(F.lit(0.0))
    return F.struct((x + (tx - x) * part).alias("x"), (y + (ty - y) * part).alias("y"), gone.alias("moved"))


def drained(battery: Column, metres: Column, rate: float = 0.01) -> Column:
    return F.greatest(F.lit(0.0), battery - metres * rate)


def score(priority: Column, idle: Column, battery: Column, dist: Column, wait_s: Column, weights: dict[str, float] = S.WEIGHTS) -> Column:
    w = {**S.WEIGHTS, **weights}
    return w["priority"] * priority + w["idle"] * idle.cast("double") + w["battery"] * battery - w["distance"] * dist + w["aging"] * wait_s


def score_reasons(priority: Column, battery: Column, dist: Column, wait_s: Column, state: Column, weights: dict[str, float] = S.WEIGHTS) -> Column:
    """What a score is made of, term by term, with its contribution."""
    w = {**S.WEIGHTS, **weights}
    return F.array(
        F.format_string("priority=%s(+%.1f)", priority_label(priority), w["priority"] * priority.cast("double")), F.format_string("distance=%.1fm(%.1f)", dist, -w["distance"] * dist), F.format_string("battery=%.1f%%(+%.1f)", battery, w["battery"] * battery),
        F.format_string("state=%s(+%.1f)", state, F.when(state == "IDLE", w["idle"]).otherwise(0.0)), F.format_string("waiting=%.1fs(+%.1f)", wait_s, w["aging"] * wait_s),
    )


def edge_cost(length: Column, occupied: Column, congestion: float = S.CONGESTION) -> Column:
    return length + congestion * occupied


def bay_capacity(vehicles: Column, hubs: int = len(S.HUBS)) -> Column:
    return F.greatest(F.lit(2), F.ceil(vehicles / hubs) + 2)


def ttl_seconds(exists: Column, expires_ms: Column, now_ms: Column) -> Column:
    """-2 missing or expired, -1 without expiry, else the remaining seconds rounded up."""
    left = F.ceil((expires_ms - now_ms) / 1000.0)
    return F.when(~exists | (expires_ms <= now_ms), F.lit(-2)).when(expires_ms.isNull(), F.lit(-1)).otherwise(left).cast("long")


def live(expires_ms: Column, now_ms: Column) -> Column:
    return expires_ms.isNull() | (expires_ms > now_ms)


def glob(column: Column, pattern: str) -> Column:
    """Case-sensitive shell pattern."""
    return column.rlike("^" + fnmatch.translate(pattern).removeprefix("(?s:").replace(r")\Z", "").replace(r")\z", "") + "$")


def canonical_json(*parts: Column) -> Column:
    """A compact JSON array of columns: strings quoted, numbers and booleans bare."""
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def rotated(cycle: Column) -> Column:
    """An array turned so that it starts at its least element."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    return F.concat(F.slice(cycle, at, F.size(cycle)), F.slice(cycle, F.lit(1), at - 1))


def header(headers: Column, name: str) -> Column:
    return F.coalesce(headers[name], F.lit(""))


def subject_kind(kind: Column) -> Column:
    return F.when(kind.startswith("task"), "task").when(kind.startswith("vehicle"), "vehicle").otherwise("other")


def encode_value(value: Column, kind: str) -> Column:
    """Stored form of a value: booleans are 1 and 0."""
    return F.when(value, "1").otherwise("0") if kind == "boolean" else value.cast("string")


def breached(value: Column, threshold: Column, above: bool = True) -> Column:
    return value > threshold if above else value < threshold


def prefixed(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key)


def unprefixed(prefix: str, key: Column) -> Column:
    return F.when(key.startswith(prefix), F.substring(key, len(prefix) + 1, 1 << 30)).otherwise(key)


def json_diff(left: Column, right: Column) -> Column:
    """Array of (path, left, right) where two JSON objects differ, by path; a missing side is null. Nested
    values are compared as their text."""
    a, b = (F.coalesce(F.from_json(x, "map<string,string>"), F.expr("cast(map() as map<string,string>)")) for x in (left, right))
    paths = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    each = F.transform(paths, lambda k: F.struct(k.alias("path"), a[k].alias("left"), b[k].alias("right")))
    return F.filter(each, lambda x: ~x["left"].eqNullSafe(x["right"]))
