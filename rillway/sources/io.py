"""Readers and writers of journals, alerts, samples, snapshots and metrics documents."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.operators.ordered import with_sequence


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped and missing ids are empty."""
    rows = spark.read.schema(S.JOURNAL).json(path).where("seq IS NOT NULL")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("trace_id", "span_id", "origin")})


def append_journal(journal: DataFrame, path: str) -> None:
    """Rows become JSON lines; readers order by seq, so files need no order of their own."""
    journal.write.mode("append").json(path)


def numbered(rows: DataFrame, order: list[str], head: int = 0) -> DataFrame:
    """Gives new rows the sequence numbers after ``head``."""
    return with_sequence(rows, order).withColumn("seq", F.col("seq") + head)


def head(journal: DataFrame) -> int:
    return journal.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]


def between(journal: DataFrame, after: int, upto: int) -> DataFrame:
    """From exclusive, to inclusive; the filter reaches the scan."""
    return journal.where((F.col("seq") > after) & (F.col("seq") <= upto))


def replay_log(messages: DataFrame, start: int, end: int, keys: list[str] | None = None, partitions: int = S.PARTITIONS) -> DataFrame:
    """Both offsets inclusive and per partition; given keys, their partitions are added as a filter, so a
    table laid out by partition reads only those."""
    from rillway.functions.scalars import partition_for_key

    out = messages.where(F.col("offset").between(start, end))
    if keys is not None:
        spark = messages.sparkSession
        at = spark.createDataFrame([(k,) for k in keys], "k string").select(partition_for_key(F.col("k"), partitions)).distinct()
        out = out.where(F.col("key").isin(keys) & F.col("partition").isin([r[0] for r in at.collect()]))
    return out


def write_alerts(alerts: DataFrame, path: str) -> None:
    """CSV with a header; with a scenario column it leads."""
    columns = ["rule", "severity", "subject", "value", "threshold", "at_ms", "message"]
    alerts.select(*(["scenario"] if "scenario" in alerts.columns else []), *columns).write.mode("overwrite").option("header", True).csv(path)


def write_event_samples(journal: DataFrame, path: str, scenario: str = "scenario") -> None:
    """One JSON line per scenario: its head and its counts per kind."""
    per = journal.groupBy(scenario, "kind").agg(F.count("*").alias("n"), F.max("seq").alias("seq"))
    per.groupBy(scenario).agg(F.max("seq").alias("journal_head"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds")).write.mode("overwrite").json(path)


def snapshot(state: DataFrame, path: str) -> None:
    """The whole fold state, stacks and steps included, so that a restore can go on folding."""
    state.write.mode("overwrite").parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: A line of a store's dump, and the documents that other programs write: the same entries in one array.
ENTRY = "key string, kind string, value string, fields map<string,string>, ttl double"
BACKENDS = ("memory", "redis")


def dump_store(entries: DataFrame, path: str, at_ms: int, backend: str = "memory", prefix: str = "", documents: int | None = None) -> None:
    """Writes the live ``entries`` (key, kind, value, fields, expires_ms) of a store as JSON: one line per entry, or
    with ``documents`` so many documents that hold an array of entries each.

    ttl is what is left at ``at_ms`` in seconds, null for ever; the redis backend has whole seconds, rounded up. Keys
    carry the prefix of their name space."""
    if backend not in BACKENDS:
        raise ValueError(f"no backend {backend!r}")
    left = (F.col("expires_ms") - at_ms) / 1000.0
    ttl = F.ceil(left).cast("double") if backend == "redis" else left
    live = entries.where(F.col("kind").isNotNull() & (F.col("expires_ms").isNull() | (F.col("expires_ms") > at_ms)))
    rows = live.select(F.lit(at_ms).cast("long").alias("at_ms"), F.lit(backend).alias("backend"), F.concat(F.lit(prefix), "key").alias("key"), "kind", F.when(F.col("kind") == "string", F.col("value")).alias("value"), F.when(F.col("kind") == "hash", F.col("fields")).alias("fields"), ttl.alias("ttl"))
    if documents:
        entry = F.struct("key", "kind", "value", "fields", "ttl")
        part = F.pmod(F.xxhash64("key"), F.lit(documents))
        rows = rows.groupBy("at_ms", "backend", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("key", entry.alias("e")).alias("x")), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("s"))
        rows = rows.select("at_ms", "backend", F.transform("s", lambda x: x["e"]).alias("entries"))
    rows.write.mode("overwrite").json(path)


def load_store(spark: SparkSession, path: str, now_ms: int, prefix: str = "", kind: str | None = None) -> DataFrame:
    """(key, kind, value, fields, expires_ms) of a dump of either shape and backend, its times counted from ``now_ms``.

    Only keys of the prefix are read, without it, and only one kind where it is named; of a dump by lines those
    conditions are left to the reader of the lines. Entries that had no time left are gone."""
    rows = spark.read.schema(f"at_ms long, backend string, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>, {ENTRY}").json(path)
    wanted = F.col("key").startswith(prefix) & (F.lit(True) if kind is None else F.col("kind") == kind)
    lines = rows.where(F.col("entries").isNull() & F.col("key").isNotNull() & wanted).select("key", "kind", "value", "fields", "ttl")
    inner = rows.where(F.col("entries").isNotNull()).select(F.inline("entries")).where(wanted)
    every = lines.unionByName(inner).where("ttl IS NULL OR ttl > 0")
    expires = F.round(now_ms + 1000 * F.col("ttl")).cast("long")
    return every.select(F.substring("key", len(prefix) + 1, 1 << 30).alias("key"), "kind", "value", "fields", expires.alias("expires_ms"))


def level_filtered(log: DataFrame, least: str) -> DataFrame:
    rank = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}
    order = F.create_map(*(F.lit(x) for kv in rank.items() for x in kv))
    return log.where(order[F.col("level")] >= rank[least])


def metrics_document(sections: dict[str, DataFrame], limit: int = 10_000) -> str:
    """Small aggregates as one JSON text with sorted keys; a section beyond the limit is refused."""
    out = {}
    for name, df in sections.items():
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"section {name} has more than {limit} rows; aggregate it first")
        out[name] = sorted((r.asDict(recursive=True) for r in rows), key=lambda r: json.dumps(r, sort_keys=True, default=str))
    return json.dumps(out, sort_keys=True, indent=2, default=str) + "\n"


def document_digest(text: str) -> str:
    """SHA-256 of a document whatever its line ends."""
    return hashlib.sha256(text.replace("\r\n", "\n").encode()).hexdigest()
