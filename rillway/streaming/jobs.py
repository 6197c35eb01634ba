"""Streams over the events table, run to the end of what is there, with results read back as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.functions.dialect import render
from rillway.streaming.stateful import live_states, ordered_gate


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that executors and driver share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events files as a stream; NTZ times become timestamps, as watermarks need."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all available input; every micro-batch is appended to a table."""
    spark = stream.sparkSession
    out = shared(spark, name)

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda b, n: sink(b.drop("batch"), n)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data/batch=*")


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delivery per message, duplicates of a batch or a later one dropped within the watermark."""
    events = source(spark, sf_dir)
    twice = events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))))
    once = twice.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    return drained(once.select("event_id", "user_id", "event_type"), "dedup")


def dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch goes to the main table or, where the handler fails, to the dead letters."""
    events, out = source(spark, sf_dir), shared(spark, "dlq")

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        failed = F.col("event_type") == "error"
        batch.where(~failed).write.mode("overwrite").parquet(f"{out}/ok/batch={number}")
        batch.where(failed).write.mode("overwrite").parquet(f"{out}/dlq/batch={number}")
        batch.unpersist()

    events.select("event_id", "user_id", "event_type").writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    read = lambda side: spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{out}/{side}/batch=*").withColumn("side", F.lit(side))
    return read("ok").unionByName(read("dlq")).groupBy("side", "event_type").agg(F.count("*").alias("n"))


def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets per partition leave the gate in order; each eleventh is lost, and a tenth arrive late."""
    events = source(spark, sf_dir)
    offset = F.col("event_id").cast("long")
    numbered = events.where("event_id % 11 <> 4").select((F.col("event_id") % 64).alias("partition"), F.floor(offset / 64).alias("offset"), (F.floor(offset / 64) + F.when(offset % 10 == 0, 3).otherwise(0)).alias("arrival"))
    return drained(ordered_gate(numbered, GATE_WINDOW), "gate").groupBy("partition").agg(F.count("*").alias("released"), F.max("offset").alias("last"), F.count_if("early").alias("early"), F.count_if("forced").alias("forced"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State per user after the stream has ended."""
    events = source(spark, sf_dir).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("subject"), F.unix_micros("ts").alias("seq"), F.element_at(F.array(*map(F.lit, ("ASSIGN", "DISPATCH", "START", "COMPLETE", "REQUEUE"))), (F.col("event_id") % 5 + 1).cast("int")).alias("event"))
    return drained(live_states(events), "states", "update").groupBy("subject").agg(F.max_by("state", "accepted").alias("state"), F.max("accepted").alias("accepted"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per type, updated until the stream ends."""
    counts = source(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    last = drained(counts.select(F.unix_millis("w.start").alias("hour_ms"), "event_type", "n"), "windows", "update")
    return last.groupBy("hour_ms", "event_type").agg(F.max("n").alias("n"))


GATE_WINDOW = 8
#: The gate as a recursive fold: arrivals in order, the offset expected, those that wait, and what was let out.
_GATE = """with recursive ev as materialized (select event_id % 64 as partition, event_id // 64 as off, row_number() over (partition by event_id % 64 order by event_id // 64 + case when event_id % 10 = 0 then 3 else 0 end, event_id) as n from {events} where event_id % 11 <> 4),
 st(partition, n, expected, held, released, last, early, forced) as (select distinct partition, B(0), B(0), cast([] as bigint[]), B(0), B(-1), B(0), B(0) from ev
 union all select partition, n, B(case when off < expected or off > expected and not full_ then expected when off = expected then off + 1 + run else list_min(grown) + len(grown) end),
  case when off < expected or (off > expected and not full_) then grown when off = expected then list_filter(held, lambda h: h > off + run) else cast([] as bigint[]) end,
  released + case when off < expected then 1 when off = expected then 1 + run when full_ then len(grown) else 0 end,
  greatest(last, case when off < expected then off when off = expected then off + run when full_ then list_max(grown) else -1 end),
  early + case when off < expected then 0 when off = expected then run when full_ then len(grown) else 0 end, forced + case when off > expected and full_ then len(grown) else 0 end
  from (select s.partition, e.n, e.off, s.expected, s.held, s.released, s.last, s.early, s.forced, case when e.off > s.expected and not list_contains(s.held, e.off) then list_append(s.held, e.off) else s.held end as grown,
   e.off > s.expected and not list_contains(s.held, e.off) and len(s.held) + 1 > 8 as full_, len(list_filter(list_sort(s.held), lambda h, i: h = e.off + i)) as run
   from st s join ev e on e.partition = s.partition and e.n = s.n + 1) z)
 select B(partition) as partition, B(arg_max(released, n)) as released, B(arg_max(last, n)) as last, B(arg_max(early, n)) as early, B(arg_max(forced, n)) as forced from st group by partition having arg_max(released, n) > 0"""

JOBS = {
    "stream_dedup": (dedup, "select event_id, user_id, event_type from {events}"),
    "stream_dlq_split": (dlq_split, "select case when event_type = 'error' then 'dlq' else 'ok' end as side, event_type, count(*) as n from {events} group by 1, 2"),
    "stream_ordered_gate": (gate, _GATE),
    "stream_fsm": (states, None),
    "stream_hourly_counts": (windows, "select B(IDIV(MS(ts), 3600000) * 3600000) as hour_ms, event_type, count(*) as n from {events} group by 1, 2"),
}
