"""One verdict on a replayed journal: nothing lost, nothing done twice, and the replay comes to the same state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway import schemas as S

ENDS = ("COMPLETE", "CANCEL", "FAIL")


def verdicts(records: DataFrame, live: DataFrame, replayed: DataFrame, scenario: Column) -> DataFrame:
    """(scenario, created, duplicates, lost, open, most_ends, differing, consistent), and all of them in the row
    whose scenario is null.

    ``records`` is the journal, ``live`` and ``replayed`` are ``applier.fold_tasks`` of it and of a copy; ``scenario``
    reads a task_id and is never null. duplicates are task_created of a task that was there, lost are created tasks
    without a state and states that nobody created, open are tasks that have not ended, most_ends is the greatest
    number of accepted ends of one task, differing are tasks whose state, vehicle or preemptions the copy has
    otherwise. Consistent is: none lost, at most one end, none differing. What comes here is added up per task
    before it is dealt by scenario."""
    made = records.where("kind = 'task_created'").groupBy("task_id").agg(F.count("*").alias("creates"))
    ended = F.size(F.filter("steps", lambda x: x["accepted"] & x["event"].isin(*ENDS)))
    here = live.where("present").select("task_id", F.struct("state", "vehicle_id", "preempted").alias("a"), ended.alias("ends"))
    again = replayed.where("present").select("task_id", F.struct("state", "vehicle_id", "preempted").alias("b"))
    per = made.join(here, "task_id", "full").join(again, "task_id", "full").withColumn("scenario", scenario)
    sums = per.rollup("scenario").agg(
        F.coalesce(F.sum("creates"), F.lit(0)).alias("created"), F.coalesce(F.sum(F.col("creates") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("creates").isNull() | F.col("a").isNull()).alias("lost"),
        F.count_if(~F.col("a.state").isin(*S.TERMINAL)).alias("open"), F.coalesce(F.max("ends"), F.lit(0)).cast("long").alias("most_ends"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"),
    )
    return sums.withColumn("consistent", (F.col("lost") == 0) & (F.col("most_ends") <= 1) & (F.col("differing") == 0))
