"""Planned silence of vehicles, and alerts from a table of rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PHASES = "vehicle long, tick long, phase string"
RULES = "rule string, metric string, threshold double, severity string, comparison string, cooldown_ms long"


def silence(plan: DataFrame) -> DataFrame:
    """(vehicle, tick, phase) from windows (vehicle, start, duration, line); phase is silent or resume.

    At each tick the lines of the plan are looked at in their order. A line that starts now silences its vehicle;
    any other line of a vehicle that is silent and whose time is over lets it resume. So a window that starts
    within another is lost; one that starts at the end of another is lost too where it is its vehicle's first
    line; and one of no length ends at the vehicle's next line in the same tick, which is lost if it starts then,
    or without a next line a tick later. Lines with a null are passed over. Plans stream through by vehicle,
    holding one window.
    """
    lines = Window.partitionBy("vehicle").orderBy("line")
    whole = plan.select(*(F.col(c).cast("long").alias(c) for c in ("vehicle", "start", "line", "duration"))).na.drop()
    rows = whole.withColumns({"first": F.row_number().over(lines) == 1, "next": F.lead("line").over(lines)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, until, lost = None, None, None
        for batch in batches:
            out = []
            for vehicle, start, line, duration, first, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if vehicle != now:
                    if until is not None:
                        out.append((now, until, "resume"))
                    now, until, lost = vehicle, None, None
                if until is not None and start < until or (start, line) == lost:
                    continue
                if until is not None:
                    out.append((vehicle, until, "resume"))
                    ended, until = until, None
                    if start == ended and first:
                        continue
                out.append((vehicle, start, "silent"))
                if duration <= 0 and following is not None:
                    out.append((vehicle, start, "resume"))
                    lost = (start, following)
                else:
                    until = start + max(duration, 1)
            yield _phases(out)
        if until is not None:
            yield _phases([(now, until, "resume")])

    return rows.repartition("vehicle").sortWithinPartitions("vehicle", "start", "line").mapInArrow(run, PHASES)


def _phases(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["vehicle", "tick", "phase"])


def alerts(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, severity, subject, value, threshold, at_ms) that fire: ``readings`` (metric, subject, value, at_ms)
    against ``rules`` (rule, metric, threshold, severity, comparison, cooldown_ms).

    A value breaches above the threshold, or below it where comparison is <. Per rule and subject an alert fires
    if the cooldown has passed since the last that fired; of equal times the least value comes first. Rules join
    by metric, only breaches are dealt, and one last alert is held at a time.
    """
    met = readings.select("metric", "subject", F.col("value").cast("double").alias("value"), F.col("at_ms").cast("long").alias("at_ms")).join(rules, "metric")
    over = F.when(F.col("comparison") == "<", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    hits = met.where(over).select("rule", "subject", "at_ms", "value", F.col("cooldown_ms").cast("long").alias("cooldown_ms"), "threshold", "severity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for rule, subject, t, _, wait in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                if (rule, subject) != now:
                    now, last = (rule, subject), None
                keep.append(last is None or t - last >= wait)
                last = t if keep[-1] else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    fired = hits.repartition("rule", "subject").sortWithinPartitions("rule", "subject", "at_ms", "value").mapInArrow(run, hits.schema)
    return fired.select("rule", "severity", "subject", "value", "threshold", "at_ms")
