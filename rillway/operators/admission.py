"""Admission with feedback: a queue whose level decides what may enter, and a budget that bounds what leaves.

A refused message does not raise the level, so each admission depends on all before it. But every step is a
function min(max(x + a, b), c) of the level, and so is every run of steps: ranges of the order are composed in
parallel, the few that result are chained, and each range is then walked from the level at its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.operators.cut import cut
from rillway.operators.ordered import ranged

FAR = 1 << 60


def composed(f: tuple[int, int, int], g: tuple[int, int, int]) -> tuple[int, int, int]:
    """First f, then g, each (a, b, c) for min(max(x + a, b), c). Beyond FAR all levels are alike."""
    a, b, c = g
    return max(-FAR, min(FAR, f[0] + a)), min(max(f[1] + a, b), c), min(max(f[2] + a, b), c)


def levels(df: DataFrame, by: list[str], order: list[str], step: Column, least: Column, most: Column) -> DataFrame:
    """``df`` with level, what the steps before a row of its part have come to, and moved, by how much the row's own
    step moves it: a step adds ``step`` and then holds the level within ``least`` and ``most``, where those are not
    null. Levels begin at 0. Rows that tie in the order are taken as equal; parts and ranges are walked in order.
    """
    dealt, _ = ranged(df.select(F.struct(*df.columns).alias("row"), *(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), step.cast("long").alias("_a"), F.coalesce(least.cast("long"), F.lit(-FAR)).alias("_b"), F.coalesce(most.cast("long"), F.lit(FAR)).alias("_c")), [f"_o{i}" for i in range(len(order))])
    part, orders = F.xxhash64(*([f"_by{i}" for i in range(len(by))] or [F.lit(0)])).alias("_part"), [f"_o{i}" for i in range(len(order))]
    dealt = cut(dealt.select("row", part, F.col("_range").cast("long").alias("_range"), *orders, "_a", "_b", "_c"))
    sorted_ = dealt.repartition("_part", "_range").sortWithinPartitions("_part", "_range", *orders)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        for batch in batches:
            out = []
            for p, r, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (p, r) != now:
                    out += [(*now, *f)] if now else []
                    now, f = (p, r), (a, b, c)
                else:
                    f = composed(f, (a, b, c))
            yield _longs(out, ["_part", "_range", "_a", "_b", "_c"])
        if now:
            yield _longs([(*now, *f)], ["_part", "_range", "_a", "_b", "_c"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x = None, 0
        for batch in batches:
            out = []
            for p, r, a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if p != now:
                    now, x = p, 0
                out.append((p, r, x))
                x = min(max(x + a, b), c)
            yield _longs(out, ["_part", "_range", "_start"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = 0
        for batch in batches:
            before, moved, keep = [], [], []
            for start, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                keep.append(start is None)
                if start is not None:
                    x = start
                    continue
                after = min(max(x + a, b), c)
                before.append(x)
                moved.append(after - x)
                x = after
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), pa.array(before, pa.int64()), pa.array(moved, pa.int64())], names=["row", "level", "moved"])

    long = lambda *names: ", ".join(f"{n} long" for n in names)
    whole = sorted_.select("_part", "_range", "_a", "_b", "_c").mapInArrow(functions, long("_part", "_range", "_a", "_b", "_c"))
    starts = whole.repartition("_part").sortWithinPartitions("_part", "_range").mapInArrow(chained, long("_part", "_range", "_start"))
    # A range's start comes as a row before its others, not by a join: Spark would take the join's shuffle for the
    # one asked for here, and then read it map by map where it broadcasts the starts, which takes ranges apart.
    met = dealt.unionByName(starts, allowMissingColumns=True)
    met = met.repartition("_part", "_range").sortWithinPartitions("_part", "_range", F.col("_start").isNull(), *orders).select("row", "_start", "_a", "_b", "_c")
    out = met.mapInArrow(walked, f"row {met.schema['row'].dataType.simpleString()}, level long, moved long")
    return out.select("row.*", "level", "moved")


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def admitted(log: DataFrame, by: list[str], order: list[str], limit: int = S.LAG_LIMIT) -> DataFrame:
    """``log`` with level, moved and refused. It has op, publish or drain, and budget, how many messages a drain
    may take, null for all. A publish is refused where the level has reached the limit, and leaves it as it is;
    a drain takes what there is, up to its budget, so moved says how much it took, as a negative number."""
    publish = F.col("op") == "publish"
    step = F.when(publish, 1).otherwise(-F.coalesce(F.col("budget"), F.lit(FAR)))
    out = levels(log, by, order, step, F.when(publish, None).otherwise(0), F.when(publish, limit))
    return out.withColumn("refused", (F.col("op") == "publish") & (F.col("moved") == 0))
