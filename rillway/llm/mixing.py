"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is the mean number of copies r of each of its documents: floor(r) copies
are certain and the fraction is an inclusion probability. The flight phase moves the probabilities of
three documents at a time along the null vector of (1, size), so that documents and words expected stay
exact while one of the three becomes 0 or 1. Each chunk of a source leaves at most two undecided; these
meet in chunks again, until one chunk per source is left. Its last document is taken in part, which puts
the words of the source within one of their target. Chunks are of bounded size, so a source of any share is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.llm import textbytes as tb
from rillway.llm.store import bounded, settle

#: The weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
MOST = 3
CHUNK_ROWS = 4096
REPEATS = 10_000
BROADCAST_SOURCES = 5_000
SURE = 1e-9


def sizes(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """Words of each whole text beside the columns ``keep``; a null text has none."""
    kept = bounded(docs).select(F.struct(*(c.alias(k) for k, c in keep.items())).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(tb.words(data, offs)[2]) for _, _, data, offs in tb.texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], names=["row", "size"])

    got = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, size long")
    return got.select("row.*", "size")


def numbered(per: DataFrame) -> DataFrame:
    """``per`` (settled by this) with place: 0, 1, 2 ... by source code point, null last. Sources are sorted
    in ranges; only the number of rows of each range comes to the driver."""
    per = settle(per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    before, offsets = 0, []
    for p, n in sorted(per.groupBy(part.alias("p")).agg(F.count("*")).collect()):
        offsets += [F.lit(p), F.lit(before)]
        before += n
    return per.withColumn("place", F.element_at(F.create_map(*offsets), part) + F.col("place").bitwiseAND((1 << 33) - 1)) if offsets else per


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) by water filling.

    All sources share one level per unit of weight; what a source's cap leaves raises the level of the rest.
    Each round is one sum over the capped sources, until their set no longer grows.
    """
    per = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    per = per.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    all_size, all_w = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    capped, level = (0, 0, 0.0), 0.0
    while True:
        left = all_w - capped[2]
        level = (all_size - most * capped[1]) / left if left > 0 else float("inf")
        over = F.lit(level) * F.col("w") > most * F.col("source_size")
        now = tuple(per.where(over).agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first())
        if now[0] <= capped[0]:
            break
        capped = now
    target = F.least(F.lit(level) * F.col("w"), (most * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def flight(pi: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Moves probabilities until at most two are strictly between 0 and 1; sums of pi and pi * size stay."""
    pi = pi.astype(float).copy()
    held: list[int] = []
    nxt, n, k = 0, len(pi), 0
    while True:
        while len(held) < 3 and nxt < n:
            if SURE < pi[nxt] < 1 - SURE:
                held.append(nxt)
            nxt += 1
        if len(held) < 3:
            return pi
        a, b, c = held
        u = [float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b])]
        if not any(u):
            u = [1.0, -1.0, 0.0]
        p = [pi[a], pi[b], pi[c]]
        up = min((1 - x) / y if y > 0 else -x / y for x, y in zip(p, u, strict=True) if y)
        down = min(x / y if y > 0 else (x - 1) / y for x, y in zip(p, u, strict=True) if y)
        step = up if draws[k] * (up + down) < down else -down
        k += 1
        for i, x, y in zip(held, p, u, strict=True):
            z = x + step * y
            pi[i] = 0.0 if z < SURE else 1.0 if z > 1 - SURE else z
        held = [i for i in held if 0.0 < pi[i] < 1.0]


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lets go of the document total: moves the last undecided along (size, -size) until one is left.

    The one that is left keeps its fraction; it is taken in part, so the word total stays as expected.
    """
    pi = pi.copy()
    while len(at := np.flatnonzero((pi > 0) & (pi < 1))) > 1:
        a, b = at[:2]
        if not size[a] or not size[b]:
            pi[a if not size[a] else b] = 0.0
            continue
        step = min((1 - pi[a]) / size[b], pi[b] / size[a])
        pi[a], pi[b] = pi[a] + step * size[b], pi[b] - step * size[a]
        pi[at] = np.where(pi[at] < SURE, 0.0, np.where(pi[at] > 1 - SURE, 1.0, pi[at]))
    return pi


def apart(sized: DataFrame) -> DataFrame:
    """Equal rows with a number, turn, from 0 on. They are counted before they are dealt and made rows again
    in steps of REPEATS, so that however many there are they meet in no task."""
    counted = sized.groupBy(*sized.columns).agg((F.count("*") - 1).alias("turn"))
    last = F.floor(F.col("turn") / REPEATS)
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rest = F.least(F.col("turn") - F.col("step") * REPEATS, F.lit(REPEATS - 1).cast("long"))
    each = steps.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), rest)))
    return each.withColumn("turn", F.col("step") * REPEATS + F.col("at")).drop("step", "at")


def copies(sized: DataFrame, seed: int = 9, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``sized`` (source, size and any others) with source_size, target, copies (whole) and part (words of one more, cut copy).

    A source without words gets target 0 and no copies. Repeated rows are drawn apart. Draws follow from
    the rows and the seed, so reruns agree. An empty table gives an empty result.
    """
    names = [c for c in sized.columns if c not in ("source", "size")]
    others = [f"o_{i}" for i in range(len(names))]  # the caller's names cannot clash with those used here
    sized = sized.select("source", "size", *(F.col(f"`{c}`").alias(o) for c, o in zip(names, others, strict=True)))
    sized = apart(sized)
    per = settle(targets(sized, weights, most))
    n_sources = per.count()
    few = n_sources <= BROADCAST_SOURCES
    per = per.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    rows = sized.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("rate", rate).withColumn("sure", F.floor(F.col("rate") + SURE)).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - F.col("sure")))
    rows = rows.withColumn("pi", F.when(F.col("pi") < SURE, 0.0).otherwise(F.col("pi"))).drop("rate").withColumn("h", F.xxhash64(*others, "size", "turn", F.lit(seed))).drop("turn")
    schema = rows.schema

    def stage(final: bool):
        def one(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.drop(columns="chunk").sort_values(["h", "size"], kind="stable")
            draws = np.random.Generator(np.random.PCG64([seed, int(frame["h"].iloc[0]) & 0xFFFFFFFF, len(frame)])).random(len(frame))
            size = frame["size"].to_numpy()
            pi = flight(frame["pi"].to_numpy(), size, draws)
            return frame.assign(pi=land(pi, size) if final else pi)

        return one

    rows = settle(rows)
    done, open_ = [rows.where("NOT (pi > 0 AND pi < 1)")], rows.where("pi > 0 AND pi < 1")
    while True:
        count = open_.groupBy("source").agg(F.ceil(F.count("*") / chunk_rows).alias("chunks")).withColumnRenamed("source", "of")
        most_chunks = count.agg(F.max("chunks")).first()[0]
        if most_chunks is None:
            break
        final = most_chunks == 1
        dealt = open_.join(F.broadcast(count) if few else count, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(len(done))), F.col("chunks"))).drop("chunks")
        moved = settle(dealt.groupBy("source", "chunk").applyInPandas(stage(final), schema))
        done.append(moved if final else moved.where("NOT (pi > 0 AND pi < 1)"))
        open_ = moved.where("pi > 0 AND pi < 1")
        if final:
            break
    out = reduce(DataFrame.unionByName, done)
    cut = F.when(F.col("pi") < 1, F.round(F.col("pi") * F.col("size"))).otherwise(F.lit(0.0)).cast("long")
    out = out.withColumn("copies", (F.col("sure") + F.floor("pi")).cast("long")).withColumn("part", cut)
    return out.select(*(F.col(o).alias(c) for c, o in zip(names, others, strict=True)), "source", "size", "source_size", "target", "copies", "part")


def first_words(rows: DataFrame, text_col: str, count_col: str) -> DataFrame:
    """``rows`` with the text cut after so many words; a count beyond the text's words leaves it whole."""
    kept = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(text_col).alias("text"), F.col(count_col).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                ends = tb.words(raw, np.array([0, len(raw)]))[1]
                out.append(text if n >= len(ends) else raw[: ends[n - 1]].tobytes().decode() if n > 0 else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    done = kept.mapInArrow(run, f"row {kept.schema['row'].dataType.simpleString()}, text string")
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in rows.columns))
