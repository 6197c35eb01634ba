"""Operators on ordered, keyed logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway import schemas as S
from rillway.operators.cut import cut


#: Rows that one range of an order holds, about; quantiles that bound ranges; most ranges between two quantiles.
RANGE_ROWS = 200_000
QUANTILES, MOST_BETWEEN = 64, 1 << 10


def _position(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column)


def _place(x: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted ``bounds`` lie below x, by halving."""
    if not bounds:
        return F.lit(first)
    m = len(bounds) // 2
    return F.when(x <= F.lit(bounds[m]), _place(x, bounds[:m], first)).otherwise(_place(x, bounds[m + 1 :], first + m + 1))


def ranged(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with _range, which rises with the order, and the number of ranges, about.

    Ranges are bounded by quantiles of the first column, so that far-off values do not crowd the others; where
    more ranges are asked for than QUANTILES, those between two quantiles are of equal width. A value that holds
    several quantiles is cut by quantiles of the next column. One aggregate is read at build time, and a second
    where there is such a value. Nulls come first.
    """
    x = _position(df, order[0])
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    rows, cuts, low, high = df.agg(F.count("*"), F.percentile_approx(x, shares, 100 * QUANTILES), F.min(x), F.max(x)).first()
    if not cuts:
        return df.withColumn("_range", F.lit(-1)), 1
    wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows // RANGE_ROWS)
    step = max(1, QUANTILES // wanted)
    bounds = sorted(set(cuts[step - 1 :: step]))
    between = min(MOST_BETWEEN, -(-wanted // QUANTILES))
    at, inner = _place(x, bounds), F.lit(0)
    if between > 1:
        edges = F.array(*(F.lit(float(b)) for b in (low, *bounds, high)))
        left, right = (F.element_at(edges, (at + i).cast("int")) for i in (1, 2))
        inner = F.when(right <= left, 0).otherwise(F.least(F.floor((x - left) / (right - left) * between), F.lit(between - 1)))
    slots = between
    heavy = sorted({c for c in bounds if cuts.count(c) > step})
    if heavy and len(order) > 1:
        # a value that holds several quantiles comes last among those up to it, and is cut by the next column
        y = _position(df, order[1])
        inside = df.where(x.isin(heavy)).groupBy(x.alias("_x")).agg(F.percentile_approx(y, shares, 100 * QUANTILES).alias("c")).collect()
        for value, some in inside:
            inner = F.when(x == F.lit(value), _place(y, sorted(set(some or [])), between)).otherwise(inner)
        slots = between + QUANTILES
    return df.withColumn("_range", F.when(x.isNull(), -1).otherwise(at * slots + inner).cast("int")), (len(bounds) + 1) * slots


def running(df: DataFrame, order: list[str], sums: dict[str, tuple[list[str], Column]]) -> DataFrame:
    """``df`` with running sums in the given order: name -> (columns that part the rows, value), each row's own
    value included.

    Rows are dealt to ranges of the order and summed within them; what the ranges before hold
    is a table of one row per range and part. No task holds a whole part, and all sums share one shuffle.
    """
    dealt, _ = ranged(df, order)
    out = dealt
    for name, (by, value) in sums.items():
        per = dealt.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
        before = F.sum("_sum").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        per = per.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_range").alias("_at"), F.coalesce(before, F.lit(0)).alias(f"_before_{name}"))
        within = F.sum(value).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(name, within)
        same = F.col("_range") == F.col("_at")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        out = out.join(per, same).withColumn(name, F.col(name) + F.col(f"_before_{name}")).drop("_at", f"_before_{name}", *(f"_by_{c}" for c in by))
    return out.drop("_range")


def placed(df: DataFrame, by: list[str], high: str, order: list[str], name: str) -> DataFrame:
    """``df`` with places from 1 within ``by``: greater values of ``high`` first, then in order. Places within
    one value are running counts; the rows of the greater values, few as those are, come before."""
    out = running(df, order, {name: ([*by, high], F.lit(1).cast("long"))})
    n = df.groupBy(*(F.col(c).alias(f"_{c}") for c in by), F.col(high).alias("_high")).agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*(f"_{c}" for c in by) if by else [F.lit(0)]).orderBy(F.col("_high").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    same = F.col(high).eqNullSafe(F.col("_high"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out.join(before, same).withColumn(name, F.col(name) + F.col("_before")).drop("_before", "_high", *(f"_{c}" for c in by))


def with_sequence(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Gap-free numbers from 1 in the given order."""
    return running(df, order, {name: ([], F.lit(1).cast("long"))})


def with_offsets(messages: DataFrame, order: list[str], topic: str, partition: str = "partition") -> DataFrame:
    """Per-partition offsets from 0 and the default message id topic-partition-offset."""
    out = running(messages, order, {"offset": ([partition], F.lit(1).cast("long"))}).withColumn("offset", F.col("offset") - 1)
    return out.withColumn("msg_id", F.concat_ws("-", F.lit(topic), F.col(partition).cast("string"), F.col("offset").cast("string")))


def committed(acks: DataFrame, partition: str = "partition") -> DataFrame:
    """(partition, head, committed): the contiguous acknowledged prefix. ``acks`` has offset and acked."""
    return acks.groupBy(partition).agg((F.max("offset") + 1).alias("head"), F.coalesce(F.min(F.when(~F.col("acked"), F.col("offset"))), F.max("offset") + 1).alias("committed"))


def first_successful(deliveries: DataFrame, key: list[str], order: list[Column], ok: Column) -> DataFrame:
    """Keeps the first successful delivery per key."""
    return deliveries.where(ok).withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def attempts(failures: DataFrame, key: list[str], order: list[Column], most: int = S.MAX_RETRIES) -> DataFrame:
    """Running failures per key and whether that sends the message to the dead letters."""
    n = F.count("*").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    return failures.withColumn("attempt", n).withColumn("dead", F.col("attempt") > most)


def redriven(failures: DataFrame, key: list[str], rounds: int = 3, most: int = S.MAX_RETRIES) -> DataFrame:
    """(key..., failures, redrives, recovered): a message that fails beyond its retries is dead; each redrive
    sends it again under its own id, whose attempts are kept, so that one more failure kills it again, up to
    ``rounds`` times."""
    n = failures.groupBy(*key).agg(F.count("*").alias("failures")).where(F.col("failures") > most)
    return n.withColumn("redrives", F.least(F.col("failures") - most, F.lit(rounds)).cast("long")).withColumn("recovered", F.col("failures") <= most + rounds)


def crash_recovery(acks: DataFrame, read: int, partition: str = "partition") -> DataFrame:
    """Per partition, after a crash with the offsets below ``read`` delivered: the committed prefix, where
    reading resumes, how many offsets come again, and how many of those had been handled already.

    ``acks`` has offset and acked.
    """
    seen = acks.where(F.col("offset") < read)
    prefix = seen.groupBy(partition).agg((F.max("offset") + 1).alias("cursor"), F.coalesce(F.min(F.when(~F.col("acked"), F.col("offset"))), F.max("offset") + 1).alias("resume"), F.count_if("acked").alias("handled"))
    return prefix.select(partition, "cursor", "resume", (F.col("cursor") - F.col("resume")).alias("again"), (F.col("handled") - F.col("resume")).alias("suppressed"))


def command_outcomes(submissions: DataFrame, key: list[str], order: list[str], fails: Column, confirmed: Column) -> DataFrame:
    """``submissions`` with outcome: a command is applied once, by its first submission that neither fails nor
    stays unconfirmed; those before it released their claim, those after it are duplicates."""
    at = F.struct(*order)
    first = submissions.where(~fails & confirmed).groupBy(*key).agg(F.min(at).alias("_first"))
    same = submissions.join(first, key, "left")
    outcome = F.when(at > F.col("_first"), "duplicate").when(fails, "failed").when(~confirmed, "unconfirmed").otherwise("applied")
    return same.withColumn("outcome", outcome).drop("_first")


def out_of_order(arrivals: DataFrame, partition: str, at: list[str]) -> DataFrame:
    """Per partition: the offset expected next once all has arrived, and how many messages came before an
    offset that stands before theirs.

    A reader that holds early messages back releases them when the hole fills, so a message is early exactly
    if some lower offset arrives later, or never does: a running maximum of arrivals by offset, per range of offsets and
    then over the maxima of the ranges. Redelivered offsets count once, by their first arrival.
    """
    first = arrivals.groupBy(partition, "offset").agg(F.min(F.struct(*at)).alias("at"))
    dealt, _ = ranged(first, ["offset"])
    order = Window.partitionBy("_range", partition).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_part").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(F.col(partition).alias("_part"), F.col("_range").alias("_r")).agg(F.max("at").alias("top")).select("_part", "_r", F.max("top").over(ahead).alias("before"))
    known = dealt.withColumn("top", F.max("at").over(order)).join(per, F.col(partition).eqNullSafe(F.col("_part")) & (F.col("_range") == F.col("_r")))
    late = F.coalesce((F.col("top") > F.col("at")) | (F.col("before") > F.col("at")), F.col("top") > F.col("at"), F.col("before") > F.col("at"), F.lit(False))
    # the first offset that is missing: up to there an offset is the number of those before it
    holes = running(first.select(partition, "offset"), ["offset"], {"_n": ([partition], F.lit(1).cast("long"))})
    expected = holes.groupBy(F.col(partition).alias("_of")).agg(F.count_if(F.col("offset") == F.col("_n") - 1).alias("expected"))
    met = known.join(expected, F.col(partition).eqNullSafe(F.col("_of")))
    return met.groupBy(partition, "expected").agg(F.count_if(late | (F.col("offset") > F.col("expected"))).alias("late"))


def flush(waiting: DataFrame, subject: list[str], order: Column, refused: Column) -> DataFrame:
    """``waiting`` with published: a subject's rows go out in order until one is refused, which holds back the rest.
    A null refusal is none; rows that tie with a refused one are held back."""
    stop = waiting.where(refused).groupBy(*(F.col(s).alias(f"_of_{s}") for s in subject)).agg(F.min(order).alias("_stop"))
    same = F.lit(True)
    for s in subject:
        same = same & F.col(s).eqNullSafe(F.col(f"_of_{s}"))
    met = waiting.withColumn("_order", order).join(stop, same, "left")
    return met.select(*waiting.columns, F.coalesce(F.col("_order") < F.col("_stop"), F.col("_stop").isNull()).alias("published"))


def cooldown(readings: DataFrame, key: list[str], at: Column, value: Column, threshold: float, cooldown_ms: int) -> DataFrame:
    """Alerts that fire: breached, and at least the cooldown after the last that fired for the key.

    Only breaches are dealt. They stream through in order, one key after another, and nothing but the last
    alert is held; equal times fire once, with the least value.
    """
    breaches = readings.select(*key, at.cast("long").alias("at_ms"), value.cast("double").alias("value")).where(F.col("value") > threshold)
    sorted_ = breaches.repartition(*key).sortWithinPartitions(*key, "at_ms", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            keep = []
            for *k, t in zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True):
                if k != now:
                    now, last = k, None
                keep.append(last is None or t - last >= cooldown_ms)
                last = t if keep[-1] else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    return sorted_.mapInArrow(run, sorted_.schema)


def percentiles(df: DataFrame, key: list[str], value: str, ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles and the usual summary; an empty group has none. A percentile of 0 or less is
    the minimum, one of 100 or more the maximum.

    Equal values are counted once, before anything is dealt, and ranks are running sums of those counts.
    """
    kind = df.schema[value].dataType.simpleString()
    counted = cut(df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n")))
    ranked = running(counted, [value], {"_upto": (key, F.col("_n"))})
    total = counted.groupBy(*(F.col(k).alias(f"_key_{k}") for k in key)).agg(F.sum("_n").alias("_total"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    met = ranked.join(total, same)
    at = lambda p: F.min(F.when(F.col("_upto") >= F.ceil(F.lit(min(100, max(0, p))) * F.col("_total") / 100), F.col(value))).cast(kind)
    mean = F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 3)
    return met.groupBy(*key).agg(F.sum("_n").alias("count"), F.min(value).alias("min"), mean.alias("mean"), *(at(p).alias(f"p{p}") for p in ps), F.max(value).alias("max"))
