"""Near duplicates: MinHash signatures in an LSH forest, exact confirmation, connected components.

Every tree of the forest reads its own eight hashes of the signature as one key. Sorted by that key, texts
that resemble one another stand side by side: candidates are neighbours that share at least ``DEPTH``
leading hashes. Regions of the order with many texts are cut deeper for a first look, so that no task holds
more than a region cut at full depth and salted. Candidates are confirmed on full shingle sets, first the
next neighbours alone, then whatever in a region is not in one component yet. Last, each crowded region is
compared as a whole: it is dealt into blocks, every two blocks meet in a task of their own, and what their
marks leave is confirmed block by block. Equal sets are one class from the start and are never paired with
one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm import textbytes as tb
from rillway.llm.store import bounded, settle

TREES, LEVELS, DEPTH = 16, 8, 4
REGION = 256
BLOCK = 512
BLOCK_BYTES = 12 << 20
GROUP_BYTES = 32 << 20
EDGES_PER_PART = 200_000
BROADCAST_IDS = 400_000
MARKS = 1024
_MARK_FACTORS = tb.mix(np.arange(1 << 20, (1 << 20) + MARKS, dtype=np.uint64)) | np.uint64(1)
_FACTORS = tb.mix(np.arange(1, TREES * LEVELS + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sorted shingle hashes, bounds per text) of lower-cased texts.

    A text with fewer words than the width has its whole word sequence as its one shingle; a text without
    words has none.
    """
    low = tb.lower_ascii(data)
    starts, ends, first = tb.words(low, offs)
    n_words = np.diff(first)
    h = tb.span_hash(low, starts, ends)
    of = tb.owner(first)
    grams = tb.window_hash(h, width)
    at = np.flatnonzero(of[: len(grams)] == of[width - 1 :]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    whole = tb.sequence_hash(h, first[short], first[short + 1])
    keys, texts = np.concatenate([grams[at], whole]), np.concatenate([of[at] if len(at) else at, short])
    order = np.lexsort((keys, texts))
    keys, texts = keys[order], texts[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
    keys, texts = keys[new], texts[new]
    return keys, np.searchsorted(texts, np.arange(len(offs)))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, one row per text with shingles, one column per hash function."""
    filled = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(filled), len(_FACTORS)), np.uint32)
    for i, f in enumerate(_FACTORS):
        x = keys * f
        x ^= x >> np.uint64(29)
        out[:, i] = np.minimum.reduceat((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32), filled) if len(filled) else 0
    return out


def sketch(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature): equal (n, set_a, set_b) means equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tb.texts(batch.column(1)):
                keys, bounds = shingles(data, offs, width)
                n = np.diff(bounds)
                run_a = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys, dtype=np.uint64)])
                run_b = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(keys), dtype=np.uint64)])
                a, b = (r[bounds[1:]] - r[bounds[:-1]] for r in (run_a, run_b))
                sig = signatures(keys, bounds)
                row = sig.shape[1] * 4
                ends = np.concatenate([[0], np.cumsum((n > 0) * row)]).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), blob], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    picked = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def forest(reps: DataFrame) -> DataFrame:
    """One row per class and tree: the tree, its key's leading hashes, the rest of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(TREES, dtype=np.int32)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for s in range(0, len(ids), 2048):
                some = ids[s : s + 2048]
                sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1).slice(s, len(some))), np.uint32).reshape(len(some), TREES, LEVELS).astype(np.uint64)
                lead = [tb.mix(reduce(lambda h, x: tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + x), [sig[:, :, k] for k in range(d)]) + tree.astype(np.uint64)) for d in (DEPTH, 6, LEVELS)]
                rest = [(sig[:, :, k] << np.uint64(32) | sig[:, :, k + 1]) for k in (DEPTH, 6)]
                cols = [np.repeat(some, TREES), *(x.reshape(-1).view(np.int64) for x in (*lead, *rest))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "p4", "p6", "p8", "r1", "r2"])

    return reps.select("id", "signature").mapInArrow(run, "id long, p4 long, p6 long, p8 long, r1 long, r2 long")


def regions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, part, r1, r2, id, whole): the texts that stand together in some order, two at least, and
    whether that is their whole region; and (region, id) of the crowded regions, whole.

    A region is the texts that share DEPTH hashes; above REGION texts it is crowded, and cut at six, then at
    all eight hashes. Texts still together then agree in a whole key; they are dealt by hash of id into parts
    of about REGION, and each part also gets the region's least id. What the cuts part is left to
    ``across_blocks``.
    """
    out, open_ = [], rows
    same = ["part", "r1", "r2", "id", "whole"]
    for key in ("p4", "p6", "p8"):
        met = open_.join(open_.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), key)
        out.append(met.where(F.col("n") <= REGION).withColumns({"part": F.lit(0).cast("long"), "whole": F.lit(key == "p4")}).select(F.col(key).alias("region"), *same))
        open_ = met.where(F.col("n") > REGION)
        if key != "p8":
            open_ = settle(open_.drop("n"))
        if key == "p4":
            crowded = open_.select(F.col("p4").alias("region"), "id")
    parts = F.ceil(F.col("n") / REGION)
    out.append(open_.withColumns({"part": F.pmod(F.xxhash64("id"), parts), "whole": F.lit(False)}).select(F.col("p8").alias("region"), *same))
    least = open_.groupBy("p8", "n").agg(F.min("id").alias("id")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)))
    first = F.lit(-(1 << 63))
    out.append(least.select(F.col("p8").alias("region"), "part", first.alias("r1"), first.alias("r2"), "id", F.lit(False).alias("whole")))
    return reduce(DataFrame.unionByName, out), crowded


def next_neighbours(places: DataFrame) -> DataFrame:
    """(a, b) with a < b: each text and the one after it in its region."""
    order = Window.partitionBy("region", "part").orderBy("r1", "r2", "id")
    return _pairs(places.select("id", F.lead("id").over(order).alias("o")).where("o IS NOT NULL"))


def bit_marks(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One bit of each of MARKS further MinHash values, packed into longs, one row per text with shingles."""
    filled = bounds[:-1][np.diff(bounds) > 0]
    bits = np.empty((len(filled), MARKS), np.uint8)
    for i, f in enumerate(_MARK_FACTORS):
        bits[:, i] = (np.minimum.reduceat(keys * f, filled) >> np.uint64(24)) & np.uint64(1) if len(filled) else 0
    return np.packbits(bits, axis=1).view(np.int64)


def mismatches(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for i in range(MARKS // 64):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def most_mismatches(percent: int) -> int:
    """How many marks of linked texts may differ, 4.5 deviations allowed."""
    p = (100 - percent) / 200
    return int(MARKS * p + 4.5 * (MARKS * p * (1 - p)) ** 0.5) + 1


def strangers(places: DataFrame, label: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: all pairs of a region of up to REGION texts that are not in one component yet, but
    whose marks differ no more often than linked texts' would, 4.5 deviations allowed. What is too unlike is
    told inside the window, so it makes no rows. Crowded regions are left to ``across_blocks``."""
    most = most_mismatches(percent)
    known = places.where("whole").join(label.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").join(marks, "id").select("region", "part", "r1", "r2", "id", F.coalesce("label", "id").alias("label"), "marks")
    order = Window.partitionBy("region", "part").orderBy("r1", "r2", "id")
    ahead = F.collect_list(F.struct("id", "label", "marks")).over(order.rowsBetween(1, REGION))
    fits = F.filter("ahead", lambda x: F.when(x["label"] != F.col("label"), mismatches(x["marks"], F.col("marks")) <= most).otherwise(F.lit(False)))
    met = known.withColumn("ahead", ahead).select("id", F.transform(fits, lambda x: x["id"]).alias("o")).where(F.size("o") > 0)
    # a pair met in several trees is made a row once; a text has at most TREES * REGION partners here
    once = met.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("o"))).alias("o"))
    return _pairs(once.select("id", F.explode("o").alias("o")))


def _pairs(met: DataFrame) -> DataFrame:
    return met.where("id <> o").select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, items, marks) of the documents named: their shingle sets and bit marks; their number decides whether the ids are broadcast."""
    picked = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ids = settle(ids)
    few = ids.count() <= BROADCAST_IDS
    picked = picked.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tb.texts(batch.column(1)):
                keys, bounds = shingles(data, offs, width)
                blob = [keys[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                packed = bit_marks(keys, bounds)
                ends = np.append(0, np.cumsum((np.diff(bounds) > 0) * packed.shape[1])).astype(np.int32)
                marks = pa.ListArray.from_arrays(pa.array(ends), pa.array(packed.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(blob, pa.binary()), marks], names=["id", "items", "marks"])

    return picked.mapInArrow(run, "id long, items binary, marks array<long>")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x n y| >= percent * |x u y|, of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A n B| >= percent * |A u B|."""
    left = pairs.join(full.select(F.col("id").alias("a"), F.col("items").alias("sa")), "a")
    both = left.join(full.select(F.col("id").alias("b"), F.col("items").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def across_blocks(crowded: DataFrame, label: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(g, a, b) with a < b: out of all pairs of each crowded region those that are not in one component yet
    and whose marks allow a link. A region is dealt by hash of id into blocks of about BLOCK texts and
    BLOCK_BYTES of sets, and every two blocks meet in one task, named g."""
    named = crowded.join(label.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left").select("region", "id", F.coalesce("label", "id").alias("label"))
    known = settle(named.join(full.select("id", F.length("items").cast("long").alias("size")), "id"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES))
    sizes = known.groupBy("region").agg(blocks.alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    dealt = known.join(sizes.select("region", "blocks"), "region").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("region", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "label")
    most = most_mismatches(percent)

    def run(group: pa.Table) -> pa.Table:
        ids, label, block, x, y = (group[c].to_numpy() for c in ("id", "label", "block", "x", "y"))
        bits = group["marks"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        right = np.flatnonzero(block == y[0])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in np.flatnonzero(block == x[0]):
            met = right[right > i] if x[0] == y[0] else right
            met = met[label[met] != label[i]]
            near = ids[met[np.bitwise_count(bits[met] ^ bits[i]).sum(axis=1) <= most]]
            a.append(np.minimum(near, ids[i]))
            b.append(np.maximum(near, ids[i]))
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"g": pa.array(np.full(len(a), group["g"][0].as_py() if len(a) else 0, np.int64)), "a": pa.array(a), "b": pa.array(b)})

    met = dealt.join(full.select("id", "marks"), "id").select("region", "x", "y", F.xxhash64("region", "x", "y").alias("g"), "block", "id", "label", "marks")
    return met.groupBy("region", "x", "y").applyInArrow(run, "g long, a long, b long").groupBy("a", "b").agg(F.min("g").alias("g")).select("g", "a", "b")


def linked_among(flat: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets are alike: a[k] and b[k] name the sets flat[bounds[i] : bounds[i + 1]]; a is sorted."""
    names, own = np.unique(flat, return_inverse=True)
    mark, size = np.zeros(len(names), np.int32), np.diff(bounds)
    keep = np.zeros(len(a), bool)
    edge = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)) if len(a) else np.zeros(1, np.int64)
    for s, e in zip(edge, edge[1:], strict=False):
        i = a[s]
        may = np.flatnonzero(100 * np.minimum(size[b[s:e]], size[i]) >= percent * np.maximum(size[b[s:e]], size[i])) + s
        if not len(may):
            continue
        mark[own[bounds[i] : bounds[i + 1]]] = 1
        with_ = b[may]
        met = mark[np.concatenate([own[bounds[j] : bounds[j + 1]] for j in with_])]
        common = np.add.reduceat(met, np.cumsum(size[with_]) - size[with_])
        keep[may] = 100 * common >= percent * (size[i] + size[with_] - common)
        mark[own[bounds[i] : bounds[i + 1]]] = 0
    return keep


def confirmed_together(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The linked among (g, a, b): a group's sets are sent to its task once, however many pairs it has.

    Groups whose sets take more than GROUP_BYTES are confirmed pair by pair instead.
    """
    named = settle(pairs.select("g", F.col("a").alias("id")).union(pairs.select("g", "b")).distinct())
    sizes = named.join(full.select("id", F.length("items").cast("long").alias("size")), "id").groupBy("g").agg(F.sum("size").alias("size"))
    large = settle(sizes.where(F.col("size") > GROUP_BYTES).select("g"))

    def run(pair: pa.Table, sets_: pa.Table) -> pa.Table:
        if not pair.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids, items = sets_["id"].to_numpy(), sets_["items"].combine_chunks()
        order = np.argsort(ids)
        flat = np.frombuffer(b"".join(x.as_buffer() for x in items), np.uint64)
        bounds = np.append(0, np.cumsum([len(x.as_buffer()) // 8 for x in items])).astype(np.int64)
        pair = pair.sort_by("a")
        a, b = (order[np.searchsorted(ids, pair[c].to_numpy(), sorter=order)] for c in ("a", "b"))
        return pair.select(["a", "b"]).filter(pa.array(linked_among(flat, bounds, a, b, percent)))

    small, some = pairs, named
    if crowd := not large.isEmpty():
        small, some = pairs.join(large, "g", "left_anti"), named.join(large, "g", "left_anti")
    held = some.join(full.select("id", "items"), "id").select(F.col("g").alias("h"), "id", "items")
    out = small.groupBy("g").cogroup(held.groupBy("h")).applyInArrow(run, "a long, b long")
    if crowd:
        out = out.unionByName(confirmed(pairs.join(large, "g", "left_semi").select("a", "b"), full, percent))
    return out


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id reachable, by alternating large-star and small-star steps.

    Each step is two grouped minima, combined before they are dealt, and joins with edge-sized tables. The
    edges of a star's hub share a key; the minima are settled first, so that the join reads both sides
    straight from a shuffle and Spark's skew handling may split that key. Tables of few edges are kept in
    few partitions, in proportion to their number.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    check = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = check(edges)
    parts = 1 + seen[0] // EDGES_PER_PART
    while True:
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = settle(small.select("e.u", "e.v").where("u <> v").distinct().coalesce(parts))
        if (now := check(edges)) == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        seen = now


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row.

    Texts are linked if the Jaccard likeness of their shingle sets is at least ``percent`` hundredths;
    component_id is the least id linked, itself included. Texts without words are linked with nothing.
    Rows that repeat an id get the same component, and of several texts of one id the one with the greatest
    set of hashes is compared; a row without an id has no component and is kept.
    """
    sketched = settle(sketch(docs, width, id_col, text_col))
    named = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = named.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"))
    places, crowded = regions(forest(classes))
    places = settle(places)
    full = sets(docs, places.select("id").union(crowded.select("id")).distinct(), width, id_col, text_col)
    full = settle(full.groupBy("id").agg(F.max(F.struct("items", "marks")).alias("s")).select("id", "s.*"))
    edges = settle(confirmed(next_neighbours(places), full, percent))
    label = components(edges)
    rest = strangers(places, label, full.select("id", "marks"), percent)
    label = components(edges.unionByName(confirmed(rest, full, percent)))
    if not crowded.isEmpty():
        joined = label.select(F.col("label").alias("a"), F.col("id").alias("b"))
        across = settle(across_blocks(crowded, label, full, percent))
        if not across.isEmpty():
            label = components(joined.unionByName(confirmed_together(across, full, percent)))
    # settled, so that the join can split a class that holds many rows
    first = settle(classes.select("n_shingles", "set_a", "set_b", "id").join(label, "id", "left").select("n_shingles", "set_a", "set_b", F.coalesce("label", "id").alias("component")))
    out = sketched.drop("signature").join(first, ["n_shingles", "set_a", "set_b"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
