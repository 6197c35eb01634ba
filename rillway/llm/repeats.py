"""What the two exact-repeat operators share: anchors, contexts of anchors and ranges to cut.

A window is ``width`` consecutive units (bytes or words) of one document. Its anchor is its leftmost
least q-gram by hash, so equal windows have equal anchors at equal offsets. Consecutive windows with one
anchor form a stretch; stretches of equal context hash hold the same windows one by one, so all but the
first of them are repeats throughout. Only stretches that share an anchor q-gram with a stretch of another
context need their windows compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm import textbytes as tb
from rillway.llm.store import bounded, settle

PLACE = np.uint64(28)
STRETCH = "fp long, ctx long, doc long, lo int, n int, off int"
#: Stands for a missing id; a key that is never null lets both joins with the documents share one shuffle.
NO_ID = -(1 << 63)
#: (units, bounds, texts) of a chunk: unit values, their bounds per text.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offs


def word_units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tb.words(data, offs)
    return tb.span_hash(data, starts, ends), first


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """min(keys[p : p + width]) for each p, by prefix and suffix minima of blocks."""
    n = len(keys) - width + 1
    pad = -len(keys) % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(units: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> dict[str, np.ndarray]:
    """The stretches of a chunk: text index, lo (first window, in its text), n windows, off (anchor - lo), fp, ctx."""
    total = len(units)
    none = {k: np.zeros(0, np.int64) for k in ("text", "lo", "n", "off", "fp", "ctx")}
    if total < width:
        return none
    grams = tb.window_hash(units, gram)
    key = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_least(key, width - gram + 1)
    size = np.diff(bounds)
    many = np.maximum(size - width + 1, 0)
    text = np.repeat(np.arange(len(size)), many)
    if not len(text):
        return none
    windows = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bounds[:-1], many)
    anchor = (least[windows] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.ones(len(text), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(text)))
    lo, a, of = windows[first], anchor[first], text[first]
    end = lo + n - 1 + width
    whole = tb.span_hash if units.dtype == np.uint8 else tb.sequence_hash
    ctx = tb.mix(whole(units, lo, end) + (a - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (n.astype(np.uint64) << np.uint64(40)))
    return {"text": of, "lo": lo - bounds[of], "n": n, "off": a - lo, "fp": grams[a].view(np.int64), "ctx": ctx.view(np.int64)}


def later_of_class(order: np.ndarray, *same: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """In the given order: does a row start later than the first row of its class (equal ``same``)?"""
    if not len(order):
        return np.zeros(0, bool)
    new = np.ones(len(order), bool)
    new[1:] = np.any([s[order][1:] != s[order][:-1] for s in same], axis=0)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return (doc[order] != doc[head]) | (lo[order] != lo[head])


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of each document joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    shift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - shift)[np.append(first[1:], len(doc)) - 1]


ANCHORS = "kind int, " + STRETCH


def _batch(kind: int, **cols: np.ndarray) -> pa.RecordBatch:
    n = len(cols["doc"])
    zero = np.zeros(n, np.int64)
    get = lambda c, t: pa.array(cols.get(c, zero).astype(t))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), get("fp", np.int64), get("ctx", np.int64), get("doc", np.int64), get("lo", np.int32), get("n", np.int32), get("off", np.int32)],
        names=["kind", "fp", "ctx", "doc", "lo", "n", "off"],
    )


def anchors(docs: DataFrame, units: Units, width: int, gram: int) -> DataFrame:
    """Stretches (kind 1), and ranges lo..lo+n (kind 0) already known to repeat within a batch of texts.

    Batches combine before anything is shuffled: a stretch that many documents share leaves a batch once.
    ``docs`` has doc and text; rows without a doc are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = []
            for i, _, data, offs in tb.texts(batch.column(1)):
                s = stretches(*units(data, offs), width, gram)
                s["doc"] = ids[i + s.pop("text")]
                parts.append(s)
            if not parts:
                continue
            s = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            order = np.lexsort((s["lo"], s["doc"], s["ctx"], s["fp"]))
            later = order[later_of_class(order, s["fp"], s["ctx"], doc=s["doc"], lo=s["lo"])]
            keep = np.ones(len(order), bool)
            keep[later] = False
            d, a, b = merged(s["doc"][later], s["lo"][later], s["lo"][later] + s["n"][later] - 1 + width)
            yield _batch(0, fp=tb.mix(d.view(np.uint64)).view(np.int64), doc=d, lo=a, n=b - a)
            yield _batch(1, **{k: v[keep] for k, v in s.items()})

    return docs.where(F.col("doc") != NO_ID).mapInArrow(run, ANCHORS)


def classes(rows: DataFrame, width: int) -> DataFrame:
    """From anchors sorted by (kind, fp, ctx, doc, lo) within partitions of fp: ranges to cut (kind 0), and
    first stretches of q-grams with several contexts (kind 2). One pass, with one row held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the only class of the last q-gram so far
        last = None  # (fp, ctx, doc, lo) of the last class, and the number of classes of its q-gram
        for batch in batches:
            kind, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = kind == 0
            if cut.any():
                yield batch.filter(pa.array(cut))
            fp, ctx, doc, lo, n, off = (c[~cut].astype(np.int64) for c in cols)
            if not len(fp):
                continue
            new_fp, new_ctx = np.ones(len(fp), bool), np.ones(len(fp), bool)
            new_fp[1:] = fp[1:] != fp[:-1]
            new_fp[0] = last is None or last[0] != fp[0]
            new_ctx[1:] = ctx[1:] != ctx[:-1]
            new_ctx[0] = last is None or last[1] != ctx[0]
            new_ctx |= new_fp
            head = np.maximum.accumulate(np.where(new_ctx, np.arange(len(fp)), -1))
            hd, hl = doc[head], lo[head]
            if head[0] < 0:
                hd, hl = np.where(head < 0, last[2], hd), np.where(head < 0, last[3], hl)
            later = (doc != hd) | (lo != hl)
            yield _batch(0, doc=doc[later], lo=lo[later], n=n[later] - 1 + width)
            segment = np.cumsum(new_fp) - new_fp[0]
            count = np.bincount(segment[new_ctx], minlength=segment[-1] + 1)
            carried = 0 if new_fp[0] else last[4]
            count[0] += carried
            if carried == 1 and count[0] > 1:
                yield held
            reps = np.flatnonzero(new_ctx & (count[segment] > 1))
            if len(reps):
                yield _batch(2, fp=fp[reps], ctx=ctx[reps], doc=doc[reps], lo=lo[reps], n=n[reps], off=off[reps])
            if count[-1] == 1 and new_ctx[segment == segment[-1]].any():
                i = np.flatnonzero(new_ctx)[-1:]
                held = _batch(2, fp=fp[i], ctx=ctx[i], doc=doc[i], lo=lo[i], n=n[i], off=off[i])
            last = (fp[-1], ctx[-1], hd[-1], hl[-1], count[-1])

    return rows.mapInArrow(run, ANCHORS)


CONTEXT = "fp long, doc long, lo int, n int, off int, units binary"
#: q-grams with more contexts than this are compared by window hashes, dealt by those.
HOT = 2048
#: In ``off``: the row holds window hashes of a hot q-gram, or a range already known to repeat.
HASHES, DONE = -1, -2


def contexts(docs: DataFrame, wanted: DataFrame, units: Units, width: int) -> DataFrame:
    """What ``compared`` needs of each wanted stretch, read from its document once.

    Usually that is the stretch's units under its q-gram. A q-gram with n > HOT contexts, such as the edge
    of a passage that a third of all documents share, would meet in one task; its windows are hashed to 128
    bits instead and dealt by hash to n / HOT groups, after those that repeat within a batch are cut.
    """
    # settled, so that the join reads both sides straight from a shuffle and can split a hot q-gram
    many = settle(wanted.groupBy("fp").agg(F.count("*").alias("k")).where(F.col("k") > HOT).coalesce(1))
    wanted = wanted.join(many, "fp", "left").withColumn("salts", F.coalesce(F.ceil(F.col("k") / HOT), F.lit(1)).cast("int"))
    per = wanted.groupBy("doc").agg(F.collect_list(F.struct("fp", "lo", "n", "off", "salts")).alias("w"))
    met = docs.join(per, "doc").select("doc", "text", "w")

    def rows(fp, doc, lo, n, off, blob) -> pa.RecordBatch:
        full = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.array(doc.astype(np.int64)), full(lo), full(n), full(off), pa.array(blob, pa.binary())], names=["fp", "doc", "lo", "n", "off", "units"])

    def hot(values, begin, fp, doc, lo, n, salts) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at, d, p = begin[row] + step, doc[row], lo[row] + step
        h1, h2 = (tb.window_hash(values, width, seed)[at] for seed in (1, 2))
        order = np.lexsort((p, d, h2, h1))
        late = order[later_of_class(order, h1, h2, doc=d, lo=p)]
        cd, ca, ce = merged(d[late], p[late], p[late] + width)
        yield rows(tb.mix(cd.view(np.uint64)).view(np.int64), cd, ca, ce - ca, DONE, [b""] * len(cd))
        keep = np.ones(len(row), bool)
        keep[late] = False
        row, d, p, h1, h2 = (x[keep] for x in (row, d, p, h1, h2))
        salt = h1 % salts[row].astype(np.uint64)
        group = tb.mix(fp[row].view(np.uint64) ^ tb.mix(salt + np.uint64(1)))
        order = np.lexsort((group, row))
        new = np.append(True, (row[order][1:] != row[order][:-1]) | (group[order][1:] != group[order][:-1]))
        edge = np.append(np.flatnonzero(new), len(order))
        packed = np.stack([h1.view(np.int64), h2.view(np.int64), p], axis=1)[order]
        first = order[edge[:-1]]
        yield rows(group[first].view(np.int64), d[first], p[first], np.diff(edge), HASHES, [packed[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, want = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for i, j, data, offs in tb.texts(batch.column(1), 1 << 20):
                values, bounds = units(data, offs)
                some = want.slice(i, j - i)
                w = some.flatten()
                of = np.repeat(np.arange(j - i), some.value_lengths().to_numpy())
                fp, lo, n, off, salts = (w.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                inside = lo + n - 1 + width <= np.diff(bounds)[of]
                doc, begin = ids[i:j][of].astype(np.int64), bounds[of] + lo
                cold, warm = inside & (salts == 1), inside & (salts > 1)
                raw, step = values.tobytes(), values.itemsize
                blob = [raw[x * step : y * step] for x, y in zip(begin[cold].tolist(), (begin + n - 1 + width)[cold].tolist(), strict=True)]
                yield rows(fp[cold], doc[cold], lo[cold], n[cold], off[cold], blob)
                if warm.any():
                    yield from hot(values, begin[warm], fp[warm], doc[warm], lo[warm].astype(np.int64), n[warm], salts[warm])

    return met.mapInArrow(run, CONTEXT)


def compared(rows: DataFrame, label: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type, width: int, limit: int = 1 << 19) -> DataFrame:
    """Ranges (doc, lo, n) of windows that start earlier in another context of the same q-gram.

    ``rows`` is sorted by (fp, doc, lo) within partitions of fp. ``label`` numbers the windows that start
    at given places of a unit array so that equal windows get equal numbers. Whole groups are handled
    together, as many as fit ``limit`` units, or one.
    """

    def ranges(doc, lo, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "lo", "n"])

    def solve(group: pa.Table) -> Iterator[pa.RecordBatch]:
        off = group.column(4).to_numpy()
        if (off == DONE).any():
            done = group.filter(pa.array(off == DONE))
            yield ranges(*(done.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3)))
        if (off == HASHES).any():
            part = group.filter(pa.array(off == HASHES))
            doc = np.repeat(part.column(1).to_numpy(), part.column(3).to_numpy())
            h1, h2, p = np.frombuffer(b"".join(x.as_buffer() for c in part.column(5).chunks for x in c), np.int64).reshape(-1, 3).T
            order = np.lexsort((p, doc, h2, h1))
            late = order[later_of_class(order, h1, h2, doc=doc, lo=p)]
            d, a, b = merged(doc[late], p[late], p[late] + width)
            yield ranges(d, a, b - a)
        if (off >= 0).any():
            yield told_apart(group.filter(pa.array(off >= 0)))

    def told_apart(group: pa.Table) -> pa.RecordBatch:
        fp, doc, lo, n, off = (group.column(k).to_numpy().astype(np.int64) for k in range(5))
        flat = np.frombuffer(b"".join(x.as_buffer() for c in group.column(5).chunks for x in c), kind)
        size = n - 1 + width
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        name = label(flat, begin[row] + step)
        rel = off[row] - step
        q = np.cumsum(np.append(False, fp[1:] != fp[:-1]))[row]
        order = np.lexsort((row, rel, name, q))
        at = lo[row] + step
        later = order[later_of_class(order, q, name, rel, doc=doc[row], lo=at)]
        d, a, b = merged(doc[row][later], at[later], at[later] + width)
        return ranges(d, a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        units_kept = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy()
            # a group is whole once another begins after it
            edge = np.flatnonzero(fp[1:] != fp[:-1]) + 1
            if kept and kept[-1].column(0)[-1].as_py() != fp[0]:
                edge = np.append(0, edge)
            sizes = np.append(0, np.cumsum(batch.column(3).to_numpy().astype(np.int64) + width))
            at = 0
            for e in edge:
                if units_kept + sizes[e] - sizes[at] >= limit:
                    kept.append(batch.slice(at, e - at))
                    yield from solve(pa.Table.from_batches([b for b in kept if b.num_rows]).combine_chunks())
                    kept, units_kept, at = [], 0, int(e)
            kept.append(batch.slice(at))
            units_kept += int(sizes[-1] - sizes[at])
        kept = [b for b in kept if b.num_rows]
        if kept:
            yield from solve(pa.Table.from_batches(kept).combine_chunks())

    return rows.mapInArrow(run, "doc long, lo int, n int")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) with NO_ID for missing ids. The least long is reserved for that."""
    return bounded(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))


def unkeyed(done: DataFrame) -> DataFrame:
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def ranges_per_document(ranges: DataFrame) -> DataFrame:
    """(doc, cuts): start << 32 | end of each range, as many as the document has."""
    packed = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR((F.col("lo") + F.col("n")).cast("long"))
    return ranges.groupBy("doc").agg(F.collect_list(packed).alias("cuts"))


def spans(cuts: list[int] | np.ndarray | None, size: int) -> list[tuple[int, int]]:
    """Maximal ranges, in order."""
    if cuts is None or not len(cuts):
        return []
    cuts = np.sort(np.asarray(cuts, np.int64))
    _, a, b = merged(np.zeros(len(cuts), np.int64), cuts >> 32, cuts & 0xFFFFFFFF)
    return [(x, min(y, size)) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x < size]
