"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact sorted-array intersection.

Documents with equal shingle sets are one class. Sizes are cut into bands so that sets that may be linked lie in
the same band or in neighbouring ones. Shingles have one order for all sets: rare ones by their hash, then those
that many classes share, the most frequent last. Two linked sets share a shingle among the first of either, so a
tile is what shares one such shingle within a band, together with the band below as guests. Tiles of many
classes are cut into blocks, and every two blocks meet in a job of their own.

Within a job classes are compared on bitmaps: every shingle turns over one bit, so the bits in which two bitmaps
differ are at most the shingles in which the sets differ, which bounds the overlap from above. What the bound
leaves is decided by intersecting the sorted arrays of shingle hashes. Nothing is left to chance but equal
64-bit hashes of different shingles.

First, each class is paired with the nearest in its block of a few tiles, and components are formed; then all tiles
are compared whole, but for classes that one component holds already. ``linked_pairs`` compares all of them instead.

Null and blank texts have no shingles and are linked with nothing; a text with fewer words than the width has
its whole sequence as its one shingle. Rows that repeat an id are one document, whose texts share its component,
but for those without shingles; a row without an id is linked with nothing and has no component. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.llm import textbytes as tb
from rillway.llm.neardup import BROADCAST_IDS, components, confirmed, shingles
from rillway.llm.store import bounded, settle

#: A shingle that stands among the first of so many classes is ordered last. At most HOT_MOST are: the number of
#: classes asked for is doubled until so few are left, which bounds what every task is sent to 4 MB.
HOT, HOT_MOST = 128, 1 << 18
#: Classes of a block, fewer where their bitmaps take more than BLOCK_BYTES.
BLOCK, LEAST_BLOCK, BLOCK_BYTES = 512, 16, 8 << 20
LEAST_BITS, MOST_BITS = 256, 1 << 20
#: Tiles in which a class is looked at first, about.
LOOKS = 4


def first_ones(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set hold one of every set that it may be linked with."""
    return sizes - -(-percent * sizes // 100) + (sizes > 0)


def bands(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Bands whose width is the greatest ratio of sizes of linked sets, and a little more."""
    return np.floor(np.log(np.maximum(sizes, 1)) / (math.log(100 / percent) * (1 + 1e-9))).astype(np.int64)


def bitmap_bits(band: np.ndarray, percent: int) -> np.ndarray:
    """Bits of a band's bitmaps: a power of two, about the size of its sets or more."""
    top = (band + 1) * math.log2(100 / percent)
    return np.clip(np.left_shift(np.int64(1), np.minimum(np.ceil(top).astype(np.int64), 40)), LEAST_BITS, MOST_BITS)


def bitmaps(keys: np.ndarray, bounds: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """Per set, the parities of its shingles by the low bits of their hashes. Half of a bitmap laid over the
    other half is the bitmap of half as many bits."""
    starts = np.cumsum(bits) - bits
    at = np.repeat(starts, np.diff(bounds)) + (keys & (np.repeat(bits, np.diff(bounds)) - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")
    return [packed[s // 8 : (s + b) // 8].tobytes() for s, b in zip(starts.tolist(), bits.tolist(), strict=True)]


def sketch(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, set_a, set_b, band, bits, first) per row: equal (n, set_a, set_b) means equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tb.texts(batch.column(1)):
                keys, bounds = shingles(data, offs, width)
                n = np.diff(bounds)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(k, dtype=np.uint64)]) for k in (keys, tb.mix(keys))]
                a, b = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
                band = bands(n, percent)
                some = first_ones(n, percent)
                ends = np.append(0, np.cumsum(some))
                at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], some)
                lead = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[at].view(np.int64)))
                marks = pa.array(bitmaps(keys, bounds, np.where(n > 0, bitmap_bits(band, percent), 0)), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(band), marks, lead], names=["doc_id", "n", "set_a", "set_b", "band", "bits", "first"])

    picked = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n long, set_a long, set_b long, band long, bits binary, first array<long>")


def _texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the ids named; their number decides whether they are broadcast."""
    ids = settle(ids)
    few = ids.count() <= BROADCAST_IDS
    picked = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "text")


def sorted_sets(docs: DataFrame, ids: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, items): the sorted shingle hashes of the documents named, equal sets of one id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in tb.texts(batch.column(1)):
                keys, bounds = shingles(data, offs, width)
                blob = pa.array([keys[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), blob], names=["id", "items"])

    return _texts_of(docs, ids, id_col, text_col).mapInArrow(run, "id long, items binary").where("length(items) > 0")


def reordered(docs: DataFrame, ids: DataFrame, hot: Broadcast, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(token, id, n, band): the first shingles of the documents named, where those in ``hot`` come last, in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place = np.unique(hot.value, return_index=True)
        for batch in batches:
            for i, j, data, offs in tb.texts(batch.column(1)):
                keys, bounds = shingles(data, offs, width)
                n = np.diff(bounds)
                at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
                late = names[at] == keys
                order = np.lexsort((np.where(late, place[at].astype(np.uint64), keys), late, tb.owner(bounds)))
                some = first_ones(n, percent)
                ends = np.append(0, np.cumsum(some))
                lead = keys[order[np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], some)]]
                ids_ = batch.column(0).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                cols = [lead.view(np.int64), *(np.repeat(c, some) for c in (ids_, n, bands(n, percent)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["token", "id", "n", "band"])

    return _texts_of(docs, ids, id_col, text_col).mapInArrow(run, "token long, id long, n long, band long").distinct()


def seats(docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(token, band, id, n, guest): who meets in which tile; in its own band, and as a guest in the next one.
    Shingles that no two classes have among their first are left out."""
    rows = classes.select(F.explode("first").alias("token"), "id", "n", "band")
    # counted once per class; only what several have goes on
    often = settle(rows.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1"))
    least = HOT
    while (hot := often.where(F.col("classes") >= least)).count() > HOT_MOST:
        least *= 2
    ranked = hot.orderBy("classes", "token").select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64)
    if len(ranked):
        held = settle(rows.join(F.broadcast(hot.select("token")), "token", "left_semi").select("id").distinct())
        sent = docs.sparkSession.sparkContext.broadcast(ranked)
        rows = rows.join(held, "id", "left_anti").unionByName(reordered(docs, held, sent, width, percent, id_col, text_col))
        often = settle(rows.groupBy("token").agg(F.count("*").alias("classes")).where("classes > 1"))
    met = rows.join(often.select("token"), "token")
    both = met.select("token", F.explode(F.array(F.struct("band", F.lit(False).alias("guest")), F.struct((F.col("band") + 1).alias("band"), F.lit(True).alias("guest")))).alias("s"), "id", "n")
    return settle(both.select("token", "s.band", "id", "n", "s.guest"))


def may_link(n: np.ndarray, m: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles whose bitmaps differ in so many bits may be linked: they have at most
    (n + m - differ) / 2 shingles in common."""
    return np.maximum(n + m - differ, 0) // 2 * (100 + percent) >= percent * (n + m)


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap as words, laid over itself until it has ``size`` bytes."""
    words = np.frombuffer(bits, np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _block_size(most: Column) -> Column:
    """How many classes a block may hold, by the size of its greatest set, which bounds that of its bitmap."""
    return F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK), F.floor(F.lit(4 * BLOCK_BYTES) / F.least(F.greatest(most, F.lit(1)), F.lit(MOST_BITS)))))


def _mixed(told: DataFrame) -> DataFrame:
    """(token, band, blocks) of the tiles that hold more than one label."""
    mixed = told.groupBy("token", "band").agg(F.count("*").alias("all"), F.count_if(~F.col("guest")).alias("own"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("n").alias("most")).where("own > 0 AND low <> high")
    return mixed.select("token", "band", F.ceil(F.col("all") / _block_size(F.col("most"))).cast("long").alias("blocks"))


def jobs(seated: DataFrame, classes: DataFrame, label: Column) -> DataFrame:
    """(token, band, x, y, block, id, n, guest, label, bits): the seats of every two blocks of every tile that
    holds more than one label. ``seated`` has what ``label`` reads."""
    told = seated.withColumn("label", label)
    dealt = told.join(_mixed(told), ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("token", "band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "n", "guest", "label")
    return _with_bits(dealt, classes)


def first_jobs(seated: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """A first look, to form components: a share of the tiles of each band, so that a class has about LOOKS of its
    own, in blocks that are dealt anew in every tile and stand alone."""
    firsts = F.exp((F.col("band") + 1) * math.log(100 / percent)) * ((100 - percent) / 100)
    some = seated.where(~F.col("guest") & (F.pmod(F.xxhash64("token"), F.greatest(F.lit(1), F.floor(firsts / LOOKS))) == 0))
    told = some.withColumn("label", F.col("id"))
    dealt = told.join(_mixed(told), ["token", "band"]).withColumn("block", F.pmod(F.xxhash64("token", "id"), "blocks"))
    return _with_bits(dealt.select("token", "band", F.col("block").alias("x"), F.col("block").alias("y"), "block", "id", "n", "guest", "label"), classes)


def _with_bits(dealt: DataFrame, classes: DataFrame) -> DataFrame:
    return dealt.join(classes.select("id", "n", "bits"), ["id", "n"]).select("token", "band", "x", "y", "block", "id", "n", "guest", "label", "bits")


def compared(met: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """(a, b) with a < b: what the bound leaves of the pairs of each job that have different labels and are not
    both guests; with ``nearest``, of each class only the pair whose bitmaps differ least. Jobs stream through a
    task in order, and one is held at a time."""
    key = ["token", "band", "x", "y"]

    def pairs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        block, ids, n, guest, label = (rows[c].to_numpy(zero_copy_only=False) for c in ("block", "id", "n", "guest", "label"))
        raw = rows["bits"].to_pylist()
        size = min(map(len, raw))
        bits = np.stack([folded(x, size) for x in raw])
        x, y = rows["x"][0].as_py(), rows["y"][0].as_py()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left:
            other = right[right > i] if x == y else right
            other = other[(label[other] != label[i]) & ~(guest[other] & guest[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            differ = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
            may = np.flatnonzero(may_link(n[other], n[i], differ, percent))
            near = ids[other[may[[differ[may].argmin()]] if nearest and len(may) else may]]
            a.append(np.minimum(near, ids[i]))
            b.append(np.maximum(near, ids[i]))
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def done() -> pa.RecordBatch:
            a, b = pairs(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(4)]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            starts = np.flatnonzero(new)
            for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if (this := tuple(c[s] for c in cols)) != now and held:
                    yield done()
                    held = []
                now = this
                held.append(batch.slice(s, e - s))
        if held:
            yield done()

    dealt = bounded(met).repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _classes(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and (id, n, set_a, set_b, band, bits, first) of each distinct set, named by its least id."""
    sketched = settle(sketch(docs, width, percent, id_col, text_col))
    named = sketched.where("doc_id IS NOT NULL AND n > 0")
    # copies are alike in all of the row, so whichever comes first stands for them
    return sketched, settle(named.groupBy("n", "set_a", "set_b").agg(F.min("doc_id").alias("id"), F.first("band").alias("band"), F.first("bits").alias("bits"), F.first("first").alias("first")))


def _one_document(sketched: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes of different sets that rows of one id have; most tables have none."""
    sets = ["n", "set_a", "set_b"]
    told = sketched.where("doc_id IS NOT NULL AND n > 0").select("doc_id", *sets).distinct()
    several = settle(told.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    named = told.join(several, "doc_id").join(classes.select(*sets, "id"), sets)
    return named.join(named.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")


def linked_pairs(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a, b) with a < b, all links between distinct sets, each named by its least id; and (doc_id, class_id),
    which says whose set a row has. Copies are not expanded into pairs."""
    sketched, classes = _classes(docs, width, percent, id_col, text_col)
    seated = seats(docs, classes, width, percent, id_col, text_col)
    left = settle(compared(jobs(seated, classes, F.col("id")), percent))
    found = confirmed(left, settle(sorted_sets(docs, left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width, id_col, text_col)), percent)
    member = sketched.select("doc_id", "n", "set_a", "set_b").join(classes.select("n", "set_a", "set_b", F.col("id").alias("class_id")), ["n", "set_a", "set_b"], "left")
    return found.distinct(), member.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: texts are linked if 100 * intersection >= percent * union."""
    sketched, classes = _classes(docs, width, percent, id_col, text_col)
    seated = seats(docs, classes, width, percent, id_col, text_col)

    def links(pairs: DataFrame) -> DataFrame:
        sets = settle(sorted_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width, id_col, text_col))
        return settle(confirmed(pairs, sets, percent))

    near = links(settle(compared(first_jobs(seated, classes, percent), percent, nearest=True)))
    label = components(near.unionByName(_one_document(sketched, classes)))
    told = seated.join(label.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id").withColumnRenamed("label", "known")
    left = settle(compared(jobs(settle(told), classes, F.coalesce("known", "id")), percent))
    if not left.isEmpty():
        label = components(label.select(F.col("label").alias("a"), F.col("id").alias("b")).unionByName(links(left)))
    first = settle(classes.select("n", "set_a", "set_b", "id").join(label, "id", "left").select("n", "set_a", "set_b", F.coalesce("label", "id").alias("component")))
    out = sketched.select("doc_id", "n", "set_a", "set_b").join(first, ["n", "set_a", "set_b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


#: What ``jaccard_components`` gives with its defaults, for the checking engine: by an inverted index of whole shingles.
CHECK = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
 s as materialized (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w),
 n as (select doc_id, count(*) as n from s group by doc_id),
 met as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on b.g = a.g and b.doc_id <> a.doc_id group by all),
 link as materialized (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
 reach(doc_id, other) as (select a, b from link union select reach.doc_id, link.b from reach join link on link.a = reach.other)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(r.first, d.doc_id))::bigint as component_id
from documents d left join n using (doc_id) left join (select doc_id, min(other) as first from reach group by doc_id) r using (doc_id)"""
