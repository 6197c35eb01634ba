"""Source divergence audit: how far the words of each source lie from those of the others of its language.

Terms are counted per group (lang, source) in Arrow batches, so that what is dealt is one row per batch, group
and term. Each kept term is pivoted into a vector with one count per source of its language; higher-order
functions turn it into probabilities, and Arrow batches of vectors into the contribution of each pair of sources,
summed where they are made before they are dealt. All arithmetic is on integers: probabilities are parts of SCALE, and
divergence is the chi-squared distance (p - q)^2 / q, rounded down term by term.

Null texts, languages and sources are read as empty. Repeated rows count again, as documents and as words. A
group without kept terms is a group of even probabilities, a language without kept terms has pairs of value 0
and no terms, an empty table gives no rows. Columns besides the three named are not read, so they may have any
names. Terms of any length are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm import textbytes as tb
from rillway.llm.store import bounded, settle

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Texts that are counted together, in bytes.
BATCH = 4 << 20
#: Groups whose totals are broadcast at most; beyond, terms and totals of a language meet in SALTS shuffled parts.
BROADCAST_GROUPS, SALTS = 5_000, 64
#: Numbers of vectors compared at a time; sums of pairs that a task holds before it hands them on.
CELLS, HELD = 1 << 16, 1 << 22

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings data[start:end] as a string column."""
    size = ends - starts
    offs = np.append(0, np.cumsum(size))
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data[at])).cast(pa.string())


def term_counts(docs: DataFrame, text: Column, lang: Column, source: Column) -> DataFrame:
    """(lang, source, term, n, docs), several rows per group and term: how often it occurs, in how many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c.dictionary_encode() for c in batch.columns[:2]]
            codes = names[0].indices.to_numpy().astype(np.int64) * len(names[1].dictionary) + names[1].indices.to_numpy()
            for i, j, data, offs in tb.texts(batch.column(2), BATCH):
                low = tb.lower_ascii(data)
                starts, ends = tb.runs(_LETTER[low], offs)
                at, which = tb.distinct_spans(low, starts, ends)
                if not len(at):
                    continue
                of = np.searchsorted(offs, starts, "right") - 1
                pairs, times = np.unique(of * len(at) + which, return_counts=True)
                group = codes[i:j][pairs // len(at)] * len(at) + pairs % len(at)
                keys, own, texts = np.unique(group, return_inverse=True, return_counts=True)
                n = np.bincount(own, times).astype(np.int64)
                code, term = keys // len(at), keys % len(at)
                cols = [d.dictionary.take(pa.array(c)) for d, c in zip(names, divmod(code, len(names[1].dictionary)), strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, _strings(low, starts[at], ends[at]).take(pa.array(term)), pa.array(n), pa.array(texts.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])

    picked = bounded(docs).select(lang.alias("lang"), source.alias("source"), text.alias("text"))
    return picked.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)): more than zero also where nothing occurs."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + terms)) + 1


def distance(p: Column, q: Column) -> Column:
    """(p - q)^2 / q rounded down; p and q are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def vectors(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lang, term, q, p) per kept term, p holding one probability per source of the language, q that of the
    language as a whole, and n the counts; and (lang, sources) with the sources in the order of p."""
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text, lang, source)]
    per = term_counts(docs, *read).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = per.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("cells"), F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = settle(cells.where(F.col("docs") >= MIN_DOCS).drop("docs"))
    groups = docs.select(read[1].alias("lang"), read[2].alias("source")).distinct()
    counted = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count("*").alias("terms"))
    sums = settle(groups.join(counted, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")))
    few = sums.count() <= BROADCAST_GROUPS
    sides = F.array_sort(F.collect_list(F.struct("source", "n")))
    langs = sums.groupBy("lang").agg(sides.alias("s")).join(whole, "lang", "left")
    langs = langs.select("lang", F.col("s.source").alias("sources"), F.col("s.n").alias("totals"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"), F.coalesce("terms", F.lit(0)).alias("terms"))
    if few:
        met = kept.join(F.broadcast(langs), "lang")
    else:
        spread = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(spread.hint("shuffle_hash"), ["lang", "salt"])
    by_source = F.map_from_entries("cells")
    n = F.transform("sources", lambda s: F.coalesce(F.try_element_at(by_source, s), F.lit(0).cast("long")))
    met = met.select("lang", "term", "sources", "totals", "terms", n.alias("n"), _probability(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q"))
    p = F.transform(F.arrays_zip("n", "totals"), lambda x: _probability(x["n"], x["totals"], F.col("terms")))
    return met.select("lang", "term", "q", p.alias("p"), "n", "sources"), langs.select("lang", "sources")


def _flat(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The sums of languages, each a square of sources, as rows, without its diagonal."""
    cols = [[], [], [], []]
    for lang, m in sums.items():
        i, j = np.nonzero(~np.eye(len(m), dtype=bool))
        for c, x in zip(cols, (np.repeat(np.array([lang], object), len(i)), i, j, m[i, j]), strict=True):
            c.append(x)
    whole = [np.concatenate(c) if c else np.array([], np.int64) for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(whole[0], pa.string()), *(pa.array(c.astype(t), k) for c, t, k in zip(whole[1:], (np.int32, np.int32, np.int64), (pa.int32(), pa.int32(), pa.int64()), strict=True))], names=["lang", "i", "j", "f"])


def distances(terms: DataFrame) -> DataFrame:
    """(lang, i, j, f) of (lang, p), several rows per pair: the distance of the i-th source to the j-th, summed over
    the terms of a task, or of a part of it where there are many sources. A term adds p^2 + q at most, and all p of a
    source come to SCALE and one per term, so that sums fit a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, p = batch.column(0).dictionary_encode(), batch.column(1)
            codes = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = p.filter(pa.array(codes == code))
                k = len(own[0])
                rows = own.flatten().to_numpy().reshape(-1, k)
                if lang not in sums and sum(m.size for m in sums.values()) + k * k > HELD:
                    yield _flat(sums)
                    sums = {}
                m = sums.setdefault(lang, np.zeros((k, k), np.int64))
                for at in range(0, len(rows), max(1, CELLS // k)):
                    part = rows[at : at + max(1, CELLS // k)]
                    for i in range(k):
                        d = part - part[:, i : i + 1]
                        m[i] += (d * d // part).sum(axis=0)
        yield _flat(sums)

    return terms.mapInArrow(run, "lang string, i int, j int, f long")


def pair_sums(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each source to each other one of its language, summed over
    all kept terms. Vectors are compared in Arrow batches, source by source."""
    made = distances(terms.select("lang", "p"))
    # a language without kept terms has its pairs all the same
    none = langs.select("lang", F.size("sources").alias("k")).select("lang", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select("lang", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).where("i <> j")
    sums = made.unionByName(none.withColumn("f", F.lit(0).cast("long"))).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    names = langs.select("lang", F.posexplode("sources").alias("k", "name"))
    a, b = (names.select("lang", F.col("k").alias(k), F.col("name").alias(n)) for k, n in (("i", "source"), ("j", "item")))
    return sums.join(a, ["lang", "i"]).join(b, ["lang", "j"]).select("lang", "source", "item", "value")


def term_values(terms: DataFrame) -> DataFrame:
    """(lang, source, item, value): the terms that a source has more often than its language, and by how much."""
    each = F.filter(F.arrays_zip("sources", "n", "p"), lambda x: (x["n"] > 0) & (x["p"] > F.col("q")))
    made = terms.select("lang", "term", "q", F.explode(each).alias("x"))
    return made.select("lang", F.col("x.sources").alias("source"), F.col("term").alias("item"), distance(F.col("x.p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the ``top`` terms of each group."""
    terms, langs = vectors(docs)
    terms = settle(terms)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair_sums(terms, langs), "pair").unionByName(ranked(term_values(terms), "term").where(F.col("rank") <= top))


#: What ``audit`` gives, for the checking engine.
CHECK = r"""with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t, row_number() over () as doc from documents),
 w as (select lang, source, doc, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
 kept as (select lang, term, count(*)::hugeint as n from w group by all having count(distinct doc) >= 3),
 size as (select lang, sum(n)::hugeint as total, count(*)::hugeint as v from kept group by lang),
 g as (select distinct lang, source from d),
 c as (select lang, source, term, count(*)::hugeint as n from w semi join kept using (lang, term) group by all),
 tot as (select lang, source, coalesce(sum(n), 0)::hugeint as total from g left join c using (lang, source) group by all),
 p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (tot.total + size.v) as p, 1 + 1000000000 * (k.n + 1) // (size.total + size.v) as q
  from g join kept k using (lang) join size using (lang) join tot on tot.lang = g.lang and tot.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
 pairs as (select a.lang, a.source, b.source as item, coalesce((select sum((x.p - y.p) * (x.p - y.p) // y.p) from p x join p y on y.lang = x.lang and y.term = x.term where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
  from g a join g b on b.lang = a.lang and b.source <> a.source),
 terms as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pairs
union all select * from (select lang, source, 'term' as part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms) where rank <= 200"""
