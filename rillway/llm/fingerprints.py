"""Order MinHash document fingerprints, in DataFrame functions alone.

Tokens are runs of up to sixteen characters without white space, and single characters of scripts that
write without blanks. A k-mer is K tokens in a row (all tokens, where a text has fewer); its n-th
occurrence in a text counts as an element of its own. The M orders are rotations of one hash order: order i
starts at its anchor and wraps around. The L least elements of an order, put back into text order and
hashed together, are one entry of the signature, so texts agree in an entry only if they hold the same
least k-mers in the same sequence. That makes the share of equal entries fall with edit distance, moved
passages included, where plain MinHash would not notice them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, L, M = 2, 2, 64
#: What a token is, and scripts that write without blanks, whose characters stand alone.
TOKEN = r"\S{1,16}"
SOLID = r"[\u0E00-\u0EFF\u2E80-\u9FFF\uF900-\uFAFF]"
PLACE_BITS = 26
RANGE_ROWS, MOST_RANGES = 4_000, 16_384


def _high(hashed: Column) -> Column:
    """The leading 64 - PLACE_BITS bits of a hash, in place."""
    return hashed.bitwiseAND(F.lit(-(1 << PLACE_BITS)))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _indexes(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _anchors() -> list[int]:
    """M starts, evenly spread over the hash range; their low bits are 0, so each sorts before its equals."""
    step = (1 << 64) // M
    return [(-(1 << 63) + i * step) & -(1 << PLACE_BITS) for i in range(M)]


def with_signature(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with a column ``name``: M ints, or an empty array for a text without tokens (null too).

    Every step is a projection of its own, so that sorts of longs stay in generated code and nothing is
    evaluated twice. Places beyond 2**26 tokens wrap around, which is defined and harmless.
    """
    t = lambda x: f"_{name}_{x}"
    text = F.coalesce(text, F.lit(""))
    text = F.when(text.rlike(SOLID), F.regexp_replace(text, f"({SOLID})", " $1 ")).otherwise(text)
    df = df.withColumn(t("tok"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    n = F.size(t("tok"))
    pair = F.transform(t("tok"), lambda x, i: _high(F.xxhash64(x, F.get(F.col(t("tok")), i + 1))).bitwiseOR(_place(i.cast("long"))))
    assert K == 2
    df = df.withColumn(t("grams"), F.when(n > 1, F.slice(pair, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(pair)).drop(t("tok"))
    df = df.withColumn(t("sorted"), F.sort_array(t("grams"))).drop(t("grams"))
    # starts of runs of equal k-mers; the occurrence number is the distance from the run's start
    s = F.col(t("sorted"))
    df = df.withColumn(t("runs"), F.filter(_indexes(s), lambda i: (i == 0) | (_high(F.get(s, i)) != _high(F.get(s, i - 1)))))
    r = F.col(t("runs"))

    def occurrences(start: Column, at: Column) -> Column:
        end = F.coalesce(F.get(r, at + 1), F.size(s))
        return F.transform(F.slice(s, start + 1, end - start), lambda x, o: F.when(o == 0, x).otherwise(_high(F.xxhash64(_high(x), o)).bitwiseOR(_place(x))))

    df = df.withColumn(t("all"), F.when(F.size(r) == F.size(s), s).otherwise(F.flatten(F.transform(r, occurrences)))).drop(t("sorted"), t("runs"))
    df = df.withColumn(t("ring"), F.sort_array(t("all"))).withColumn(t("merged"), F.sort_array(F.concat(t("all"), F.array(*(F.lit(a) for a in _anchors()))))).drop(t("all"))
    return _tuples(df, t, name)


def _tuples(df: DataFrame, t, name: str) -> DataFrame:
    """From the elements in hash order (ring) to one hash per order."""
    ring, m = F.col(t("ring")), F.col(t("merged"))
    size = F.size(ring)
    # anchors alone are multiples of their step; the place of anchor i, less i, is the number of elements before it
    found = F.filter(_indexes(m), lambda i: F.get(m, i).bitwiseAND(F.lit((1 << 64) // M - 1)) == 0)
    df = df.withColumn(t("starts"), F.transform(F.slice(found, 1, M), lambda at, i: at - i)).drop(t("merged"))

    def entry(at: Column) -> Column:
        one, two = F.get(ring, F.pmod(at, size)), F.get(ring, F.pmod(at + 1, size))
        swapped = _place(one) > _place(two)
        return F.hash(F.when(swapped, _high(two)).otherwise(_high(one)), F.when(swapped, _high(one)).otherwise(_high(two)))

    assert L == 2
    return df.withColumn(name, F.when(size > 0, F.transform(t("starts"), entry)).otherwise(F.expr("cast(array() as array<int>)"))).drop(t("ring"), t("starts"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries; two texts without tokens are alike (1), one such text is like no other (0)."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(equal / F.lit(float(M)))


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(df: DataFrame, id_col: str, columns: list[str], tie: Column) -> DataFrame:
    """``df`` with next_<c>: the column of the row that follows in descending id, after the last the first.

    Rows without an id come last; equal ids are ordered by ``tie``. Rows are dealt to ranges of ids,
    bounded by quantiles, and the rows of each range's first id are also sent to the range before it, so
    a task sorts a range alone. Only bounds and first ids, at most MOST_RANGES of each, reach the driver.
    A single row follows itself.
    """
    key = F.col(id_col)
    n = df.count()
    ranges = max(2, min(MOST_RANGES, n // RANGE_ROWS))
    found = df.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = sorted(set(found or []))
    # descending: ids above all bounds are range 0, null ids come after all
    df = df.withColumn("_range", F.when(key.isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - _below(bounds, key)))
    seen = sorted((r["_range"], r["top"]) for r in df.groupBy("_range").agg(F.max(id_col).alias("top")).collect())
    if not seen:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in columns)).drop("_range")
    before = df.sparkSession.createDataFrame([(r, top, seen[i - 1][0]) for i, (r, top) in enumerate(seen)], "_range int, _top long, _to int")
    copies = F.array(F.struct(F.col("_range").alias("at"), F.lit(0).alias("ghost")), F.struct(F.col("_to").alias("at"), F.lit(1).alias("ghost")))
    leads = key.eqNullSafe(F.col("_top"))
    dealt = df.join(F.broadcast(before), "_range").withColumn("_c", F.explode(F.slice(copies, 1, F.when(leads, 2).otherwise(1)))).drop("_range", "_top", "_to")
    window = Window.partitionBy("_c.at").orderBy("_c.ghost", key.desc_nulls_last(), tie)
    return dealt.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where("_c.ghost = 0").drop("_c")


def _below(bounds: list[int], key: Column) -> Column:
    """How many of the sorted bounds are less than the key, by binary search."""
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    cuts, n = F.array(*(F.lit(x) for x in bounds)), len(bounds)
    return F.aggregate(F.array(*(F.lit(x) for x in steps)), F.lit(0), lambda at, by: F.when((at + by <= n) & (F.get(cuts, F.least(at + by, F.lit(n)) - 1) < key), at + by).otherwise(at))


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, signature) per row; a null text is the empty one."""
    return with_signature(docs.select(F.col(id_col), F.col(text_col)), F.col(text_col), "signature").select(id_col, "signature")


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last third is the start of the next document's.

    Null texts are empty; repeated rows each get a row, and follow one another.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = with_signature(base, F.col("text"), "sig")
    both = with_next(signed, "doc_id", ["text", "sig"], F.xxhash64("text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))).drop("next_text", "text")
    both = with_signature(both.withColumn("edited_sha256", F.sha2("edited", 256)), F.col("edited"), "edited_sig").drop("edited")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
