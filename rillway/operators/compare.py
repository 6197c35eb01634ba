"""Comparing journals and trees: a digest of a whole journal, where two journals part, and paths that differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.operators.cut import cut

LEAF, FAN = 1024, 256


def _line(columns: list[str]) -> Column:
    """One record as a compact JSON array; nulls are null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def merkle(journal: DataFrame, columns: list[str], seq: str = "seq", leaf: int = LEAF, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(level, node, low, high, records, digest): a tree of SHA-256 digests over ranges of sequence numbers.

    A leaf digests the lines of ``leaf`` numbers in order; a node above digests its ``fan`` children, each with its
    number, so a missing range shows. The last level has one node, whose digest is that of the journal. No task
    holds more than a leaf or a node's children; numbers need not be free of gaps, and of repeated numbers the
    lines are taken in their own order. An empty journal has no nodes. With ``levels`` the tree ends after so many,
    with as many nodes in the last as those below need; all records are in it all the same.
    """
    lines = journal.select(F.col(seq).cast("long").alias("_seq"), _line(columns).alias("line"))
    rows = F.array_sort(F.collect_list(F.struct("_seq", "line")))
    text = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    nodes = lines.groupBy(F.floor(F.col("_seq") / leaf).alias("node")).agg(F.min("_seq").alias("low"), F.max("_seq").alias("high"), F.count("*").alias("records"), F.sha2(text, 256).alias("digest"))
    least, top = journal.agg(F.min(seq), F.max(seq)).first()
    level, out = 0, nodes.withColumn("level", F.lit(0))
    width, first, last = leaf, (least or 0) // leaf, (top or 0) // leaf
    while first != last and (levels is None or level + 1 < levels):
        level, width, first, last = level + 1, width * fan, first // fan, last // fan
        kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
        text = F.array_join(F.transform(kids, lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), ",")
        nodes = nodes.groupBy(F.floor(F.col("node") / fan).alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("records").alias("records"), F.sha2(text, 256).alias("digest"))
        out = out.unionByName(nodes.withColumn("level", F.lit(level)))
    return out.select("level", "node", "low", "high", "records", "digest")


def parting(left: DataFrame, right: DataFrame) -> DataFrame:
    """(level, node, side, low, high) of the nodes of two ``merkle`` trees that differ: both, or left or right where
    only that journal has records there. Trees of different height differ in what only one of them has."""
    names = ["level", "node"]
    a, b = (t.select(*names, *(F.col(c).alias(f"{c}_{s}") for c in ("low", "high", "digest"))) for t, s in ((left, "l"), (right, "r")))
    met = a.join(b, names, "full").where(~F.col("digest_l").eqNullSafe(F.col("digest_r")))
    side = F.when(F.col("digest_l").isNull(), "right").when(F.col("digest_r").isNull(), "left").otherwise("both")
    return met.select(*names, side.alias("side"), F.least("low_l", "low_r").alias("low"), F.greatest("high_l", "high_r").alias("high"))


def leaves(trees: DataFrame, key: list[str], json: str) -> DataFrame:
    """(key..., path, value) of every leaf of JSON trees of any depth: paths as ``$.a.b[0]``, values as their JSON text,
    an empty object or array as {} or []. Text that is no JSON is one leaf at ``$``, null where it is null.

    Trees are variants, unfolded one level per round for all rows at once, until none is left to unfold.
    """
    trees = cut(trees.select(*key, json))
    open_ = trees.select(*key, F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v"), F.col(json).alias("raw"))
    broken = open_.where("v IS NULL").select(*key, "path", F.col("raw").alias("value"))
    done, open_ = broken, open_.where("v IS NOT NULL").drop("raw")
    while True:
        kind = F.schema_of_variant("v")
        told = open_.withColumn("kind", kind)
        nested = told.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'")
        flat = told.where("NOT (kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%')")
        done = done.unionByName(flat.select(*key, "path", F.to_json("v").alias("value")))
        empty = nested.withColumn("value", F.to_json("v")).where("value IN ('{}', '[]')")
        done = done.unionByName(empty.select(*key, "path", "value"))
        nested = cut(nested.where("to_json(v) NOT IN ('{}', '[]')"))
        if nested.isEmpty():
            return done
        inner = nested.lateralJoin(nested.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("_key"), F.col("value").alias("_value")))
        step = F.when(F.col("_key").isNotNull(), F.concat(F.lit("."), F.col("_key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        open_ = inner.select(*key, F.concat("path", step).alias("path"), F.col("_value").alias("v"))


def tree_diff(left: DataFrame, right: DataFrame, key: list[str], json: str) -> DataFrame:
    """(key..., path, left, right) of the leaves in which trees of the same key differ; a missing side is null.
    Where one side has a leaf and the other a tree, the leaf and all leaves of the tree are told."""
    a = leaves(left, key, json).withColumnRenamed("value", "left")
    b = leaves(right, key, json).withColumnRenamed("value", "right")
    return a.join(b, [*key, "path"], "full").where("NOT (`left` <=> `right`)")
