"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each result is written
as Parquet to the shared folder and read again. All but the last return the columns of documents, whatever
others there are besides doc_id, text, lang, source and n_chars. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillway.llm import mixing, neardup, packing, quality, secrets
from rillway.llm.store import fresh_path, remove, settle, tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; cutoffs come from the labelled documents still present.

    A null text has no words and goes. A null language is a language of its own; rows without an id have no
    label and are judged like all others.
    """
    labels = tables(spark, sf_dir, "labels").select("doc_id", "quality").where("quality IS NOT NULL")
    counted = quality.with_counts(docs, "text", ["doc_id", "lang"]).select("row.doc_id", "row.lang", *quality.COUNTS)
    cuts = quality.fit_cutoffs(counted.join(labels, "doc_id"), F.col("lang"), F.col("quality") == 1)
    judged = quality.judge(quality.with_counts(docs, "text", docs.columns), F.col("row.lang"), cuts)
    return judged.where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of least id; so does one of repeated rows.

    Rows without an id, and texts without words, resemble nothing and stay.
    """
    found = settle(neardup.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80).select("doc_id", "kept"))
    rows, ids, nulls = found.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    kept = docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti")
    if rows - nulls > ids:
        kept = kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of secrets are masked; the character count follows. A null text stays null, no row goes."""
    masked = secrets.redact(docs, words=secrets.dictionary_path())
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; at most one per source is cut after the words taken.

    A null source is one of its own. Null texts and sources without words are not taken. Rows without an id
    are told by their texts.
    """
    key = {"doc_id": F.col("doc_id"), "source": F.col("source"), "h": F.xxhash64("text")}
    mixed = mixing.copies(settle(mixing.sizes(docs, key)))
    # equal rows are interchangeable: what is drawn for them is shared out in turn
    drawn = mixed.groupBy("doc_id", "source", "h").agg(F.count("*").alias("n"), F.sum("copies").alias("c"), F.max("part").alias("part"))
    d, m = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").alias("h")).alias("d"), drawn.alias("m")
    same = F.lit(True)
    for c in ("doc_id", "source", "h"):
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}"))
    met = d.join(m, same).select("row", *(F.col(f"d.{c}") for c in ("doc_id", "source", "h")), "n", "c", "part")
    met = met.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "source", "h").orderBy("row.lang", "row.n_chars")))
    share = F.floor(F.col("c") / F.col("n")) + (F.col("turn") <= F.col("c") % F.col("n")).cast("long")
    whole = met.withColumn("copies", share).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
    cut = mixing.first_words(met.where("part > 0 AND turn = 1").select("row.*", F.col("part").alias("_words_taken")), "text", "_words_taken")
    return whole.unionByName(cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their sequence and place. Every row counts, also repeated ones; a
    null text is empty and holds the end id alone, a null id stays null."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Quality cutoffs, forest candidates, balanced sampling and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder goes once the next has been written."""
    docs, done = tables(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            remove(spark, done)
        done = path
    return docs
