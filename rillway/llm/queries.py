"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rillway.llm import conversations, divergence, fingerprints, jaccard, mixing, neardup, packing, pages, pii, quality, secrets, substrings, suffixes
from rillway.llm.store import settle, tables


def pii_key() -> bytes:
    """The key in RILLWAY_PII_KEY; where it is unset a fresh one per run, which nobody keeps."""
    return os.environ.get("RILLWAY_PII_KEY", "").encode() or os.urandom(32)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every text, its edited text, and its likeness to that and to the next document."""
    return fingerprints.edit_probe(tables(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: three-word shingles, a likeness of 0.85 or more."""
    return neardup.near_duplicates(tables(spark, sf_dir, "documents"), width=3, percent=85)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(tables(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict of the base rules and the certified cutoffs of its language."""
    docs, labels = tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")
    counted = settle(quality.with_counts(docs, "text", ["doc_id", "lang"]).select("row.doc_id", "row.lang", *quality.COUNTS))
    labelled = counted.join(labels.select("doc_id", "quality").where("quality IS NOT NULL"), "doc_id")
    cuts = quality.fit_cutoffs(labelled, F.col("lang"), F.col("quality") == 1)
    return quality.judge(counted, F.col("lang"), cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated strings of 100 bytes."""
    return suffixes.dedup(tables(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated windows of 20 words."""
    return substrings.dedup(tables(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base secrets of every text and the values that are dear to guess."""
    return secrets.scan(tables(spark, sf_dir, "documents"), words=secrets.dictionary_path())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens of every text and their places in sequences."""
    return packing.pack_documents(tables(spark, sf_dir, "documents"), packing.tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = tables(spark, sf_dir, "documents")
    sized = mixing.sizes(docs, {"doc_id": F.col("doc_id"), "source": F.col("source")})
    out = mixing.copies(settle(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies") + F.col("part")).alias("taken"), "source", "copies", "part")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal numbers, dates and addresses replaced by pseudonyms."""
    return pii.pseudonymise(tables(spark, sf_dir, "documents"), pii_key())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of what they make of every damaged conversation."""
    return conversations.repair_report(tables(spark, sf_dir, "conversations"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source lies from the others of its language, and the words that set it apart."""
    return divergence.audit(tables(spark, sf_dir, "documents"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts linked by four-word shingles, a likeness of 0.85 or more."""
    return jaccard.jaccard_components(tables(spark, sf_dir, "documents"), width=4, percent=85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage of corpus_pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_near_dedup, op3_html_extraction, op4_quality_rules, op5_suffix_dedup, op6_substring_dedup, op7_secret_scans, op8_packing, op9_mixing, op10_pii, op11_conversation_repair, op12_source_divergence, op13_jaccard_join, pipeline)}
ORACLE_SQL: dict[str, str] = {"op11_conversation_repair": conversations.CHECK, "op12_source_divergence": divergence.CHECK, "op13_jaccard_join": jaccard.CHECK}
