"""Exact repeats of word windows over a log-structured fingerprint index.

The index is a list of immutable runs: tables bucketed by fingerprint and sorted within buckets, one per
batch added. A batch is combined within itself, written as the next run, and merge-joined with every
earlier run bucket by bucket; of history only what a batch meets again is shuffled. Fingerprints met again are
compared: equal contexts under equal fingerprints (128 bits together) are repeats throughout, others are
verified against the documents, word by word on 64-bit hashes of the words. When a level holds ``fan_in`` runs
they are compacted into one run of the next level before a batch is added. ``dedup`` adds its last batch, before
which a level is full, to the index as it is opened again from its folder, as a later load would.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillway.llm import repeats as rp
from rillway.llm import textbytes as tb
from rillway.llm.store import fresh_path, remove, settle
from rillway.llm.suffixes import pointers, refine

WIDTH, GRAM = 20, 5
ANCHOR_COLUMNS = ["kind", "fp", "ctx", "doc", "lo", "n", "off"]


def word_labels(width: int):
    return lambda flat, at: refine(pointers(flat), 1, width)[at]


class FingerprintIndex:
    """Runs of anchor fingerprints (fp, ctx, doc, lo, n, off); documents come in batches of rising ids.

    An index lives in a folder of its own under the shared one: each run's files, and a manifest per change
    that names the runs it has. Opening the same folder again, in any session, goes on where it stopped.
    """

    def __init__(self, spark: SparkSession, width: int = WIDTH, gram: int = GRAM, buckets: int | None = None, fan_in: int = 4, root: str | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.root = root or fresh_path(spark, "fingerprint-index")
        self.session = uuid.uuid4().hex
        self.runs: list[tuple[int, str]] = []
        self.made = 0
        known = self._manifest() if root else None
        if known is None:
            self.width, self.gram = width, min(gram, max(1, width // 2))
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        else:
            self.width, self.gram, self.buckets, self.made = known["width"], known["gram"], known["buckets"], known["made"]
            for level, run in known["runs"]:
                self.runs.append((level, run))
                spark.sql(f"CREATE TABLE {self._table(run)} ({rp.ANCHORS.replace(' long', ' bigint')}) USING parquet CLUSTERED BY (fp) SORTED BY (fp, ctx, doc, lo) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run}'")

    def _table(self, run: str) -> str:
        return f"rillway_{self.session}_{run}"

    def _rows(self, run: str) -> DataFrame:
        return self.spark.table(self._table(run))

    def _manifest(self) -> dict | None:
        """The manifest of the last change, or None in a folder without one."""
        try:
            found = self.spark.read.schema("made long, body string").json(f"{self.root}/manifest").orderBy(F.desc("made")).first()
        except AnalysisException:
            return None
        return found and json.loads(found["body"])

    def _commit(self) -> None:
        body = json.dumps({"width": self.width, "gram": self.gram, "buckets": self.buckets, "made": self.made, "runs": self.runs})
        self.spark.createDataFrame([(self.made, body)], "made long, body string").coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def _write(self, rows: DataFrame) -> str:
        run = f"run_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, "fp").sortBy("fp", "ctx", "doc", "lo").format("parquet").option("compression", "zstd").option("path", f"{self.root}/{run}").saveAsTable(self._table(run))
        return run

    def _forget(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(run)}")
        remove(self.spark, f"{self.root}/{run}")

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Adds documents (doc, text) later than all before. Gives (ranges to cut, stretches to verify).

        Full levels are merged before, not after: the runs of the last batch of a load wait for the next load.
        """
        self.compact()
        rows = rp.anchors(batch, rp.word_units, self.width, self.gram).repartition(self.buckets, "fp")
        new = self._rows(run := self._write(rows))
        every = [t.where("kind = 1") for t in (new, *(self._rows(r) for _, r in self.runs))]
        # fingerprints met in an earlier run, and those with company in this one
        alone = every[0].groupBy("fp").agg(F.count("*").alias("k"))
        met = [alone.join(t.select("fp"), "fp", "left_semi").select("fp") for t in every[1:]]
        again = settle(reduce(DataFrame.union, met, alone.where("k > 1").select("fp")).distinct())
        touched = reduce(DataFrame.unionByName, [t.join(again, "fp", "left_semi").select(*ANCHOR_COLUMNS) for t in every])
        sorted_ = touched.repartition(self.buckets, "fp").sortWithinPartitions("kind", "fp", "ctx", "doc", "lo")
        found = settle(rp.classes(sorted_, self.width))
        self.runs.append((0, run))
        whole = settle(new.where("kind = 0").select("doc", "lo", "n"))
        self._commit()
        return found.where("kind = 0").select("doc", "lo", "n").unionByName(whole), found.where("kind = 2").select("fp", "doc", "lo", "n", "off")

    def compact(self) -> None:
        """Merges the runs of any full level, the first level first; only first stretches of a class stay."""
        level = 0
        while level <= max((k for k, _ in self.runs), default=-1):
            full = [r for k, r in self.runs if k == level]
            if len(full) >= self.fan_in:
                rows = reduce(DataFrame.unionByName, (self._rows(r).where("kind = 1") for r in full))
                first = rows.groupBy("fp", "ctx").agg(F.min(F.struct("doc", "lo", "n", "off")).alias("s"))
                merged = first.select(F.lit(1).alias("kind"), "fp", "ctx", "s.doc", "s.lo", "s.n", "s.off").repartition(self.buckets, "fp")
                run = self._write(merged)
                self.runs = [r for r in self.runs if r[1] not in full] + [(level + 1, run)]
                self._commit()
                for r in full:
                    self._forget(r)
            level += 1

    def verify(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """Ranges of windows that hold word for word, read from ``docs`` (doc, text), which has all batches."""
        near = rp.contexts(docs, wanted, rp.word_units, self.width).repartition(self.buckets, "fp").sortWithinPartitions("fp", "doc", "lo")
        return rp.compared(near, word_labels(self.width), np.uint64, self.width)

    def close(self) -> None:
        """Forgets the tables of this session; the folder stays and can be opened again."""
        for _, r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(r)}")

    def drop(self) -> None:
        self.close()
        self.runs = []
        remove(self.spark, self.root)


def batches_by_id(docs: DataFrame, count: int) -> list[DataFrame]:
    """``count`` batches of rising ids and about equal numbers of rows."""
    found = docs.agg(F.percentile_approx("doc", [i / count for i in range(1, count)], 10_000)).first()[0] if count > 1 else None
    edges = sorted(set(found or []))
    bounds = [None, *edges, None]
    out = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = docs.where(F.col("doc") != rp.NO_ID)
        part = part if low is None else part.where(F.col("doc") > low)
        out.append(part if high is None else part.where(F.col("doc") <= high))
    return out


def cut_words(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs``."""
    met = docs.join(rp.ranges_per_document(ranges), "doc", "left").select("doc", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(2)
            for i, j, data, offs in tb.texts(batch.column(1)):
                starts, ends, first = tb.words(data, offs)
                keep = np.ones(len(starts), bool)
                for k in range(i, j):
                    if cuts[k].is_valid:
                        a0, size = first[k - i], first[k - i + 1] - first[k - i]
                        for a, b in rp.spans(cuts[k].values.to_numpy(), int(size)):
                            keep[a0 + a : a0 + b] = False
                # kept words with a blank after each, gathered at once
                s, n = starts[keep], (ends - starts)[keep] + 1
                run_ = np.cumsum(n)
                place = np.repeat(s - (run_ - n), n) + np.arange(int(run_[-1]) if len(n) else 0)
                flat = np.append(data, np.uint8(32))[place] if len(place) else np.zeros(0, np.uint8)
                flat[run_ - 1] = 32
                kept = np.append(0, np.cumsum(keep))[first]
                edge = np.append(0, run_)[kept]
                sha = [hashlib.sha256(flat[a : max(a, b - 1)]).hexdigest() for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
                total = np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(total, pa.int64()), pa.array(total - np.diff(kept), pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest per row of the words left of each whole text, its documents added in batches of rising ids.

    A null text has no words. Rows that repeat an id must repeat its text and count as one document; a row
    without an id is compared with nothing and keeps everything.
    """
    picked = rp.keyed(docs, id_col, text_col)
    *early, last = batches_by_id(picked, batches)
    index = FingerprintIndex(picked.sparkSession, width, gram)
    try:
        found = [index.add(b) for b in early]
        if early:
            index.close()
            index = FingerprintIndex(picked.sparkSession, root=index.root)
        cuts, wanted = zip(*found, index.add(last), strict=True)
    finally:
        index.drop()
    wanted = reduce(DataFrame.unionByName, wanted).distinct()
    ranges = reduce(DataFrame.unionByName, cuts).unionByName(index.verify(picked, wanted))
    return rp.unkeyed(cut_words(picked, ranges))
