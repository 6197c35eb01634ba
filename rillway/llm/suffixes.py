"""Exact repeats of byte strings by bucket-pointer refinement of suffixes.

Suffixes are bucketed by their first q-gram; a bucket is refined by sorting its members on the bucket
pointers found at a later offset, which doubles the depth that a bucket stands for, and the new pointers
serve the next refinement. Refinement stops at the string length asked for. Across executors, q-gram
buckets of anchors (see ``repeats``) bring together the few stretches whose suffixes must be told apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm import repeats as rp
from rillway.llm import textbytes as tb
from rillway.llm.store import settle

WIDTH, GRAM = 100, 32


def byte_grams(flat: np.ndarray, q: int) -> np.ndarray:
    """Exact q-grams of bytes (q of 1, 2, 4 or 8) as integers."""
    x, have = flat.astype(np.uint64), 1
    while have < q:
        x = (x[:-have] << np.uint64(8 * have)) | x[have:]
        have *= 2
    return x


def pointers(values: np.ndarray) -> np.ndarray:
    """Bucket pointer of each value: where its bucket starts in sorted order."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = values[order][1:] != values[order][:-1]
    ptr = np.empty(len(order), np.int64)
    ptr[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return ptr


def refine(ptr: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Pointers at ``width`` from pointers at ``depth``; only buckets of several suffixes are sorted again."""
    n = len(ptr)
    while depth < width:
        step = min(depth, width - depth)
        many = np.bincount(ptr, minlength=n)
        active = np.flatnonzero(many[ptr[: n - step]] > 1) if n > step else np.zeros(0, np.int64)
        if not len(active):
            break
        key = ptr[active] * n + ptr[active + step]
        order = np.argsort(key, kind="stable")
        at, key = active[order], key[order]
        old = ptr[at]
        bucket = np.ones(len(at), bool)
        bucket[1:] = old[1:] != old[:-1]
        part = np.ones(len(at), bool)
        part[1:] = key[1:] != key[:-1]
        i = np.arange(len(at))
        start = np.maximum.accumulate(np.where(bucket, i, 0))
        ptr = ptr.copy()
        ptr[at] = old + np.maximum.accumulate(np.where(part, i, 0)) - start
        depth += step
    return ptr


def byte_labels(width: int):
    q = next(x for x in (8, 4, 2, 1) if x <= width)
    return lambda flat, at: refine(pointers(byte_grams(flat, q)), q, width)[at]


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Ranges (doc, lo, n) of bytes covered by a ``width``-byte string that also starts earlier.

    ``docs`` has doc and text. Rows that repeat a doc must repeat its text; they count as one document.
    """
    gram = min(gram, max(1, width // 2))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rp.anchors(docs, rp.byte_units, width, gram).repartition(parts, "fp").sortWithinPartitions("kind", "fp", "ctx", "doc", "lo")
    found = settle(rp.classes(dealt, width))
    near = rp.contexts(docs, found.where("kind = 2"), rp.byte_units, width).repartition(parts, "fp").sortWithinPartitions("fp", "doc", "lo")
    fine = rp.compared(near, byte_labels(width), np.uint8, width)
    return found.where("kind = 0").select("doc", "lo", "n").unionByName(fine)


def cut_bytes(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    met = docs.join(rp.ranges_per_document(ranges), "doc", "left").select("doc", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.column_bytes(batch.column(1))
            out: list[tuple[int, int, int, str]] = []
            for i in range(batch.num_rows):
                raw = data[offs[i] : offs[i + 1]]
                cuts = rp.spans(batch.column(2)[i].values.to_numpy() if batch.column(2)[i].is_valid else None, len(raw))
                digest, at = hashlib.sha256(), 0
                for a, b in cuts:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in cuts), len(cuts), digest.hexdigest()))
            n, removed, spans, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest per row of what is left of each whole text.

    A null text is empty. A row without an id is compared with nothing and keeps everything.
    """
    picked = rp.keyed(docs, id_col, text_col)
    return rp.unkeyed(cut_bytes(picked, repeated_ranges(picked, width, gram)))
