"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm import textbytes as tb
from rillway.llm.mixing import apart
from rillway.llm.store import bounded, settle

END_ID = 1
CACHE = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path() -> str:
    """The public vocabulary that the queries use; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length): full windows first, then what is left."""
    return [(s, min(window, total - s)) for s in range(0, total, window)]


#: Classes of bytes. Letters are A-Z, a-z, À-Ö, Ø-ö and ø-ÿ, marks ASCII ones but the apostrophe: lower-casing and
#: NFC leave a run of either as it is but for case, and the vocabulary's splitting pattern cuts exactly between them.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[i for i in range(33, 127) if not chr(i).isalnum()]] = _MARK
_CLASS[[i for i in range(128) if chr(i).isalpha()]] = _LETTER
_CLASS[ord("'")] = _OTHER
_CLASS[tb.SPACE] = _SPACE
_LATIN = 0xC3  # leads U+00C0 to U+00FF, of which the capitals lie 32 before the small letters
_CLASS[_LATIN] = _LETTER
#: Plain spans that are tokenised as one line.
LINE = 128


class SpanIds(dict):
    """Little-endian ids of spans (UTF-8 keys), learnt a chunk at a time and emptied beyond CACHE entries."""

    def __init__(self, tokenizer):
        self.tokenizer, self.classes = tokenizer, _CLASS.copy()
        for token in tokenizer.get_added_tokens_decoder().values():  # told from the text around them by the tokenizer alone
            for letter in (token.content[:1].lower(), token.content[:1].upper()):
                self.classes[list(letter.encode()[:1])] = _OTHER

    def spans(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, whether plain) of the spans of all words in turn.

        Spans are runs of letters, made small, and runs of marks, plain if at most LONG bytes; a word with any other
        byte is one span, as it is.
        """
        kind, data = self.classes[data], data.copy()
        tail = np.flatnonzero(data[:-1] == _LATIN) + 1
        of = data[tail]
        tail = tail[(of >= 0x80) & (of <= 0xBF) & (of != 0x97) & (of != 0xB7) & (kind[tail - 1] == _LETTER)]
        kind[tail] = _LETTER
        starts, ends = tb.runs(kind != _SPACE, offs)
        if len(starts):
            odd = np.maximum.reduceat(kind, starts) == _OTHER
            at, size = starts[odd], (ends - starts)[odd]
            kind[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())] = _OTHER
        tail = tail[(data[tail] <= 0x9E) & (kind[tail] == _LETTER)]
        data[tail] += 32
        data[(data >= 65) & (data <= 90) & (kind == _LETTER)] += 32
        edge = np.zeros(len(data) + 1, bool)  # a span may begin or has ended here
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offs] = True
        starts = np.flatnonzero(edge[:-1] & (kind != _SPACE))
        ends = np.flatnonzero(edge[1:] & (kind != _SPACE)) + 1
        return data, starts, ends, (kind[starts] != _OTHER) & (ends - starts <= tb.LONG)

    def of(self, keys: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of each of some distinct keys. New plain ones are tokenised by lines of many, each a word of its line."""
        got = list(map(self.get, keys))
        new = [i for i, e in enumerate(got) if e is None]
        if len(self) + len(new) > CACHE:
            self.clear()
            self.update((k, e) for k, e in zip(keys, got, strict=True) if e is not None)
        alone, many = [i for i in new if not plain[i]], [i for i in new if plain[i]]
        lines = [many[i : i + LINE] for i in range(0, len(many), LINE)]
        for i in range(0, len(lines), 16):
            texts = [b" ".join([keys[k] for k in line]).decode() for line in lines[i : i + 16]]
            for line, told in zip(lines[i : i + 16], self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
                ids, word = np.array(told.ids, "<u4").tobytes(), np.array(told.word_ids)
                cuts = [0, *(4 * (np.flatnonzero(word[1:] != word[:-1]) + 1)).tolist(), len(ids)]
                if len(cuts) == len(line) + 1:
                    for k, (a, b) in zip(line, pairwise(cuts), strict=True):
                        got[k] = ids[a:b]
                else:  # a vocabulary that cuts or drops some of them
                    alone += line
        for k in alone:
            got[k] = np.array(self.tokenizer.encode(keys[k].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self.update((keys[k], got[k]) for k in new)
        return got


_LOADED: dict[str, SpanIds] = {}


def word_ids(tokenizer: str) -> SpanIds:
    """One table per worker process and vocabulary."""
    if tokenizer not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[tokenizer] = SpanIds(Tokenizer.from_file(tokenizer))
    return _LOADED[tokenizer]


def token_ids(known: SpanIds, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): each text's ids with the end id after them.

    The vocabulary drops white space, so the ids of a text are those of its words in turn, and those of a word
    are those of its spans; each distinct span of the chunk is looked up once.
    """
    data, starts, ends, plain = known.spans(data, offs)
    at, which = tb.distinct_spans(data, starts, ends)
    raw = data.tobytes()
    entries = known.of([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], plain[at].tolist())
    flat = np.frombuffer(b"".join(entries), "<u4")
    length = np.array([len(e) for e in entries], np.int64) // 4
    begin = np.cumsum(length) - length
    per_span = length[which]
    run = np.concatenate([[0], np.cumsum(per_span)])
    ids = flat[np.arange(run[-1]) + np.repeat(begin[which] - run[:-1], per_span)]
    cuts = run[np.searchsorted(starts, offs, "left")]
    return np.insert(ids, cuts[1:], END_ID), cuts + np.arange(len(offs))


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises whole texts and cuts them; one row per piece with the CRC of its ids.

    A null text is empty and still holds the end id. A null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        for batch in batches:
            for i, j, data, offs in tb.texts(batch.column(1), 4 << 20):
                ids, bounds = token_ids(known, data, offs)
                out = []
                for doc, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                    out += [(doc, s, n, zlib.crc32(ids[a + s : a + s + n]), b - a) for s, n in cut(b - a, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


class CapacityTree:
    """Open windows by remaining capacity 0..size; finds the least capacity of at least ``need``."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest fit, removed; None if nothing fits."""
        i = self.leaves + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i + (not self.count[2 * i])
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.stacks[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; the lengths come in decreasing order and none exceeds the window."""
    tree, used, where, offset = CapacityTree(window), 0, [], []
    for n in lengths:
        got = tree.take(n)
        capacity, at = got or (window, used)
        used += got is None
        where.append(at)
        offset.append(window - capacity)
        if capacity > n:
            tree.put(capacity - n, at)
    return where, offset


def pack(cut_pieces: DataFrame, window: int = 2048, group_pieces: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Pieces of a whole window are sequences of their own. The others are dealt by hash of document and
    start into groups of about ``group_pieces``, packed one group to a task, so no task grows with the
    input; a group leaves at most a few open windows. A copy number parts equal rows. Ties are ordered
    by every column, so reruns agree. An empty input gives an empty result.
    """
    total = cut_pieces.agg(F.count("*")).first()[0]
    groups = max(1, -(-total // group_pieces))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(table: pa.Table) -> pa.Table:
        group = table.column("g")[0].as_py()
        table = table.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens"))])
        where, offset = best_fit(table.column("length").to_pylist(), window)
        return table.select(names).append_column("sequence_id", pa.array([group + groups * w for w in where], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = apart(cut_pieces.select(*names)).withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "turn"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048) -> DataFrame:
    """Pieces of all documents with their places; see ``pieces`` for null texts and ids, ``pack`` for repeated rows."""
    return pack(settle(pieces(docs, tokenizer, window)), window)
