"""Vectorised numpy work on whole Arrow string columns.

Words are maximal runs of bytes outside space and \\t..\\r; since those are ASCII, cutting UTF-8 bytes
cuts code points the same way. Columns are handled in chunks of whole texts so that the numpy
temporaries stay near ``CHUNK`` bytes times a small constant, or one text if that is longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: Longer spans are hashed one by one with BLAKE2.
LONG = 256
_FULL = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def texts(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) of each chunk."""
    data, offs = column_bytes(col)
    for i, j in chunks(offs, limit):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, zeros beyond the end; a view of one copy."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end].

    Strings are read eight bytes at a time, each block mixed in turn, all strings abreast; those of more than
    LONG bytes get a BLAKE2 digest. Strings of one length up to eight bytes never collide.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * _STEP + np.uint64(seed))
    at, eights, j = np.flatnonzero((size > 0) & (size <= LONG)), _eights(data), 0
    while len(at):
        left = size[at] - 8 * j
        out[at] = mix(out[at] ^ (eights[starts[at] + 8 * j] & _FULL[np.minimum(left, 8)]))
        at, j = at[left > 8], j + 1
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=salt).digest(), "little")
    return out


def sequence_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the short sequences values[start:end] of 64-bit hashes."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * _STEP + np.uint64(seed))
    at, j = np.flatnonzero(size > 0), 0
    while len(at):
        out[at] = mix(out[at] * _STEP + values[starts[at] + j])
        j += 1
        at = at[size[at] > j]
    return out


def window_hash(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of each ``width`` consecutive values, bytes or 64-bit hashes, by doubling: a window is hashed
    from two windows that cover it. Up to eight bytes are kept as they are until they are mixed."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, have = values, 1
    if values.dtype == np.uint8:
        h = values.astype(np.uint64)
        while 2 * have <= min(width, 8):
            h = (h[:-have] << np.uint64(8 * have)) | h[have:]
            have *= 2
    if seed or values.dtype == np.uint8:
        h = mix(h + np.uint64(seed))
    while have < width:
        step = min(have, width - have)
        h = mix(h[: len(h) - step] * _STEP + h[step:])
        have += step
    return h[:n]


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the distinct byte strings data[start:end], which of them each is), told by their bytes."""
    _, at, which = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    size, own, eights = ends - starts, at[which], _eights(data)
    same = size == size[own]
    some, j = np.flatnonzero(same & (size > 8) & (own != np.arange(len(own)))), 0
    while len(some) and j * 8 < LONG:
        left = np.minimum(size[some] - 8 * j, 8)
        same[some] &= ((eights[starts[some] + 8 * j] ^ eights[starts[own[some]] + 8 * j]) & _FULL[left]) == 0
        some, j = some[size[some] > 8 * (j + 1)], j + 1
    for i in some.tolist():
        same[i] &= np.array_equal(data[starts[i] : ends[i]], data[starts[own[i]] : ends[own[i]]])
    if not same.all():
        raw, first = data.tobytes(), {}
        own = np.array([first.setdefault(raw[a:b], i) for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))])
        at, which = np.unique(own, return_inverse=True)
    return at, which


def runs(mark: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that do not cross a text's border."""
    if len(mark) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = mark.copy(), mark.copy()
    first[1:] &= ~mark[:-1]
    last[:-1] &= ~mark[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(mark))]
    first[edge] = mark[edge]
    last[edge - 1] = mark[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text): the third has one entry more than there are texts."""
    starts, ends = runs(~SPACE[data], offs)
    return starts, ends, np.searchsorted(starts, offs, "left")


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def text_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    run = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=run[1:], dtype=np.int64)
    return run[offs[1:]] - run[offs[:-1]]


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each element, from the bounds of the texts."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
