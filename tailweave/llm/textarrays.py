"""Whole texts as numpy arrays: words, word hashes and shingle sets straight from Arrow buffers.

Nothing here loops over characters or words in Python.  A batch is cut into slices of whole
documents of about SLICE bytes; a longer document is a slice of its own, so memory follows the
longest document, not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
BATCH_ROWS = 1024
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random odd number for each lower-cased byte; blanks weigh nothing.
BYTE64 = (_rng.integers(0, 2**63, 256, dtype=np.uint64) << U(1)) | U(1)
BYTE64 = BYTE64[LOWER]
BYTE64[SPACE] = 0
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(int(BASE), -1, 2**64))
JOIN = U(0xD6E8FEB86659FD93)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 8 << 20:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_array(column) -> pa.Array:
    """One string array without nulls (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def slices(column, most: int = SLICE, change=None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): runs of whole documents; offsets start at 0.

    The batch's own buffers are read, nothing is copied as a whole.  ``change``: a function of string arrays, applied
    to each run by itself.
    """
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + n + 1]
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, int(offsets[row]) + most, "right")) - 1
        end = min(n, max(end, row + 1))
        part = text_array(column.slice(row, end - row))
        part = change(part) if change else part
        _, where, data = part.buffers()
        own = np.frombuffer(where, np.int64 if pa.types.is_large_string(part.type) else np.int32)[part.offset : part.offset + end - row + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        yield row, end, data[own[0] : own[-1]], own - own[0]
        row = end


def trimmed(run):
    """run, a generator over batches, giving freed memory back to the system when it ends: workers live on and share a limit."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return outer


def arrow_map(df, run, schema):
    """df.mapInArrow(trimmed(run), schema) in batches of at most BATCH_ROWS texts.

    Spark's own limit, 10,000 rows, is meant for numbers; whole texts of that many rows lie in memory four times
    over (on both sides of both pipes).  The limit is a setting of the session: a higher one is lowered there.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(trimmed(run), schema)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte at which each word starts, index of the first word of each document and the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = SPACE[data]
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    fresh[1:] = blank[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(fresh & ~blank)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits for each word, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):  # pieces cut between words keep a huge document's arrays small
        last = int(np.searchsorted(starts, starts[first] + 2 * SLICE))
        last = max(last, first + 1)
        begin, end = starts[first], starts[last] if last < len(starts) else len(data)
        c = BYTE64[data[begin:end]]
        c *= powers(BASE, len(c))
        own = starts[first:last] - begin
        h = np.add.reduceat(c, own)
        h *= powers(BASE_INVERSE, len(c))[own]
        out[first:last] = h
        first = last
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and the end)."""
    starts, first = word_spans(data, offsets)
    return word_hashes(data, starts), first


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of width words, first run of each document and the end).

    A document of fewer words, but one at least, has its whole sequence as its single run.
    """
    n = np.diff(first)
    runs = np.maximum(n - width + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate(([0], np.cumsum(runs)))
    out = np.empty(bounds[-1], np.uint64)
    if len(hashes) >= width:
        rolled = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            rolled *= JOIN
            rolled += hashes[k : len(hashes) - width + 1 + k]
        full = n >= width
        at = np.repeat(first[:-1][full] - bounds[:-1][full], runs[full])
        place = np.flatnonzero(np.repeat(full, runs))
        out[place] = rolled[place + at]
    for d in np.flatnonzero((n > 0) & (n < width)):
        h = U(0)
        with np.errstate(over="ignore"):
            for w in hashes[first[d] : first[d + 1]]:
                h = h * JOIN + w
            out[bounds[d]] = h + U(int(n[d]) * 0x632BE59BD9B4E019 & (2**64 - 1))
    return mix(out), bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each document, and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    n = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(n)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*shingles(*words(data, offsets), width))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
