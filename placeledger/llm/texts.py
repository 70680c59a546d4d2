"""Vectorised helpers for Arrow batches of texts: byte slices, words and hashes of byte spans.

All work is on UTF-8 bytes. Words are runs of bytes other than 0x20 and 0x09-0x0D; only A-Z are folded to lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept and grown by each worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection, so equality is kept)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the bytes, from which :func:`span_hash` gets the hash of any span."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(_BACK, len(sums))[starts])


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """:func:`span_hash` of all spans of ``k`` bytes."""
    out = sums[k:] - sums[:-k]
    out *= _powers(_BACK, len(sums))[: len(out)]
    return mix(out)


def arrow_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its rows) for consecutive rows of at most ``limit`` bytes, or one longer row."""
    data, offsets = arrow_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        until = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[until]], offsets[row : until + 1] - offsets[row]
        row = until


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each text (and past the last) the number of its first word."""
    solid = ~SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles, text after text, and the first of each text (and past the last).

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    folded = LOWER[data]
    starts, ends, first = words(folded, offsets)
    hashes = span_hash(prefix_hash(folded), starts, ends)
    counts = np.diff(first)
    rolled = roll(hashes, size)
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    out = np.empty(bounds[-1], dtype=np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        out[bounds[i]] = roll(hashes[first[i] : first[i + 1]], int(counts[i]))[0]
    if len(rolled):
        full = np.flatnonzero(counts >= size)
        length = per_text[full]
        at = np.repeat(first[full] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        to = np.repeat(bounds[full] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        out[to] = rolled[at]
    return out, bounds


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of words of each text."""
    return np.diff(words(data, offsets)[2])


def windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, as :func:`shingles` has them, and the text of each."""
    folded = LOWER[data]
    starts, ends, first = words(folded, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inside = np.flatnonzero(text[size - 1 :] == text[: len(text) - size + 1]) if len(text) >= size else np.zeros(0, np.int64)
    return roll(span_hash(prefix_hash(folded), starts, ends), size)[inside], text[inside]


def roll(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive values; the size is part of the hash."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def with_text_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``text_key``, by which a row is found again; rows equal in all three get equal results."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
    )


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
