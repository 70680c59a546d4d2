"""Two Bloom filters over a data set: values seen in at least one row, and in at least two.

The tasks send the bit positions they set, by slice of the filter; each slice is merged by one task. The finished filter
has a fixed number of bits, which bounds what the driver gathers and sends to the executors. A filter that is too small
for its input only lets more values through: it never loses one that is repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 64
#: Hashes that are counted count if a batch has them so often.
FEW = 4
_SCHEMA = "slice int, once binary, twice binary"


def _pack(positions: np.ndarray) -> bytes:
    """Ascending positions as differences of the smallest width that holds them."""
    steps = np.diff(positions, prepend=0)
    wide = len(steps) > 0 and int(steps.max()) >= 1 << 16
    return (b"4" if wide else b"2") + steps.astype("<u4" if wide else "<u2").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, "<u4" if packed[:1] == b"4" else "<u2", offset=1), dtype=np.int64)


def positions(hashes: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    """The bits of each hash, probe by probe. ``bits`` is a power of two."""
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    for k in range(probes):
        yield ((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)


def _ascending(values: Iterator[np.ndarray]) -> np.ndarray:
    """All different values in order."""
    out = np.concatenate(list(values))
    out.sort()
    new = np.ones(len(out), dtype=bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def has(bitmap: np.ndarray, hashes: np.ndarray, probes: int) -> np.ndarray:
    """Which hashes the filter may hold."""
    found = np.ones(len(hashes), dtype=bool)
    for at in positions(hashes, len(bitmap) * 8, probes):
        found &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return found


def repeated(rows: DataFrame, hashes_of: Callable, bits: int, probes: int, times: int = 2, heavy: tuple[int, int] | None = None):
    """The bits of the filter of values seen in at least ``times`` (two or one) rows.

    ``hashes_of`` gets a record batch and yields arrays of 64-bit hashes, distinct within each row of the table. With ``heavy``
    (slots, limit) it yields pairs of such an array and one of hashes to be counted, and the result is the filter and which slots
    (lower bits of the hashes) got more than ``limit``; hashes that a batch has fewer than FEW times are not counted.
    """
    if bits & (bits - 1) or bits < SLICES * 8:
        raise ValueError("the number of bits must be a power of two")
    width = bits // SLICES

    def send(batches):
        for batch in batches:
            parts = list(hashes_of(batch))
            if heavy and parts:
                parts, counted = zip(*parts, strict=True)
                found, counts = np.unique(np.concatenate(counted), return_counts=True)
                often = counts >= FEW
                if often.any():
                    packed = np.stack([found[often] & np.uint64(heavy[0] - 1), counts[often].astype(np.uint64)]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([SLICES], pa.int32()), pa.array([packed], pa.binary()), pa.array([b""], pa.binary())], names=["slice", "once", "twice"])
            values, counts = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            if not len(values):
                continue
            once = _ascending(positions(values, bits, probes))
            twice = _ascending(positions(values[counts > 1], bits, probes))
            cuts = np.arange(SLICES + 1) * width
            a, b = np.searchsorted(once, cuts), np.searchsorted(twice, cuts)
            keep = [i for i in range(SLICES) if a[i] < a[i + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array(keep, pa.int32()),
                pa.array([_pack(once[a[i] : a[i + 1]] - cuts[i]) for i in keep], pa.binary()),
                pa.array([_pack(twice[b[i] : b[i + 1]] - cuts[i]) for i in keep], pa.binary()),
            ], names=["slice", "once", "twice"])

    def merge(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sums = None
        for batch in batches:
            for i, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i == SLICES:
                    sums = np.zeros(heavy[0], np.int64) if sums is None else sums
                    at, counts = np.frombuffer(once, np.uint64).reshape(2, -1).astype(np.int64)
                    np.add.at(sums, at, counts)
                    continue
                first, second = seen.setdefault(i, (np.zeros(width, bool), np.zeros(width, bool)))
                at = _unpack(once)
                second[at] |= first[at]
                first[at] = True
                second[_unpack(twice)] = True
        if sums is not None:
            packed = np.packbits(sums > heavy[1], bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([SLICES], pa.int32()), pa.array([b""], pa.binary()), pa.array([packed], pa.binary())], names=["slice", "once", "twice"])
        for i, filters in seen.items():
            packed = np.packbits(filters[times - 1], bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([b""], pa.binary()), pa.array([packed], pa.binary())], names=["slice", "once", "twice"]
            )

    out = np.zeros(bits // 8, dtype=np.uint8)
    merged = rows.mapInArrow(send, _SCHEMA).repartition(SLICES, "slice").mapInArrow(merge, _SCHEMA)
    # Not more than ``bits`` bits come to the driver, whatever the input.
    over = np.zeros(heavy[0] if heavy else 0, dtype=bool)
    for row in merged.select("slice", "twice").collect():
        if row[0] == SLICES:
            over = np.unpackbits(np.frombuffer(row[1], np.uint8), bitorder="little").astype(bool)
            continue
        out[row[0] * width // 8 : (row[0] + 1) * width // 8] = np.frombuffer(row[1], np.uint8)
    return (out, over) if heavy else out
