"""Blocks of documents and their exchange with buckets of keys.

A task cuts its documents into blocks of bounded size and sends what it wants to know about its distinct keys, packed by
bucket of the key, to the task of the bucket; that one sees every block's distinct keys once, works out each key once and
answers each block in the order asked. So a key is shuffled once for each block that has it, not for each time it occurs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

ASKED = "block long, bucket int, payload binary"


def block_number(k: int) -> int:
    """The id of a task's block ``k``. Blocks are written to the checkpoint folder, so only the ids of one attempt count."""
    return (TaskContext.get().partitionId() << 32) + k


def give_back() -> None:
    """Hand freed memory back to the machine: a worker lives on between blocks, tasks and stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def payloads(batches):
    """(block, payload) of each row; one payload at a time is copied out of a batch."""
    for batch in batches:
        for block, payload in zip(batch.column("block"), batch.column("payload"), strict=True):
            yield block.as_py(), payload.as_py()
            give_back()


def buckets(spark, per_partition: int = 4) -> int:
    """How many buckets: a few for each shuffle partition, so that a bucket's keys fit in memory as those do."""
    return max(16, per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        kind = a.dtype.str.encode()
        parts += [np.array([len(kind), a.size], "<i8").tobytes(), kind, a.tobytes()]
    raw = b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    at, out = 8, []
    for _ in range(int.from_bytes(raw[:8], "little")):
        width, size = (int.from_bytes(raw[at + 8 * k : at + 8 * k + 8], "little") for k in (0, 1))
        kind = np.dtype(raw[at + 16 : at + 16 + width].decode())
        at += 16 + width
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * kind.itemsize
    return out


def least(values: np.ndarray) -> np.ndarray:
    """The same values in the narrowest unsigned type."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def planes(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Numbers as byte planes: the small ones in one byte, the others, marked by 255, in three more, or in four if they need it."""
    big = (values[values >= 255] - 255).astype("<u4").view(np.uint8).reshape(-1, 4)
    if len(values) and int(values.max()) - 255 >= 1 << 32:
        raise ValueError("a number of more than four bytes")
    return np.minimum(values, 255).astype(np.uint8), *(big[:, k] for k in range(4 if big[:, 3].any() else 3))


def from_planes(arrays) -> np.ndarray:
    small, *big = arrays
    kind = np.int32 if len(big) < 4 else np.int64
    out = small.astype(kind)
    out[small == 255] += sum(b.astype(kind) << (8 * k) for k, b in enumerate(big))
    return out


def asked(rows) -> pa.RecordBatch:
    """(block, bucket, payload) rows as a batch."""
    block, bucket, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], names=["block", "bucket", "payload"]
    )


def answered(questions: DataFrame, answer: Callable[[list[tuple[int, bytes]]], list[tuple[int, bytes]]]) -> DataFrame:
    """For each bucket, ``answer`` gets (block, payload) of all blocks, ordered by block, and gives such pairs back."""

    def work(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        got = sorted(zip(group.column("block").to_pylist(), group.column("payload").to_pylist(), strict=True))
        return pa.Table.from_batches([asked([(block, bucket, payload) for block, payload in answer(got)])])

    return questions.groupBy("bucket").applyInArrow(work, ASKED)
