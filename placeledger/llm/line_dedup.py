"""Line dedup: lines that many documents share are dropped everywhere.

Two Bloom filters (lines seen once, lines seen twice) go over all lines first. Only lines that the second one may hold are
shuffled, as 128-bit digests of their keys, to count their documents exactly; what is found common goes back to its rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeledger.llm import bloom
from placeledger.llm.blocks import give_back
from placeledger.llm.texts import LOWER, SPACE, prefix_hash, slices, span_hash, with_text_key

#: Bits of each filter: 16 MB. More lines than it has room for only mean that more of them are counted exactly.
FILTER_BITS = 1 << 27
PROBES = 3
#: Rows whose texts are put together at once.
ROWS = 512


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Start and end of the stripped lines of each text, and the first line of each text (and past the last)."""
    at = np.flatnonzero(data == 10)
    breaks = np.searchsorted(at, offsets)
    ends = np.insert(at, breaks[1:], offsets[1:])
    first = breaks + np.arange(len(offsets))
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1] + 1
    starts[first[:-1]] = offsets[:-1]
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = b > a
    low = np.where(full, solid[np.minimum(a, len(solid) - 1)] if len(solid) else 0, starts)
    high = np.where(full, solid[b - 1] + 1 if len(solid) else 0, low)
    return low, high, first


def _keys(column: pa.Array, min_chars: int):
    """Slice by slice: first row, folded bytes, and of each line long enough its text, number, start, end and hash."""
    for row, data, offsets in slices(column):
        low, high, first = _lines(data, offsets)
        folded = LOWER[data]
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        keep = np.flatnonzero(chars[high] - chars[low] >= max(1, min_chars))
        hashes = span_hash(prefix_hash(folded), low[keep], high[keep])
        yield row, folded, text[keep], keep - first[:-1][text[keep]], low[keep], high[keep], hashes


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, text_key, lines): numbers of the lines of each document whose key is in ``min_docs`` documents or more."""
    rows = with_text_key(docs)
    filtered = min_docs > 1

    def hashes_of(batch):
        for _, _, text, _, _, _, hashes in _keys(batch.column("text"), min_chars):
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order]
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
            yield hashes[new]

    bitmap = rows.sparkSession.sparkContext.broadcast(bloom.repeated(rows.select("text"), hashes_of, filter_bits, PROBES) if filtered else None)

    def suspects(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            at, digests, numbers = [], [], []
            for row, folded, text, number, low, high, hashes in _keys(batch.column("text"), min_chars):
                hit = np.flatnonzero(bloom.has(bitmap.value, hashes, PROBES)) if filtered else np.arange(len(hashes))
                raw = folded.tobytes()
                found: dict[tuple[int, bytes], list[int]] = {}
                for t, n, a, b in zip(text[hit].tolist(), number[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                    found.setdefault((row + t, hashlib.blake2b(raw[a:b], digest_size=16).digest()), []).append(n)
                for (t, digest), lines in found.items():
                    at.append(t)
                    digests.append(digest)
                    numbers.append(np.array(lines, "<u4").tobytes())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), ids.take(at), keys.take(at), pa.array(numbers, pa.binary())],
                names=["digest", "doc_id", "text_key", "lines"],
            )
        give_back()

    found = rows.mapInArrow(suspects, "digest binary, doc_id long, text_key long, lines binary")
    common = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("digest")
    return (
        found.join(common, "digest", "left_semi").groupBy("doc_id", "text_key")
        .agg(F.collect_set("lines").alias("lines"))  # rows that are repeated as a whole give the same numbers
    )


def _rebuilt(docs: DataFrame, marks: DataFrame, schema: T.StructType, counts: bool) -> DataFrame:
    """The rows of ``docs`` with their common lines left out."""
    names, out_names = docs.columns, schema.names
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    own = own.select("own", F.xxhash64(F.col("own.text").cast("string")).alias("own_key"))
    marked = marks.withColumnRenamed("doc_id", "mark_id")
    joined = own.join(
        marked, (F.col("own.doc_id").cast("long").eqNullSafe(F.col("mark_id"))) & (F.col("own_key") == F.col("text_key")), "left"
    ).select("own", "lines")

    def rebuild(batches):
        for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
            texts, n_lines, n_dropped = [], [], []
            for text, marks in zip(batch.column("own").field("text").cast(pa.string()).to_pylist(), batch.column("lines").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                drop = set().union(*(np.frombuffer(m, "<u4").tolist() for m in marks)) if marks else ()
                kept = text if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(kept)
                n_lines.append(len(lines))
                n_dropped.append(len(drop))
            own = batch.column("own")
            columns = [pa.array(texts, pa.string()) if c == "text" else own.field(c) for c in names] if not counts else [
                own.field("doc_id").cast(pa.int64()), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=out_names)
        give_back()

    return joined.mapInArrow(rebuild, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``docs`` with all its columns, its ``text`` without the lines that ``min_docs`` documents or more have.

    A text is split at ``\\n``. The key of a line is the line without white space (0x20, 0x09-0x0D) at its ends and with A-Z
    folded; keys of fewer than ``min_chars`` code points (at least one) are never dropped. Each row counts as a document, also
    rows that repeat or have no id. A null text has one empty line and stays null; a text of common lines only becomes empty.
    """
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema])
    return _rebuilt(docs, common_lines(docs, min_docs, min_chars, filter_bits), schema, counts=False)


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row: the text that :func:`dedup_lines` leaves, and the line counts."""
    schema = T._parse_datatype_string("doc_id long, text string, n_lines long, n_dropped long")
    return _rebuilt(docs.select("doc_id", "text"), common_lines(docs, min_docs, min_chars, filter_bits), schema, counts=True)
