"""Benchmark decontamination: short test items inside long documents, by containment of word shingles.

Items are partitioned by the size of their shingle sets. The sketch of an item is its smallest shingle hashes, as many as
its size class needs so that a document with the wanted share of the item must hold one of them. A document is too long
for a sketch of its own (a short item is a thousandth of a long document, which no usable number of minima would show), so
all its shingles are tried against the sketches, through a filter of fixed size. The shingles of the documents that the
sketches let through are joined with the items and counted: containment is verified exactly. An item of fewer words than a
shingle has is a single shingle of its own length; the runs of each such length that occurs are tried too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger.llm import bloom
from placeledger.llm.texts import shingles, slices, windows, with_text_key, word_counts
from placeledger.session import cut

FILTER_BITS = 1 << 24
PROBES = 4


def sketch_length(n: int, percent: int) -> int:
    """Minima of an item of ``n`` shingles, by the largest size of its class (powers of two), so that none is missed."""
    top = 2 ** int(n).bit_length() - 1
    return min(n, top - -(-top * percent // 100) + 1)


def _item_shingles(percent: int, size: int):
    def make(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            at, hashes, counts, sketched, short = [], [], [], [], []
            for row, data, offsets in slices(batch.column("text")):
                found, bounds = shingles(data, offsets, size)
                n_words = word_counts(data, offsets)
                for i in np.flatnonzero(np.diff(bounds)):
                    own = np.unique(found[bounds[i] : bounds[i + 1]])
                    short.append(np.full(len(own), n_words[i] if n_words[i] < size else 0))
                    at.append(np.full(len(own), row + i))
                    hashes.append(own)
                    counts.append(np.full(len(own), len(own)))
                    sketched.append(np.arange(len(own)) < sketch_length(len(own), percent))
            if at:
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(counts)), pa.array(np.concatenate(sketched)), pa.array(np.concatenate(short))],
                    names=["item_id", "item_key", "hash", "n_shingles", "sketched", "short"],
                )

    return make


def _leaks(docs: DataFrame, items: DataFrame, percent: int, size: int, filter_bits: int) -> DataFrame:
    """(doc_id, text_key, item_id, n_shared, n_shingles) of all pairs over the limit."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    rows = with_text_key(docs)
    made = with_text_key(items.select(F.col("item_id").alias("doc_id"), "text")).mapInArrow(
        _item_shingles(percent, size), "item_id long, item_key long, hash long, n_shingles long, sketched boolean, short long"
    )
    made = cut(made.dropDuplicates(["item_id", "item_key", "hash"]))
    # At most one for each length under ``size``.
    lengths = sorted(r[0] for r in made.select("short").filter("short > 0").distinct().collect())

    def own_hashes(batch):
        yield np.unique(np.asarray(batch.column("hash")).view(np.uint64))

    context = rows.sparkSession.sparkContext
    known = context.broadcast((
        bloom.repeated(made.filter("sketched").select("hash"), own_hashes, filter_bits, PROBES, times=1),
        bloom.repeated(made.select("hash"), own_hashes, filter_bits, PROBES, times=1),
    ))

    def probe(batches):
        sketches, everything = known.value
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            for row, data, offsets in slices(batch.column("text")):
                found, bounds = shingles(data, offsets, size)
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
                for length in lengths:
                    more, of = windows(data, offsets, length)
                    found, text = np.concatenate([found, more]), np.concatenate([text, of])
                suspect = np.zeros(len(offsets) - 1, dtype=bool)
                suspect[text[bloom.has(sketches, found, PROBES)]] = True
                keep = np.flatnonzero(suspect[text])
                keep = keep[bloom.has(everything, found[keep], PROBES)]
                at = pa.array(row + text[keep])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), keys.take(at), pa.array(found[keep].view(np.int64))], names=["doc_id", "text_key", "hash"]
                )

    hits = rows.mapInArrow(probe, "doc_id long, text_key long, hash long").distinct()
    return (
        hits.join(made, "hash").groupBy("doc_id", "text_key", "item_id", "item_key")
        .agg(F.count(F.lit(1)).alias("n_shared"), F.max("n_shingles").alias("n_shingles"), F.max("sketched").alias("candidate"))
        .filter(F.col("candidate") & (100 * F.col("n_shared") >= percent * F.col("n_shingles")))
    )


def find_leaks(docs: DataFrame, items: DataFrame, percent: int = 75, size: int = 5, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): items of which a document holds ``percent`` or more of the distinct shingles.

    Words are runs of anything but 0x20 and 0x09-0x0D, with A-Z folded. A text of fewer than ``size`` words is one shingle;
    such an item counts as held by a document that has its words in a row. Null texts, and texts without words, match nothing. Of
    several rows with one doc_id or item_id the best pair counts. Null ids stay null and are one id.
    """
    found = _leaks(docs, items, percent, size, filter_bits)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shared", "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_shingles")


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 75, size: int = 5, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs``, with all columns, in which :func:`find_leaks` finds no item."""
    bad = _leaks(docs, items, percent, size, filter_bits).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    match = F.col("own.doc_id").cast("long").eqNullSafe(F.col("bad_id")) & (F.xxhash64(F.col("own.text").cast("string")) == F.col("bad_key"))
    return own.join(bad, match, "left_anti").select("own.*")
