"""Best-fit decreasing packing of token sequences.

Best-fit decreasing looks at lengths only, and there are no more lengths than a sequence has places. So the corpus is counted
by length, and the packing is done on these counts: a segment tree over remaining capacities gives the tightest open bin in
logarithmic time, and all pieces of one length that would go to bins of one kind are placed in one step. The steps (*runs*)
say, for the r-th piece of a length, which bin it goes to and where; every piece finds its run by binary search. What one
place holds is bounded by the capacity, not by the corpus, and the result is that of best-fit decreasing over all pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeledger.llm.texts import slices
from placeledger.llm.token_files import BLOCK_BYTES, encoder
from placeledger.session import cut, small, spread

#: Pieces that a task hands on at once.
BATCH = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, nth long"


class Tightest:
    """Open bins by remaining capacity: which capacities occur is kept in a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.leaves)
        #: remaining capacity -> [(first bin, number of bins)]
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, r: int, there: bool) -> None:
        k = self.leaves + r
        self.tree[k] = there
        while k > 1:
            k >>= 1
            self.tree[k] = self.tree[2 * k] or self.tree[2 * k + 1]

    def add(self, r: int, first: int, n: int) -> None:
        """``n`` bins from number ``first`` have ``r`` left; full bins are closed."""
        if r and n:
            self.bins.setdefault(r, []).append((first, n))
            if not self.tree[self.leaves + r]:
                self._mark(r, True)

    def take(self, least: int) -> tuple[int, int, int] | None:
        """(remaining, first bin, number) of some bins with the smallest remaining capacity of at least ``least``."""
        k = self.leaves + least
        while not self.tree[k]:
            while k & 1:  # a right child: its subtree is done, go up
                k >>= 1
            if k == 0:
                return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.tree[2 * k] else 2 * k + 1
        r = k - self.leaves
        first, n = self.bins[r].pop()
        if not self.bins[r]:
            self._mark(r, False)
        return r, first, n


def best_fit_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, number, first bin, pieces per bin, offset): where the pieces of each length go.

    Piece ``r`` of a length, counted from 0, is in the run with the last first rank <= r; with j = r - first rank it goes to
    bin ``first bin + j // per bin`` at ``offset + (j % per bin) * length``. Pieces are taken by falling length, each into the
    open bin with the least remaining capacity that holds it. A bin just used has less left than all others that hold the
    length, so it stays the tightest as long as it does; that is why many pieces can be placed at once.
    """
    tree, runs, made = Tightest(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            found = tree.take(length)
            if found:
                remaining, first, n = found
            else:
                remaining, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            per = remaining // length
            take = min(left, n * per)
            runs.append((length, rank, take, first, per, capacity - remaining))
            full, more = divmod(take, per)
            tree.add(remaining, first + full + (more > 0), n - full - (more > 0))
            tree.add(remaining - more * length, first + full, int(more > 0))
            tree.add(remaining - per * length, first, full)
            rank, left = rank + take, left - take
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Encode every whole text, add ``end_id``, and cut what is longer than ``capacity`` into pieces of that many ids.

    Rows (doc_id, piece, start, length, ids_crc32, ids, part, nth): ``ids`` are packed unsigned integers (16-bit if the
    vocabulary allows), ``ids_crc32`` is over them as 32-bit ones. The first piece takes the odd length, so that all others
    fill a sequence. ``nth`` counts the pieces of a length within the ``part``.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    width = "<u2" if max(Tokenizer.from_str(tokenizer_json).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], width).tobytes()
    size = len(end)

    def make(batches):
        encode, part = encoder(source.value, width), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        rows = []

        def flush():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            texts, docs = batch.column("text"), batch.column("doc_id").to_pylist()
            for row, _, offsets in slices(texts, BLOCK_BYTES):
                data, edges = encode(texts.slice(row, len(offsets) - 1))
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    ids = bytes(data[a:b]) + end
                    wide = np.frombuffer(ids, width).astype("<u4")
                    start, piece = 0, 0
                    while start < len(wide):
                        length = (len(wide) - start) % capacity or capacity
                        crc = zlib.crc32(wide[start : start + length])
                        rows.append((docs[row + i], piece, start, length, crc, ids[start * size : (start + length) * size], part, seen[length]))
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                    if len(rows) >= BATCH:
                        yield flush()
        if rows:
            yield flush()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(columns).mapInArrow(make, PIECES)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``length`` (1 to ``capacity``), ``part`` and ``nth``.

    ``pieces`` is read three times and must give the same rows each time (a written table). Pieces of one length are told
    apart by the number of those in earlier parts (a prefix sum over a row for each part and length) and their own ``nth``.
    """
    spark = pieces.sparkSession
    by_part = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    # At most ``capacity`` rows come to the driver, whatever the corpus.
    counts = {row.length: row.n for row in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(best_fit_runs(counts, capacity))

    def assign(batches):
        length, rank, _, first, per, offset = runs.value.T
        by_length = np.lexsort((rank, length))
        length, rank, first, per, offset = (x[by_length] for x in (length, rank, first, per, offset))
        begin = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            own, nth = np.asarray(batch.column("length")), np.asarray(batch.column("base")) + np.asarray(batch.column("nth"))
            at = np.empty(len(own), np.int64)
            for some in np.unique(own).tolist():
                here = own == some
                a, b = begin[some], begin[some + 1]
                at[here] = a + np.searchsorted(rank[a:b], nth[here], "right") - 1
            j = nth - rank[at]
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("part", "nth", "base")}
            columns["sequence_id"] = pa.array(first[at] + j // per[at])
            columns["offset"] = pa.array(offset[at] + j % per[at] * own)
            yield pa.RecordBatch.from_pydict(columns)

    kept = [f for f in pieces.schema.fields if f.name not in ("part", "nth")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    names = [f.name for f in kept]
    joined = pieces.join(small(base), ["part", "length"]).select(*names, "part", "nth", "base")
    return joined.mapInArrow(assign, schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` ids as best-fit decreasing needs.

    Rows (doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset), one for each piece; the pieces of a sequence
    follow one another from offset 0 without gaps. A null or empty text has the end id alone. Each row is a document of its
    own, also if rows or ids repeat or doc_id is null; other columns are not read. An empty table gives no rows.
    """
    return place(cut(cut_pieces(docs, tokenizer_path, end_id, capacity)), capacity)
