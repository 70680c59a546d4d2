"""Suffix dedup: bytes covered by strings that an earlier document has too, found with run-length indexes.

Whole corpora have no index that fits a task, so the text is dealt out such that equal strings of the wanted length meet: a
window of that length is assigned to the k-gram in it with the smallest hash, and neighbouring windows with one such anchor
make a piece. Anchors found in one document only cannot be part of a match; two Bloom filters leave them out. The pieces of
the others go to the bucket of their anchor; where an anchor has many different pieces (at the ends of a passage that many
documents share), these are cut into their windows, which go to the buckets of the windows' hashes. There a run-compressed
Burrows-Wheeler transform of the distinct pieces is built, the documents that come first last in the text, with rows ordered by as
many bytes as a window has but one, and equal rows by text position. The text positions of the run ends are its samples. The
pieces are streamed through it from right to left: a backward step gives the rows that begin with a window, and the sample of
the last run there is the last occurrence in the text, so one in the first document that has it. Where that document is
smaller than an occurrence's own, the bytes are marked. Nothing of the index is as long as its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger.llm import blocks, bloom
from placeledger.llm.texts import arrow_bytes, gram_hash, mix, prefix_hash, slices, span_hash, with_text_key

#: Bits of the filters: 64 MB.
FILTER_BITS = 1 << 29
PROBES = 2
BATCH_BYTES = 8 << 20
NULL_ID = -(1 << 63)
#: An anchor with more different pieces, added up over batches, is split; they are counted in so many slots (powers of two).
HOT_PIECES, HOT_SLOTS = 4096, 1 << 22
#: Stands after each piece; no UTF-8 text has this byte.
SEPARATOR = 0xFF


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = 1 << 28):
    """Pieces of the texts: text, start, number of windows, anchor hash and content hash of each."""
    return placed(data, offsets, length, limit)[:5]


def gram(length: int) -> int:
    """Bytes of an anchor."""
    return max(1, min(24, length // 2))


def placed(data: np.ndarray, offsets: np.ndarray, length: int, limit: int = 1 << 28):
    """As :func:`anchors`, and the position of each piece's anchor within the piece.

    Positions have 28 bits, so more than ``limit`` bytes are taken in parts, which overlap by less than a window.
    """
    if len(data) > limit:
        parts = []
        for at in range(0, len(data) - length + 1, limit - length + 1):
            part = data[at : at + limit]
            text, starts, *more = placed(part, np.clip(offsets - at, 0, len(part)), length, limit)
            parts.append((text, starts + at, *more))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    none = np.zeros(0, np.int64)
    k = gram(length)
    width = length - k + 1  # k-grams in a window
    windows = len(data) - length + 1
    if windows <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    sums = prefix_hash(data)
    grams = gram_hash(sums, k)
    least = grams & ~np.uint64((1 << 28) - 1)
    least |= np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    # A piece begins with a text, or where the anchor is another one; no window goes over the end of a text.
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    full = np.flatnonzero(counts)
    if not len(full):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    new = np.ones(windows, dtype=bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    begins, ends = offsets[full], offsets[full] + counts[full]
    new[begins] = True
    inside = np.zeros(windows + 1, dtype=np.int8)
    inside[begins], inside[ends] = 1, -1
    new &= np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    starts = np.flatnonzero(new)
    text = np.repeat(full, np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
    n = np.minimum(np.append(starts[1:], windows), (offsets[:-1] + counts)[text]) - starts
    own = (least[starts] & np.uint64((1 << 28) - 1)).astype(np.int64)
    return text, starts, n, grams[own], span_hash(sums, starts, starts + n + length - 1), own - starts


def split(found, sums: np.ndarray, length: int, hot: np.ndarray):
    """The pieces with those of ``hot`` anchors cut into single windows, each with its own hash as anchor."""
    text, starts, windows, hashes, contents, *inside = found
    some = hot[(hashes & np.uint64(len(hot) - 1)).astype(np.int64)]
    if not some.any():
        return found
    n = windows[some]
    at = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own = span_hash(sums, at, at + length)
    parts = [(text, np.repeat(text[some], n)), (starts, at), (windows, np.ones(len(at), windows.dtype)), (hashes, own), (contents, own)]
    # The anchor stands where it stood in the text.
    parts += [(x, np.repeat((x + starts)[some], n) - at) for x in inside]
    return tuple(np.concatenate([a[~some], b]) for a, b in parts)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different hash, and the number of each hash among these."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(order), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Marks:
    """Marked positions of a sequence, a bit for each position, and how many there are up to any of them."""

    def __init__(self, marked: np.ndarray):
        bits = np.packbits(marked, bitorder="little")
        self.words = np.append(bits, np.zeros(-len(bits) % 8, np.uint8)).view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def up_to(self, at: np.ndarray) -> np.ndarray:
        """How many marks there are at the positions 0..at."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] << (~at & 63).astype(np.uint64))


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of pieces (each closed by a separator) with sampled run ends.

    ``data`` has the pieces one after another, each with its separator, in falling order of their least documents ``owners``;
    ``starts`` and ``sizes`` are without it. Rows are the suffixes that have ``length`` - 1 bytes before a separator, by these
    bytes, equal ones by text position; no step comes from or leads to a shorter one. Kept are the runs (start, byte, rank, the
    text position at the end), the classes of equal rows (end, the text position and the run at the end), where the classes
    change among the rows that steps lead to, in bits, and bounds and owners of the pieces; neither the order of the suffixes
    nor anything else by text position is.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owners: np.ndarray, length: int):
        self.length = length
        self.starts, self.owners = starts, owners
        counts = sizes - (length - 2)
        lasts = np.cumsum(counts) - 1
        rows = np.repeat(starts - (lasts + 1 - counts), counts) + np.arange(counts.sum())
        n = self.n = len(rows)
        # A step does not come from the separators, which are the greatest bytes.
        left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(data))  # bytes before the separator
        order, rank = self._sorted(data, left, rows, length - 1)
        ranked = rank[order]
        self.ends = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]) + 1, n)
        self.end_samples = rows[order[self.ends - 1]]
        # Each piece enters the stream with the class of its last bytes.
        self.entries = rank[lasts]
        bwt = data[rows[order] - 1]  # before the first byte stands the last separator
        heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        run_ends = np.append(heads[1:], n)
        self.bytes = bwt[heads].astype(np.int64)
        by = np.argsort(self.bytes, kind="stable")
        self.bytes = self.bytes[by]
        # Runs by byte and start: one search finds the last run of a byte that begins before a row.
        self.keys = self.bytes * np.int64(n + 1) + heads[by]
        self.heads, self.lengths = heads[by], (run_ends - heads)[by]
        self.before = np.cumsum(self.lengths) - self.lengths  # rows of smaller bytes, and of this byte in earlier runs
        self.samples = rows[order[run_ends - 1]][by]
        number = np.empty(len(by), dtype=np.int64)
        number[by] = np.arange(len(by))
        self.end_runs = number[np.searchsorted(heads, self.ends - 1, "right") - 1]
        # The rows that steps lead to, by a byte more, and their classes.
        reached = order[np.argsort(bwt, kind="stable")][: n - int((bwt == SEPARATOR).sum())] - 1
        classes = rank[reached]
        change = np.ones(len(classes), dtype=bool)
        change[1:] = classes[1:] != classes[:-1]
        self.changes, self.classes = Marks(change), classes[change]

    @staticmethod
    def _ranks(key: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
        """The rank of each key, from 1, and how many bits a rank has. Keys have ``bits`` bits."""
        n = len(key)
        low = n.bit_length()
        if bits + low <= 64:
            # The position fits behind the key, so plain numbers are sorted.
            ordered = (key << np.uint64(low)) | np.arange(n, dtype=np.uint64)
            ordered.sort()
            order = (ordered & np.uint64((1 << low) - 1)).view(np.int64)
            ordered >>= np.uint64(low)
        else:
            order = np.argsort(key)
            ordered = key[order]
        new = np.ones(n, dtype=bool)
        np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
        numbers = np.cumsum(new, dtype=np.uint32)
        rank = np.empty(n, dtype=np.uint32)
        rank[order] = numbers
        return rank, int(numbers[-1]).bit_length()

    @classmethod
    def _sorted(cls, data: np.ndarray, left: np.ndarray, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes at ``rows`` by their first ``depth`` bytes, equal ones by position, and the rank of each.

        All suffixes are ranked by five bytes, then by doubling until a few of these parts make up the depth; the rows by those.
        """
        n, span = len(data), min(5, depth)
        padded = np.concatenate([data, np.zeros(span, np.uint8)])
        key = np.zeros(n, dtype=np.uint64)
        for j in range(span):
            key <<= np.uint64(8)
            key |= padded[j : j + n]
        # What stands behind a separator does not count.
        seen = [(1 << 8 * span) - (1 << 8 * (span - 1 - j)) for j in range(span)]
        short = np.flatnonzero(left < span - 1)
        key[short] &= np.array(seen, np.uint64)[left[short]]
        rank, bits = cls._ranks(key, 8 * span)
        while span * 5 < depth:
            key = rank.astype(np.uint64)
            key <<= np.uint64(bits)
            key[:-span] |= np.where(left[:-span] >= span, rank[span:], np.uint32(0))
            (rank, bits), span = cls._ranks(key, 2 * bits), 2 * span
        # The last part overlaps the one before where the depth is not a multiple; all of them lie within the piece.
        key, wide = rank[rows].astype(np.uint64), bits
        for at in range(span, depth, span):
            if wide + bits > 64:
                key, wide = cls._ranks(key, wide)
                key = key.astype(np.uint64)
            key = (key << np.uint64(bits)) | rank[rows + min(at, depth - span)]
            wide += bits
        rank, _ = cls._ranks(key, wide)
        rank -= np.uint32(1)
        order = (rank.astype(np.uint64) << np.uint64(32)) | np.arange(len(rows), dtype=np.uint64)
        order.sort()
        return (order & np.uint64((1 << 32) - 1)).view(np.int64), rank

    def _step(self, of: np.ndarray, byte: np.ndarray):
        """Ends of the rows reached by a backward step with ``byte`` from the rows of classes, and the last run of it there."""
        ends, at = self.ends[of], self.end_runs[of]
        # Most classes end in a run of the byte.
        other = np.flatnonzero(self.bytes[at] != byte)
        at[other] = np.searchsorted(self.keys, byte[other] * np.int64(self.n + 1) + ends[other], "left") - 1
        inside = np.minimum(ends - self.heads[at], self.lengths[at])
        return self.before[at] + inside, at

    def stream(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Matching statistics of pieces that are in the index: for each window, the position of its last occurrence.

        A match is as long as it may get, a window; its last byte goes before the next step, which widens the interval to the
        class of equal rows that has it. All pieces take a step at a time, from their last window to their first. Yields
        (pieces, window, position).
        """
        windows = sizes - self.length + 1
        at = self.entries.copy()
        for step in range(int(windows.max(initial=0))):
            on = np.flatnonzero(windows > step)
            of = at[on]
            window = windows[on] - 1 - step
            high, run = self._step(of, data[starts[on] + window].astype(np.int64))
            # The last occurrence comes from the last row of the byte: the end of its run, or of the class if the run goes on.
            whole = self.heads[run] + self.lengths[run] <= self.ends[of]
            at[on] = self.classes[self.changes.up_to(high - 1) - 1]
            yield on, window, np.where(whole, self.samples[run], self.end_samples[of]) - 1

    def first_owner(self, place: np.ndarray) -> np.ndarray:
        """The document of the piece at a text position."""
        return self.owners[np.searchsorted(self.starts, place, "right") - 1]


def _index_bucket(got: list[tuple[np.ndarray, ...]], length: int):
    """First owners of the windows of a bucket's distinct pieces, their bounds, and the number of each block's pieces (or -1).

    Of an anchor that the filters let through by mistake, all pieces are of one document; such pieces are left out.
    """
    hashes, sizes, owners, greatest, anchor, data = (np.concatenate(x) for x in zip(*got, strict=True))
    sizes = sizes.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(anchor)
    groups = np.flatnonzero(np.concatenate([[True], anchor[order][1:] != anchor[order][:-1]]))
    alone = np.minimum.reduceat(owners[order], groups) == np.maximum.reduceat(greatest[order], groups)
    keep = np.empty(len(hashes), dtype=bool)
    keep[order] = np.repeat(~alone, np.diff(np.append(groups, len(order))))
    if not keep.any():
        none = np.zeros(0, np.int64)
        return none, none, none, np.full(len(hashes), -1)
    kept = np.flatnonzero(keep)
    first, inverse = distinct(hashes[kept])
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, owners[kept])
    # The documents that come first stand last in the text.
    falling = np.argsort(-least, kind="stable")
    at = np.empty(len(first), dtype=np.int64)
    at[falling] = np.arange(len(first))
    first, least, numbers = kept[first[falling]], least[falling], np.full(len(hashes), -1)
    numbers[kept] = at[inverse]
    own_sizes = sizes[first]
    own_starts = np.cumsum(own_sizes + 1) - (own_sizes + 1)
    total = int((own_sizes + 1).sum())
    text = np.full(total, SEPARATOR, dtype=np.uint8)
    n = int(own_sizes.sum())
    shift = np.cumsum(own_sizes) - own_sizes
    text[np.repeat(own_starts - shift, own_sizes) + np.arange(n)] = data[np.repeat(starts[first] - shift, own_sizes) + np.arange(n)]
    index = RunIndex(text, own_starts, own_sizes, least, length)
    windows = own_sizes - length + 1
    bounds = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), dtype=np.int64)
    for pieces, window, place in index.stream(text, own_starts, own_sizes):
        out[bounds[pieces] + window] = index.first_owner(place)
    return out, bounds, windows, numbers


def received(sizes, inside, data, counts, doc, ids, length: int) -> tuple[np.ndarray, ...]:
    """Content hash, size, least and greatest document and anchor of a block's pieces, and their bytes.

    The block has their sizes, the places of the anchors in them, their bytes, how often each occurs, and the documents of the
    occurrences (numbers into ``ids``), which are in order by piece and document.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    starts, last, anchor = ends - sizes, np.cumsum(counts, dtype=np.int64), ends - sizes + inside
    sums = prefix_hash(data)
    return span_hash(sums, starts, ends), sizes, ids[doc[last - counts]], ids[doc[last - 1]], span_hash(sums, anchor, anchor + gram(length)), data


def marked(docs: DataFrame, length: int, filter_bits: int = FILTER_BITS, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(doc_id, text_key, spans): byte ranges, as pairs of 32-bit numbers, covered by long strings of earlier documents."""
    spark = docs.sparkSession
    n = blocks.buckets(spark, 8)
    rows = with_text_key(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))

    def hashes_of(batch):
        for _, data, offsets in slices(batch.column("text")):
            text, _, _, hashes, contents = anchors(data, offsets, length)
            different = hashes[distinct(contents)[0]]
            # Most anchors are in one text only; of the others, each text's first one counts.
            order = np.argsort(hashes)
            ordered = hashes[order]
            same = np.zeros(len(order) + 1, dtype=bool)
            np.equal(ordered[1:], ordered[:-1], out=same[1:-1])
            several = same[1:] | same[:-1]
            some, single = order[several], ordered[~several]
            some = some[np.lexsort((text[some], hashes[some]))]
            new = np.ones(len(some), dtype=bool)
            new[1:] = (text[some][1:] != text[some][:-1]) | (hashes[some][1:] != hashes[some][:-1])
            yield np.concatenate([single, hashes[some[new]]]), different

    bitmap = spark.sparkContext.broadcast(bloom.repeated(rows.select("text"), hashes_of, filter_bits, PROBES, heavy=(HOT_SLOTS, hot_pieces)))

    def send(batches):
        filters, hot = bitmap.value
        for batch in batches:
            column, ids, keys = batch.column("text"), np.asarray(batch.column("doc_id")), np.asarray(batch.column("text_key"))
            for begin, _, bounds in slices(column, BATCH_BYTES):
                part = column.slice(begin, len(bounds) - 1)
                raw, at = arrow_bytes(part)
                found = []
                for row, data, offsets in slices(part):
                    text, starts, windows, hashes, contents, inside = placed(data, offsets, length)
                    hit = np.flatnonzero(bloom.has(filters, hashes, PROBES))
                    base = at[row]
                    pieces = tuple(x[hit] for x in (text, starts, windows, hashes, contents, inside))
                    if hot.any():
                        pieces = split(pieces, prefix_hash(data), length, hot)
                    text, starts, windows, hashes, contents, inside = pieces
                    found.append((text + begin + row, starts - offsets[text], starts + base, windows, hashes, contents, inside))
                text, start, place, windows, hashes, contents, inside = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(text):
                    continue
                bucket = (mix(hashes) % np.uint64(n)).astype(np.int64)
                order = np.lexsort((ids[text], contents, bucket))
                edges = np.searchsorted(bucket[order], np.arange(n + 1))
                out = []
                for b in np.flatnonzero(np.diff(edges)):
                    some = order[edges[b] : edges[b + 1]]
                    new = np.flatnonzero(np.concatenate([[True], contents[some][1:] != contents[some][:-1]]))
                    one = some[new]
                    sizes = windows[one] + length - 1
                    shift = np.cumsum(sizes) - sizes
                    data = raw[np.repeat(place[one] - shift, sizes) + np.arange(sizes.sum())]
                    names, doc = np.unique(text[some], return_inverse=True)
                    # Hashes and documents of the pieces follow from the rest; see `received`.
                    out.append((0, int(b), blocks.pack(
                        blocks.least(sizes), blocks.least(inside[one]), data, blocks.least(np.diff(np.append(new, len(some)))),
                        blocks.least(doc), blocks.least(start[some]), ids[names], keys[names])))
                yield blocks.asked(out)

    def work(group: pa.Table) -> pa.Table:
        got = [blocks.unpack(p) for p in group.column("payload").to_pylist()]
        owner, bounds, windows, numbers = _index_bucket([received(*g[:5], g[6], length) for g in got], length)
        base = 0
        found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        for _, _, _, counts, doc, start, ids, keys in got:
            of = np.repeat(numbers[base : base + len(counts)], counts)
            base += len(counts)
            here = np.flatnonzero(of >= 0)
            of, doc, start = of[here], doc[here], start[here]
            if not len(of):
                continue
            size = windows[of]
            place = np.cumsum(size) - size
            at = np.arange(size.sum()) - np.repeat(place, size)
            hit = owner[np.repeat(bounds[of], size) + at] < np.repeat(ids[doc], size)
            # Runs of marked windows of one occurrence are one range.
            edge = np.zeros(len(hit) + 1, dtype=bool)
            edge[place] = True
            begins = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
            ends = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
            occurrence = np.repeat(np.arange(len(of)), size)[begins]
            low = start[occurrence].astype(np.int64) + at[begins]
            high = start[occurrence].astype(np.int64) + at[ends] + length
            order = np.lexsort((low, doc[occurrence]))
            spans, owners = np.stack([low, high], axis=1)[order], doc[occurrence][order]
            cuts = np.searchsorted(owners, np.arange(len(ids) + 1))
            some = np.flatnonzero(np.diff(cuts))
            # Eight bytes a range; the ranges of a document stand together.
            edges = np.append(cuts[some], len(spans)) * 8
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(edges.astype("<i8").tobytes()), pa.py_buffer(spans.astype("<u4").tobytes())])
            found.append((ids[some], keys[some], packed.cast(pa.binary())))
        return pa.table({
            "doc_id": pa.chunked_array([pa.array(f[0], pa.int64()) for f in found], pa.int64()),
            "text_key": pa.chunked_array([pa.array(f[1], pa.int64()) for f in found], pa.int64()),
            "spans": pa.chunked_array([f[2] for f in found], pa.binary()),
        })

    return rows.mapInArrow(send, blocks.ASKED).groupBy("bucket").applyInArrow(work, "doc_id long, text_key long, spans binary")


def remove_repeats(docs: DataFrame, length: int = 50, filter_bits: int = FILTER_BITS, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(doc_id, n_bytes, kept, removed): for each row the remaining bytes of its text, and the removed ranges.

    Each byte goes that is covered by a string of ``length`` bytes which also starts in a document with a smaller doc_id. All
    strings are judged on the input; overlaps count; no string goes over the end of a document. ``removed`` has the maximal
    ranges in order. A null text is empty. Rows without a doc_id come before all others; rows that share a doc_id are not
    smaller than each other. What is left may not be valid UTF-8, so ``kept`` is binary. Other columns are not read.
    """
    if length < 8 or length > 60_000:
        raise ValueError("the length must be in 8..60000")
    marks = marked(docs, length, filter_bits, hot_pieces).groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans"))
    rows = with_text_key(docs).withColumn("own_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    joined = rows.join(marks.select(F.col("doc_id").alias("own_id"), "text_key", "spans"), ["own_id", "text_key"], "left")

    def cut_out(batches):
        for batch in batches:
            data, offsets = arrow_bytes(batch.column("text"))
            kept, removed = [], []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                raw = data[offsets[i] : offsets[i + 1]]
                ranges = []
                if spans:
                    edge = np.zeros(len(raw) + 1, dtype=np.int64)
                    pairs = np.concatenate([np.frombuffer(s, "<u4").reshape(-1, 2) for s in spans])
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 1], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    ranges = turns.reshape(-1, 2).tolist()
                    raw = raw[~gone]
                kept.append(raw.tobytes())
                removed.append([{"start": a, "end": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "kept", "removed"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(cut_out, "doc_id long, n_bytes long, kept binary, removed array<struct<start: long, end: long>>")
