"""MinHash near-dedup: groups of documents whose sets of word shingles are similar.

Documents with equal sets are one class, which one of them represents. The minima of many universal hashes of a set are its
signature; equal bands of it make candidates. A bucket's members are compared with a pivot of the bucket (a different one in
each bucket), not with each other; the signatures are compared first, the full sets next. Where a bucket still joins
different components, its members meet those with which they share a rare shingle. Members made of common shingles meet in
their buckets, by pairs of blocks, inside the tasks: only links leave them. Components are found by alternating large-star and
small-star.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger.llm import bloom
from placeledger.llm.components import components
from placeledger.llm.texts import shingles, slices, with_text_key
from placeledger.session import cut

#: 32 bands of 4: a pair at the limit of 0.75 shares no band once in 190,000 times.
BANDS, ROWS = 32, 4
#: A pair is compared in full if this share of its minima agrees; at 0.75 fewer do once in a million times.
PROMISING = 0.56
#: After the components are known, pairs that share a rare shingle are compared unless so few of their minima agree; at 0.75
#: fewer do once in 10^13 times.
LIKELY = 0.45
#: Members of a block; a task compares two blocks.
BLOCK_ROWS = 256
#: A shingle that more sets may have does not bring them together by itself.
HOT = 64
#: Counters of shingles: four or more for each shingle of the open members, between these limits (a byte each in driver and tasks).
MIN_SLOTS, MAX_SLOTS = 1 << 16, 1 << 24
FILTER_BITS = 1 << 24
PROBES = 4
NULL_ID = -(1 << 63)

_RNG = np.random.default_rng(11)
_MUL = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures of the sets that stand one after another; each has a shingle at least."""
    x = hashes >> np.uint64(32)
    out = np.empty((len(bounds), BANDS * ROWS), dtype=np.uint32)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat((x * _MUL[k] + _ADD[k]) >> np.uint64(32), bounds)
    return out


def _sets(column: pa.Array, size: int):
    """First row, distinct shingles of each text one after another, and their bounds."""
    for row, data, offsets in slices(column):
        found, bounds = shingles(data, offsets, size)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        order = np.lexsort((found, text))
        found, text = found[order], text[order]
        new = np.ones(len(found), dtype=bool)
        new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        found, text = found[new], text[new]
        yield row, found, np.searchsorted(text, np.arange(len(offsets)))


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, digest, signature) of each row; no digest and signature without shingles."""

    def work(batches):
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID)
            for row, found, bounds in _sets(batch.column("text"), size):
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                minima = _minima(found, bounds[:-1][full]) if len(full) else np.zeros((0, 1), np.uint32)
                digests, marks = [None] * len(counts), [None] * len(counts)
                for k, i in enumerate(full.tolist()):
                    digests[i] = hashlib.blake2b(found[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest()
                    marks[i] = minima[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(counts)), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "signature"],
                )

    return with_text_key(docs).select("doc_id", "text").mapInArrow(work, "doc_id long, n_shingles long, digest binary, signature binary")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, shingles): the sets of the documents named in ``wanted`` (node), as 64-bit numbers one after another."""

    def hashes_of(batch):
        from placeledger.llm.texts import mix

        yield np.unique(mix(np.asarray(batch.column("node")).view(np.uint64)))

    named = docs.sparkSession.sparkContext.broadcast(bloom.repeated(wanted.select("node"), hashes_of, FILTER_BITS, PROBES, times=1))

    def work(batches):
        from placeledger.llm.texts import mix

        for batch in batches:
            ids = batch.column("doc_id").fill_null(NULL_ID)
            keep = np.flatnonzero(bloom.has(named.value, mix(np.asarray(ids).view(np.uint64)), PROBES))
            ids, texts = np.asarray(ids)[keep], batch.column("text").take(pa.array(keep))
            for row, found, bounds in _sets(texts, size):
                n = len(bounds) - 1
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row : row + n][full]), pa.array([found[bounds[i] : bounds[i + 1]].tobytes() for i in full], pa.binary())], names=["node", "shingles"]
                )

    found = with_text_key(docs).select("doc_id", "text").mapInArrow(work, "node long, shingles binary")
    # Rows that share an id are one document, whose sets are linked anyway; each of them is compared.
    return found.join(wanted.select("node").distinct(), "node", "left_semi").distinct()


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    # Sizes alone rule out many pairs.
    near = (100 * F.length("sa") >= percent * F.length("sb")) & (100 * F.length("sb") >= percent * F.length("sa"))

    def work(batches):
        for batch in batches:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").filter(near).select("a", "b", "sa", "sb").mapInArrow(work, "a long, b long")


def _frequencies(sets: DataFrame, slots: int) -> np.ndarray:
    """How many of the sets have a shingle of each slot, up to 255. It is never less than for the shingle itself."""
    width = slots // bloom.SLICES

    def send(batches):
        counts = np.zeros(slots, dtype=np.uint32)
        for batch in batches:
            for x in batch.column("shingles").to_pylist():
                at = (np.frombuffer(x, np.uint64) & np.uint64(slots - 1)).astype(np.int64)
                np.add.at(counts, at, 1)
        counts = np.minimum(counts, 255).astype(np.uint8).reshape(bloom.SLICES, width)
        keep = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array([pa.compress(counts[i].tobytes(), codec="zstd", asbytes=True) for i in keep], pa.binary())], names=["slice", "counts"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = np.frombuffer(pa.decompress(packed, width, codec="zstd", asbytes=True), np.uint8)
                sums[i] = np.minimum(sums.get(i, np.zeros(width, np.uint16)) + more, 255).astype(np.uint16)
        for i, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([counts.astype(np.uint8).tobytes()], pa.binary())], names=["slice", "counts"])

    out = np.zeros(slots, dtype=np.uint8)
    schema = "slice int, counts binary"
    # Not more than ``slots`` bytes come to the driver, whatever the input.
    for i, counts in sets.select("shingles").mapInArrow(send, schema).repartition(bloom.SLICES, "slice").mapInArrow(merge, schema).collect():
        out[i * width : (i + 1) * width] = np.frombuffer(counts, np.uint8)
    return out


def _rare(sets: DataFrame, percent: int, hot: int) -> DataFrame:
    """(node, n, token): the repeated shingles among the rarest of each set, of which similar sets must share one.

    Shingles that more than ``hot`` sets may have are one null token of the node. ``sets`` (node, shingles).
    """
    total = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    slots = min(max(1 << (total // 2).bit_length(), MIN_SLOTS), MAX_SLOTS)
    known = sets.sparkSession.sparkContext.broadcast(_frequencies(sets, slots))

    def work(batches):
        for batch in batches:
            nodes, sizes, tokens = [], [], []
            cold = []
            for node, x in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                own = np.frombuffer(x, np.uint64)
                often = known.value[(own & np.uint64(slots - 1)).astype(np.int64)]
                first = np.lexsort((own, often))[: len(own) + (-percent * len(own)) // 100 + 1]
                own, often = own[first], often[first]
                some = own[(often > 1) & (often <= hot)]
                top = int((often > hot).any())
                tokens.append(np.concatenate([some, np.zeros(top, np.uint64)]))
                cold.append(np.arange(len(some) + top) < len(some))
                nodes.append(np.full(len(some) + top, node, np.int64))
                sizes.append(np.full(len(some) + top, len(x) // 8, np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(tokens).view(np.int64), mask=~np.concatenate(cold))], names=["node", "n", "token"]
                )

    return sets.select("node", "shingles").mapInArrow(work, "node long, n long, token long")


def _meetings(own: DataFrame, block_rows: int) -> DataFrame:
    """(key, lo, hi, node, component, block): members of a bucket by pairs of blocks, so that all that are in different components meet.

    The largest component of a bucket has blocks of its own, which meet the others' blocks and not each other.
    """
    parts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    open_keys = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks_of = lambda n: F.ceil(n / block_rows).cast("int")
    placed = own.join(open_keys.select("key", "top.component", blocks_of(F.col("top.n")).alias("n_main"), blocks_of(F.col("n") - F.col("top.n")).alias("n_others")).withColumnRenamed("component", "top"), "key")
    main, turn = F.col("component") == F.col("top"), F.xxhash64("node")
    block = F.when(main, F.col("n_others") + F.pmod(turn, F.col("n_main"))).otherwise(F.pmod(turn, F.col("n_others"))).cast("int")
    met = F.sequence(F.lit(0), F.col("n_others") + F.when(main, 0).otherwise(F.col("n_main")) - 1)
    dealt = placed.select("key", "node", "component", block.alias("block"), F.explode(met).alias("other"))
    return dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "node", "component", "block")


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, marks: DataFrame, percent: int, hot: int = HOT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links between members of one bucket that are in different components so far.

    Similar sets share one of their rarest shingles (prefix filter), so members meet by such a shingle if few have it. Only
    members whose rarest shingles include ones that many have meet in their buckets, by pairs of blocks.
    """
    own = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_keys = own.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    own = cut(own.join(open_keys, "key", "left_semi"))
    nodes = own.select("node", "component").distinct()
    rare = cut(_rare(sets.join(nodes.select("node"), "node", "left_semi"), percent, hot).join(nodes, "node"))
    cold = rare.filter("token is not null")
    side = lambda x: cold.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "n")])
    near = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    met = side("a").join(side("b"), "token").filter((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & near)
    pairs = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    by_token = _compared(cut(_promising(pairs, marks, LIKELY)), sets, percent)

    def work(group: pa.Table) -> pa.Table:
        nodes, parts, block = (np.asarray(group.column(c)) for c in ("node", "component", "block"))
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        sizes = np.array([len(x) for x in sets])
        starts = np.cumsum(sizes) - sizes
        later = np.arange(len(sets))
        found = []
        for i in np.flatnonzero(block == lo):
            may = (parts != parts[i]) & (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes) & ((later > i) if lo == hi else (block == hi))
            if not may.any():
                continue
            mark = np.zeros(len(values), dtype=np.int64)
            mark[inverse[starts[i] : starts[i] + sizes[i]]] = 1
            shared = np.add.reduceat(mark[inverse], starts)
            like = may & (100 * shared >= percent * (sizes + sizes[i] - shared))
            found += [(int(nodes[i]), int(nodes[j])) for j in np.flatnonzero(like)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    common = own.join(rare.filter("token is null").select("node").distinct(), "node", "left_semi")
    by_bucket = _meetings(common, block_rows).join(sets, "node").groupBy("key", "lo", "hi").applyInArrow(work, "a long, b long")
    return by_token.union(by_bucket).distinct()


def _promising(pairs: DataFrame, marks: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of whose minima ``share`` agree. ``marks`` (node, signature)."""
    both = pairs.join(marks.select(F.col("node").alias("a"), F.col("signature").alias("ma")), "a").join(marks.select(F.col("node").alias("b"), F.col("signature").alias("mb")), "b")

    def work(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("ma", "mb"))
            keep = pa.array((x == y).mean(axis=1) >= share, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return both.mapInArrow(work, "a long, b long")


def near_groups(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    Two documents are linked if their distinct ``size``-word shingles satisfy 100 * intersection >= ``percent`` * union. Words
    are runs of anything but 0x20 and 0x09-0x0D, with A-Z folded; a text of fewer words has its whole sequence as one shingle;
    one without words, or a null, has none and is linked with nothing. ``component_id`` is the least doc_id that links reach.
    Rows that share a doc_id are one document and linked. Rows without a doc_id are one document too, whose component_id
    is null unless a link reaches a doc_id. Other columns are not read.
    """
    rows = cut(signatures(docs, size))
    full = rows.filter("digest is not null")
    # One representative for each set; every document is linked with that of its set.
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("node"))
    members = full.select("doc_id", "digest").join(classes, "digest").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    represented = full.join(classes, "digest", "inner").filter("doc_id = node").dropDuplicates(["digest"]).select("node", "signature")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    banded = represented.select("node", "signature").select("node", F.explode(bands).alias("key"))
    turn = F.struct(F.xxhash64("key", "node").alias("turn"), F.col("node"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(turn).alias("pivot")).filter("n > 1").select("key", F.col("pivot.node").alias("pivot"))
    buckets = cut(banded.join(shared, "key"))
    pairs = buckets.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    marks = represented.join(buckets.select("node").distinct(), "node", "left_semi")
    likely = cut(_promising(pairs, marks, PROMISING))
    wanted = buckets.select("node").distinct()
    sets = cut(_wanted_sets(docs, wanted, size))
    links = cut(_compared(likely, sets, percent).union(members))
    labels = cut(components(links))
    more = cut(_rest(buckets.select("key", "node"), labels, sets, marks, percent))
    # The components found so far are stars: with the new links they need few rounds.
    final = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    joined = rows.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_shingles", F.nullif(component, F.lit(NULL_ID)).alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, percent: int = 75, size: int = 5) -> DataFrame:
    """One row of each group of :func:`near_groups`, with all columns: that of the least doc_id.

    Of several rows with words and that doc_id the one with the least text hash stays. Texts without words, which are linked with
    nothing, and rows without a doc_id all stay.
    """
    kept = near_groups(docs, percent, size).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")).select(
        "own", F.col("own.doc_id").cast("long").alias("own_id"), F.xxhash64(F.col("own.text").cast("string")).alias("own_key"))
    named = own.join(kept, F.col("own_id") == F.col("kept_id"), "left_semi")
    worded = F.regexp_like(F.coalesce(F.col("own.text").cast("string"), F.lit("")), F.lit("[^ \\t-\\r]"))
    # Rows without words take no turn, so they can't take the place of one with words.
    first = named.withColumn("worded", worded).selectExpr("*", "row_number() OVER (PARTITION BY own_id, worded ORDER BY own_key) AS turn").filter("turn = 1 or not worded")
    return first.select("own.*").union(own.filter("own_id is null").select("own.*"))
