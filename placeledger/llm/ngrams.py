"""LM scoring by a weighted backoff automaton.

States are the words that a token may follow (and the start of a text), under a root. A state has an arc for each bigram of
the training texts, with the probability that absolute discounting leaves it plus its share of the lower order; its failure
arc leads to the root with the weight of what was taken off. The root has an arc for every token: its smoothed unigram.
Scoring walks a text once from left to right: it carries the state and adds up the log-probabilities of the arcs taken.

The model is as large as the corpus, so no task holds it: a block of documents asks for the arcs that its texts can take, and
gets their counts from the tasks that count them. Contexts with many tokens are spread over all buckets; there can be no more
than ``HOT_SHARE`` of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger.llm import blocks
from placeledger.llm.texts import LOWER, mix, prefix_hash, slices, span_hash, words
from placeledger.session import cut

BLOCK_BYTES = 4 << 20
#: A word with more than this share of the training tokens is a hot context, so there are at most ``HOT_SHARE`` of them.
HOT_SHARE = 5000
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
_WORD = np.uint64(0xFF51AFD7ED558CCD)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each closed by the end, and how many each text has."""
    found, counts = [], []
    for _, data, offsets in slices(column):
        folded = LOWER[data]
        starts, ends, first = words(folded, offsets)
        hashes = span_hash(prefix_hash(folded), starts, ends)
        found.append(np.insert(hashes, first[1:], END))
        counts.append(np.diff(first) + 1)
    return (np.concatenate(found), np.concatenate(counts)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The state each token is read in."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(counts) - counts] = START
    return out


def _bigrams(tokens: np.ndarray, counts: np.ndarray, train: np.ndarray, hot: np.ndarray, n: int):
    """Distinct bigrams by (bucket, context, hash): their context, hash, bucket, training count, and each token's bigram."""
    context = _contexts(tokens, counts)
    pair = mix(context * _WORD + tokens)
    # A hot context is spread by its bigrams; any other has all its arcs in one bucket.
    at = np.searchsorted(hot, context)
    spread = hot[np.minimum(at, len(hot) - 1)] == context if len(hot) else np.zeros(len(context), bool)
    bucket = np.where(spread, pair, mix(context)) % np.uint64(n)
    values, first, inverse = np.unique(pair, return_index=True, return_inverse=True)
    weights = np.bincount(inverse, weights=np.repeat(train, counts), minlength=len(values)).astype(np.int64)
    order = np.lexsort((context[first], bucket[first]))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return context[first][order], values[order], bucket[first][order].astype(np.int64), weights[order], rank[inverse]


def _by_bucket(bucket: np.ndarray, n: int):
    edges = np.searchsorted(bucket, np.arange(n + 1))
    return [(int(b), slice(int(edges[b]), int(edges[b + 1]))) for b in np.flatnonzero(np.diff(edges))]


def _count(parts: list[np.ndarray], weights: list[np.ndarray]):
    """Distinct values of all parts, their summed weights, and the place of each part's values among them."""
    values, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(weights), minlength=len(values)).astype(np.int64)
    return values, total, np.split(inverse, np.cumsum([len(p) for p in parts])[:-1])


def score(docs: DataFrame, train, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of all whole texts under a model of the rows for which the column ``train`` is true.

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, a row for each row of ``docs``. Tokens are
    words (runs of anything but 0x20 and 0x09-0x0D, A-Z folded), then one end. A null text is empty: one token. A null ``train``
    counts as false. Rows may repeat; repeated training rows count each time. Without training tokens, both scores are those
    of a uniform choice (log10 of 1). Tokens are told apart by 64-bit hashes. Scores are base-10 logarithms.
    """
    spark = docs.sparkSession
    n = blocks.buckets(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def make(batches):
        k = 0
        for batch in batches:
            texts = batch.column("text")
            for row, _, offsets in slices(texts, block_bytes):
                count = len(offsets) - 1
                tokens, counts = _tokens(texts.slice(row, count))
                ids, trained = batch.column("doc_id").slice(row, count), np.asarray(batch.column("train").slice(row, count).to_pylist(), dtype=bool)
                vocabulary, inverse = np.unique(tokens, return_inverse=True)
                uses = np.bincount(inverse, weights=np.repeat(trained, counts), minlength=len(vocabulary)).astype(np.int64)
                # Frequent words get small numbers, which compress better.
                order = np.argsort(-np.bincount(inverse), kind="stable")
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                null = np.asarray(ids.is_null().to_pylist(), dtype=bool)
                block = blocks.block_number(k)
                k += 1
                yield blocks.asked([(block, -1, blocks.pack(np.asarray(ids.fill_null(0)), null, trained, blocks.least(counts), vocabulary[order], blocks.least(uses[order]), *blocks.planes(rank[inverse])))])
                del tokens, inverse, uses, order, rank
                blocks.give_back()

    own = cut(rows.mapInArrow(make, blocks.ASKED))

    def words_of(payload: bytes):
        ids, null, trained, counts, vocabulary, uses, *numbers = blocks.unpack(payload)
        return ids, null, trained, counts.astype(np.int64), vocabulary, uses.astype(np.int64), blocks.from_planes(numbers)

    def ask_words(batches):
        for block, payload in blocks.payloads(batches):
            _, _, _, _, vocabulary, uses, _ = words_of(payload)
            bucket = (mix(vocabulary) % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            yield blocks.asked([(block, b, blocks.pack(vocabulary[order[s]], blocks.least(uses[order[s]]))) for b, s in _by_bucket(bucket[order], n)])

    def count_words(questions):
        parts = [blocks.unpack(p) for _, p in questions]
        values, total, places = _count([p[0] for p in parts], [p[1] for p in parts])
        out = [(block, blocks.pack(blocks.least(total[at]))) for (block, _), at in zip(questions, places, strict=True)]
        # Block -1: the tokens and the distinct words of the bucket, and the words with their counts that may be hot.
        top = np.argsort(-total, kind="stable")[: HOT_SHARE]
        top = top[total[top] > max(1, total.sum() // HOT_SHARE)]
        # Every training text closes with one end, so that is how often the start was left.
        return [(-1, blocks.pack(np.array([total.sum(), (total > 0).sum(), total[values == END].sum()]), values[top], total[top])), *out]

    counted = cut(blocks.answered(own.mapInArrow(ask_words, blocks.ASKED), count_words))
    # A row for each bucket; of the words, those that are hot within their own bucket at least.
    tokens_n, words_n, starts_n, tops = 0, 0, 0, []
    for row in counted.filter("block = -1").select("payload").collect():
        sums, values, total = blocks.unpack(row[0])
        tokens_n, words_n, starts_n = tokens_n + int(sums[0]), words_n + int(sums[1]), starts_n + int(sums[2])
        tops = [(v, t) for v, t in [*tops, *zip(values.tolist(), total.tolist(), strict=True)] if t * HOT_SHARE > tokens_n]
    hot = np.sort(np.array([START, *(v for v, t in tops if t * HOT_SHARE > tokens_n)], dtype=np.uint64))

    def ask_bigrams(batches):
        for block, payload in blocks.payloads(batches):
            _, _, trained, counts, vocabulary, _, numbers = words_of(payload)
            context, pair, bucket, weights, _ = _bigrams(vocabulary[numbers], counts, trained, hot, n)
            out = []
            for b, s in _by_bucket(bucket, n):
                states, sizes = _runs(context[s])
                out.append((block, b, blocks.pack(states, blocks.least(sizes), pair[s], blocks.least(weights[s]))))
            yield blocks.asked(out)

    def count_bigrams(questions):
        parts = [blocks.unpack(p) for _, p in questions]
        _, total, places = _count([p[2] for p in parts], [p[3] for p in parts])
        context = np.empty(len(total), dtype=np.uint64)
        for (states, sizes, _, _), at in zip(parts, places, strict=True):
            context[at] = np.repeat(states, sizes)
        states, inverse = np.unique(context, return_inverse=True)
        kinds = np.bincount(inverse, weights=total > 0, minlength=len(states)).astype(np.int64)
        out = []
        for (block, _), (own_states, _, _, _), at in zip(questions, parts, places, strict=True):
            out.append((block, blocks.pack(blocks.least(total[at]), blocks.least(kinds[np.searchsorted(states, own_states)]))))
        shared = np.flatnonzero(np.isin(states, hot))
        return [(-1, blocks.pack(np.array([(total == 1).sum(), (total == 2).sum()]), states[shared], kinds[shared])), *out]

    arcs = cut(blocks.answered(own.mapInArrow(ask_bigrams, blocks.ASKED), count_bigrams))
    ones, twos, hot_kinds = 0, 0, np.zeros(len(hot), dtype=np.int64)
    for row in arcs.filter("block = -1").select("payload").collect():
        sums, states, kinds = blocks.unpack(row[0])
        ones, twos = ones + int(sums[0]), twos + int(sums[1])
        hot_kinds[np.searchsorted(hot, states)] += kinds
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    below = tokens_n + 0.5 * (words_n + 1)

    def walk(block_own: pa.Table, answers: pa.Table) -> pa.Table:
        ids, null, trained, counts, vocabulary, _, numbers = words_of(block_own.column("payload")[0].as_py())
        answers = sorted(zip(answers.column("arcs").to_pylist(), answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
        known = np.concatenate([blocks.unpack(p)[0].astype(np.int64) for is_arc, _, p in answers if not is_arc])
        order = np.argsort((mix(vocabulary) % np.uint64(n)).astype(np.int64), kind="stable")
        count = np.empty(len(vocabulary), dtype=np.int64)
        count[order] = known
        # The part of the automaton that these texts can reach.
        tokens = vocabulary[numbers]
        context, _, bucket, _, arc = _bigrams(tokens, counts, trained, hot, n)
        got = [blocks.unpack(p) for is_arc, _, p in answers if is_arc]
        seen = np.concatenate([x[0].astype(np.int64) for x in got])
        kinds = np.concatenate([x[1].astype(np.int64) for x in got])
        sizes = np.concatenate([_runs(context[s])[1] for _, s in _by_bucket(bucket, n)])
        arc_kinds = np.repeat(kinds, sizes)
        at = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
        arc_kinds = np.where(hot[at] == context, hot_kinds[at], arc_kinds)
        place = np.argsort(vocabulary)
        of_state = np.minimum(np.searchsorted(vocabulary, context, sorter=place), len(vocabulary) - 1)
        arc_total = np.where(context == START, starts_n, count[place[of_state]])
        unigram = (count + 0.5) / below
        token_arc_seen, total, follow = seen[arc], arc_total[arc], arc_kinds[arc]
        with np.errstate(divide="ignore", invalid="ignore"):
            # The failure arc of a state; an unknown state is the root itself.
            failure = np.where(total > 0, discount * follow / total, 1.0)
            arc_weight = np.where(total > 0, np.maximum(token_arc_seen - discount, 0) / total, 0.0)
        lower = unigram[numbers]
        steps = np.log10(arc_weight + failure * lower)
        begin = np.cumsum(counts) - counts
        known_token = (count > 0)[numbers].astype(np.int64)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null), "held_out": pa.array(~trained), "n_tokens": pa.array(counts, pa.int64()),
            "n_known": pa.array(np.add.reduceat(known_token, begin), pa.int64()), "train_tokens": pa.array(np.full(len(ids), tokens_n), pa.int64()),
            "base_score": pa.array(np.add.reduceat(np.log10(lower), begin)), "score": pa.array(np.add.reduceat(steps, begin)),
        })

    answers = counted.select("block", "bucket", "payload", F.lit(False).alias("arcs")).unionByName(
        arcs.select("block", "bucket", "payload", F.lit(True).alias("arcs"))).filter("block >= 0")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive equal values: each once, and how often."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))
