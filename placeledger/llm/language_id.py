"""Language ID by unigram pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary of byte strings. The probability of a run of
letters is the sum, over all ways to cut it into pieces, of the products of their probabilities; a forward pass gives it. A
text has the product over its runs. The piece probabilities are learned by expectation maximisation (forward and backward
passes) on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeledger.llm.blocks import give_back
from placeledger.llm.bpe import vocabulary
from placeledger.session import cut

#: Texts of each language to learn from, chosen by a hash of text and id; the model needs no more.
SAMPLE_DOCS = 500
ROUNDS = 3
#: A model holds a number for each language and piece, and goes to every task.
MAX_LANGUAGES = 256
#: Longer runs of letters are learned from in stretches of so many bytes; their own sums are never cut.
TRAIN_RUN = 1024
#: Starts of a run whose pieces are looked up at once, and places of the pieces of a chunk of runs.
STRETCH, CHUNK_CELLS = 1024, 1 << 21
#: Probabilities are brought back to the range of doubles after so many bytes.
RESCALE = 8
#: Words whose sums a worker keeps.
KNOWN_WORDS = 1 << 18
#: Probabilities are kept in range by this factor for each byte.
_SCALE = 8.0
#: Byte strings are told apart by 64-bit hashes; the upper bits of the pieces' hashes are marked in a table.
_STEP, _MARK_BITS = np.uint64(0x9E3779B97F4A7C15), 22
_SHIFT = np.uint64(64 - _MARK_BITS)
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: What can stand in a run: a space, then bytes of letters, A-Z folded.
_USABLE = regex.compile(rb" ?[a-z\x80-\xff]*")
_KNOWN: dict[int, tuple[dict[str, int], np.ndarray]] = {}


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: dict[bytes, int]  # from 1; 0 is no piece
    probabilities: np.ndarray  # piece x language, scaled by the length of the piece; row 0 is 0

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def lookup(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' hashes in order, their numbers, and which upper bits occur."""
        marks = np.zeros(1 << _MARK_BITS, dtype=bool)
        hashes = np.zeros(len(self.pieces), dtype=np.uint64)
        lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        for m, found in enumerate(_hashes(list(self.pieces), self.longest, self.longest)):
            hashes[lengths == m + 1] = found[lengths == m + 1, 0]
        order = np.argsort(hashes)
        hashes, numbers = hashes[order], np.fromiter(self.pieces.values(), np.int32, len(order))[order]
        if (hashes[1:] == hashes[:-1]).any():
            raise ValueError("two pieces of one hash")
        marks[hashes >> _SHIFT] = True
        return hashes, numbers, marks


def _hashes(strings: list[bytes], width: int, longest: int):
    """For each length up to ``longest``, the hashes of the parts of that length: string x start."""
    data = np.array(strings, dtype=f"S{width}").view(np.uint8).reshape(len(strings), width).astype(np.uint64) + np.uint64(1)
    found = np.zeros_like(data)
    for m in range(min(longest, width)):
        found = (found[:, : width - m] + data[:, m:]) * _STEP
        yield found


def _runs(word: str) -> list[bytes]:
    """The runs of letters of a word as bytes, each marked as a start by a space."""
    low = word.lower()
    return [b" " + run.encode() for run in ([low] if word.isalpha() else _LETTERS.findall(low))]


def _lattice(runs: list[bytes], model: Model, begin: int = 0, stretch: int | None = None) -> np.ndarray:
    """ids[run, start, length - 1] of the pieces that fit there, for ``stretch`` starts from ``begin`` on."""
    reach = model.longest
    if stretch is None:
        stretch = max(map(len, runs))
    else:
        runs = [r[begin : begin + stretch + reach - 1] for r in runs]
    lengths = np.array([len(r) for r in runs])
    width = int(lengths.max())
    out = np.zeros((len(runs), stretch, min(reach, width)), dtype=np.int32)
    keys, numbers, marks = model.lookup
    for m, found in enumerate(_hashes(runs, width, reach)):
        found = found[:, :stretch]
        run, start = np.nonzero(marks[found >> _SHIFT] & (np.arange(found.shape[1]) + m < lengths[:, None]))
        asked = found[run, start]
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        out[run, start, m] = np.where(keys[at] == asked, numbers[at], 0)
    return out


def _forward(ids: np.ndarray, probabilities: np.ndarray, before: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[run, position, language]: the summed products of all ways to cut what is before the position, and their scale.

    ``before`` has the sums that earlier stretches left, from the first position on, in the scale ``log``. The true sum at a
    position is alpha times the exponential of the scale of its step of ``RESCALE`` positions.
    """
    runs, width, reach = ids.shape
    alpha = np.zeros((runs, max(width + reach, before.shape[1]) + 1, probabilities.shape[1]))
    alpha[:, : before.shape[1]] = before
    scales, occurs = [], [np.flatnonzero(x).tolist() for x in ids.any(axis=0)]
    for i in range(width):
        if i % RESCALE == 0:
            filled = alpha[:, i : i + max(reach, before.shape[1])]
            top = filled.max(axis=1)
            top[top == 0] = 1.0
            filled /= top[:, None]
            log = log + np.log(top)
            scales.append(log)
        for m in occurs[i]:
            fits = np.flatnonzero(ids[:, i, m])
            alpha[fits, i + m + 1] += alpha[fits, i] * probabilities[ids[fits, i, m]]
    return alpha, np.array(scales)


def _chunks(runs: list[bytes], model: Model):
    """Runs of like length together, as many as have their pieces and sums in ``CHUNK_CELLS`` places; a longer run alone."""
    order = sorted(range(len(runs)), key=lambda k: len(runs[k]))
    some: list[int] = []
    for k in order:
        # The last run is the longest of its chunk.
        cells = min(len(runs[k]), STRETCH) * max(min(len(runs[k]), model.longest), len(model.languages))
        if some and (len(some) + 1) * cells > CHUNK_CELLS:
            yield np.array(some), [runs[j] for j in some]
            some = []
        some.append(k)
    if some:
        yield np.array(some), [runs[j] for j in some]


def run_logs(runs: list[bytes], model: Model) -> np.ndarray:
    """Natural logarithms of the probability of each run in each language; a long run is passed through in stretches."""
    out = np.zeros((len(runs), len(model.languages)))
    for at, some in _chunks(runs, model):
        lengths = np.array([len(r) for r in some])
        log = np.zeros((len(some), len(model.languages)))
        alpha = np.ones((len(some), 1, len(model.languages)))
        for begin in range(0, int(lengths.max()), STRETCH):
            stretch = min(STRETCH, int(lengths.max()) - begin)
            alpha, scales = _forward(_lattice(some, model, begin, stretch), model.probabilities, alpha, log)
            own = np.flatnonzero((lengths > begin) & (lengths <= begin + stretch))
            end = lengths[own] - begin
            step = np.minimum(end // RESCALE, len(scales) - 1)
            out[at[own]] = np.log(np.maximum(alpha[own, end], 1e-300)) + scales[step, own]
            alpha, log = alpha[:, stretch:], scales[-1]
        out[at] -= lengths[:, None] * np.log(_SCALE)
    return out


def expected_counts(runs: list[bytes], weights: np.ndarray, model: Model) -> np.ndarray:
    """How often each piece is used in each language, over all segmentations. weights: run x language."""
    total = np.zeros_like(model.probabilities)
    for at, some in _chunks(runs, model):
        ids = _lattice(some, model)
        shape = (len(some), total.shape[1])
        alpha, scales = _forward(ids, model.probabilities, np.ones((shape[0], 1, shape[1])), np.zeros(shape))
        lengths = np.array([len(r) for r in some])
        ends = np.arange(len(some))
        last = scales[np.minimum(lengths // RESCALE, len(scales) - 1), ends]
        whole = np.log(np.maximum(alpha[ends, lengths], 1e-300)) + last
        beta = np.zeros_like(alpha)
        beta[ends, lengths] = 1.0
        back = np.zeros(shape)
        used, uses = [np.zeros(0, np.int32)], [np.zeros((0, shape[1]))]
        for i in range(ids.shape[1] - 1, -1, -1):
            if (i + 1) % RESCALE == 0:
                filled = beta[:, i + 1 : i + 1 + ids.shape[2]]
                top = filled.max(axis=1)
                top[top == 0] = 1.0
                filled /= top[:, None]
                back = back + np.log(top)
            share = weights[at] * np.exp(scales[i // RESCALE] + back - whole)
            for m in range(ids.shape[2]):
                fits = np.flatnonzero(ids[:, i, m])
                if len(fits):
                    piece = ids[fits, i, m]
                    step = model.probabilities[piece] * beta[fits, i + m + 1]
                    beta[fits, i] += step
                    used.append(piece)
                    uses.append(alpha[fits, i] * step * share[fits])
        used, inverse = np.unique(np.concatenate(used), return_inverse=True)
        uses = np.concatenate(uses)
        for k in range(total.shape[1]):
            total[used, k] += np.bincount(inverse, uses[:, k], len(used))
    return total


def _normalised(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    p = counts + 0.01
    p[0] = 0
    return p / p.sum(axis=0) * (_SCALE ** lengths)[:, None]


def train(docs: DataFrame, vocabulary_path: str, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """A model of the languages in the column ``lang``, from whole texts; rows without text or language are not used.

    At most ``sample_docs`` texts of each language are learned from: those with the smallest hashes. Without any labelled row
    the model has no language, and every text is ``und``.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text", "doc_id").alias("hash")).filter("text is not null and lang is not null")
    counts = sorted(map(tuple, rows.groupBy("lang").agg(F.count(F.lit(1)), F.min("hash")).limit(MAX_LANGUAGES + 1).collect()))
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(name for name, _, _ in counts)
    pieces = {b: i + 1 for i, b in enumerate(p for p in vocabulary(vocabulary_path) if _USABLE.fullmatch(p))}
    lengths = np.array([0, *map(len, pieces)], dtype=float)
    model = Model(languages, pieces, _normalised(np.ones((len(pieces) + 1, len(languages))), lengths))
    if not languages:
        return model
    # Few more than are wanted pass the hash, in any case those of the smallest; then the smallest are taken.
    share = F.create_map(*[F.lit(x) for name, n, _ in counts for x in (name, min(1.0, 1.5 * sample_docs / n + 0.0))])
    least = F.create_map(*[F.lit(x) for name, _, low in counts for x in (name, low)])
    passed = rows.filter(((F.col("hash") / 2.0**64 + 0.5) < share[F.col("lang")]) | (F.col("hash") == least[F.col("lang")]))
    ranked = passed.selectExpr("*", "row_number() OVER (PARTITION BY lang ORDER BY hash, text) AS r").filter(F.col("r") <= sample_docs)

    def count(batches):
        for batch in batches:
            found = Counter()
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found.update((lang, run[i : i + TRAIN_RUN]) for run in _runs(text) for i in range(0, len(run), TRAIN_RUN))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "run", "n"],
            )

    counted = ranked.select("text", "lang").mapInArrow(count, "lang string, run binary, n long")
    runs = cut(counted.groupBy("run", "lang").agg(F.sum("n").alias("n")).repartition("run"))
    context = docs.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(model)

        def expect(batches):
            now = sent.value
            place = {name: k for k, name in enumerate(now.languages)}
            total = np.zeros_like(now.probabilities)
            for batch in batches:
                weights: dict[bytes, np.ndarray] = {}
                for lang, run, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "run", "n")), strict=True):
                    weights.setdefault(run, np.zeros(len(place)))[place[lang]] += n
                if weights:
                    total += expected_counts(list(weights), np.array(list(weights.values())), now)
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["piece", "uses"]
            )

        found = runs.mapInArrow(expect, "piece int, uses array<double>").groupBy("piece").agg(*[F.sum(F.col("uses")[k]).alias(f"u{k}") for k in range(len(languages))])
        uses = np.zeros_like(model.probabilities)
        for row in found.collect():  # as many rows as the vocabulary at most
            uses[row[0]] = row[1:]
        model = Model(languages, pieces, _normalised(uses, lengths))
        sent.unpersist()
    return model


def _sums(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of ``values`` for each of ``n`` groups."""
    return np.stack([np.bincount(groups, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _predict(texts: pa.Array, model: Model, key: int) -> tuple[list[str], list[float]]:
    """The most probable language of each text and its posterior (languages equally likely before)."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = {}, np.zeros((0, len(model.languages) + 1))
    known, logs = _KNOWN[key]
    split = pc.utf8_split_whitespace(texts.fill_null(""))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    new = [w for w in words if w not in known]
    if new:
        if len(known) + len(new) > KNOWN_WORDS:
            known, logs, new = {}, logs[:0], words
        parts = [_runs(w) for w in new]
        of: dict[bytes, int] = {}
        flat = np.array([of.setdefault(r, len(of)) for p in parts for r in p], dtype=np.int64)
        owner = np.repeat(np.arange(len(new)), [len(p) for p in parts])
        by_run = np.ones((len(of), len(model.languages) + 1))
        by_run[:, 1:] = run_logs(list(of), model)
        known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        logs = np.concatenate([logs, _sums(owner, by_run[flat], len(new))])
        _KNOWN[key] = known, logs
    place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    total = _sums(np.asarray(pc.list_parent_indices(split)), logs[place[np.asarray(coded.indices)]], len(texts))
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    best = total[:, 1:].argmax(axis=1)
    score = 1 / np.exp(total[:, 1:] - total[np.arange(len(texts)), 1 + best][:, None]).sum(axis=1)
    some = total[:, 0] > 0
    return [model.languages[k] if yes else "und" for k, yes in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0).tolist()


def _judged(batches, model: Model, key: int):
    for batch in batches:
        for row in range(0, batch.num_rows, 512):
            some = batch.slice(row, 512)
            yield some, *_predict(some.column("text"), model, key)
    _KNOWN.clear()
    give_back()


def identify(docs: DataFrame, model: Model, *also: Column) -> DataFrame:
    """doc_id, the columns ``also``, lang_pred and score of each row, from the whole text alone.

    ``lang_pred`` is one of the model's languages, or ``und`` (score 0) if the text is null or has no letter. Ties go to the
    first language by name. Rows may repeat.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, F.col("text").cast("string").alias("text"))
    sent, key = docs.sparkSession.sparkContext.broadcast(model), hash((model.languages, model.probabilities.tobytes()))
    fields = [f for f in rows.schema if f.name != "text"]
    names = [f.name for f in fields]

    def work(batches):
        for some, found, scores in _judged(batches, sent.value, key):
            yield pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in names), pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"]
            )

    return rows.mapInArrow(work, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language: those that :func:`identify` calls ``und`` go."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), hash((model.languages, model.probabilities.tobytes()))

    def work(batches):
        for some, found, _ in _judged(batches, sent.value, key):
            yield some.filter(pa.array([x != "und" for x in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
