"""Quality rules and robust multivariate outliers.

A text's statistics are transformed to a vector. For each language and source, and for each language and for all, towards
which estimates of few rows lean, the minimum-covariance-determinant estimate of location and scatter is sought by concentration
steps over all rows: the share of rows nearest by Mahalanobis distance gives the next estimate. Each step is one aggregation:
rows are summed by group and distance bin, so that a group of any size is summed before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeledger.llm.texts import SPACE, prefix_hash, roll, slices, span_hash, words
from placeledger.session import cut, small

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Share of a group's rows that its estimate rests on.
SHARE = 0.75
STEPS = 6
#: An estimate leans towards that of its language, and a language's towards that of all rows, as if so many rows were added.
PRIOR_ROWS = 25
#: A row is rejected beyond this squared distance; the 0.999 quantile of chi-squared with 5 degrees of freedom.
CUTOFF = 20.515
#: Least spread of each number of the vector: log word length, log symbols, repeated lines, repeated words, capitals.
FLOORS = (0.1, 0.4, 0.2, 0.2, 0.15)
P = len(FLOORS)
_CHI2_MEDIAN = 4.351
_BINS = 16

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long"


def _statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = words(data, offsets)
    texts = len(offsets) - 1
    n_words = np.diff(first)
    at_char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    sums = np.concatenate([[0], np.cumsum(at_char[ends] - at_char[starts])])
    symbol = np.zeros(256, dtype=bool)
    symbol[list(b"#*$%&|<>")] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[data])])
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    hashes = prefix_hash(data)
    # Lines with a word that are equal to an earlier line of their text.
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets)
    line_ends = np.insert(breaks, before[1:], offsets[1:])
    line_first = before + np.arange(texts + 1)
    line_starts = np.empty_like(line_ends)
    line_starts[1:] = line_ends[:-1] + 1
    line_starts[line_first[:-1]] = offsets[:-1]
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    line_text = np.repeat(np.arange(texts), np.diff(line_first))
    full = solid[line_ends] > solid[line_starts]
    line_hash, line_text = span_hash(hashes, line_starts[full], line_ends[full]), line_text[full]
    order = np.lexsort((line_hash, line_text))
    same = (line_hash[order][1:] == line_hash[order][:-1]) & (line_text[order][1:] == line_text[order][:-1])
    n_dup = np.bincount(line_text[order][1:][same], minlength=texts)
    # Words in windows of three words that the text has twice or more.
    windows = roll(span_hash(hashes, starts, ends), 3)
    word_text = np.repeat(np.arange(texts), n_words)
    own = np.flatnonzero(word_text[2:] == word_text[:-2]) if len(word_text) > 2 else np.zeros(0, np.int64)
    order = own[np.lexsort((windows[own], word_text[own]))]
    pair = (windows[order][1:] == windows[order][:-1]) & (word_text[order][1:] == word_text[order][:-1])
    again = np.zeros(len(word_text) + 2, dtype=bool)
    again[order[1:][pair]] = True
    again[order[:-1][pair]] = True
    covered = again[:-2].copy()
    covered[1:] |= again[:-3] if len(covered) else False
    covered[2:] |= again[: max(0, len(covered) - 2)]
    repeats = np.concatenate([[0], np.cumsum(covered[: len(word_text)])])
    return [n_words, sums[first[1:]] - sums[first[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]], n_dup, repeats[first[1:]] - repeats[first[:-1]], capitals[offsets[1:]] - capitals[offsets[:-1]]]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts in ``STATISTICS`` and ``base_failed`` of each row, from its whole text (null: none).

    Words are runs of anything but 0x20 and 0x09-0x0D, compared as they stand. ``n_dup_lines`` counts lines with a word that
    equal an earlier line, ``n_repeat_words`` words in windows of three words found twice or more, the first included.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))

    def work(batches):
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(row, n) for c in ("doc_id", "lang", "source")] + [pa.array(x, pa.int64()) for x in _statistics(data, offsets)],
                    names=["doc_id", "lang", "source", *(c.split()[0] for c in STATISTICS.split(", "))],
                )

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(work, f"doc_id long, lang string, source string, {STATISTICS}").withColumn("base_failed", failed)


def _vector():
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(chars / n), F.log(F.col("n_symbols") / (chars + 100) + 0.01), F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_dup_lines") * 5 / (n + 50)))),
        F.asin(F.sqrt(F.col("n_repeat_words") / (n + 50))), F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_capitals") / (chars + 100)))),
    ]


_ESTIMATE = "key string, start int, n long, mean array<double>, inverse array<double>, logdet double, scale double"


def _estimates(sums: DataFrame) -> DataFrame:
    """Location and inverse scatter of each (key, start) from its sums; each number has its least spread added."""

    def work(batches):
        floor = np.diag(np.square(FLOORS))
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                mean = np.array(row.sums) / row.n
                cross = np.zeros((P, P))
                cross[np.triu_indices(P)] = row.products
                cross = np.triu(cross) + np.triu(cross, 1).T
                scatter = cross / row.n - np.outer(mean, mean) + floor
                out.append((row.key, row.start, row.total, mean, np.linalg.inv(scatter).ravel(), float(np.linalg.slogdet(scatter)[1]), row.scale))
            yield pd.DataFrame(out, columns=["key", "start", "n", "mean", "inverse", "logdet", "scale"])

    return sums.mapInPandas(work, _ESTIMATE)


def _distance(x, mean, inverse):
    d = [x[i] - mean[i] for i in range(P)]
    return sum(((inverse[i * P + j] * (1 if i == j else 2)) * d[i] * d[j] for i in range(P) for j in range(i, P)), F.lit(0.0))


def _concentrate(rows: DataFrame, distance, by: list[str]) -> DataFrame:
    """Sums over the nearest ``SHARE`` of the rows of each key and start, to the end of a distance bin, and their number.

    ``scale`` is the median squared distance of all rows, to the middle of a bin.
    """
    x = [F.col("x")[i] for i in range(P)]
    binned = rows.withColumn("bin", F.floor(F.log(distance + 1e-6) * _BINS).cast("int"))
    pairs = [(i, j) for i in range(P) for j in range(i, P)]
    part = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]
    )
    over = ", ".join(by)
    ranked = part.selectExpr(
        "*", f"sum(n) OVER (PARTITION BY {over}) AS total", f"sum(n) OVER (PARTITION BY {over} ORDER BY bin ROWS UNBOUNDED PRECEDING) - n AS before"
    )
    return ranked.filter(F.col("before") < SHARE * F.col("total")).groupBy(*by).agg(
        F.sum("n").alias("n"), F.max("total").alias("total"),
        F.exp(F.max(F.when(F.col("before") < 0.5 * F.col("total"), F.col("bin") + 0.5)) / _BINS).alias("scale"),
        F.array(*[F.sum(f"s{i}") for i in range(P)]).alias("sums"), F.array(*[F.sum(f"p{i}_{j}") for i, j in pairs]).alias("products"),
    )


def estimate(rows: DataFrame, share_steps: int = STEPS) -> DataFrame:
    """The estimates (one for each key) of ``rows`` (key, x), best of two starts.

    One start is nearest to the medians of the single numbers, in units of their median deviations; the other to the means of
    their squashed deviations, which gives weight to how the numbers go together.
    """
    mid = rows.groupBy("key").agg(F.array(*[F.percentile_approx(F.col("x")[i], 0.5, 1000) for i in range(P)]).alias("mid"))
    apart = rows.join(small(cut(mid)), "key").groupBy("key", "mid").agg(F.array(*[
        F.greatest(1.4826 * F.percentile_approx(F.abs(F.col("x")[i] - F.col("mid")[i]), 0.5, 1000), F.lit(FLOORS[i])) for i in range(P)]).alias("dev"))
    began = cut(apart)
    z = [(F.col("x")[i] - F.col("mid")[i]) / F.col("dev")[i] for i in range(P)]
    first = rows.join(small(began), "key").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    far = F.when(F.col("start") == 0, sum((a * a for a in z), F.lit(0.0))).otherwise(
        sum((F.tanh(a) * F.tanh(a) for a in z), F.lit(0.0)) + sum((F.pow(F.tanh(z[i]) - F.tanh(z[j]), 2) for i in range(P) for j in range(i)), F.lit(0.0)))
    now = cut(_estimates(_concentrate(first, far, ["key", "start"])))
    for _ in range(share_steps):
        d = _distance([F.col("x")[i] for i in range(P)], [F.col("mean")[i] for i in range(P)], [F.col("inverse")[i] for i in range(P * P)])
        joined = rows.join(small(now.select("key", "start", "mean", "inverse")), "key")
        now = cut(_estimates(_concentrate(joined, d, ["key", "start"])))
    return now.groupBy("key").agg(F.min(F.struct("logdet", "start", "n", "mean", "inverse", "scale")).alias("e")).select("key", "e.*")


def lean(own: DataFrame, wide: DataFrame, on: list[str], prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """The estimates ``own`` mixed with the wider estimate of the same ``on``, by rows against ``prior_rows``.

    The scatter is that of the mixture: how far the two locations are apart is part of it.
    """
    names, numbers = own.columns, ["mean", "inverse", "scale"]
    both = own.join(small(wide.select(*on, *[F.col(c).alias(f"wide_{c}") for c in numbers])), on)

    def work(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                part = row.n / (row.n + prior_rows) if row.n + prior_rows else 1.0
                apart = np.array(row.mean) - np.array(row.wide_mean)
                scatter = [np.linalg.inv(np.array(x).reshape(P, P)) for x in (row.inverse, row.wide_inverse)]
                mixed = part * scatter[0] + (1 - part) * scatter[1] + part * (1 - part) * np.outer(apart, apart)
                scale = np.exp(part * np.log(row.scale) + (1 - part) * np.log(row.wide_scale))
                out.append((part * apart + np.array(row.wide_mean), np.linalg.inv(mixed).ravel(), float(scale)))
            if out:
                pdf = pdf.drop(columns=numbers).join(pd.DataFrame(out, columns=numbers, index=pdf.index))
            yield pdf[names]

    return both.mapInPandas(work, own.schema)


def judge(docs: DataFrame, cutoff: float = CUTOFF, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """The statistics of each row with ``base_failed``, ``distance`` and ``kept``.

    Rows that fail the base rules are not kept and take no part in the estimates. ``distance`` is the squared Mahalanobis
    distance from the row's group, divided by how far the group's median exceeds that of chi-squared (where it does); a row is
    kept up to ``cutoff``. A null language or source is a group of its own. Each group has an estimate of its own, which leans
    (:func:`lean`) towards its language's, that towards the estimate of all rows; a group none of whose rows passes the base rules
    needs none. Rows may repeat; an empty table gives an empty result.
    """
    stats = cut(statistics(docs))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    keys = F.array(F.concat(F.lit("0"), name("lang"), F.lit("\n"), name("source")), F.concat(F.lit("1"), name("lang")), F.lit("2"))
    vectors = stats.filter(~F.col("base_failed")).select(F.explode(keys).alias("key"), F.array(*_vector()).alias("x"))
    best = cut(estimate(vectors))
    level, kind = F.substring("key", 1, 1), F.concat(F.lit("1"), F.substring_index(F.expr("substring(key, 2)"), "\n", 1))
    everything = best.filter(level == "2")
    languages = cut(lean(best.filter(level == "1").withColumn("all", F.lit(1)), everything.withColumn("all", F.lit(1)), ["all"], prior_rows).drop("all"))
    groups = lean(best.filter(level == "0").withColumn("language", kind), languages.withColumnRenamed("key", "language"), ["language"], prior_rows)
    usable = cut(groups.select("key", F.struct("mean", "inverse", "scale").alias("e")))
    own = stats.select("*", keys[0].alias("key"), F.array(*_vector()).alias("x")).join(small(usable), "key", "left")
    d = _distance([F.col("x")[i] for i in range(P)], [F.col("e.mean")[i] for i in range(P)], [F.col("e.inverse")[i] for i in range(P * P)])
    out = own.withColumn("distance", d / F.greatest(F.col("e.scale") / _CHI2_MEDIAN, F.lit(1.0)))
    return out.select(*stats.columns, "distance", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept"))
