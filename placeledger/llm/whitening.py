"""Whitening of embeddings by shifted CholeskyQR.

The centred rows A (n x d) never leave their tasks. Each pass solves a triangular system for a block of rows, Q = A R^-1, adds
up Q'Q over all rows, and its Cholesky factor is put before R; the first pass is shifted, so that it can't break down. When
Q'Q is the identity, A = Q R, and the singular values and right vectors of the small R are those of A.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(float).eps
#: Groups that add up the parts' matrices; the driver gets one matrix of each.
GROUPS = 32
#: Gram passes at most, and the distance of Q'Q from the identity that ends them.
PASSES, CLOSE = 6, 1e-13
#: Codes are held within this bound (a component of 2^42 or more is no embedding).
CODE_LIMIT = 1 << 52
LONG = 2**63 - 1


def codes(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of each entry as a long.

    Rows whose vector is null, or holds null, NaN or infinite entries, go. Entries beyond +-2^52 codes are held there.
    """
    c = F.col(f"`{column}`").cast("array<double>")
    usable = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & (F.abs(e) < float("inf")) & ~F.isnan(e))

    def code(e):
        wide = F.floor(F.greatest(F.least(e * F.lit(float(scale)), F.lit(float(CODE_LIMIT))), F.lit(float(-CODE_LIMIT))))
        return wide.cast("long") + F.lit(shift).cast("long")

    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.transform(c, code).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), d)


def solve_upper(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows R^-1 by substitution, column after column."""
    q = np.empty_like(rows)
    for j in range(len(r)):
        q[:, j] = (rows[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(rows: DataFrame, prepare: Callable[[np.ndarray], np.ndarray], d: int, width: int) -> np.ndarray:
    """The sum over all rows of q'q with q = prepare(x). Parts are added up in :data:`GROUPS` groups, then on the driver."""

    def add(batches):
        total = np.zeros((width, width))
        for batch in batches:
            q = prepare(_matrix(batch.column("x"), d))
            total += q.T @ q
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "g": pa.array([total.tobytes()], pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(width * width)
        for _, g in sorted(zip(group.column("part").to_pylist(), group.column("g").to_pylist(), strict=True)):
            total += np.frombuffer(g)
        return pa.table({"part": pa.array([group.column("part")[0].as_py() % GROUPS], pa.int32()), "g": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x").mapInArrow(add, "part int, g binary")
    groups = parts.groupBy(F.pmod("part", F.lit(GROUPS))).applyInArrow(merge, "part int, g binary").collect()
    return sum((np.frombuffer(row.g) for row in sorted(groups)), np.zeros(width * width)).reshape(width, width)


def cholesky(g: np.ndarray, shift: float) -> np.ndarray:
    """The upper factor of g + shift; a matrix that is not positive definite gets a shift that grows until it is."""
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift * 10, EPS * np.trace(g), np.finfo(float).tiny)


class Whitening:
    """What was fitted: ``n``, exact sums, components (columns) and eigenvalues (divisor n), by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, trace: float):
        self.n, self.sums, self.components, self.values, self.trace = n, sums, components, values, trace
        self.error = 0.0

    @property
    def scales(self) -> np.ndarray:
        """sqrt of the eigenvalues; infinite where a component has no variance, so that its whitened values are zero."""
        least = self.values[0] * EPS * max(len(self.sums), 1) ** 2 if len(self.values) else 0.0
        return np.where(self.values > least, np.sqrt(self.values), np.inf)

    @property
    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n, with the whole part of S/n taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return lambda x: (x - whole).astype(float) - rest

    def project(self, count: int) -> Callable[[np.ndarray], np.ndarray]:
        centre, directions = self.centre, self.components[:, :count] / self.scales[:count]
        return lambda x: centre(x) @ directions


def fit(rows: DataFrame, keep: int) -> Whitening | None:
    """Fit on all ``rows`` (x: codes of equal length). None if there are none.

    Ties: equal rows count each. Components without variance have the eigenvalue 0. Every component's largest entry by
    size (the first of equal ones) is positive.
    """
    # Column sums in the JVM: one row of each task for each dimension.
    cells = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    got = sorted(cells.collect())
    if not got:
        return None
    n, sums = got[0].n, [int(row.s) for row in got]
    d = len(sums)
    model = Whitening(n, sums, np.eye(d), np.zeros(d), 0.0)
    centre = model.centre
    g = gram(rows, centre, d, d)
    trace = float(np.trace(g))
    r = np.eye(d)
    if trace > 0:
        shift = 11 * (n * d + d * (d + 1)) * (EPS / 2) * float(np.linalg.norm(g, 2))
        # Beyond some 10^12 rows the bound would drown the small directions; the later passes then need the shift anyway.
        r = cholesky(g, min(shift, 1e-3 * float(np.linalg.norm(g, 2))))
        for _ in range(PASSES - 1):
            # Each pass is a new function, so that its tasks get the factor as it is now.
            g = gram(rows, lambda x, r=r: solve_upper(centre(x), r), d, d)
            if np.abs(g - np.eye(d)).max() <= CLOSE:
                break
            r = cholesky(g, 0.0) @ r
            r = np.triu(r)
        # Q'Q may still have directions without any row: what is left of it goes into R before the decomposition.
        g = gram(rows, lambda x, r=r: solve_upper(centre(x), r), d, d)
        size, turn = np.linalg.eigh((g + g.T) / 2)
        r = (turn * np.sqrt(np.maximum(size, 0.0))).T @ r
        _, sigma, components = np.linalg.svd(r)
        components = components.T
        at = np.abs(components).argmax(axis=0)
        components = components * np.where(components[at, np.arange(d)] < 0, -1.0, 1.0)
        model = Whitening(n, sums, components, sigma**2 / n, trace / n)
    count = min(keep, d)
    if trace > 0:
        live = np.isfinite(model.scales[:count])
        error = np.abs(gram(rows, model.project(count), d, count) / n - np.diag(live.astype(float)))
        model.error = float(error.max())
    return model


def _squares(model: Whitening) -> Callable[[np.ndarray], list[int | None]]:
    """sum (n x - S)^2 of each row, exact; null where it is beyond 64 bits."""
    n, whole = model.n, np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([s % model.n for s in model.sums], dtype=np.int64)

    def exact(x: np.ndarray) -> list[int | None]:
        near = x - whole  # n x - S = n (x - whole) - rest
        top = float(np.abs(near).max(initial=0)) + 1
        if (top * n) ** 2 * len(model.sums) < 2**62:
            return ((near * n - rest) ** 2).sum(axis=1).tolist()
        out = [sum((a * n - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in near.tolist()]
        return [v if v <= LONG else None for v in out]

    return exact


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, keep: int = 8, **options) -> DataFrame:
    """A row for each usable vector and component up to ``keep``: its whitened value and what goes with it.

    ``deviation`` is n^2 times the squared distance from the mean, exact. Rows whose vector is null, empty, or has null or
    non-finite entries go; if lengths differ, vectors of the commonest length stay (the longest of equally common ones).
    Equal rows and ids count each, null ids stay. Components without variance have whitened and explained 0 and do not count in
    ``identity_error``. ``deviation`` is null where it needs more than 64 bits. An empty table gives no rows; other columns are
    not read. ``options`` go to :func:`codes`. The table is read once for each pass, so it must stay as it is.
    """
    spark = vectors.sparkSession
    rows = codes(vectors, **options).filter(F.size("x") > 0)
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if first is None:
        return spark.createDataFrame([], OUT)
    rows = rows.filter(F.size("x") == first.d)
    model = fit(rows, keep)
    count, d = min(keep, first.d), first.d
    project, squares = model.project(count), _squares(model)
    explained = (model.values[:count] / model.trace if model.trace > 0 else np.zeros(count)) * np.isfinite(model.scales[:count])
    n, error = model.n, model.error

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            size = len(x)
            each = pa.array(np.repeat(np.arange(size), count))
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(each), "component": pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                "n": pa.array(np.full(size * count, n)), "deviation": pa.array(squares(x), pa.int64()).take(each),
                "whitened": pa.array(project(x).ravel()), "explained": pa.array(np.tile(explained, size)),
                "identity_error": pa.array(np.full(size * count, error)),
            })

    return rows.mapInArrow(give, OUT)
