"""Whitening of embeddings: moments of each partition by Chan's formulas, merged pairwise in a tree, eigenvectors on the driver.

Entries c become the integers floor(64 c) + 1,000,000. A task keeps three things of the rows that it has seen: their number,
the sums of the dimensions (exact) and, about their own mean, the scatter matrix; a batch is centred before it is multiplied,
and two sets meet by

    mean = mean_a + delta n_b / n        scatter = scatter_a + scatter_b + delta delta' n_a n_b / n,      delta = mean_b - mean_a

so no large squares are ever subtracted. What moves is one such triple a task, of d^2 numbers for d dimensions, whatever the
rows: the driver and each task hold a few of them. A second pass takes the moments of the whitened rows in the same way and
says how far their covariance is from the identity. Lost tasks are made again from the table; nothing is stored between.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm.ball_tree import usable

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 32
#: Integers beyond this, which doubles no longer hold, stand at it.
WIDEST = 2**53
#: Eigenvalues under this share of the trace are none: double precision can't tell them from zero.
NONE = 1e-12
#: Rows that are taken into a matrix at once.
ROWS = 4096


@dataclass
class Moments:
    """n rows; sums of each dimension as integers; mean (of x - OFFSET) and scatter about it."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scatter: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def moments_of(values: np.ndarray) -> Moments:
    """Of the rows of a matrix of doubles, without integer sums."""
    mean = values.mean(0)
    centred = values - mean
    return Moments(len(values), [], mean, centred.T @ centred)


def _widened(m: Moments, width: int) -> Moments:
    """With further dimensions, in which every row so far has entry 0."""
    more = width - len(m.mean)
    if more <= 0:
        return m
    return Moments(m.n, m.sums + [m.n * OFFSET] * more if m.sums or not len(m.mean) else [], np.pad(m.mean, (0, more)), np.pad(m.scatter, ((0, more), (0, more))))


def merged(a: Moments, b: Moments) -> Moments:
    if not a.n or not b.n:
        return a if a.n else b
    width = max(len(a.mean), len(b.mean))
    a, b = _widened(a, width), _widened(b, width)
    n, delta = a.n + b.n, b.mean - a.mean
    scatter = a.scatter + b.scatter + np.outer(delta, delta) * (a.n * (b.n / n))
    return Moments(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + delta * (b.n / n), scatter)


def matrices(column: pa.Array, width: int = 0) -> Iterator[np.ndarray]:
    """Integers x of at most ROWS rows at a time, as doubles (exact); shorter vectors end in entries 0, `width` columns at least."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        size = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(part), max(width, int(size.max(initial=0)))))
        out[np.arange(out.shape[1]) < size[:, None]] = part.flatten().to_numpy(zero_copy_only=False)
        yield np.clip(np.floor(SCALE * out) + OFFSET, -WIDEST, WIDEST)


def _integers(values: np.ndarray, most: float) -> np.ndarray:
    """As 64-bit integers where results up to `most` fit them, else as Python's."""
    return values.astype(np.int64) if most < 2.0**62 else values.astype(np.int64).astype(object)


def _sums(x: np.ndarray) -> list[int]:
    return [int(s) for s in _integers(x, len(x) * float(np.abs(x).max(initial=0))).sum(0)]


def _tree(vectors: DataFrame, of: Callable[[pa.Array], Iterator[Moments]]) -> Moments:
    """The moments of all rows: one value a partition, then pairs of them in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Moments()
        for batch in batches:
            for m in of(batch.column(0)):
                here = merged(here, m)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(here)], pa.binary())], ["state"])

    states = vectors.mapInArrow(run, "state binary").rdd.map(lambda r: pickle.loads(bytes(r.state)))
    return states.treeReduce(merged) if states.getNumPartitions() else Moments()


@dataclass
class Whitening:
    """n, sums: of the integers of the rows; vectors: components in columns; values: their eigenvalues; trace: of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        most = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        return self.n * _integers(x, most) - np.array(self.sums, np.int64 if most < 2.0**62 else object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """A column a component; components without variance are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.values > NONE * self.trace, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (deviations.astype(np.float64) / self.n) @ self.vectors * scale


def _picked(vectors: DataFrame, vector_col: str) -> DataFrame:
    return vectors.where(usable(F.col(f"`{vector_col}`")))


def fit(vectors: DataFrame, vector_col: str, components: int = COMPONENTS) -> Whitening:
    """Moments in one pass, eigenvectors of the covariance (divisor n), largest loading positive, then the pass that verifies."""
    column = _picked(vectors, vector_col).select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def own(batch: pa.Array) -> Iterator[Moments]:
        for x in matrices(batch):
            m = moments_of(x - OFFSET)
            m.sums = _sums(x)
            yield m

    total = _tree(column, own)
    width = len(total.mean)
    if not total.n or not width:
        return Whitening(total.n, [], np.zeros((width, 0)), np.zeros(0), 0.0)
    values, basis = np.linalg.eigh(total.scatter / total.n)
    first = np.argsort(-values, kind="stable")[:components]
    values, basis = values[first], basis[:, first]
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(total.n, total.sums, basis, values, float(np.trace(total.scatter) / total.n))
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def again(batch: pa.Array) -> Iterator[Moments]:
        for x in matrices(batch, width):
            yield moments_of(np.nan_to_num(shared.value.whitened(shared.value.deviations(x))))

    check = _tree(column, again)
    some = model.values > NONE * model.trace
    off = np.abs(check.scatter / check.n - np.eye(len(some)))[np.ix_(some, some)]
    model.error = float(off.max(initial=0.0))
    return model


def whiten(vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """id, component int (from 1), n long, deviation long, whitened double, explained double, identity_error double.

    A row for each vector and each of the first `components` components, or for as many as there are dimensions. Vectors that
    are null or hold null, NaN or infinity take no part; null and repeated ids do. Vectors of different lengths meet as if the
    shorter ended in entries 0, empty ones are all zeros. Where variance is missing (constant dimensions, one row, fewer rows
    than dimensions) components whose eigenvalue double precision can't tell from zero have a null `whitened` and, if there is
    no variance at all, a null `explained`; the others are whitened. No vectors give no rows. Integers stand at +-2^53 beyond
    these, and a deviation that 64 bits can't hold is null. Two jobs run at once, the rows are lazy; no other column is read.
    """
    spark = vectors.sparkSession
    schema = vectors.select(F.col(f"`{id_col}`").alias("id")).schema
    kind = schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, vector_col, components)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)
    rows = _picked(vectors, vector_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        explained = m.values / m.trace if m.trace > 0 else np.full(k, np.nan)
        for batch in batches:
            at = 0
            for x in matrices(batch.column(1), len(m.sums)):
                d = m.deviations(x)
                exact = d.astype(object) if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2.0**62 else d
                far = [int(s) if s < 2**63 else None for s in (exact * exact).sum(1)]
                own = m.whitened(d).ravel()
                rows = np.repeat(np.arange(len(x)), k)
                cols = [
                    batch.column(0).slice(at, len(x)).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(rows), m.n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(rows)),
                    pa.array(own, from_pandas=True),
                    pa.array(np.tile(explained, len(x)), from_pandas=True),
                    pa.array(np.full(len(rows), m.error)),
                ]
                at += len(x)
                yield pa.RecordBatch.from_arrays(cols, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
