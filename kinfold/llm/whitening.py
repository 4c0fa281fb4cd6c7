"""Whitening of embedding vectors by the eigenvectors of their covariance.

Vectors are read on the executors in Arrow batches; what leaves a task is its count, its sums or
its d x d product. The driver sees d x d numbers, never a vector. Eigenvectors are found in single
precision and corrected in double precision by matrix multiplications (Ogita and Aishima, 2018);
clusters of eigenvalues too close for that are solved anew inside their own space (the same, 2019).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
# Entries beyond this have no exact integer form.
LARGEST = 2.0**40
# The driver holds a few matrices of this width; 4096 is 128 MB each.
MOST_DIMENSIONS = 4096
ROUNDS = 20


def norm(a: np.ndarray) -> float:
    return float(np.linalg.norm(a, 2)) if a.size else 0.0


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(vectors, values, close, change): one Ogita-Aishima step for approximate eigenvectors ``x``.

    ``close`` marks pairs of values that the step cannot tell apart; for these it only mends
    orthogonality. ``change`` is the largest correction.
    """
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    # Where values lie close, an unsymmetric rounding error would cost orthogonality.
    r, s = (r + r.T) / 2.0, (s + s.T) / 2.0
    values = np.diag(s) / (1.0 - np.diag(r))
    unsure = 2.0 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    gaps = values[None, :] - values[:, None]
    close = np.abs(gaps) <= unsure
    e = np.where(close, r / 2.0, (s + values[None, :] * r) / np.where(close, 1.0, gaps))
    return x + x @ e, values, close, float(np.abs(e).max(initial=0.0))


def clusters(values: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
    """Index sets of two or more values that hang together by ``close`` neighbours in order."""
    order = np.argsort(values)
    joined = close[order[:-1], order[1:]]
    parts = np.split(order, np.flatnonzero(~joined) + 1)
    return [p for p in parts if len(p) > 1]


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix to double precision, values falling.

    Starts from single precision. Each round corrects all vectors in double precision; where values
    cluster, the matrix is restricted to the cluster's space, shifted by the cluster's centre, and
    solved in the same way: relative to the smaller matrix the values lie far apart. Equal values
    keep any orthonormal basis. Each vector's largest entry is positive.
    """
    a = np.asarray(a, dtype=np.float64)
    size = norm(a)
    if not len(a) or size == 0.0:
        return np.zeros(len(a)), np.eye(len(a))
    x = np.linalg.eigh((a / size).astype(np.float32))[1].astype(np.float64)
    noise = len(a) * np.finfo(np.float64).eps * size
    last = np.inf
    for _ in range(ROUNDS):
        x, values, close, change = corrected(a, x)
        for c in clusters(values, close):
            inner = x[:, c].T @ (a @ x[:, c])
            inner -= np.mean(values[c]) * (x[:, c].T @ x[:, c])
            inner = (inner + inner.T) / 2.0
            if len(c) < len(a) and norm(inner - np.diag(np.diag(inner))) > noise:
                x[:, c] = x[:, c] @ eigenvectors(inner)[1]
                change = np.inf
        if change < len(a) * np.finfo(np.float64).eps or (change < 1e-6 and change >= last):
            break
        last = change
    for _ in range(2):
        # Values apart by rounding errors only leave large corrections behind; orthogonality comes last.
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2.0
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    signs = np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return values, x * np.where(signs == 0, 1.0, signs)


def integers(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(good, x): which rows have a vector of ``width`` finite entries, and these as integers."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]]).astype(np.int64) if len(lengths) else lengths
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    good = lengths == width
    m = flat[starts[good][:, None] + np.arange(width)[None, :]]
    finite = np.isfinite(m).all(axis=1)
    good[np.flatnonzero(good)[~finite]] = False
    m = m[finite]
    if m.size and np.abs(m).max() > LARGEST:
        raise OverflowError(f"entries beyond {LARGEST:.0f} have no exact integer form")
    return good, np.floor(SCALE * m).astype(np.int64) + SHIFT


def sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(width, n, sum per dimension), exact, over the vectors of the most frequent width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            column = batch.column(0)
            for width in {n for n in column.value_lengths().unique().to_pylist() if n}:
                good, x = integers(column, width)
                n, total = found.get(width, (0, np.zeros(width, np.int64)))
                found[width] = n + int(good.sum()), total + x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({
            "width": pa.array(found, pa.int32()),
            "n": pa.array([n for n, _ in found.values()], pa.int64()),
            "sums": pa.array([list(s) for _, s in found.values()], pa.list_(pa.int64())),
        })

    parts = vectors.mapInArrow(run, "width int, n long, sums array<long>").filter("n > 0").persist()
    best = parts.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if best is None:
        parts.unpersist()
        return 0, 0, []
    if best.width > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {best.width} entries; at most {MOST_DIMENSIONS} are supported")
    rows = parts.filter(F.col("width") == best.width).select(F.posexplode("sums").alias("i", "s"))
    total = [r.s for r in rows.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()]
    parts.unpersist()
    return best.width, best.n, total


def product(vectors: DataFrame, width: int, size: int, transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of y y' over all vectors, y = transform(x) with ``size`` entries.

    A task adds up its own rows; its matrix leaves it line by line, and lines of one number are
    added in the order of the tasks, so reruns over the same splits agree to the last digit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = transform(integers(batch.column(0), width)[1])
            total += y.T @ y
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(size), pa.int32()),
            "task": pa.array([TaskContext.get().partitionId()] * size, pa.int32()),
            "line": pa.array(list(total), pa.list_(pa.float64())),
        })

    def add(lines: pd.DataFrame) -> pd.DataFrame:
        line = np.add.reduce(np.stack(lines.sort_values("task")["line"].to_list()), axis=0)
        return pd.DataFrame({"i": [lines["i"].iloc[0]], "line": [line]})

    lines = vectors.mapInArrow(run, "i int, task int, line array<double>").groupBy("i")
    found = lines.applyInPandas(add, "i int, line array<double>").orderBy("i").collect()
    return np.array([r.line for r in found])


def mean_of(vectors: DataFrame, width: int, size: int, n: int, transform: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Mean of transform(x) over all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += transform(integers(batch.column(0), width)[1]).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "s": pa.array(total)})

    parts = vectors.mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    return np.array([r.s for r in parts.orderBy("i").collect()]) / n


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(row, n, deviation, whitened, explained, identity_error): a row for every usable vector.

    Entries become integers x = floor(64 c) + 1000000, so counts, sums and the centred n x - S are
    exact; covariances are taken of the centred vectors with divisor n. ``whitened`` and
    ``explained`` are arrays over the components, ``n`` and ``identity_error`` one value: the
    largest entry of the whitened vectors' measured covariance off the identity.

    Null vectors and vectors with null or infinite entries or NaN are left out, as are those whose
    length is not the most frequent one (the longest, on ties). There are as many components as
    dimensions where these are fewer. A component without variance has null ``whitened`` and takes
    no part in ``identity_error``; ``explained`` is null if nothing varies. Repeated rows count as
    often as they stand. An empty table gives no rows. Input columns of any name are safe inside
    ``row``.
    """
    vectors = table.select(F.col(vector).alias("v"))
    width, n, total = sums(vectors)
    found = min(components, width)
    middle = np.array([round(s / n) for s in total], dtype=np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(total, middle)], dtype=np.int64)

    def scaled(x: np.ndarray) -> np.ndarray:
        """n x - S in whole numbers."""
        return n * (x - middle) - rest

    def centred(x: np.ndarray) -> np.ndarray:
        return scaled(x) / n

    covariance = product(vectors, width, width, centred) / n if n else np.zeros((0, 0))
    covariance = (covariance + covariance.T) / 2.0
    values, basis = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    kept = values[:found]
    varies = kept > width * np.finfo(np.float64).eps * max(trace, 0.0)
    project = basis[:, :found][:, varies] / np.sqrt(kept[varies])
    size = int(varies.sum())

    def white(x: np.ndarray) -> np.ndarray:
        return centred(x) @ project

    error = None
    if size:
        mean = mean_of(vectors, width, size, n, white)
        spread = product(vectors, width, size, lambda x: white(x) - mean) / n
        error = float(np.abs(spread - np.eye(size)).max())
    explained = [float(e) / trace if trace > 0 else None for e in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = integers(batch.column(1), width)
            exact = scaled(x)
            out = np.zeros((len(x), found))
            out[:, varies] = white(x)
            flat = pa.array(out.ravel(), mask=np.broadcast_to(~varies, out.shape).ravel())
            offsets = pa.array(np.arange(len(x) + 1) * found, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.array((exact * exact).sum(axis=1), pa.int64()),
                 pa.ListArray.from_arrays(offsets, flat)],
                ["row", "deviation", "whitened"],
            )

    rows = table.select(F.struct(*table.columns).alias("row"), F.col(vector).alias("v"))
    if not n:
        rows = rows.limit(0)
    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    one = F.array(*map(F.lit, explained)).cast("array<double>")
    return rows.mapInArrow(run, schema).select(
        "row", F.lit(n).cast("long").alias("n"), "deviation", "whitened", one.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
