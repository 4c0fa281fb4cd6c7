"""Refined eigenvectors, whitened vectors and exact sums against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import whitening as W
from kinfold.llm.queries import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>, row string, n string"


def spectrum(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    list(range(1, 41)),
    [1 + 1e-9 * i for i in range(20)] + [5.0, 7.0],
    [1.0, 1 + 1e-12, 1 + 2e-12, 3.0, 3 + 1e-7, 8.0] + [0.5] * 6,
    [2.0] * 10, [0.0] * 5 + [1.0], [1e-12, 1e-6, 1.0, 1e6], [3.0],
])
def test_eigenvectors(values):
    a = spectrum(values)
    got, x = W.eigenvectors(a)
    size = max(abs(v) for v in values)
    assert np.allclose(got, sorted(values, reverse=True), rtol=0, atol=1e-14 * size * len(values))
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14 * len(a)
    assert np.abs(a @ x - x * got).max() < 1e-14 * size * len(a)
    assert all(x[np.abs(x[:, k]).argmax(), k] > 0 for k in range(len(a)))


def test_single_precision_alone_would_not_do():
    a = spectrum([1 + 1e-9 * i for i in range(20)] + [5.0, 7.0])
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    s = x.T @ a @ x
    assert np.abs(s - np.diag(np.diag(s))).max() > 1e-10


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(5)


def brute(rows, components):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    u = np.array((n * x - total), dtype=float) / n
    v = u.T @ u / n
    values, basis = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    return [int(d) for d in deviation], u @ basis[:, order] / np.sqrt(values[order]), values[order] / np.trace(v)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    good = [[float(c) for c in rng.normal(size=6) * [9, 7, 5, 3, 2, 1]] for _ in range(300)]
    bad = [None, [], [1.0] * 5, [None] + [0.0] * 5, [float("nan")] * 6, [float("inf")] + [1.0] * 5]
    rows = list(enumerate(good)) + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, good[0]), (7, good[7])]
    got = W.whiten(frame(spark, rows), components=4).collect()
    used = good + [good[0], good[7]]
    deviation, white, explained = brute(used, 4)
    assert len(got) == len(used) and {r.n for r in got} == {len(used)}
    assert {r.row.n for r in got} == {"clash"}
    at = {i: k for k, i in enumerate([*range(300), None])}
    signs = None
    for r in got:
        k = at[r.row.vec_id]
        assert r.deviation == deviation[k] and np.allclose(r.explained, explained)
        assert r.identity_error < 1e-12
        ratio = np.array(r.whitened) / white[k]
        signs = np.sign(ratio) if signs is None else signs
        assert np.allclose(ratio, signs, atol=1e-9)


def test_flat_dimensions_and_small_tables(spark):
    rows = [(i, [float(i), 1.0, 2.0 * i]) for i in range(10)]
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 10
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in got)
    assert got[0].identity_error < 1e-12 and math.isclose(got[0].explained[0], 1.0)
    alone = W.whiten(frame(spark, [(1, [1.0, 2.0])])).first()
    assert alone.n == 1 and alone.deviation == 0 and alone.whitened == [None, None]
    assert alone.identity_error is None and alone.explained == [None, None]
    for rows in ([], [(1, None), (2, [])]):
        assert W.whiten(frame(spark, rows)).count() == 0


def test_query(spark, sf_small):
    rows = op12_embedding_whitening(spark, sf_small).collect()
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, explained = brute([r.embedding for r in table], 32)
    assert len(rows) == 32 * len(table)
    at = {r.vec_id: k for k, r in enumerate(table)}
    signs = {}
    for r in rows:
        k, c = at[r.vec_id], r.component - 1
        assert r.deviation == deviation[k] and r.n == len(table) and r.identity_error < 1e-10
        assert math.isclose(r.explained, explained[c], rel_tol=1e-9)
        signs.setdefault(c, np.sign(r.whitened / white[k, c]))
        assert math.isclose(r.whitened, signs[c] * white[k, c], rel_tol=1e-6, abs_tol=1e-8)
