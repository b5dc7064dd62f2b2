"""Whitening against the plain eigendecomposition, and the intervals of the contour method."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from palimpsest.llm import feast, whitening
from palimpsest.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, n long, dims int"


def expected(rows, components=16):
    """By row: (n, deviation), and for all rows the projections, shares and values by the library's solver."""
    x = np.floor(64 * np.array([r for r in rows], np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), [int(s) for s in fit.astype(object).sum(0)]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    c = fit - mean
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(values)[::-1][:components]
    return n, deviation, (x - mean) @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check(got, ids, rows, components=16):
    n, deviation, whitened, explained = expected(rows, components)
    k = whitened.shape[1]
    got = sorted(got, key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c + 1) for i in sorted(ids) for c in range(k)]
    place = np.argsort(ids)
    found = np.array([r["whitened"] for r in got]).reshape(len(ids), k)
    want = whitened[place]
    want = want * np.sign((found * want).sum(0))
    assert np.abs(found - want).max() < 1e-8
    assert {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got[::k]] == [deviation[i] for i in place]
    assert [str(r["deviation"]) for r in got] == [r["deviation_exact"] for r in got]
    assert np.allclose([r["explained"] for r in got[:k]], explained, rtol=1e-10)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitens_the_table(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    check(QUERIES["op13_whitening"](spark, FOLDER).collect(), table.vec_id.tolist(), [list(v) for v in table.embedding])


def test_repeated_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(v)) for v in rng.standard_normal(5)] for _ in range(60)]
    good[7] = good[8] = good[9]
    rows = [(i, v, 0, 0) for i, v in enumerate(good)]
    odd = [(100, None, 0, 0), (101, [], 0, 0), (102, [1.0, None, 1.0, 1.0, 1.0], 0, 0), (103, [float("nan")] * 5, 0, 0),
           (104, [1.0, float("inf"), 0.0, 0.0, 0.0], 0, 0)]
    got = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(4)).collect()
    check(got, list(range(60)), good, 5)
    repeated = whitening.whiten(spark.createDataFrame(rows + rows + [(None, good[0], 1, 1)], VECTORS)).collect()
    assert len(repeated) == 5 * 121 and {r["n"] for r in repeated} == {58}


def test_lengths_are_fitted_apart_and_without_variance_nothing_is_projected(spark):
    rng = np.random.default_rng(4)
    long = [[float(v) for v in rng.integers(-9, 9, 20)] for _ in range(50)]
    rows = [(i, v, 0, 0) for i, v in enumerate(long)] + [(90, [1.0, 2.0], 0, 0), (91, [1.0, 2.0], 0, 0)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    check([r for r in got if r["vec_id"] < 90], list(range(50)), long)
    alone = [r for r in got if r["vec_id"] >= 90]
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone} == {(1, 0, None, None, None)}
    assert len(alone) == 4
    few = whitening.whiten(spark.createDataFrame(rows[:3], VECTORS)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 2) for r in few)
    assert {r["explained"] for r in few if r["component"] > 2} == {0.0}
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_very_large_entries_stay_exact(spark):
    rows = [(0, [1e30, 1.0], 0, 0), (1, [-1e30, 2.0], 0, 0), (2, [5.0, 3.0], 0, 0)]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    x = [[4 * 10**18 + 10**6, 10**6 + 64], [-4 * 10**18 + 10**6, 10**6 + 128], [10**6 + 320, 10**6 + 192]]
    sums = [sum(c) for c in zip(*x)]
    for i, v in enumerate(x):
        exact = sum((3 * a - s) ** 2 for a, s in zip(v, sums))
        assert got[i, 1]["deviation_exact"] == str(exact)
        assert got[i, 1]["deviation"] == (exact if exact < 1 << 63 else None)


@pytest.mark.parametrize("seed", range(4))
def test_intervals_hold_all_leading_values(seed):
    rng = np.random.default_rng(seed)
    d = [3, 16, 40, 90][seed]
    values = np.sort(rng.exponential(1, d))[::-1]
    values[: d // 4] = values[0] if seed % 2 else values[: d // 4]  # ties
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v = q * values @ q.T
    v = (v + v.T) / 2
    parts = feast.intervals(v, 16)
    assert [p.first for p in parts] == np.cumsum([1, *[p.count for p in parts]])[:-1].tolist()
    found = [feast.solve_interval(v, p) for p in parts]
    got = np.concatenate([e for e, _ in found])
    assert len(got) >= min(16, d) and np.allclose(got, values[: len(got)], rtol=1e-12)
    vectors = np.concatenate([x for _, x in found], axis=1)
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-9
    assert np.abs(v @ vectors - vectors * got).max() < 1e-12 * values[0] * d


def test_inertia_counts():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((30, 30))
    v = a + a.T
    diagonal, beside = feast.tridiagonal(v)
    values = np.linalg.eigvalsh(v)
    for s in [*rng.uniform(values[0] - 1, values[-1] + 1, 50), 0.0]:
        assert feast.above(diagonal, beside, s) == (values > s).sum()
    assert feast.intervals(np.zeros((4, 4)), 3) == []
