"""Contour integration against numpy's eigensolver, and whitening against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from twosight.llm import queries, whitening


def matrix(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    v = q @ np.diag(values) @ q.T
    return (v + v.T) / 2


CASES = [
    [3.0], [2.0, 1.0], list(range(1, 65)), [1.0] * 20, [5.0] * 12 + [1.0] * 30, [5.0] * 7 + [1, 1 - 1e-9] + [0.5] * 20, [1.0, 0, 0], [4.0] * 3 + [0.0] * 10,
    list(10.0 ** -np.arange(30.0)), list(1 - 1e-4 * np.arange(64)), [1e6, 170.0, 169.9, 1.0] + [0.1] * 20, list(np.abs(np.random.default_rng(1).standard_cauchy(50)) ** 2),
]


@pytest.mark.parametrize("case", range(len(CASES)))
@pytest.mark.parametrize("wanted", [1, 8, 40])
def test_leading_eigenpairs(case, wanted):
    v = matrix(CASES[case], case)
    values, vectors = whitening.leading(v, wanted)
    truth = np.sort(CASES[case])[::-1][:wanted]
    truth = truth[truth > len(v) * 1e-13 * truth[0]]
    assert len(truth) <= len(values) <= wanted and np.allclose(values[: len(truth)], truth, rtol=0, atol=1e-13 * truth[0])
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * truth[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-8


def test_inertia_counts():
    v = matrix(CASES[2], 5)
    diagonal, off = whitening.tridiagonal(v)
    assert [whitening.eigenvalues_above(diagonal, off, x) for x in (-1, 0.5, 10.5, 63.5, 65)] == [64, 64, 54, 1, 0]


def test_interval_that_misses_pairs_is_an_error():
    with pytest.raises(ArithmeticError, match="inertia counts 5"):
        whitening.feast(matrix(CASES[2], 5), 61.5, 70.0, 5)


def brute(rows, wanted=8):
    fine = [(i, np.asarray(v, float)) for i, v in rows if v is not None and len(v) == 10 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.stack([np.floor(1024 * v).astype(np.int64) + 100_000 for _, v in fine])
    s, n = x.sum(axis=0), len(x)
    z = (n * x - s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    return [i for i, _ in fine], n, ((n * x - s) ** 2).sum(axis=1), (z @ u) / np.sqrt(e), e / np.trace(z.T @ z / n)


ROWS = [(i, [float(c) for c in np.random.default_rng(i).standard_normal(10) * np.linspace(0.1, 2, 10)]) for i in range(300)]
ROWS += [(7, ROWS[7][1]), (7, ROWS[8][1]), (None, ROWS[9][1]), (400, [0.0] * 10), (401, ROWS[9][1]), (402, [1e3] + [0.0] * 9)]
BAD = [(500, None), (501, []), (502, [1.0] * 9), (503, [None] + [1.0] * 9), (504, [float("nan")] + [1.0] * 9), (505, [1.0] * 9 + [float("inf")])]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*r, 1, 2.0) for r in [*ROWS, *BAD]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, x double").repartition(7)


def test_whitening(table):
    got = whitening.whiten(table)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = got.toPandas()
    ids, n, deviation, whitened, explained = brute(ROWS)
    assert len(got) == 8 * len(ids) and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    key = lambda i: -1 if i is None or i != i else int(i)
    want = sorted((key(i), int(d), *np.round(np.abs(w), 6)) for i, d, w in zip(ids, deviation, whitened, strict=True))
    wide = [(key(g.vec_id.iloc[0]), int(g.deviation.iloc[0]), g.sort_values("component").whitened.to_numpy()) for _, g in got.groupby([got.vec_id.fillna(-1), "deviation"])]
    # Rows that are equal in id and vector stand twice in got, with equal values.
    assert {(w[0], w[1]) for w in want} == {(w[0], w[1]) for w in wide}
    values = {(a, b): np.array(c) for a, b, *c in want}
    for a, b, c in wide:
        assert np.allclose(np.abs(c[:: len(c) // 8]), values[a, b], atol=2e-6)
    share = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(share, explained, rtol=1e-9)
    others = [i for i in range(300) if i != 7]
    signs = got[got.vec_id.isin(others)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    raw = np.stack([whitened[ids.index(i)] for i in others])
    assert np.allclose(np.abs((signs * raw).sum(axis=0)), (raw**2).sum(axis=0), rtol=1e-6)


def test_few_dimensions_and_tables_without_variance(spark, table):
    assert whitening.whiten(table.where("false")).count() == 0
    assert whitening.whiten(table.where("vec_id >= 500")).where("vec_id = 505").count() == 0
    assert whitening.whiten(table.where("vec_id = 3")).count() == 0
    flat = spark.createDataFrame([(i, [float(i % 5), 1.0, 2.0 * (i % 5)]) for i in range(20)], "vec_id int, embedding array<float>")
    got = whitening.whiten(flat).toPandas()
    assert sorted(got.component.unique()) == [1] and abs(got.explained[0] - 1) < 1e-9 and got.identity_error[0] < 1e-9
    assert whitening.whiten(flat, components=0).count() == 0


def test_query(spark, sf_dir):
    got = queries.QUERIES["op12_whitening"](spark, sf_dir).toPandas()
    assert got.component.max() == 8 and got.identity_error[0] < 1e-9 and len(got) == 8 * got.n[0]
