import time

import numpy as np
import pandas as pd
import pytest

from twosight.operators import models


def sample(levels, rows, seed=2):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, levels, rows)
    g[: 2 * levels] = np.repeat(np.arange(levels), 2)
    x, z = np.round(rng.normal(size=rows), 1), rng.integers(0, 3, rows) / 2
    line = rng.normal(scale=0.5, size=levels)[g] + 0.8 * x - 0.5 * z
    y = (rng.random(rows) < 1 / (1 + np.exp(-line))).astype(int)
    return pd.DataFrame({"g": [f"v{v:05d}" for v in g], "x": x, "z": z, "y": y})


def test_few_levels_agree_with_the_general_fit(spark):
    df = spark.createDataFrame(sample(8, 1500)).repartition(4)
    got = {r.term: r for r in models.logit_levels(df, "y", ["x", "z"], "g").collect()}
    want = {r.term: r for r in models.logit(df, "y", ["x", "z"], "g").collect()}
    assert set(got) == set(want)
    for term, r in want.items():
        assert [got[term].estimate, got[term].std_error, got[term].p] == pytest.approx([r.estimate, r.std_error, r.p], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("levels, rows", [(1500, 30_000), (20_000, 200_000)])
def test_many_levels_solve_the_score_equations(spark, levels, rows):
    frame = sample(levels, rows)
    start = time.perf_counter()
    got = models.logit_levels(spark.createDataFrame(frame).repartition(8), "y", ["x", "z"], "g").toPandas().set_index("term")
    assert time.perf_counter() - start < 150
    both = frame.groupby("g").y.transform(lambda v: 0 < v.sum() < len(v)).astype(bool)
    base = sorted(frame.g[both])[0]
    assert len(got) == frame.g.nunique() + 2 and np.isinf(got.estimate[[f"g{v}" for v in set(frame.g[~both])]]).all()
    own = frame.g[both].map(lambda v: 0.0 if v == base else got.estimate["g" + v])
    line = got.estimate["(Intercept)"] + own + got.estimate["x"] * frame.x[both] + got.estimate["z"] * frame.z[both]
    rest = frame.y[both] - 1 / (1 + np.exp(-line))
    assert abs((rest * frame.x[both]).sum()) < 1e-5 and abs((rest * frame.z[both]).sum()) < 1e-5
    assert rest.groupby(frame.g[both]).sum().abs().max() < 1e-6
    assert abs(got.estimate["x"] - 0.8) < 6 * got.std_error["x"] + 0.15


def test_no_slopes_and_no_usable_level(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 1)], "g string, y int")
    got = {r.term: (r.estimate, r.std_error) for r in models.logit_levels(df, "y", [], "g").collect()}
    assert got["(Intercept)"] == pytest.approx((np.log(2), np.sqrt(1 / 2 + 1)))
    assert got["gb"] == pytest.approx((-np.log(2), np.sqrt(1 / 2 + 1 + 1 + 1))) and got["gc"] == (float("inf"), None)
    assert [r.term for r in models.logit_levels(df.where("g = 'c'"), "y", [], "g").collect()] == ["gc"]
