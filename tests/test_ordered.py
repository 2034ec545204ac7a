import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twosight.operators import layers, ordered, summary


@pytest.fixture(scope="module")
def frame():
    """A third of the rows in one group, a third of those on one value, missing values, tiny groups."""
    rng = np.random.default_rng(3)
    n = 1500
    group = np.where(rng.random(n) < 0.34, "hot", rng.choice([f"g{i:02d}" for i in range(40)], n))
    x = np.round(np.exp(rng.normal(2, 1, n)), 2)
    x[(group == "hot") & (rng.random(n) < 0.34)] = 5.0
    x[rng.random(n) < 0.05] = np.nan
    pdf = pd.DataFrame({"g": group, "x": x, "i": np.arange(n)})
    pdf.loc[n] = ["alone", 2.5, n]
    pdf.loc[n + 1] = ["unknown", np.nan, n + 1]
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    out = spark.createDataFrame(frame)
    return out.withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(6)


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_prefix_sums_match_a_sorted_scan(df, frame, ranges):
    got = ordered.prefix_sums(df.where("x IS NOT NULL"), ["x", "i"], {"n": F.lit(1), "s": F.col("x")}, ["g"], ranges).toPandas()
    want = frame.dropna().sort_values(["g", "x", "i"])
    want["n_before"] = want.groupby("g").cumcount()
    want["s_before"] = want.groupby("g").x.cumsum() - want.x
    want["n_total"] = want.groupby("g").x.transform("size")
    both = got.merge(want, on=["g", "x", "i"], suffixes=("", "_w"))
    assert len(got) == len(want) == len(both)
    assert (both.n_before == both.n_before_w).all() and (both.n_total == both.n_total_w).all()
    np.testing.assert_allclose(both.s_before, both.s_before_w, atol=1e-9)


def test_prefix_sums_without_groups(df, frame):
    got = ordered.ordered_position(df, ["i"], ranges=5).toPandas().sort_values("i")
    assert got.n.tolist() == list(range(1, len(frame) + 1)) and set(got.n_total) == {len(frame)}


@pytest.mark.parametrize("ranges", [2, 9])
def test_describe_matches_pandas(df, frame, ranges):
    got = summary.describe(df, "x", ["g"], probs={"lb": 0.025, "ub": 0.975}, ranges=ranges).toPandas().set_index("g").sort_index()
    by = frame.groupby("g").x
    assert got.n.tolist() == by.count().tolist() and got.n_rows.tolist() == by.size().tolist()
    for name, want in {"mean": by.mean(), "sd": by.std(), "median": by.median(), "lb": by.quantile(0.025), "ub": by.quantile(0.975)}.items():
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, equal_nan=True)
    np.testing.assert_allclose(got.se.astype(float), by.std() / np.sqrt(by.size()), rtol=1e-9, equal_nan=True)


def test_describe_strict(df, frame):
    got = summary.describe(df, "x", ["g"], na_rm=False).toPandas().set_index("g")
    complete = frame.groupby("g").x.apply(lambda s: s.notna().all())
    assert (got["mean"].notna() == complete[got.index]).all()


def test_one_row_and_empty_groups(df):
    got = {r.g: r for r in summary.describe(df, "x", ["g"]).where("g IN ('alone', 'unknown')").collect()}
    assert got["alone"].median == 2.5 and got["alone"].sd is None
    assert got["unknown"].n == 0 and got["unknown"]["mean"] is None and got["unknown"].n_rows == 1


def test_describe_many_is_describe_of_each(df):
    many = {(r.g, r.variable): r.median for r in summary.describe_many(df, {"a": "x", "b": F.col("x") * 2}, ["g"]).collect()}
    for r in summary.describe(df, "x", ["g"]).collect():
        assert many[(r.g, "a")] == r.median
        assert many[(r.g, "b")] == (None if r.median is None else 2 * r.median)


def test_cumulative_share_uses_rows_not_ranges(spark):
    df = spark.createDataFrame([(1, 2.0, k) for k in range(3)] + [(1, 4.0, 9)], "id int, t double, k int")
    got = ordered.cumulative_share(df, "t", [F.col("t").desc(), "k"], ["id"]).orderBy("n").collect()
    assert [r.n for r in got] == [1, 2, 3, 4]
    assert [r.share_cum for r in got] == pytest.approx([0.4, 0.6, 0.8, 1.0])


def test_percentile_rank(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.1), (4, 0.9)], "id int, acc double")
    got = {r.id: r.rank for r in ordered.percentile_rank_desc(df, ["acc", "id"]).collect()}
    assert got == {3: 0.75, 1: 0.5, 2: 0.25, 4: 0.0}


def test_sample_groups_is_whole_and_repeatable(df, frame):
    a = ordered.sample_groups(df, "g", 7, seed=5).groupBy("g").count().toPandas()
    b = ordered.sample_groups(df.repartition(3), "g", 7, seed=5).groupBy("g").count().toPandas()
    assert len(a) == 7 and sorted(a.g) == sorted(b.g)
    size = frame.groupby("g").size()
    assert all(size[g] == c for g, c in zip(a.g, a["count"]))


def test_shares(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), (None, "y")], "g string, c string")
    overall = {(r.g, r.c): r.prop for r in summary.share(df, ["g", "c"]).collect()}
    within = {(r.g, r.c): r.prop for r in summary.share(df, ["g", "c"], ["g"]).collect()}
    assert overall[("a", "x")] == pytest.approx(0.4) and sum(overall.values()) == pytest.approx(1)
    assert within[("a", "x")] == pytest.approx(2 / 3) and within[(None, "y")] == 1


def test_box_stats(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 40]], "x double")
    r = layers.box_stats(df, "x").first()
    assert (r.q1, r.median, r.q3, r.ymin, r.ymax, r.outliers) == (3.25, 5.5, 7.75, 1.0, 9.0, 1)
    assert r.notch_upper - r.median == pytest.approx(1.58 * 4.5 / np.sqrt(10))


def test_histogram_keeps_every_row(df, frame):
    got = layers.histogram(df, "x", ["g"]).groupBy("g").agg(F.sum("n").alias("n")).toPandas().set_index("g").n
    want = frame.dropna().groupby("g").size()
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_histogram_edges(spark):
    # Width 1: bins centred on 0, 1, 2, ..., closed on the right.
    df = spark.createDataFrame([(0.0,), (0.5,), (0.51,), (29.0,)], "x double")
    got = {r.bin: r.n for r in layers.histogram(df, "x").collect()}
    assert got == {0: 2, 1: 1, 29: 1}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.n) for r in layers.histogram(flat, "x").collect()] == [(0, 2)]


def test_density_matches_a_direct_kernel_sum(df, frame):
    got = layers.density(df, "x", ["g"], limits=(0.0, 40.0)).where("g = 'hot'").toPandas().sort_values("point")
    x = frame[(frame.g == "hot") & frame.x.between(0, 40)].x.to_numpy()
    q = np.quantile(x, [0.25, 0.75])
    bw = 0.9 * min(x.std(ddof=1), (q[1] - q[0]) / 1.34) * len(x) ** -0.2
    assert got.bw.iloc[0] == pytest.approx(bw, rel=1e-9)
    grid = got.x.to_numpy()
    direct = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
    np.testing.assert_allclose(got.density, direct, atol=2e-4)


def test_limits_censor_before_the_statistic(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "x double")
    assert layers.box_stats(df, "x", limits=(0, 10)).first().median == 2.0


def test_ridges_share_a_bandwidth_and_leave_small_groups_out(df, frame):
    got = layers.ridges(df, "x", ["g"])
    assert got.select("bw").distinct().count() == 1
    sizes = frame.dropna().groupby("g").size()
    assert sorted(r.g for r in got.select("g").distinct().collect()) == sorted(sizes[sizes >= 3].index)
