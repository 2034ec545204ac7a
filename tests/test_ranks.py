import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twosight.operators import inference, ordered, ranks


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(8)
    n = 900
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "c": rng.choice(["p", "q", "r"], n), "s": rng.integers(0, 21, n) / 20})
    pdf["t"] = np.round(rng.gamma(2, 3, n), 1)
    pdf["y"] = (rng.random(n) < 0.2 + 0.6 * pdf.s).astype(int)
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


def brute_auc(y, s):
    pos, neg = s[y == 1][:, None], s[y == 0][None, :]
    return ((pos > neg) + 0.5 * (pos == neg)).mean()


@pytest.mark.parametrize("ranges", [1, 6])
def test_auc(df, frame, ranges):
    got = {r.k: r.auc for r in ranks.auc(df, "y", "s", ["k"], ranges).collect()}
    for k, p in frame.groupby("k"):
        assert got[k] == pytest.approx(brute_auc(p.y.to_numpy(), p.s.to_numpy()), abs=1e-12)


def test_auc_of_reversed_scores(df):
    a, b = ranks.auc(df, "y", "s").first().auc, ranks.auc(df, "y", -F.col("s")).first().auc
    assert a + b == pytest.approx(1)


def test_auc_without_negatives_is_missing(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4), (None, 0.1), (0, None)], "y int, s double")
    assert ranks.auc(df, "y", "s").first().auc is None


def reference_rank_sum(x, a):
    r = pd.Series(x).rank().to_numpy()
    na, nb, n = a.sum(), (~a).sum(), len(a)
    w = r[a].sum() - na * (na + 1) / 2
    t = pd.Series(x).value_counts().to_numpy().astype(float)
    sigma = np.sqrt(na * nb / 12 * ((n + 1) - (t**3 - t).sum() / (n * (n - 1))))
    gap = w - na * nb / 2
    return w, (gap - 0.5 * np.sign(gap)) / sigma


@pytest.mark.parametrize("ranges", [1, 5])
def test_rank_sum(df, frame, ranges):
    got = {r.k: r for r in ranks.rank_sum(df, "t", "c", "p", "q", ["k"], ranges).collect()}
    for k, p in frame[frame.c.isin(["p", "q"])].groupby("k"):
        w, z = reference_rank_sum(p.t.to_numpy(), (p.c == "p").to_numpy())
        assert (got[k].w, got[k].z) == pytest.approx((w, z))
        assert 0 < got[k].p <= 1


def test_rank_sums_of_both_orders_add_up(df):
    a, b = (ranks.rank_sum(df, "t", "c", *pair).first() for pair in (("p", "q"), ("q", "p")))
    assert a.w + b.w == a.n_a * a.n_b and a.z == pytest.approx(-b.z)


def test_rank_sum_with_one_sample_is_missing(spark):
    df = spark.createDataFrame([(1.0, "p"), (2.0, "p")], "x double, g string")
    r = ranks.rank_sum(df, "x", "g", "p", "q").first()
    assert r.w is None and r.z is None and r.p is None


def test_kruskal(df, frame):
    got = ranks.kruskal(df, "t", "c", ranges=4).first()
    r = frame.t.rank()
    n = len(frame)
    t = frame.t.value_counts().to_numpy().astype(float)
    h = 12 / (n * (n + 1)) * sum(r[frame.c == c].sum() ** 2 / (frame.c == c).sum() for c in "pqr") - 3 * (n + 1)
    assert got.h == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)))
    assert got.dof == 2 and got.groups == 3


def test_kruskal_of_two_groups_is_the_rank_sum_without_continuity(df, frame):
    two = df.where("c <> 'r'")
    h = ranks.kruskal(two, "t", "c").first().h
    p = frame[frame.c != "r"]
    a = (p.c == "p").to_numpy()
    w, z = reference_rank_sum(p.t.to_numpy(), a)
    gap = w - a.sum() * (~a).sum() / 2
    assert h == pytest.approx((z * gap / (gap - 0.5 * np.sign(gap))) ** 2)


def test_spearman(df, frame):
    got = {r.k: r for r in ranks.spearman(df, "t", "s", ["k"], ranges=3).collect()}
    for k, p in frame.groupby("k"):
        rho = p.t.rank().corr(p.s.rank())
        assert got[k].rho == pytest.approx(rho)
        assert got[k].t == pytest.approx(rho * np.sqrt((len(p) - 2) / (1 - rho**2)))


def test_spearman_leaves_incomplete_pairs_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 9.0), (None, 1.0), (4.0, None)], "x double, y double")
    r = ranks.spearman(df, "x", "y").first()
    assert r.n == 3 and r.rho == pytest.approx(1)


def test_welch(df, frame):
    got = inference.welch_t(df, "t", "c", "p", "q").first()
    a, b = frame[frame.c == "p"].t, frame[frame.c == "q"].t
    ea, eb = a.var() / len(a), b.var() / len(b)
    assert got.t == pytest.approx((a.mean() - b.mean()) / np.sqrt(ea + eb))
    assert got.dof == pytest.approx((ea + eb) ** 2 / (ea**2 / (len(a) - 1) + eb**2 / (len(b) - 1)))


def test_paired_t(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (4.0, 1.0), (None, 3.0)], "a double, b double")
    r = inference.paired_t(df, "a", "b").first()
    d = np.array([1.0, 2.0, 3.0])
    assert (r.n, r.t) == (3, pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(3))))


def test_pearson(df, frame):
    r = inference.pearson_test(df, "t", "s").first()
    assert r.r == pytest.approx(frame.t.corr(frame.s))


def test_chi_square_two_by_two_is_corrected(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 12
    r = inference.chi_square(spark.createDataFrame(rows, "g string, c string"), "g", "c").first()
    a, b, c, d = 10, 5, 3, 12
    assert r.chi2 == pytest.approx(30 * (abs(a * d - b * c) - 15) ** 2 / (15 * 15 * 13 * 17))


def test_chi_square_with_an_empty_cell(spark):
    rows = [("a", "x")] * 4 + [("b", "x")] * 2 + [("b", "y")] * 3
    r = inference.chi_square(spark.createDataFrame(rows, "g string, c string"), "g", "c").first()
    a, b, c, d = 4, 0, 2, 3
    assert r.chi2 == pytest.approx(9 * (abs(a * d - b * c) - 4.5) ** 2 / (4 * 5 * 6 * 3))


def test_chi_square_larger_table(df, frame):
    r = inference.chi_square(df, "c", "y").first()
    o = pd.crosstab(frame.c, frame.y).to_numpy()
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert r.chi2 == pytest.approx(((o - e) ** 2 / e).sum()) and r.dof == 2


def test_chi_square_of_one_level_is_missing(spark):
    r = inference.chi_square(spark.createDataFrame([("a", "x"), ("b", "x")], "g string, c string"), "g", "c").first()
    assert r.chi2 is None and r.p is None


def test_a_common_value_is_many_keys(spark):
    """Half of all rows share one value of x; the ranges that the rank join works by stay even."""
    rng = np.random.default_rng(8)
    n = 4000
    x = np.where(rng.random(n) < 0.5, 7.0, rng.integers(0, 500, n).astype(float))
    frame = pd.DataFrame({"x": x, "y": rng.permutation(n).astype(float), "g": rng.permutation(n) % 1000})
    df = spark.createDataFrame(frame).repartition(5)
    for order, cells in ((["x", "y"], ["x", "y"]), (["x", "g"], ["x", "g"])):
        sizes = [r["count"] for r in ordered.ranged(df.select(*cells).distinct(), order, ranges=12).groupBy("_range").count().collect()]
        assert len(sizes) == 12 and max(sizes) <= 2 * np.median(sizes)
    r = ranks.spearman(df, "x", "y", ranges=12).first()
    rx, ry = frame.x.rank(), frame.y.rank()
    assert r.n == n and abs(r.rho - np.corrcoef(rx, ry)[0, 1]) < 1e-12
    h = ranks.kruskal(df, "x", "g", ranges=12).first()
    sums = rx.groupby(frame.g).agg(["sum", "size"])
    ties = frame.x.value_counts()
    want = (12 / (n * (n + 1)) * (sums["sum"] ** 2 / sums["size"]).sum() - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
    assert h.groups == 1000 and abs(h.h - want) < 1e-8 * want
