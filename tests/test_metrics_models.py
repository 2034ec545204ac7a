import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twosight.operators import bootstrap, metrics, models


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(21)
    n = 1200
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n, p=[0.75, 0.25]), "qp": np.round(rng.random(n), 2)})
    pdf["outcome"] = (rng.random(n) < 0.15 + 0.7 * pdf.qp).astype(int)
    pdf["qb"] = (rng.random(n) < pdf.qp).astype(int)
    return pdf


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame)


def test_bundle(df, frame):
    got = {(r.g, r.metric): r for r in metrics.metric_bundle(df, ["g"], score="qp", base_rate=True).collect()}
    for g, p in frame.groupby("g"):
        values = {
            metrics.POSITIVE: p.qb,
            metrics.ACCURACY: (p.qb == p.outcome).astype(int),
            metrics.FPR: (p.qb != p.outcome)[p.outcome == 0].astype(int),
            metrics.FNR: (p.qb != p.outcome)[p.outcome == 1].astype(int),
            metrics.PPV: p.outcome[p.qb == 1],
            metrics.BASE: p.outcome,
        }
        for m, v in values.items():
            r = got[(g, m)]
            assert (r.n, r.value) == (len(v), pytest.approx(v.mean()))
            if m != metrics.BASE:
                se = v.std() / np.sqrt(len(v))
                assert (r.se, r.ub - r.lb) == (pytest.approx(se), pytest.approx(3.92 * se))
        assert 0.5 < got[(g, metrics.AUC)].value < 1


def test_undefined_rates_are_missing(spark):
    df = spark.createDataFrame([(1, 1, 0.7), (1, 0, 0.2)], "outcome int, qb int, qp double")
    got = {r.metric: r.value for r in metrics.metric_bundle(df, score="qp").collect()}
    assert got[metrics.FPR] is None and got[metrics.AUC] is None and got[metrics.FNR] == 0.5


def test_missing_answers(spark):
    df = spark.createDataFrame([(1, 1), (0, None), (0, 0)], "outcome int, qb int")
    strict = {r.metric: r.value for r in metrics.metric_bundle(df).collect()}
    lenient = {r.metric: r.value for r in metrics.metric_bundle(df, na_rm=True).collect()}
    assert strict[metrics.ACCURACY] is None and strict[metrics.FNR] == 0 and strict[metrics.PPV] == 1
    assert lenient[metrics.ACCURACY] == 1


def test_pairs_equal_single_tests(df, frame):
    got = {r.metric: r for r in metrics.metric_pairs(df, "g", [("a", "b")]).collect()}
    a, b = (frame.qb[frame.g == g] for g in "ab")
    se = np.sqrt(a.var() / len(a) + b.var() / len(b))
    assert got[metrics.POSITIVE].t == pytest.approx((a.mean() - b.mean()) / se)
    assert len(got) == 5


def test_wide(df):
    wide = metrics.metrics_wide(metrics.metric_bundle(df, ["g"]), "g", ["a", "b"])
    assert wide.columns == ["metric", "ord", "a", "b"] and wide.count() == 5


# --- bootstrap ---


def test_bootstrap_centres_on_the_area(df):
    from twosight.operators.ranks import auc

    point = {r.g: r.auc for r in auc(df, "outcome", "qp", ["g"]).collect()}
    for r in bootstrap.bootstrap_auc(df, "outcome", "qp", ["g"], b=200, seed=3).collect():
        assert r.lb < r["mean"] < r.ub and r.replicates == 200
        assert r["mean"] == pytest.approx(point[r.g], abs=0.01)


def test_bootstrap_does_not_depend_on_partitions(df):
    def run(frame, ranges):
        reps = bootstrap.bootstrap_auc_replicates(frame, "outcome", "qp", ["g"], b=20, seed=9, block_cells=15, ranges=ranges)
        return sorted((r.g, r.replicate, r.auc) for r in reps.collect())

    assert run(df, 1) == run(df.repartition(7), 5)


def test_bootstrap_spread_matches_direct_resampling(df, frame):
    """The tree of multinomial splits has the spread of resampling whole rows."""
    rng = np.random.default_rng(0)
    p = frame[frame.g == "b"]
    y, s = p.outcome.to_numpy(), p.qp.to_numpy()

    def area(i):
        r = pd.Series(s[i]).rank().to_numpy()
        n1 = y[i].sum()
        return (r[y[i] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(i) - n1))

    direct = np.array([area(rng.integers(0, len(y), len(y))) for _ in range(600)])
    reps = bootstrap.bootstrap_auc_replicates(df.where("g = 'b'"), "outcome", "qp", b=600, seed=1, block_cells=9).toPandas().auc
    assert reps.mean() == pytest.approx(direct.mean(), abs=0.005)
    assert reps.std() == pytest.approx(direct.std(), rel=0.15)


def test_bootstrap_of_the_total_size_is_narrower(df):
    width = {}
    for size in ("group", "total"):
        r = bootstrap.bootstrap_auc(df, "outcome", "qp", ["g"], b=200, seed=2, size=size).where("g = 'b'").first()
        width[size] = r.ub - r.lb
    assert width["total"] < 0.75 * width["group"]


# --- operating points ---


@pytest.mark.parametrize("target", [0.0, 0.25, 0.5, 0.999])
def test_threshold(df, frame, target):
    want = max((i * 0.01 for i in range(101) if (frame.qp > i * 0.01).mean() >= target), default=None)
    assert models.match_threshold(df, "qp", target).first()[0] == want


def test_threshold_that_nothing_reaches(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "qp double")
    assert models.match_threshold(df, "qp", 0.5).first()[0] is None


def test_shares_at_every_threshold_with_scores_on_the_grid(spark):
    scores = [i * 0.01 for i in range(101)] + [0.3, 0.29, 1.0, 0.0]
    df = spark.createDataFrame([(s,) for s in scores], "qp double")
    got = {round(r.threshold * 100): r.share for r in models.share_above(df, "qp").collect()}
    assert got == {i: pytest.approx(np.mean([s > i * 0.01 for s in scores])) for i in range(101)}


def test_open_and_closed_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (None,)], "qp double")
    assert [r[0] for r in df.select(models.apply_threshold("qp", 0.5)).collect()] == [0, 1, None]
    assert [r[0] for r in df.select(models.apply_threshold("qp", 0.5, closed=True)).collect()] == [1, 1, None]


# --- logistic regression ---


def newton(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ beta))
    inverse = np.linalg.inv(x.T @ (x * (mu * (1 - mu))[:, None]))
    sandwich = inverse @ (x.T @ (x * ((y - mu) ** 2)[:, None])) @ inverse
    return beta, np.sqrt(np.diag(inverse)), np.sqrt(np.diag(sandwich))


@pytest.mark.parametrize("interact", [False, True])
def test_logit(df, frame, interact):
    b = (frame.g == "b").astype(float).to_numpy()
    columns = [np.ones(len(frame)), frame.qp.to_numpy(), b] + ([frame.qp.to_numpy() * b] if interact else [])
    beta, se, robust = newton(np.column_stack(columns), frame.outcome.to_numpy())
    fit = models.fit_logit(df, "outcome", ["qp"], "g", interact)
    assert fit.terms == ["(Intercept)", "qp", "gb"] + (["qp:gb"] if interact else [])
    tidy, hc0 = fit.tidy().toPandas(), fit.robust().toPandas()
    np.testing.assert_allclose(tidy.estimate, beta, rtol=1e-6)
    np.testing.assert_allclose(tidy.std_error, se, rtol=1e-6)
    np.testing.assert_allclose(hc0.std_error, robust, rtol=1e-6)
    assert ((0 <= tidy.p) & (tidy.p <= 1)).all()


def test_logit_of_few_heavy_patterns(spark):
    """Large counts per pattern with an uneven outcome."""
    cells = [(x, n1, n0) for x, n1, n0 in [(0.0, 65000, 35000), (1.0, 66000, 34000), (2.0, 70000, 30000)]]
    rows = spark.createDataFrame(cells, "_t0 double, _n1 long, _n0 long")
    x = np.array([[1, c[0]] for c in cells])
    beta = np.zeros(2)
    n, y = np.array([c[1] + c[2] for c in cells]), np.array([c[1] / (c[1] + c[2]) for c in cells])
    for _ in range(30):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve(x.T @ (x * (n * mu * (1 - mu))[:, None]), x.T @ (n * (y - mu)))
    np.testing.assert_allclose(models.fit_patterns(rows, ["x"]).beta, beta, rtol=1e-8)


def test_logit_of_many_levels(spark):
    """A model of levels alone has the logits of their shares; its robust errors are then the plain ones."""
    levels = [(f"v{i:05d}", 1 + i % 7, 1 + i % 5) for i in range(300)]
    rows = [(g, y) for g, a, b in levels for y in [1] * a + [0] * b]
    df = spark.createDataFrame(rows, "g string, y int")
    fit = models.fit_patterns(models.patterns(df, "y", [], "g"), [], "g")
    assert fit.terms == ["(Intercept)", *[f"g{g}" for g, _, _ in levels[1:]]]
    logits = np.log([a / b for _, a, b in levels])
    np.testing.assert_allclose(fit.beta, np.r_[logits[0], logits[1:] - logits[0]], atol=1e-8)
    variance = np.array([1 / a + 1 / b for _, a, b in levels])
    np.testing.assert_allclose(fit.se, np.sqrt(np.r_[variance[0], variance[1:] + variance[0]]), rtol=1e-6)
    np.testing.assert_allclose(fit.robust().toPandas().std_error, fit.se, rtol=1e-6)


def test_logit_interaction_of_three_levels(spark, frame):
    three = frame.assign(g=np.where(frame.qb == 1, "c", frame.g))
    columns = [np.ones(len(three)), three.qp.to_numpy()]
    columns += [(three.g == v).astype(float).to_numpy() for v in "bc"]
    columns += [columns[1] * c for c in columns[2:4]]
    beta, se, robust = newton(np.column_stack(columns), three.outcome.to_numpy())
    fit = models.fit_logit(spark.createDataFrame(three), "outcome", ["qp"], "g", True)
    assert fit.terms == ["(Intercept)", "qp", "gb", "gc", "qp:gb", "qp:gc"]
    np.testing.assert_allclose(fit.beta, beta, rtol=1e-6)
    np.testing.assert_allclose(fit.se, se, rtol=1e-6)
    np.testing.assert_allclose(fit.robust().toPandas().std_error, robust, rtol=1e-6)
