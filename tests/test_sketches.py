import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twosight.operators import ranks, sketches
from twosight.plans import timeuse


@pytest.fixture(scope="module")
def df(spark):
    n = 40_000
    return spark.range(n).select(
        (F.col("id") % 7).alias("part"), (F.col("id") % 2).alias("arm"), (F.col("id") * 7919 % 12_345).alias("key"),
        F.when(F.col("id") % 50 != 0, F.pow(F.col("id") / n, F.lit(3.0))).alias("x"),
    )


def test_merged_distinct_counts_stay_within_the_error(df):
    one = sketches.merged_distinct(sketches.distinct_sketches(df, "key", ["part", "arm"])).first()[0]
    assert abs(one - 12_345) <= sketches.distinct_error() * 12_345
    by = {r.arm: r.estimate for r in sketches.merged_distinct(sketches.distinct_sketches(df, "key", ["part", "arm"]), ["arm"]).collect()}
    for arm, n in {r.arm: r.n for r in df.groupBy("arm").agg(F.countDistinct("key").alias("n")).collect()}.items():
        assert abs(by[arm] - n) <= sketches.distinct_error() * n


def test_merged_quantiles_stay_within_the_rank_error(df):
    found = sketches.merged_quantiles(sketches.quantile_sketches(df, "x", ["part", "arm"]), {"a": 0.05, "m": 0.5, "z": 0.99}).first()
    x = np.sort(df.select("x").dropna().toPandas().x.to_numpy())
    assert found.n == len(x)
    for value, p in ((found.a, 0.05), (found.m, 0.5), (found.z, 0.99)):
        assert abs(np.searchsorted(x, value, "right") / len(x) - p) <= sketches.rank_error() + 1 / len(x)


def test_sketches_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "arm int, x double")
    got = sketches.merged_quantiles(sketches.quantile_sketches(none, "x", ["arm"]), {"m": 0.5}, ["arm"]).select("n").first()
    assert got.n == 0 and sketches.merged_distinct(sketches.distinct_sketches(none, "x", ["arm"]), ["arm"]).first().estimate == 0


def test_auc_spread_is_the_variance_of_placements(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    frame = pd.DataFrame({"g": np.where(np.arange(300) < 297, "all", "tiny"), "y": y, "s": s + 0.2 * y})
    got = {r.g: r for r in ranks.auc_spread(spark.createDataFrame(frame).repartition(4), "y", "s", ["g"], ranges=5).collect()}
    part = frame[frame.g == "all"]
    wins = lambda a, b: (a[:, None] > b[None]) + (a[:, None] == b[None]) / 2
    pos, neg = part.s[part.y == 1].to_numpy(), part.s[part.y == 0].to_numpy()
    psi = wins(pos, neg)
    assert got["all"].auc == pytest.approx(psi.mean())
    assert got["all"].sd == pytest.approx(np.sqrt(psi.mean(axis=1).var(ddof=1) / len(pos) + psi.mean(axis=0).var(ddof=1) / len(neg)))
    assert got["tiny"].sd is None


ROWS = [(1, 5.0, 1), (1, 9.0, 2), (1, 9.0, 3), (1, 1.0, 4), (2, 4.0, 1), (3, 2.0, 1), (3, 6.0, 2), (3, 3.0, 3), (3, 3.0, 4), (3, 8.0, 5)]


def test_the_slowest_and_the_rest(spark):
    df = spark.createDataFrame(ROWS, "id int, time double, k int")
    whole = timeuse.by_time_within_participant(df, ["k"], keep=())
    top = timeuse.slowest(df, ["k"], k=2)
    key = lambda rows: sorted((r.id, r.n, r.time, round(r.time_cum, 9)) for r in rows)
    assert key(top.collect()) == key(whole.where("n <= 2").collect())
    for a, b in ((timeuse.without_slowest(df, ["k"], 2), timeuse.without_top(whole, 2)),):
        assert a.first() == pytest.approx(b.first())
    short = lambda rows: sorted((r.id, round(r.mean_time, 9), round(r.mean_time_sub, 9)) for r in rows)
    assert short(timeuse.decrease_without_slowest(df, ["k"], 2).collect()) == short(timeuse.decrease_by_participant(whole, 2).collect())
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Exchange rangepartitioning" not in plan


def test_sizes_need_no_expand(spark, sf_dir):
    assert "Expand" not in entry.queries()["study_sizes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
