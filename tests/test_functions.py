import math

import pytest
from pyspark.sql import functions as F

from twosight.functions import nulls as N
from twosight.functions import pvalues as P
from twosight.functions import recodes as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "got, want",
    [
        (lambda: P.normal_two_sided(1.959963984540054), 0.05),
        (lambda: P.chi2_upper(3.841458820694124, 1), 0.05),
        (lambda: P.chi2_upper(5.991464547107979, 2), 0.05),
        (lambda: P.chi2_upper(124.3421134, 100), 0.05),
        (lambda: P.t_two_sided(2.228138852, 10), 0.05),
        (lambda: P.t_two_sided(12.706204736, 1), 0.05),
        (lambda: P.t_two_sided(0.0, 7), 1.0),
        (lambda: P.chi2_upper(0.0, 3), 1.0),
    ],
)
def test_p_values_at_known_points(got, want):
    assert got() == pytest.approx(want, abs=1e-9)


def test_t_approaches_normal():
    assert P.t_two_sided(1.3, 1e7) == pytest.approx(P.normal_two_sided(1.3), rel=1e-6)


def test_t_tail_stays_positive():
    assert 0 < P.t_two_sided(40.0, 50) < 1e-35


def test_chi2_two_degrees_is_exponential():
    for x in (0.1, 1.0, 7.5, 60.0):
        assert P.chi2_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)


def test_p_columns_agree_with_series_and_fractions(spark):
    points = [(t, d) for t in (0.0, 0.3, -1.0, 2.0, 3.5, 7.0, 15.0, 40.0, float("inf")) for d in (0.7, 1.0, 2.0, 3.3, 10.0, 57.7, 500.0, 1e4)]
    df = spark.createDataFrame(points, "t double, d double").withColumn("x", F.col("d") + F.col("t") * F.sqrt("d"))
    df = df.select("t", "d", "x", P.p_student("t", "d").alias("pt"), P.p_normal("t").alias("pn"), P.p_chi2("x", "d").alias("pc"))
    for r in df.collect():
        assert r.pt == pytest.approx(P.t_two_sided(r.t, r.d), rel=1e-7, abs=1e-11)
        assert r.pn == pytest.approx(P.normal_two_sided(r.t), rel=1e-9, abs=1e-290)
        if math.isfinite(r.t):
            assert r.pc == pytest.approx(P.chi2_upper(r.x, r.d), rel=1e-7, abs=1e-11)
    assert P.t_two_sided(40.0, 50) == pytest.approx(one(spark, P.p_student(F.lit(40.0), F.lit(50.0))), rel=1e-9)


def test_p_columns_need_no_python(spark):
    df = spark.range(3).select(P.p_normal("id"), P.p_student("id", F.lit(4.0)), P.p_chi2("id", F.lit(2.0)))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_p_columns_pass_missing_through(spark):
    df = spark.createDataFrame([(1.959963984540054,), (None,)], "z double")
    got = [r[0] for r in df.select(P.p_normal("z")).collect()]
    assert got[0] == pytest.approx(0.05) and got[1] is None


@pytest.mark.parametrize(
    "text, want", [("7/14", 0.5), ("13/25", 0.52), (None, None), ("abc", None), ("3/0", None), ("5", None), ("/4", None)]
)
def test_fraction(spark, text, want):
    assert one(spark, N.fraction(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(
    "x, capped, plain",
    [(0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (0.99, 0.9, 0.9), (1.0, 0.9, 1.0), (None, None, None)],
)
def test_bins(spark, x, capped, plain):
    v = F.lit(x).cast("double")
    assert one(spark, N.decile(v)) == capped
    assert one(spark, N.bin_floor(v, 10)) == plain


def test_half_even_rounding(spark):
    assert [one(spark, N.round_even(F.lit(x), 2)) for x in (0.125, 0.375)] == [0.12, 0.38]
    assert [one(spark, N.round_even(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_strict_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "g string, x double")
    got = {r.g: (r.strict, r.plain) for r in df.groupBy("g").agg(N.strict(F.avg("x"), "x").alias("strict"), F.avg("x").alias("plain")).collect()}
    assert got == {"a": (2.0, 2.0), "b": (None, 1.0)}


def test_unknown_tests(spark):
    null = F.lit(None).cast("string")
    assert one(spark, N.matches(null, "a")) is False
    assert one(spark, N.is_in(null, ["a"])) is False
    assert one(spark, N.if_known(null == "a", F.lit(1), F.lit(0))) is None
    assert one(spark, N.row_min(F.lit(None).cast("double"), F.lit(0.99))) is None
    assert one(spark, N.ratio(F.lit(1), F.lit(0))) is None


def test_distinct_counts_missing_once(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,), (None,)], "x int")
    assert df.agg(N.distinct_values("x")).first()[0] == 3


def test_standard_error_counts_missing_rows(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert df.agg(N.std_error("x")).first()[0] == pytest.approx(math.sqrt(2) / math.sqrt(3))


def test_missing_answers_fall_to_the_default_class(spark):
    null = F.lit(None).cast("string")
    assert one(spark, R.confidence_class(null)) == "Somewhat confident"
    assert one(spark, R.rank_class(null)) == "Higher"
    assert one(spark, R.confidence_class(F.lit("Slightly confident"))) == "Not confident"
    assert one(spark, R.rank_class(F.lit("among the lowest accuracies (0-20%)"))) == "Lower"


@pytest.mark.parametrize("age, band", [(17, "<18"), (18, "18-24"), (24, "18-24"), (34, "25-34"), (59, "35-59"), (78, "60-78"), (79, "79+")])
def test_age_band(spark, age, band):
    assert one(spark, R.age_band(F.lit(age))) == band


@pytest.mark.parametrize("place, region", [("Maine", "northeast"), ("Ohio", "midwest"), ("Utah", "west"), ("Texas", "other"), (None, "other")])
def test_region(spark, place, region):
    assert one(spark, R.region(F.lit(place).cast("string"))) == region


def test_regions_are_complete():
    assert {k: len(v) for k, v in R.REGIONS.items()} == {"northeast": 9, "midwest": 12, "west": 13}


def test_prior_score(spark):
    null = F.lit(None).cast("string")
    assert one(spark, R.prior_score_number(null)) == 6.0
    assert one(spark, R.prior_score_number(F.lit("3"))) == 3.0
    assert one(spark, R.prior_score_label(null)) == "RFEL"


def test_text_cell(spark):
    assert one(spark, R.percent_and_count(F.lit(0.125), F.lit(34))) == "12.5% (34)"
    assert one(spark, R.percent_and_count(F.lit(0.5), F.lit(2))) == "50% (2)"


def test_types_merge(spark):
    got = [one(spark, R.human_or_model(F.lit(t))) for t in ("h", "hr", "r", "re")]
    assert got == ["h", "h", "r", "re"]
