from catalog import sqltext as q
from catalog.registry import query
from catalog.views import assess
from twosight.plans import mapping, preparation

_A = "hr2 AS (SELECT * FROM long WHERE type = 'hr' AND survey_part = 2)"
_BAND = (
    "bd AS (SELECT 'below half' AS band, * FROM hr2 WHERE qp < 0.5 UNION ALL SELECT 'above half', * FROM hr2 WHERE qp > 0.5 "
    "UNION ALL SELECT '40 to half', * FROM hr2 WHERE qp >= 0.4::DOUBLE AND qp < 0.5 UNION ALL SELECT 'half', * FROM hr2 WHERE qp = 0.5 "
    "UNION ALL SELECT 'half to 60', * FROM hr2 WHERE qp > 0.5 AND qp <= 0.6::DOUBLE)"
)


def _hr2(spark, d):
    return preparation.assisted(assess(spark, d)).where("survey_part = 2")


@query(
    "score_decile_curve",
    f"""WITH {_A}, g AS (SELECT floor(least(qp, 0.99::DOUBLE) * 10) / 10 AS qp_binned, avg(qb) AS m, count(*) AS n FROM hr2 GROUP BY 1),
        e AS (SELECT *, sqrt(m * (1 - m) / n) AS s FROM g)
        SELECT qp_binned, round(m, 6) AS mean_qb, n, round(s, 6) AS se, round(m - 1.96::DOUBLE * s, 6) AS lb, round(m + 1.96::DOUBLE * s, 6) AS ub FROM e""",
    ["long"],
)
def _(spark, d):
    return mapping.decile_curve(_hr2(spark, d))


@query(
    "score_exact_curve",
    "SELECT survey_part, round(qp, 6) AS qp, round(avg(qb), 6) AS mean_qb, count(*) AS n FROM long WHERE type = 'h' GROUP BY survey_part, long.qp",
    ["long"],
)
def _(spark, d):
    return mapping.exact_curve(preparation.assessments_long(assess(spark, d), ("h",)), ["survey_part"])


@query(
    "score_bands",
    f"""WITH {_A}, {_BAND} SELECT band, round(avg(qb), 6) AS mean_qb, round(1 - avg(qb), 6) AS mean_negative,
        round_even(stddev_samp(qb) / sqrt(count(*)), 3) AS se, count(*) AS n FROM bd GROUP BY band""",
    ["long"],
)
def _(spark, d):
    return mapping.bands(_hr2(spark, d))


@query(
    "score_bands_unassisted",
    f"""WITH hr2 AS (SELECT * FROM long WHERE type = 'h'), {_BAND} SELECT survey_part, band, round(avg(qb), 6) AS mean_qb, round(1 - avg(qb), 6) AS mean_negative,
        round_even(stddev_samp(qb) / sqrt(count(*)), 3) AS se, count(*) AS n FROM bd GROUP BY survey_part, band""",
    ["long"],
)
def _(spark, d):
    return mapping.bands(preparation.assessments_long(assess(spark, d), ("h",)), ["survey_part"])


@query(
    "score_band_tests",
    f"WITH {_A}, {_BAND}, "
    + q.welch_sql(
        """SELECT pa AS a, pb AS b, CASE WHEN band = pa THEN qb END AS xa, CASE WHEN band = pb THEN qb END AS xb FROM bd,
           (VALUES ('40 to half', 'half'), ('40 to half', 'half to 60'), ('half to 60', 'half')) p(pa, pb) WHERE band IN (pa, pb)""",
        ["a", "b"],
    )[5:],
    ["long"],
)
def _(spark, d):
    return mapping.band_tests(_hr2(spark, d))


@query(
    "participants_by_lowest_positive",
    f"""WITH {_A}, m AS (SELECT id, min(qp) AS mq FROM hr2 WHERE qb = 1 GROUP BY id)
        SELECT id, round(mq, 6) AS min_qp, row_number() OVER (ORDER BY mq, id) AS ord FROM m""",
    ["long"],
)
def _(spark, d):
    return mapping.participant_order(_hr2(spark, d))


@query(
    "participant_heat",
    f"WITH {_A} SELECT id, floor(least(qp, 0.99::DOUBLE) * 10) / 10 AS binned_qp, round(avg(qb), 6) AS mean_qb, count(*) AS n FROM hr2 GROUP BY 1, 2",
    ["long"],
)
def _(spark, d):
    return mapping.participant_heat(_hr2(spark, d))


@query(
    "strategy_consistency",
    f"""WITH {_A}, p AS (SELECT id, avg(CASE WHEN (CASE WHEN qp > 0.5 THEN 1 ELSE 0 END) = qb THEN 1 ELSE 0 END) > 0.65::DOUBLE AS consistent FROM hr2 WHERE qp <> 0.5 GROUP BY id)
        SELECT consistent, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS prop FROM p GROUP BY consistent""",
    ["long"],
)
def _(spark, d):
    return mapping.consistent_participants(_hr2(spark, d), more_than=0.65)


@query(
    "positive_rate_rethresholded",
    f"""WITH {_A} SELECT round(avg(qb), 6) AS mean_qb, round(avg(CASE WHEN qp > 0.5 THEN 1 ELSE 0 END), 6) AS share_above,
        round(avg(CASE WHEN qp >= 0.5 THEN 1 ELSE 0 END), 6) AS share_from, round(avg(CASE WHEN qp > 0.5 THEN qp END), 6) AS mean_qp_above,
        round(avg(CASE WHEN qp >= 0.5 THEN qp END), 6) AS mean_qp_from FROM hr2""",
    ["long"],
)
def _(spark, d):
    return mapping.overall_shares(_hr2(spark, d))


@query(
    "welch_estimate_against_answer",
    f"WITH {_A}, "
    + q.welch_sql(
        """SELECT 'open' AS rule, CASE WHEN qp > 0.5 THEN 1 ELSE 0 END AS xa, qb AS xb FROM hr2
           UNION ALL SELECT 'closed', CASE WHEN qp >= 0.5 THEN 1 ELSE 0 END, qb FROM hr2""",
        ["rule"],
    )[5:],
    ["long"],
)
def _(spark, d):
    return mapping.estimate_against_answer(_hr2(spark, d))


@query(
    "paired_estimate_against_answer",
    f"""WITH {_A}, g AS (SELECT 'open' AS rule, CASE WHEN qp > 0.5 THEN 1 ELSE 0 END - qb AS x FROM hr2
        UNION ALL SELECT 'closed', CASE WHEN qp >= 0.5 THEN 1 ELSE 0 END - qb FROM hr2),
        t AS (SELECT rule, count(*) AS n, avg(x) AS m, avg(x) * sqrt(count(*)) / stddev_samp(x) AS t, (count(*) - 1)::DOUBLE AS dof FROM g GROUP BY rule)
        SELECT rule, n, round(m, 6) AS mean_diff, round(t, 6) AS t, dof, {q.p_t("t", "dof")} AS p FROM t""",
    ["long"],
)
def _(spark, d):
    return mapping.estimate_against_answer(_hr2(spark, d), paired=True)


@query(
    "inconsistency_by_second",
    f"""WITH {_A}, g AS (SELECT round_even(time, 0) AS time, CASE WHEN qb <> CASE WHEN qp > 0.5 THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS x FROM hr2),
        s AS (SELECT time, avg(x) AS m, stddev_samp(x) / sqrt(count(*)) AS e, count(*) AS n FROM g WHERE time BETWEEN 3 AND 20 GROUP BY time)
        SELECT time, round(m, 6) AS mean_inc, round(e, 6) AS se_inc, n, round(m - 1.96::DOUBLE * e, 6) AS lb, round(m + 1.96::DOUBLE * e, 6) AS ub FROM s""",
    ["long"],
)
def _(spark, d):
    return mapping.inconsistency_by_second(_hr2(spark, d))


_TWO = (
    "two AS (SELECT 'score' AS source, outcome, CASE WHEN qp > 0.5 THEN 1 ELSE 0 END AS qb FROM hr2 WHERE qp <> 0.5 "
    "UNION ALL SELECT 'binary', outcome, qb FROM hr2 WHERE qp <> 0.5)"
)


@query("thresholded_vs_binary", f"WITH {_A}, {_TWO}, " + q.bundle_sql("SELECT * FROM two", ["source"])[5:], ["long"])
def _(spark, d):
    return mapping.score_and_binary_bundle(_hr2(spark, d))


@query(
    "thresholded_vs_binary_tests",
    f"WITH {_A}, {_TWO}, " + q.metric_pairs_sql("SELECT * FROM two", "source", [("score", "binary")])[5:],
    ["long"],
)
def _(spark, d):
    return mapping.score_and_binary_tests(_hr2(spark, d))


@query(
    "slow_answers_only",
    """SELECT setting, count(*) AS n, round(avg(qp_r), 6) AS mean_qp_r FROM assess
       WHERE (time_h >= 20 AND time_h IS NOT NULL) OR (time_hr >= 20 AND time_h IS NULL) GROUP BY setting""",
)
def _(spark, d):
    from pyspark.sql import functions as F

    rows = preparation.drop_fast(assess(spark, d), 20)
    return rows.groupBy("setting").agg(F.count(F.lit(1)).alias("n"), F.avg("qp_r").alias("mean_qp_r"))


@query(
    "familiar_participants_only",
    """SELECT setting, count(*) AS n, round(avg(qp_r), 6) AS mean_qp_r FROM assess
       WHERE id IN (SELECT id FROM demographics WHERE ml_familiarity = 'No') GROUP BY setting""",
    ["assess", "demographics"],
)
def _(spark, d):
    from pyspark.sql import functions as F

    from catalog.views import view

    people = view(spark, d, "demographics")
    rows = preparation.only_participants(assess(spark, d), people, F.col("ml_familiarity") == "No")
    return rows.groupBy("setting").agg(F.count(F.lit(1)).alias("n"), F.avg("qp_r").alias("mean_qp_r"))
