from pyspark.sql import functions as F

from catalog import sqltext as q
from catalog.registry import off_ties, query
from catalog.views import assess
from twosight.operators import metrics, models, ranks
from twosight.plans import fairness, impact, preparation

_A = "SELECT * FROM long WHERE type = 'hr'"
_INF = "CASE WHEN abs(qp_r - qp_h) >= 0.05::DOUBLE THEN (qp_hr - qp_h) / (qp_r - qp_h) END"
_NAI = f"nai AS (SELECT *, {_INF} AS influence FROM na)"


def _hr(spark, d):
    return preparation.assisted(assess(spark, d))


def _na(spark, d):
    return impact.with_influence(preparation.part_two(assess(spark, d), "No anchor"), closed=True)


@query(
    "metric_bundle_by_group_wide",
    f"""WITH b AS ({q.bundle_sql(_A, ["grp"], base=True)}) SELECT metric, ord, max(CASE WHEN grp = 'g0' THEN value END) AS g0,
        max(CASE WHEN grp = 'g1' THEN value END) AS g1 FROM b GROUP BY metric, ord""",
    ["long"],
)
def _(spark, d):
    return metrics.metrics_wide(metrics.metric_bundle(_hr(spark, d), ["grp"], base_rate=True), "grp", ["g0", "g1"])


@query("metric_pairs_by_group", q.metric_pairs_sql(_A, "grp", [("g0", "g1")]), ["long"])
def _(spark, d):
    return metrics.metric_pairs(_hr(spark, d), "grp", [("g0", "g1")])


@query("auc_by_group", q.auc_sql(f"SELECT grp, outcome AS y, qp AS s FROM ({_A}) z", ["grp"]), ["long"])
def _(spark, d):
    return ranks.auc(_hr(spark, d), "outcome", "qp", ["grp"])


_PATTERNS = f"SELECT grp AS g, qp AS x1, CASE WHEN grp = 'g1' THEN 1 ELSE 0 END AS x2, sum(outcome) AS n1, count(*) AS n FROM ({_A}) z GROUP BY grp, qp"


_MAIN = f"""WITH RECURSIVE {q.logit_ctes("lm", _PATTERNS)}
        SELECT CASE i WHEN 0 THEN '(Intercept)' WHEN 1 THEN 'qp' ELSE 'grpg1' END AS term, round(estimate, 6) AS estimate, round(se, 6) AS std_error,
        round(estimate / se, 6) AS statistic, {q.p_normal("estimate / se")} AS p FROM lm_f"""


@query("logit_main", _MAIN, ["long"])
def _(spark, d):
    return fairness.calibration_logit(_hr(spark, d), "grp")


@query(
    "logit_interaction",
    f"""WITH RECURSIVE {q.logit_by_group_ctes("li", _PATTERNS)},
        t AS (SELECT '(Intercept)' AS term, b0 AS e, sqrt(v00) AS s FROM li_f WHERE g = 'g0' UNION ALL SELECT 'qp', b1, sqrt(v11) FROM li_f WHERE g = 'g0'
        UNION ALL SELECT 'grpg1', max(CASE WHEN g = 'g1' THEN b0 END) - max(CASE WHEN g = 'g0' THEN b0 END), sqrt(sum(v00)) FROM li_f
        UNION ALL SELECT 'qp:grpg1', max(CASE WHEN g = 'g1' THEN b1 END) - max(CASE WHEN g = 'g0' THEN b1 END), sqrt(sum(v11)) FROM li_f)
        SELECT term, round(e, 6) AS estimate, round(s, 6) AS std_error, round(e / s, 6) AS statistic, {q.p_normal("e / s")} AS p FROM t""",
    ["long"],
)
def _(spark, d):
    return fairness.calibration_logit(_hr(spark, d), "grp", interact=True)


@query("logit_levels", _MAIN, ["long"])
def _(spark, d):
    return models.logit_levels(_hr(spark, d), "outcome", ["qp"], "grp")


@query("calibration_p_values", f"SELECT term, p FROM ({_MAIN}) z", ["long"])
def _(spark, d):
    return fairness.calibration_logit(_hr(spark, d), "grp").select("term", "p")


@query(
    "chisq_calibration_bins",
    f"""WITH g AS (SELECT floor(least(qp, 0.99::DOUBLE) * 10) / 10 AS qp_binned, count(*)::DOUBLE AS n,
        sum(CASE WHEN outcome = 1 AND grp = 'g0' THEN 1 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN outcome = 1 AND grp = 'g1' THEN 1 ELSE 0 END)::DOUBLE AS b,
        sum(CASE WHEN outcome = 0 AND grp = 'g0' THEN 1 ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN outcome = 0 AND grp = 'g1' THEN 1 ELSE 0 END)::DOUBLE AS d FROM ({_A}) z GROUP BY 1),
        x AS (SELECT *, n * pow(greatest(abs(a * d - b * c) - n / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS x FROM g)
        SELECT qp_binned, n::BIGINT AS n, round(x, 6) AS chi2, 1.0::DOUBLE AS dof, {q.p_chi2("x", "1.0::DOUBLE")} AS p FROM x""",
    ["long"],
)
def _(spark, d):
    return fairness.calibration_test(_hr(spark, d), "grp")


@query(
    "chisq_outcome_condition_by_part",
    f"""WITH o AS (SELECT survey_part, outcome, condition, count(*)::DOUBLE AS o FROM long GROUP BY 1, 2, 3),
       e AS (SELECT *, sum(o) OVER (PARTITION BY survey_part, outcome) * sum(o) OVER (PARTITION BY survey_part, condition) / sum(o) OVER (PARTITION BY survey_part) AS e FROM o),
       x AS (SELECT survey_part, sum(o)::BIGINT AS n, sum((o - e) * (o - e) / e) AS x FROM e GROUP BY survey_part)
       SELECT survey_part, n, round(x, 6) AS chi2, 2.0::DOUBLE AS dof, {q.p_chi2("x", "2.0::DOUBLE")} AS p FROM x""",
    ["long"],
)
def _(spark, d):
    from twosight.operators.inference import chi_square

    return chi_square(preparation.assessments_long(assess(spark, d)), "outcome", "condition", ["survey_part"])


@query(
    "calibration_by_group",
    f"""WITH g AS (SELECT floor(least(qp, 0.99::DOUBLE) * 10) / 10 AS qp_binned, grp, avg(outcome) AS m, stddev_samp(outcome) / sqrt(count(*)) AS s, count(*) AS n FROM ({_A}) z GROUP BY 1, 2)
        SELECT qp_binned, grp, round(m, 6) AS mean_outcome, round(s, 6) AS se, n, round(m - 1.96::DOUBLE * s, 6) AS lb, round(m + 1.96::DOUBLE * s, 6) AS ub FROM g""",
    ["long"],
)
def _(spark, d):
    return fairness.calibration(_hr(spark, d), "grp")


@query(
    "influence_by_group",
    f"WITH {_NAI} SELECT grp, round(avg(influence), 6) AS mean_influence, round(median(influence), 6) AS median_influence, count(*) AS n FROM nai GROUP BY grp",
    ["na"],
)
def _(spark, d):
    return fairness.influence_by_group(_na(spark, d), "grp")


@query(
    "influence_by_group_direction",
    f"WITH {_NAI} SELECT grp, qp_h < qp_r AS model_higher, round(avg(influence), 6) AS mean_influence, round(median(influence), 6) AS median_influence, count(*) AS n FROM nai GROUP BY 1, 2",
    ["na"],
)
def _(spark, d):
    return fairness.influence_by_group(_na(spark, d), "grp", by_direction=True)


@query(
    "rank_sum_influence_by_group",
    f"WITH {_NAI}, "
    + q.rank_sum_sql(
        "SELECT qp_h < qp_r AS model_higher, round(influence, 6) AS x, CASE WHEN grp = 'g0' THEN 1 ELSE 0 END AS a FROM nai", ["model_higher"]
    )[5:],
    ["na"],
)
def _(spark, d):
    rows = _na(spark, d).withColumn("model_higher", F.col("qp_h") < F.col("qp_r"))
    return ranks.rank_sum(rows, F.round("influence", 6), "grp", "g0", "g1", ["model_higher"])


_ITEM = (
    "it AS (SELECT idx, grp, avg(CASE WHEN type = 'h' THEN qp END) AS h, avg(CASE WHEN type = 'hr' THEN qp END) AS hr, max(qp_r) AS qp_r FROM long "
    "GROUP BY idx, grp HAVING count(CASE WHEN type = 'h' THEN 1 END) >= 3 AND count(CASE WHEN type = 'hr' THEN 1 END) >= 3), "
    "iti AS (SELECT *, CASE WHEN abs(qp_r - h) >= 0.05::DOUBLE THEN (hr - h) / (qp_r - h) END AS influence FROM it)"
)


def _items(spark, d):
    return fairness.item_influence(preparation.assessments_long(assess(spark, d)), "grp")


@query(
    "item_influence",
    f"WITH {_ITEM} SELECT grp, round(avg(influence), 6) AS mean_influence, round(median(influence), 6) AS median_influence, count(*) AS n FROM iti GROUP BY grp",
    ["long"],
)
def _(spark, d):
    return fairness.item_influence_summary(_items(spark, d), "grp")


@query(
    "item_influence_by_direction",
    f"WITH {_ITEM} SELECT grp, h < qp_r AS model_higher, round(avg(influence), 6) AS mean_influence, round(median(influence), 6) AS median_influence, count(*) AS n FROM iti GROUP BY 1, 2",
    ["long"],
)
def _(spark, d):
    return fairness.item_influence_summary(_items(spark, d), "grp", by_direction=True)


@query(
    "item_influence_rows",
    f"WITH {_ITEM} SELECT idx AS index, grp, round(h + 1e-9, 6) AS h, round(hr + 1e-9, 6) AS hr, round(qp_r, 6) AS qp_r FROM iti",
    ["long"],
)
def _(spark, d):
    return off_ties(_items(spark, d).drop("influence"), "h", "hr")


@query(
    "rank_sum_item_influence",
    f"WITH {_ITEM}, " + q.rank_sum_sql("SELECT round(influence + 1e-9, 7) AS x, CASE WHEN grp = 'g0' THEN 1 ELSE 0 END AS a FROM iti")[5:],
    ["long"],
)
def _(spark, d):
    return ranks.rank_sum(_items(spark, d), F.round(F.col("influence") + 1e-9, 7), "grp", "g0", "g1")


@query(
    "items_with_enough_answers",
    """WITH k AS (SELECT *, count(*) OVER (PARTITION BY idx, type) AS c FROM long), f AS (SELECT * FROM k WHERE c >= 3),
       g AS (SELECT idx FROM f GROUP BY idx HAVING count(DISTINCT type) = 2)
       SELECT type, count(*) AS n, count(DISTINCT idx) AS items FROM f WHERE idx IN (SELECT idx FROM g) GROUP BY type""",
    ["long"],
)
def _(spark, d):
    from twosight.operators.summary import keep_groups

    long = preparation.assessments_long(assess(spark, d)).select("index", "type")
    enough = keep_groups(long, ["index", "type"], F.count(F.lit(1)) >= 3)
    both = keep_groups(enough, ["index"], F.countDistinct("type") == 2)
    return both.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("index").alias("items"))
