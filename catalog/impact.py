from pyspark.sql import functions as F

from catalog import sqltext as q
from catalog.registry import off_ties, query
from catalog.views import assess, view
from twosight.functions.nulls import bin_floor, flag
from twosight.operators import inference, joins, layers, metrics, ranks
from twosight.plans import impact, overview, preparation

_A = "SELECT * FROM long WHERE type = 'hr'"
_GAP = "round(abs(qp - qp_r), 6)"
_INF = "CASE WHEN abs(qp_h - qp_r) > 0.05::DOUBLE THEN (qp_hr - qp_h) / (qp_r - qp_h) END"
_NAI = f"nai AS (SELECT *, {_INF} AS influence FROM na)"


def _a(spark, d):
    return preparation.assisted(assess(spark, d))


def _na(spark, d):
    return impact.with_influence(preparation.part_two(assess(spark, d), "No anchor"))


def _na_long(spark, d):
    return preparation.assessments_long(preparation.part_two(assess(spark, d), "No anchor"))


def _gap():
    return F.round(impact.distance("qp"), 6)


def _answers(spark, d, arm=None):
    return preparation.perception_long(view(spark, d, "perception"), arm)


@query(
    "gap_by_setting",
    f"SELECT setting, count(*) AS n, round(avg(abs(qp - qp_r)), 6) AS mean_abs_diff, round(median(abs(qp - qp_r)), 6) AS median_diff FROM ({_A}) z GROUP BY setting",
    ["long"],
)
def _(spark, d):
    return impact.gap_summary(_a(spark, d), ["setting"])


@query(
    "welch_gap_by_setting",
    q.welch_sql(
        f"SELECT CASE WHEN setting = 'Anchor' THEN abs(qp - qp_r) END AS xa, CASE WHEN setting = 'No anchor' THEN abs(qp - qp_r) END AS xb FROM ({_A}) z"
    ),
    ["long"],
)
def _(spark, d):
    return inference.welch_t(_a(spark, d), impact.distance("qp"), "setting", "Anchor", "No anchor")


@query(
    "rank_sum_gap_by_setting",
    q.rank_sum_sql(f"SELECT {_GAP} AS x, CASE WHEN setting = 'Anchor' THEN 1 ELSE 0 END AS a FROM ({_A}) z"),
    ["long"],
)
def _(spark, d):
    return ranks.rank_sum(_a(spark, d), _gap(), "setting", "Anchor", "No anchor")


@query(
    "rank_sum_by_bin",
    q.rank_sum_sql(
        f"SELECT floor(qp_r * 5) / 5 AS qp_r_bin, {_GAP} AS x, CASE WHEN setting = 'Anchor' THEN 1 ELSE 0 END AS a FROM ({_A}) z",
        ["qp_r_bin"],
    ),
    ["long"],
)
def _(spark, d):
    rows = _a(spark, d).withColumn("qp_r_bin", bin_floor("qp_r", 5))
    return ranks.rank_sum(rows, _gap(), "setting", "Anchor", "No anchor", ["qp_r_bin"])


@query(
    "rank_sum_by_condition",
    q.rank_sum_sql(
        f"SELECT condition, {_GAP} AS x, CASE WHEN setting = 'Anchor' THEN 1 ELSE 0 END AS a FROM ({_A}) z", ["condition"]
    ),
    ["long"],
)
def _(spark, d):
    return ranks.rank_sum(_a(spark, d), _gap(), "setting", "Anchor", "No anchor", ["condition"])


@query(
    "rank_sum_condition_by_model_right",
    q.rank_sum_sql(
        f"""SELECT qb_r = outcome AS model_right, {_GAP} AS x, CASE condition WHEN 'Controlled' THEN 1 WHEN 'Decreasing' THEN 0 END AS a
            FROM ({_A}) z""",
        ["model_right"],
    ),
    ["long"],
)
def _(spark, d):
    rows = _a(spark, d).withColumn("model_right", F.col("qb_r") == F.col("outcome"))
    return ranks.rank_sum(rows, _gap(), "condition", "Controlled", "Decreasing", ["model_right"])


@query(
    "gap_by_score_bin",
    f"""SELECT floor(qp_r * 5) / 5 AS qp_r_bin, setting, round(avg(abs(qp - qp_r)), 6) AS value,
        round(stddev_samp(abs(qp - qp_r)) / sqrt(count(*)), 6) AS se, count(*) AS n FROM ({_A}) z GROUP BY 1, 2""",
    ["long"],
)
def _(spark, d):
    return impact.gap_by_score(_a(spark, d), ["setting"])


@query(
    "gap_by_condition_setting",
    f"SELECT condition, setting, round(avg(abs(qp - qp_r)), 6) AS value, round(stddev_samp(abs(qp - qp_r)) / sqrt(count(*)), 6) AS se, count(*) AS n FROM ({_A}) z GROUP BY 1, 2",
    ["long"],
)
def _(spark, d):
    from twosight.operators.summary import mean_se

    return mean_se(_a(spark, d), impact.distance("qp"), ["condition", "setting"])


@query(
    "gap_box_by_score_bin",
    f"""WITH v AS (SELECT floor(qp_r * 5) / 5 AS b, setting, qp - qp_r AS x FROM ({_A}) z),
        s AS (SELECT b, setting, count(*) AS n, quantile_cont(x, 0.25) AS q1, median(x) AS md, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY b, setting)
        SELECT b AS qp_r_bin, setting, n, round(q1, 6) AS q1, round(md, 6) AS median, round(q3, 6) AS q3, round(min(CASE WHEN ok THEN x END), 6) AS ymin,
        round(max(CASE WHEN ok THEN x END), 6) AS ymax, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS outliers,
        round(md - 1.58::DOUBLE * (q3 - q1) / sqrt(n), 6) AS notch_lower, round(md + 1.58::DOUBLE * (q3 - q1) / sqrt(n), 6) AS notch_upper
        FROM (SELECT *, x BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS ok FROM v JOIN s USING (b, setting)) k
        GROUP BY b, setting, n, q1, md, q3""",
    ["long"],
)
def _(spark, d):
    rows = _a(spark, d).withColumn("qp_r_bin", bin_floor("qp_r", 5))
    return layers.box_stats(rows, F.col("qp") - F.col("qp_r"), ["qp_r_bin", "setting"])


@query(
    "unassisted_baseline",
    "SELECT round(avg(abs(qp_h - qp_r)), 6) AS mean_abs_diff, round(avg(CASE WHEN qb_h <> qb_r THEN 1 ELSE 0 END), 6) AS disagreement FROM na",
    ["na"],
)
def _(spark, d):
    return impact.unassisted_baseline(preparation.part_two(assess(spark, d), "No anchor"))


@query(
    "gap_given_model_accuracy",
    f"""WITH z AS ({_A}), a AS (SELECT id, avg(CASE WHEN qb_r = outcome THEN 1 ELSE 0 END) AS acc_r FROM z GROUP BY id)
        SELECT condition, setting, round(acc_r, 6) AS acc_r, round(avg(abs(qp_r - qp)) + 1e-9, 6) AS mean_abs_diff,
        round(avg(CASE WHEN qb_r = qb THEN 1 ELSE 0 END), 6) AS agreement, count(*) AS n
        FROM z JOIN a USING (id) GROUP BY condition, setting, a.acc_r HAVING count(*) > 50""",
    ["long"],
)
def _(spark, d):
    return off_ties(impact.given_model_accuracy(_a(spark, d), more_than=50), "mean_abs_diff")


@query(
    "disagreement_by_arm",
    f"""SELECT condition, setting, round(avg(CASE WHEN qb <> qb_r THEN 1 ELSE 0 END), 6) AS value,
        round(stddev_samp(CASE WHEN qb <> qb_r THEN 1 ELSE 0 END) / sqrt(count(*)), 6) AS se, count(*) AS n FROM ({_A}) z GROUP BY 1, 2""",
    ["long"],
)
def _(spark, d):
    return impact.disagreement(_a(spark, d), ["condition", "setting"])


@query(
    "agreement_by_condition_order",
    f"""SELECT condition, order_question, round(avg(abs(qp - qp_r)), 6) AS mean_diff,
        round(avg(CASE WHEN qb = qb_r THEN 1 ELSE 0 END), 6) AS mean_agreement FROM ({_A}) z GROUP BY 1, 2""",
    ["long"],
)
def _(spark, d):
    return impact.agreement_by(_a(spark, d), ["condition", "order_question"])


# Conditions compared.
_C = "SELECT * FROM long WHERE type = 'hr' AND condition <> 'None'"


def _c(spark, d):
    return _a(spark, d).where("condition <> 'None'")


@query("metric_bundle_by_condition", q.bundle_sql(_C, ["condition"], base=True), ["long"])
def _(spark, d):
    return metrics.metric_bundle(_c(spark, d), ["condition"], base_rate=True)


@query("metric_pairs_by_condition", q.metric_pairs_sql(_C, "condition", [("Decreasing", "Controlled")]), ["long"])
def _(spark, d):
    return metrics.metric_pairs(_c(spark, d), "condition", [("Decreasing", "Controlled")])


@query(
    "model_accuracy_by_condition",
    f"SELECT condition, round(avg(CASE WHEN qb_r = outcome THEN 1 ELSE 0 END), 6) AS acc FROM ({_C}) z GROUP BY condition",
    ["long"],
)
def _(spark, d):
    return impact.model_accuracy(_c(spark, d), ["condition"])


@query(
    "items_per_participant",
    f"SELECT round(avg(n), 6) AS mean_items FROM (SELECT id, count(*) AS n FROM ({_C}) z GROUP BY id) k",
    ["long"],
)
def _(spark, d):
    return impact.items_per_participant(_c(spark, d))


@query(
    "arm_text_table",
    """WITH p AS (SELECT DISTINCT id, setting, condition FROM assess),
       c AS (SELECT condition, setting, count(*) AS n, round_even(count(*) / (SELECT count(*) FROM p), 3) AS prop FROM p GROUP BY condition, setting),
       t AS (SELECT condition, setting, concat(rtrim(rtrim(printf('%.3f', prop * 100), '0'), '.'), '% (', n, ')') AS txt FROM c)
       SELECT condition, max(CASE WHEN setting = 'Anchor' THEN txt END) AS "Anchor", max(CASE WHEN setting = 'No anchor' THEN txt END) AS "No anchor" FROM t GROUP BY condition""",
)
def _(spark, d):
    counts = overview.participants_per_arm(assess(spark, d), ["setting", "condition"])
    return impact.arm_text_table(counts, ["Anchor", "No anchor"])


# The arm without anchoring: before and after.
_NL = "SELECT * FROM long WHERE survey_part = 2 AND setting = 'No anchor'"


@query("metric_bundle_before_after", q.bundle_sql(_NL, ["type"]), ["long"])
def _(spark, d):
    return metrics.metric_bundle(_na_long(spark, d), ["type"])


@query("metric_pairs_before_after", q.metric_pairs_sql(_NL, "type", [("h", "hr")]), ["long"])
def _(spark, d):
    return metrics.metric_pairs(_na_long(spark, d), "type", [("h", "hr")])


@query("auc_of_model", q.auc_sql("SELECT outcome AS y, qp_r AS s FROM na"), ["na"])
def _(spark, d):
    return ranks.auc(_na(spark, d), "outcome", "qp_r")


@query("influence_summary", f"WITH {_NAI} SELECT round(avg(influence), 6) AS mean_influence, round(median(influence), 6) AS median_influence, count(*) AS n FROM nai", ["na"])
def _(spark, d):
    return impact.influence_by(_na(spark, d), [])


@query(
    "influence_by_sign",
    f"""WITH {_NAI} SELECT qp_r - qp_h > 0 AS model_higher, round(avg(influence), 6) AS mean_influence, round(avg(abs(qp_hr - qp_h)), 6) AS mean_revision,
        round(avg(qp_r - qp_h), 6) AS size_initial_diff, count(*) AS n FROM nai GROUP BY 1""",
    ["na"],
)
def _(spark, d):
    return impact.influence_by_sign(_na(spark, d))


@query(
    "rank_sum_influence_by_sign",
    f"WITH {_NAI}, "
    + q.rank_sum_sql("SELECT round(influence, 6) AS x, CASE WHEN qp_r - qp_h > 0 THEN 0 ELSE 1 END AS a FROM nai")[5:],
    ["na"],
)
def _(spark, d):
    higher = flag(F.col("qp_r") - F.col("qp_h") > 0)
    return ranks.rank_sum(_na(spark, d), F.round("influence", 6), higher, 0, 1)


@query(
    "welch_revision_by_sign",
    q.welch_sql(
        """SELECT CASE WHEN NOT (qp_r - qp_h > 0) THEN abs(qp_hr - qp_h) END AS xa, CASE WHEN qp_r - qp_h > 0 THEN abs(qp_hr - qp_h) END AS xb FROM na"""
    ),
    ["na"],
)
def _(spark, d):
    higher = flag(F.col("qp_r") - F.col("qp_h") > 0)
    return inference.welch_t(_na(spark, d), impact.distance("qp_hr", "qp_h"), higher, 0, 1)


@query("pearson_influence_gap", f"WITH {_NAI}, " + q.pearson_sql("SELECT influence AS x, qp_r - qp_h AS y FROM nai")[5:], ["na"])
def _(spark, d):
    return inference.pearson_test(_na(spark, d), "influence", F.col("qp_r") - F.col("qp_h"))


@query(
    "spearman_influence_gap_by_sign",
    f"WITH {_NAI}, "
    + q.spearman_sql(
        "SELECT CAST(sign(qp_r - qp_h) AS INTEGER) AS side, round(influence, 6) AS x, round(qp_r - qp_h, 6) AS y FROM nai WHERE qp_r <> qp_h", ["side"]
    )[5:],
    ["na"],
)
def _(spark, d):
    gap = F.col("qp_r") - F.col("qp_h")
    rows = _na(spark, d).where("qp_r <> qp_h").withColumn("side", F.signum(gap))
    out = ranks.spearman(rows, F.round("influence", 6), F.round(gap, 6), ["side"])
    return out.withColumn("side", F.col("side").cast("int"))


@query(
    "influence_boxes",
    f"""WITH {_NAI}, v AS (SELECT floor((qp_r - qp_h) * 10) / 10 AS b, influence AS x FROM nai),
        w AS (SELECT * FROM v WHERE b BETWEEN -0.5::DOUBLE AND 0.3::DOUBLE AND x BETWEEN -1.6::DOUBLE AND 1.6::DOUBLE),
        s AS (SELECT b, count(*) AS n, quantile_cont(x, 0.25) AS q1, median(x) AS md, quantile_cont(x, 0.75) AS q3 FROM w GROUP BY b)
        SELECT b AS initial_risk_diff, n, round(q1, 6) AS q1, round(md, 6) AS median, round(q3, 6) AS q3 FROM s""",
    ["na"],
)
def _(spark, d):
    return impact.influence_boxes(_na(spark, d)).select("initial_risk_diff", "n", "q1", "median", "q3")


@query(
    "deviation_before_after",
    f"SELECT type, round(avg(abs(qp - qp_r)), 6) AS mean_dev, round(median(abs(qp - qp_r)), 6) AS median_dev FROM ({_NL}) z GROUP BY type",
    ["long"],
)
def _(spark, d):
    out = impact.gap_summary(_na_long(spark, d), ["type"])
    return out.select("type", F.col("mean_abs_diff").alias("mean_dev"), F.col("median_diff").alias("median_dev"))


@query(
    "before_after_rows",
    "SELECT id, 'initial_diff' AS type, round(abs(qp_h - qp_r), 6) AS value FROM na UNION ALL SELECT id, 'final_diff', round(abs(qp_hr - qp_r), 6) FROM na",
    ["na"],
)
def _(spark, d):
    return impact.before_after(_na(spark, d), ["id"])


@query(
    "influence_box_by_participant",
    f"""WITH {_NAI}, x AS (SELECT id, influence AS v FROM nai WHERE influence BETWEEN -1 AND 2),
        s AS (SELECT id, count(*) AS n, quantile_cont(v, 0.25) AS q1, median(v) AS md, quantile_cont(v, 0.75) AS q3 FROM x GROUP BY id)
        SELECT id, n, round(q1 + 1e-9, 6) AS q1, round(md + 1e-9, 6) AS median, round(q3 + 1e-9, 6) AS q3 FROM s""",
    ["na"],
)
def _(spark, d):
    boxes = layers.box_stats(_na(spark, d), "influence", ["id"], limits=(-1.0, 2.0))
    return off_ties(boxes.select("id", "n", "q1", "median", "q3"), "q1", "median", "q3")


@query(
    "influence_by_participant",
    f"""WITH {_NAI}, p AS (SELECT id, avg(influence) AS mi, avg(abs(qp_r - qp_hr)) AS fd FROM nai GROUP BY id)
        SELECT id, round(mi + 1e-9, 6) AS mean_influence, round(fd + 1e-9, 6) AS mean_final_diff FROM p""",
    ["na"],
)
def _(spark, d):
    return off_ties(impact.influence_by_participant(_na(spark, d)).drop("place"), "mean_influence", "mean_final_diff")


@query(
    "kruskal_influence_by_participant",
    f"WITH {_NAI}, " + q.kruskal_sql("SELECT round(influence, 6) AS x, id AS g FROM nai")[5:],
    ["na"],
)
def _(spark, d):
    return ranks.kruskal(_na(spark, d), F.round("influence", 6), "id")


@query(
    "kruskal_influence_by_order",
    f"WITH {_NAI}, " + q.kruskal_sql("SELECT round(influence, 6) AS x, order_question AS g FROM nai")[5:],
    ["na"],
)
def _(spark, d):
    return ranks.kruskal(_na(spark, d), F.round("influence", 6), "order_question")


@query(
    "influence_by_order",
    f"WITH {_NAI} SELECT order_question, round(avg(influence), 6) AS mean_influence, round(median(influence), 6) AS median_influence, count(*) AS n FROM nai GROUP BY order_question",
    ["na"],
)
def _(spark, d):
    return impact.influence_by(_na(spark, d), ["order_question"])


@query(
    "behaviour_counts",
    """WITH p AS (SELECT id, avg(CASE WHEN abs(qp_hr - qp_r) <= 0.6::DOUBLE THEN 1 ELSE 0 END) AS a, avg(CASE WHEN abs(qp_hr - qp_h) <= 0.6::DOUBLE THEN 1 ELSE 0 END) AS b,
       avg(CASE WHEN abs(abs(qp_r + qp_h) / 2 - qp_hr) <= 0.6::DOUBLE THEN 1 ELSE 0 END) AS c FROM na GROUP BY id)
       SELECT count(CASE WHEN a = 1 THEN 1 END) AS always_matched, count(CASE WHEN b = 1 THEN 1 END) AS never_revised,
       count(CASE WHEN c = 1 THEN 1 END) AS always_averaged, count(*) AS participants FROM p""",
    ["na"],
)
def _(spark, d):
    return impact.behaviour_counts(_na(spark, d), near=0.6)


@query(
    "revision_stats",
    """SELECT round(avg(CASE WHEN qb_h <> qb_hr THEN 1 ELSE 0 END), 6) AS revised,
       round(stddev_samp(CASE WHEN qb_h <> qb_hr THEN 1 ELSE 0 END) / sqrt(count(*)), 6) AS revised_se,
       round(avg(CASE WHEN qb_h = qb_r THEN 1 ELSE 0 END), 6) AS agree_initial, round(avg(CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END), 6) AS agree_final,
       round(avg(CASE WHEN qb_h <> qb_r THEN CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END END), 6) AS switch_when_disagree,
       round(avg(CASE WHEN qb_h <> qb_hr THEN CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END END), 6) AS revision_to_model,
       round(avg(CASE WHEN qb_h = qb_r THEN CASE WHEN qb_hr <> qb_r THEN 1 ELSE 0 END END), 6) AS left_model,
       round(avg(qb_h), 6) AS initial_positive,
       round(avg(CASE WHEN qb_h <> qb_hr THEN CASE WHEN outcome = qb_h THEN 1 ELSE 0 END END), 6) AS acc_qb_h,
       round(avg(CASE WHEN qb_h <> qb_hr THEN CASE WHEN outcome = qb_hr THEN 1 ELSE 0 END END), 6) AS acc_qb_hr,
       count(CASE WHEN qb_h <> qb_hr THEN 1 END) AS n_revised FROM na""",
    ["na"],
)
def _(spark, d):
    return impact.revision_stats(_na(spark, d))


@query(
    "agreement_by_verdict",
    """SELECT qb_r, round(avg(CASE WHEN qb_h = qb_r THEN 1 ELSE 0 END), 6) AS mean_initial, round(avg(CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END), 6) AS mean_final,
       round(avg(CASE WHEN qb_h <> qb_r THEN CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END END), 6) AS switched FROM na GROUP BY qb_r""",
    ["na"],
)
def _(spark, d):
    return impact.agreement_by_verdict(_na(spark, d))


@query(
    "transition_shares",
    "SELECT qb_h, qb_hr, count(*) AS n, round(count(*) / (SELECT count(*) FROM na), 6) AS prop FROM na GROUP BY qb_h, qb_hr",
    ["na"],
)
def _(spark, d):
    return impact.transition_shares(_na(spark, d))


@query(
    "switch_direction",
    """WITH c AS (SELECT qb_hr, qp_h < qp_r AS model_higher, count(*) AS n FROM na WHERE qb_h <> qb_hr GROUP BY 1, 2)
       SELECT qb_hr, model_higher, n, round(n / sum(n) OVER (PARTITION BY qb_hr), 6) AS prop FROM c""",
    ["na"],
)
def _(spark, d):
    return impact.switch_direction(_na(spark, d))


@query(
    "agreement_test",
    q.welch_sql("SELECT CASE WHEN qb_h = qb_r THEN 1 ELSE 0 END AS xa, CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END AS xb FROM na"),
    ["na"],
)
def _(spark, d):
    return impact.agreement_test(_na(spark, d))


@query(
    "adherence_test",
    q.welch_sql(
        """SELECT CASE WHEN qb_r = 0 THEN CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END END AS xa,
           CASE WHEN qb_r = 1 THEN CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END END AS xb FROM na WHERE qb_h <> qb_r"""
    ),
    ["na"],
)
def _(spark, d):
    return impact.adherence_test(_na(spark, d))


@query(
    "revision_matrix",
    """WITH c AS (SELECT qb_h, qb_r, qb_hr, count(*) AS n FROM na GROUP BY 1, 2, 3)
       SELECT qb_h, qb_r, qb_hr, n, round(round_even(n / sum(n) OVER (PARTITION BY qb_h), 3) * 100, 6) AS prop FROM c""",
    ["na"],
)
def _(spark, d):
    return impact.revision_matrix(_na(spark, d))


@query(
    "decisions_by_model_decile",
    f"""SELECT floor(qp_r * 10) / 10 AS qp_r_binned, type, round(avg(qb), 6) AS value, round(stddev_samp(qb) / sqrt(count(*)), 6) AS se, count(*) AS n
        FROM ({_NL}) z GROUP BY 1, 2""",
    ["long"],
)
def _(spark, d):
    return impact.decisions_by_model_decile(_na_long(spark, d))


@query(
    "switches_by_model_decile",
    """SELECT floor(qp_r * 10) / 10 AS qp_r_binned, round(avg(CASE WHEN qb_hr = qb_r THEN 1 ELSE 0 END), 6) AS value, count(*) AS n
       FROM na WHERE qb_h <> qb_r GROUP BY 1""",
    ["na"],
)
def _(spark, d):
    return impact.switches_by_model_decile(_na(spark, d))


@query(
    "spearman_switch_score",
    q.spearman_sql("SELECT CASE WHEN qb_hr = 0 THEN 1 ELSE 0 END AS x, qp_r AS y FROM na WHERE qb_h <> qb_r AND qp_r < 0.5"),
    ["na"],
)
def _(spark, d):
    return ranks.spearman(impact.low_score_switches(_na(spark, d)), "changed", "qp_r")


# Stated use.
_ARM = "arm AS (SELECT DISTINCT id, setting, condition FROM long WHERE type = 'hr')"
_DP = f"{_ARM}, dp AS (SELECT * FROM answers JOIN arm USING (id) WHERE set_q = 3)"


def _dp(spark, d):
    arm = preparation.arms(_a(spark, d), "setting", "condition")
    return _answers(spark, d, arm).where("set_q = 3")


@query(
    "stated_use_by_setting",
    f"""WITH {_DP} SELECT setting, CASE WHEN count(use_binary) = count(*) THEN round(avg(use_binary), 6) END AS use_binary,
        CASE WHEN count(use_likelihood) = count(*) THEN round(avg(use_likelihood), 6) END AS use_likelihood,
        CASE WHEN count(humanaccuracy) = count(*) THEN round(avg(humanaccuracy), 6) END AS humanaccuracy,
        round(avg(CASE WHEN trust = 'Yes' THEN 1 ELSE 0 END), 6) AS trust, count(*) AS n FROM dp GROUP BY setting""",
    ["answers", "long"],
)
def _(spark, d):
    return impact.stated_use(_dp(spark, d), ["setting"])


@query(
    "rank_sum_use_by_setting",
    f"WITH {_DP}, "
    + q.rank_sum_sql(
        """SELECT 'use_binary' AS measure, use_binary AS x, CASE WHEN setting = 'Anchor' THEN 1 ELSE 0 END AS a FROM dp
           UNION ALL SELECT 'use_likelihood', use_likelihood, CASE WHEN setting = 'Anchor' THEN 1 ELSE 0 END FROM dp""",
        ["measure"],
    )[5:],
    ["answers", "long"],
)
def _(spark, d):
    from twosight.operators.reshape import longer

    rows = longer(_dp(spark, d), ["setting"], ["use_binary", "use_likelihood"], "measure", "x")
    return ranks.rank_sum(rows, "x", "setting", "Anchor", "No anchor", ["measure"])


@query(
    "welch_trust_by_setting",
    f"WITH {_DP}, "
    + q.welch_sql(
        """SELECT CASE WHEN setting = 'Anchor' THEN CASE WHEN trust = 'Yes' THEN 1 ELSE 0 END END AS xa,
           CASE WHEN setting = 'No anchor' THEN CASE WHEN trust = 'Yes' THEN 1 ELSE 0 END END AS xb FROM dp"""
    )[5:],
    ["answers", "long"],
)
def _(spark, d):
    return inference.welch_t(_dp(spark, d), flag(F.col("trust") == "Yes"), "setting", "Anchor", "No anchor")


@query(
    "confidence_by_setting",
    f"""WITH {_DP} SELECT setting, confidence, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY setting), 3) AS prop
        FROM dp GROUP BY setting, confidence""",
    ["answers", "long"],
)
def _(spark, d):
    from twosight.operators.summary import share

    return share(_dp(spark, d), ["setting", "confidence"], ["setting"], 3)


_USE = (
    f"{_NAI}, real AS (SELECT id, avg(influence) AS mean_influence, avg(abs(qp_r - qp_h)) AS mean_initial_diff, avg(abs(qp_r - qp_hr)) AS mean_final_diff FROM nai GROUP BY id), "
    "usage AS (SELECT *, CASE WHEN trust = 'Yes' THEN 1 ELSE 0 END AS trusts FROM real JOIN (SELECT * FROM answers WHERE set_q = 3) s USING (id))"
)


def _use(spark, d):
    return impact.use_by_participant(_na(spark, d), _answers(spark, d).where("set_q = 3"))


@query(
    "perceived_use",
    f"""WITH {_USE} SELECT 'use_likelihood' AS variable, count(use_likelihood) AS n, round(avg(use_likelihood), 6) AS mean, round(median(use_likelihood), 6) AS median FROM usage
        UNION ALL SELECT 'use_binary', count(use_binary), round(avg(use_binary), 6), round(median(use_binary), 6) FROM usage""",
    ["answers", "na"],
)
def _(spark, d):
    return impact.stated_use_center(_use(spark, d))


@query(
    "spearman_use_influence",
    f"WITH {_USE}, " + q.spearman_sql("SELECT use_likelihood AS x, round(mean_influence, 9) AS y FROM usage")[5:],
    ["answers", "na"],
)
def _(spark, d):
    return ranks.spearman(_use(spark, d), "use_likelihood", F.round("mean_influence", 9))


@query(
    "trust_shares",
    f"WITH {_USE} SELECT trusts AS trust, count(*) AS n, round(count(*) / (SELECT count(*) FROM usage), 6) AS prop FROM usage GROUP BY trusts",
    ["answers", "na"],
)
def _(spark, d):
    from twosight.operators.summary import share

    return share(_use(spark, d), ["trust"])


@query(
    "use_by_trust",
    f"""WITH {_USE} SELECT trusts AS trust, round(avg(mean_influence), 6) AS mean_influence, round(avg(mean_initial_diff), 6) AS mean_initial_diff,
        round(avg(mean_final_diff), 6) AS mean_final_diff, count(*) AS n FROM usage GROUP BY trusts""",
    ["answers", "na"],
)
def _(spark, d):
    return impact.use_by_trust(_use(spark, d))


@query(
    "rank_sum_influence_by_trust",
    f"WITH {_USE}, " + q.rank_sum_sql("SELECT round(mean_influence, 9) AS x, 1 - trusts AS a FROM usage")[5:],
    ["answers", "na"],
)
def _(spark, d):
    return ranks.rank_sum(_use(spark, d), F.round("mean_influence", 9), "trust", 0, 1)


_CP = (
    "arm AS (SELECT DISTINCT id, setting, condition FROM long WHERE type = 'hr' AND condition <> 'None'), "
    "cp AS (SELECT * FROM answers JOIN arm USING (id) WHERE set_q <> 1)"
)


def _cp(spark, d):
    arm = preparation.arms(_c(spark, d), "setting", "condition")
    return _answers(spark, d, arm).where("set_q <> 1")


@query(
    "stated_use_by_condition",
    f"""WITH {_CP} SELECT set_q, condition, CASE WHEN count(use_binary) = count(*) THEN round(avg(use_binary), 6) END AS use_binary,
        CASE WHEN count(use_likelihood) = count(*) THEN round(avg(use_likelihood), 6) END AS use_likelihood,
        CASE WHEN count(humanaccuracy) = count(*) THEN round(avg(humanaccuracy), 6) END AS humanaccuracy,
        round(avg(CASE WHEN trust = 'Yes' THEN 1 ELSE 0 END), 6) AS trust, count(*) AS n FROM cp GROUP BY set_q, condition""",
    ["answers", "long"],
)
def _(spark, d):
    return impact.stated_use(_cp(spark, d), ["set_q", "condition"])


@query(
    "confidence_by_condition_wide",
    f"""WITH {_CP}, s AS (SELECT set_q, condition, confidence, round(count(*) / sum(count(*)) OVER (PARTITION BY set_q, condition), 6) AS p FROM cp GROUP BY 1, 2, 3)
        SELECT set_q, confidence, max(CASE WHEN condition = 'Controlled' THEN p END) AS "Controlled", max(CASE WHEN condition = 'Decreasing' THEN p END) AS "Decreasing"
        FROM s GROUP BY set_q, confidence""",
    ["answers", "long"],
)
def _(spark, d):
    return impact.confidence_by_condition(_cp(spark, d), ["Controlled", "Decreasing"])
