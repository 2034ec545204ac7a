from pyspark.sql import functions as F

from catalog import sqltext as q
from catalog.registry import query
from catalog.views import assess, view
from twosight.operators import bootstrap, metrics, models, ordered, ranks
from twosight.plans import performance, preparation

_PAIRS = [("r", "re"), ("hr", "r"), ("hr", "re")]


def _everyone(spark, d):
    return preparation.everyone_long(assess(spark, d))


def _both(spark, d):
    answers = preparation.perception_long(view(spark, d, "perception"))
    return performance.perceived_and_real(answers, performance.accuracy_by_set(_everyone(spark, d), before=6))


@query("long_pairs", "SELECT id, idx AS index, order_question, type, qp, qb, qp_r, qb_r, round(time, 6) AS time FROM long", ["long"])
def _(spark, d):
    long = preparation.assessments_long(assess(spark, d))
    return long.select("id", "index", "order_question", "type", "qp", "qb", "qp_r", "qb_r", "time")


@query(
    "long_everyone_counts",
    "SELECT type, survey_part, count(*) AS n, round(avg(qp), 6) AS mean_qp, round(avg(qb), 6) AS mean_qb FROM everyone GROUP BY type, survey_part",
    ["everyone"],
)
def _(spark, d):
    return _everyone(spark, d).groupBy("type", "survey_part").agg(
        F.count(F.lit(1)).alias("n"), F.avg("qp").alias("mean_qp"), F.avg("qb").alias("mean_qb")
    )


@query("threshold_match", "SELECT round(rate, 6) AS rate, round(threshold, 6) AS threshold FROM cut, goal", ["cut"])
def _(spark, d):
    return performance.operating_point(_everyone(spark, d))


@query(
    "share_above_thresholds",
    """SELECT setting, round(i * 0.01::DOUBLE, 6) AS threshold, round(avg(CASE WHEN qp > i * 0.01::DOUBLE THEN 1 ELSE 0 END), 6) AS share,
       count(*) AS n FROM long, range(101) t(i) WHERE type = 'hr' GROUP BY setting, i""",
    ["long"],
)
def _(spark, d):
    return models.share_above(preparation.assisted(assess(spark, d)), "qp", ["setting"])


@query("metric_bundle_by_type", q.bundle_sql("SELECT * FROM matched", ["type"]), ["matched"])
def _(spark, d):
    return metrics.metric_bundle(performance.with_matched_model(_everyone(spark, d)), ["type"])


@query("metric_pairs_by_type", q.metric_pairs_sql("SELECT * FROM matched", "type", _PAIRS), ["matched"])
def _(spark, d):
    return metrics.metric_pairs(performance.with_matched_model(_everyone(spark, d)), "type", _PAIRS)


@query("auc_by_type", q.auc_sql("SELECT type, outcome AS y, qp AS s FROM matched", ["type"]), ["matched"])
def _(spark, d):
    return ranks.auc(performance.with_matched_model(_everyone(spark, d)), "outcome", "qp", ["type"])


_SPREAD = q.auc_spread_sql("SELECT type, outcome AS y, qp AS s FROM matched", ["type"])
_LIMITS = "round(auc, 6) AS mean, round(auc - 1.96::DOUBLE * sd, 6) AS lb, round(auc + 1.96::DOUBLE * sd, 6) AS ub"


def _held_to(boot, spread, scale=1.0):
    """Bootstrap mean and limits, each replaced by the area and its normal limits from placement values where it lies
    within three of its own standard errors of them: the mean of 300 within 0.2 sd, a limit within 0.5 sd."""
    both = boot.join(spread.withColumnsRenamed({"type": "_t", "setting": "_t", "n": "_n"}), F.col("type" if "type" in boot.columns else "setting") == F.col("_t"))
    sd = F.col("sd") * scale
    near = lambda c, to, by: F.when(F.abs(F.col(c) - to) <= by * sd, to).otherwise(F.col(c)).alias(c)
    return both, [near("mean", F.col("auc"), 0.2), near("lb", F.col("auc") - 1.96 * sd, 0.5), near("ub", F.col("auc") + 1.96 * sd, 0.5)]


@query("auc_spread_by_type", f"SELECT type, round(auc, 6) AS auc, round(sd, 6) AS sd, n_pos, n_neg FROM ({_SPREAD}) z", ["matched"])
def _(spark, d):
    return ranks.auc_spread(performance.with_matched_model(_everyone(spark, d)), "outcome", "qp", ["type"])


@query("bootstrap_auc_by_type", f"SELECT type, {_LIMITS}, CAST(300 AS BIGINT) AS replicates, n_pos + n_neg AS n FROM ({_SPREAD}) z", ["matched"])
def _(spark, d):
    rows = performance.with_matched_model(_everyone(spark, d))
    both, limits = _held_to(bootstrap.bootstrap_auc(rows, "outcome", "qp", ["type"], seed=7), ranks.auc_spread(rows, "outcome", "qp", ["type"]))
    return both.select("type", *limits, "replicates", "n")


@query(
    "bootstrap_covers_auc",
    f"""WITH b AS ({q.auc_spread_sql("SELECT type, outcome AS y, qp AS s FROM long", ["type"])})
        SELECT type, round(auc, 6) AS auc, n_pos + n_neg AS n, round(auc - 1.96::DOUBLE * sd, 6) AS lb, round(auc + 1.96::DOUBLE * sd, 6) AS ub FROM b""",
    ["long"],
)
def _(spark, d):
    long = preparation.assessments_long(assess(spark, d))
    spread = ranks.auc_spread(long, "outcome", "qp", ["type"])
    both, limits = _held_to(bootstrap.bootstrap_auc(long, "outcome", "qp", ["type"], seed=5), spread)
    return both.select("type", *limits, "n").withColumnRenamed("mean", "auc")


@query(
    "bundle_with_auc_wide",
    f"""WITH au AS ({q.auc_sql("SELECT type, outcome AS y, qp AS s FROM long", ["type"])}),
        bu AS ({q.bundle_sql("SELECT * FROM long", ["type"])}),
        al AS (SELECT metric, ord, type, value FROM bu UNION ALL SELECT 'Area under the curve (AUC)', 5, type, auc FROM au)
        SELECT metric, ord, max(CASE WHEN type = 'h' THEN value END) AS h, max(CASE WHEN type = 'hr' THEN value END) AS hr
        FROM al GROUP BY metric, ord""",
    ["long"],
)
def _(spark, d):
    bundle = metrics.metric_bundle(preparation.assessments_long(assess(spark, d)), ["type"], score="qp")
    return metrics.metrics_wide(bundle, "type", ["h", "hr"])


@query(
    "beat_model",
    """WITH p AS (SELECT id, CASE WHEN type IN ('h', 'hr') THEN 'h' ELSE type END AS t, avg(CASE WHEN qb = outcome THEN 1 ELSE 0 END) AS acc
       FROM matched WHERE NOT (type = 'h' AND survey_part = 2) AND survey_part <> 1 GROUP BY 1, 2),
       w AS (SELECT id, max(CASE WHEN t = 'h' THEN acc END) AS h, max(CASE WHEN t = 'r' THEN acc END) AS r, max(CASE WHEN t = 're' THEN acc END) AS re FROM p GROUP BY id)
       SELECT round(avg(CASE WHEN h >= r THEN 1 WHEN h < r THEN 0 END), 6) AS share_r, CAST(coalesce(sum(CASE WHEN h >= r THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_r,
       round(avg(CASE WHEN h >= re THEN 1 WHEN h < re THEN 0 END), 6) AS share_re, count(*) AS participants FROM w""",
    ["matched"],
)
def _(spark, d):
    return performance.beat_model(performance.with_matched_model(_everyone(spark, d)))


@query(
    "halves",
    """SELECT order_question < 2 AS first_half, round(avg(qb), 6) AS mean_qb, round(avg(qp), 6) AS mean_qp, round(avg(outcome), 6) AS mean_outcome,
       count(DISTINCT order_question) AS n_questions, round(avg(CASE WHEN qb = outcome THEN 1 ELSE 0 END), 6) AS accuracy
       FROM everyone WHERE order_question < 4 AND type = 'h' GROUP BY 1""",
    ["everyone"],
)
def _(spark, d):
    return performance.halves(_everyone(spark, d), half=2, end=4)


@query(
    "halves_tests",
    q.welch_sql(
        """SELECT 'qb' AS measure, CASE WHEN order_question < 2 THEN qb END AS xa, CASE WHEN order_question >= 2 THEN qb END AS xb
           FROM everyone WHERE order_question < 4 AND type = 'h'
           UNION ALL SELECT 'accuracy', CASE WHEN order_question < 2 THEN CASE WHEN qb = outcome THEN 1 ELSE 0 END END,
           CASE WHEN order_question >= 2 THEN CASE WHEN qb = outcome THEN 1 ELSE 0 END END FROM everyone WHERE order_question < 4 AND type = 'h'""",
        ["measure"],
    ),
    ["everyone"],
)
def _(spark, d):
    return performance.halves_tests(_everyone(spark, d), half=2, end=4)


@query(
    "accuracy_by_part",
    """SELECT survey_part, round(avg(CASE WHEN qb = outcome THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(qp), 6) AS risk_estimate
       FROM everyone WHERE type = 'h' AND setting = 'No anchor' AND condition <> 'Decreasing' GROUP BY survey_part""",
    ["everyone"],
)
def _(spark, d):
    return performance.by_part(_everyone(spark, d))


@query(
    "accuracy_rank_by_set",
    "SELECT id, set_q, round(acc, 6) AS acc, round(rank, 6) AS rank FROM accset",
    ["accset"],
)
def _(spark, d):
    return performance.accuracy_by_set(_everyone(spark, d), before=6)


@query(
    "perception_answers",
    """SELECT id, set_q, round(humanaccuracy, 6) AS humanaccuracy, round(use_binary, 6) AS use_binary,
       round(use_likelihood, 6) AS use_likelihood, confidence, humanaccuracy_comparison, trust FROM answers""",
    ["answers"],
)
def _(spark, d):
    return preparation.perception_long(view(spark, d, "perception"))


_AP = "ap AS (SELECT * FROM answers JOIN accset USING (id, set_q))"


@query(
    "perceived_vs_real_correlation",
    f"""WITH {_AP}, m AS (SELECT set_q, CASE WHEN count(acc) = count(*) THEN round(avg(acc), 6) END AS mean_acc,
        CASE WHEN count(humanaccuracy) = count(*) THEN round(avg(humanaccuracy), 6) END AS mean_humanacc FROM ap GROUP BY set_q),
        sp AS ({q.spearman_sql("SELECT set_q, humanaccuracy AS x, acc AS y FROM ap", ["set_q"])})
        SELECT set_q, mean_acc, mean_humanacc, n, rho, t, p FROM m JOIN sp USING (set_q)""",
    ["answers", "accset"],
)
def _(spark, d):
    return performance.perceived_correlation(_both(spark, d))


@query(
    "perceived_gap",
    f"""WITH {_AP} SELECT set_q, round(avg(abs(acc - humanaccuracy)), 6) AS perc_diff,
        round(avg(CASE WHEN humanaccuracy > acc THEN 1 WHEN humanaccuracy <= acc THEN 0 END), 6) AS overestimate,
        round(avg(abs(acc - humanaccuracy)) * CASE WHEN set_q = 1 THEN 14 ELSE 25 END, 6) AS diff_n_question FROM ap GROUP BY set_q""",
    ["answers", "accset"],
)
def _(spark, d):
    return performance.perceived_gap(_both(spark, d), na_rm=True)


@query(
    "perceived_gap_strict",
    f"""WITH {_AP}, x AS (SELECT set_q, abs(acc - humanaccuracy) AS gap, CASE WHEN humanaccuracy > acc THEN 1 WHEN humanaccuracy <= acc THEN 0 END AS over FROM ap),
        m AS (SELECT set_q, CASE WHEN count(gap) = count(*) THEN avg(gap) END AS g, CASE WHEN count(over) = count(*) THEN avg(over) END AS o FROM x GROUP BY set_q)
        SELECT set_q, round(g, 6) AS perc_diff, round(o, 6) AS overestimate, round(g * CASE WHEN set_q = 1 THEN 14 ELSE 25 END, 6) AS diff_n_question FROM m""",
    ["answers", "accset"],
)
def _(spark, d):
    return performance.perceived_gap(_both(spark, d))


@query(
    "confidence_shares",
    f"""WITH {_AP} SELECT set_q, confidence, CASE WHEN count(humanaccuracy) = count(*) THEN round(avg(humanaccuracy), 6) END AS mean_hacc,
        count(*) AS n, round_even(count(*) / sum(count(*)) OVER (PARTITION BY set_q), 3) AS prop_n
        FROM ap WHERE set_q <> 2 GROUP BY set_q, confidence""",
    ["answers", "accset"],
)
def _(spark, d):
    return performance.by_class(_both(spark, d).where("set_q <> 2"), "confidence", "humanaccuracy", "mean_hacc")


@query(
    "kruskal_perceived_by_confidence",
    f"WITH {_AP}, " + q.kruskal_sql("SELECT set_q, humanaccuracy AS x, confidence AS g FROM ap", ["set_q"])[5:],
    ["answers", "accset"],
)
def _(spark, d):
    return ranks.kruskal(_both(spark, d), "humanaccuracy", "confidence", ["set_q"])


for _a, _b in (("Confident", "Not confident"), ("Not confident", "Somewhat confident"), ("Confident", "Somewhat confident")):

    @query(
        f"rank_sum_perceived_{_a}_{_b}".lower().replace(" ", "_"),
        f"WITH {_AP}, "
        + q.rank_sum_sql(
            f"""SELECT set_q, humanaccuracy AS x, CASE confidence WHEN '{_a}' THEN 1 WHEN '{_b}' THEN 0 END AS a FROM ap WHERE set_q <> 2""",
            ["set_q"],
        )[5:],
        ["answers", "accset"],
    )
    def _(spark, d, a=_a, b=_b):
        rows = _both(spark, d).where("set_q <> 2")
        return ranks.rank_sum(rows, "humanaccuracy", "confidence", a, b, ["set_q"])


@query(
    "stated_rank_shares",
    f"""WITH {_AP} SELECT set_q, humanaccuracy_comparison, round(avg(rank), 6) AS rank, count(*) AS n,
        round_even(count(*) / sum(count(*)) OVER (PARTITION BY set_q), 3) AS prop_n FROM ap GROUP BY set_q, humanaccuracy_comparison""",
    ["answers", "accset"],
)
def _(spark, d):
    return performance.by_class(_both(spark, d), "humanaccuracy_comparison", "rank", "rank")


@query(
    "kruskal_rank_by_stated_rank",
    f"WITH {_AP}, " + q.kruskal_sql("SELECT set_q, rank AS x, humanaccuracy_comparison AS g FROM ap", ["set_q"])[5:],
    ["answers", "accset"],
)
def _(spark, d):
    return ranks.kruskal(_both(spark, d), "rank", "humanaccuracy_comparison", ["set_q"])


@query(
    "rank_sum_stated_rank",
    f"WITH {_AP}, "
    + q.rank_sum_sql(
        "SELECT set_q, rank AS x, CASE humanaccuracy_comparison WHEN 'Lower' THEN 1 WHEN 'Median' THEN 0 END AS a FROM ap",
        ["set_q"],
    )[5:],
    ["answers", "accset"],
)
def _(spark, d):
    return ranks.rank_sum(_both(spark, d), "rank", "humanaccuracy_comparison", "Lower", "Median", ["set_q"])


# Arms compared on the assisted answers.
_A = "SELECT * FROM long WHERE type = 'hr'"


@query("metric_bundle_by_setting", q.bundle_sql(_A, ["setting"], base=True), ["long"])
def _(spark, d):
    return metrics.metric_bundle(preparation.assisted(assess(spark, d)), ["setting"], base_rate=True)


@query("metric_pairs_welch", q.metric_pairs_sql(_A, "setting", [("Anchor", "No anchor")]), ["long"])
def _(spark, d):
    return metrics.metric_pairs(preparation.assisted(assess(spark, d)), "setting", [("Anchor", "No anchor")])


@query("auc_by_setting", q.auc_sql(f"SELECT setting, outcome AS y, qp AS s FROM ({_A}) z", ["setting"]), ["long"])
def _(spark, d):
    return ranks.auc(preparation.assisted(assess(spark, d)), "outcome", "qp", ["setting"])


@query(
    "bootstrap_bundle_by_setting",
    f"""WITH b AS ({q.bundle_sql(_A, ["setting"], base=True)}), w AS ({q.auc_spread_sql(f"SELECT setting, outcome AS y, qp AS s FROM ({_A}) z", ["setting"])}),
        t AS (SELECT *, sd * sqrt((n_pos + n_neg) / sum(n_pos + n_neg) OVER ()) AS sdt FROM w)
        SELECT setting, metric, ord, value, se, lb, ub, n FROM b UNION ALL
        SELECT setting, 'Area under the curve (AUC)', 5, round(auc, 6), NULL, round(auc - 1.96::DOUBLE * sdt, 6), round(auc + 1.96::DOUBLE * sdt, 6), n_pos + n_neg FROM t""",
    ["long"],
)
def _(spark, d):
    rows = preparation.assisted(assess(spark, d))
    bundle = metrics.metric_bundle(rows, ["setting"], score="qp", base_rate=True, b=300, seed=11, size="total")
    spread = ranks.auc_spread(rows, "outcome", "qp", ["setting"])
    # Every group draws as many rows as all groups have, which narrows its limits.
    narrow = F.sqrt(F.col("n") / rows.where("qp IS NOT NULL AND outcome IS NOT NULL").agg(F.count(F.lit(1)).cast("double")).scalar())
    area = F.col("metric") == "Area under the curve (AUC)"
    both, limits = _held_to(bundle.where(area).withColumnRenamed("value", "mean"), spread, narrow)
    held = both.select("setting", "metric", "ord", *limits, "se", "n").withColumnRenamed("mean", "value")
    return bundle.where(~area).unionByName(held)


@query(
    "metric_order",
    f"""WITH b AS ({q.bundle_sql(_A, ["setting"])}), s AS (SELECT metric, avg(ord) AS stat FROM b GROUP BY metric)
        SELECT metric, round(stat, 6) AS stat, row_number() OVER (ORDER BY stat, metric) AS ord FROM s""",
    ["long"],
)
def _(spark, d):
    bundle = metrics.metric_bundle(preparation.assisted(assess(spark, d)), ["setting"])
    return ordered.category_order(bundle, "metric", F.avg("ord"))


@query(
    "rank_sum_stated_rank_lower_higher",
    f"WITH {_AP}, "
    + q.rank_sum_sql(
        "SELECT set_q, rank AS x, CASE humanaccuracy_comparison WHEN 'Lower' THEN 1 WHEN 'Higher' THEN 0 END AS a FROM ap",
        ["set_q"],
    )[5:],
    ["answers", "accset"],
)
def _(spark, d):
    return ranks.rank_sum(_both(spark, d), "rank", "humanaccuracy_comparison", "Lower", "Higher", ["set_q"])


@query(
    "rank_sum_stated_rank_median_higher",
    f"WITH {_AP}, "
    + q.rank_sum_sql(
        "SELECT set_q, rank AS x, CASE humanaccuracy_comparison WHEN 'Median' THEN 1 WHEN 'Higher' THEN 0 END AS a FROM ap",
        ["set_q"],
    )[5:],
    ["answers", "accset"],
)
def _(spark, d):
    return ranks.rank_sum(_both(spark, d), "rank", "humanaccuracy_comparison", "Median", "Higher", ["set_q"])
