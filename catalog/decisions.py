from pyspark.sql import functions as F

from catalog import sqltext as q
from catalog.registry import query
from catalog.views import assess, view
from twosight.operators.models import robust_logit
from twosight.plans import decisions

_IT = (
    "it AS (SELECT idx, coalesce(prs, 'RFEL') AS prs, ogs, CASE WHEN incar IS NULL THEN 0 ELSE 1 END AS incar, crimecat FROM items), "
    "ev AS (SELECT e.type, e.qp, e.qb, e.outcome, it.* FROM everyone e JOIN it USING (idx))"
)
_REG = (
    f"{_IT}, rate AS (SELECT avg(incar) AS r FROM (SELECT DISTINCT idx, incar FROM ev) k), "
    "dcut AS (SELECT max(i * 0.01::DOUBLE) AS threshold FROM range(101) t(i), rate "
    "WHERE (SELECT avg(CASE WHEN qp > i * 0.01::DOUBLE THEN 1 ELSE 0 END) FROM ev WHERE type = 'r') >= r), "
    "reg AS (SELECT CASE WHEN type IN ('h', 'hr') THEN 'h' ELSE type END AS type, qp, CASE WHEN type = 'r' THEN CASE WHEN qp > threshold THEN 1 ELSE 0 END ELSE qb END AS qb, "
    "outcome, idx, CASE WHEN prs = 'RFEL' THEN 6.0::DOUBLE ELSE CAST(prs AS DOUBLE) END AS prs, ogs, incar, crimecat FROM ev, dcut)"
)


def _rows(spark, d):
    items = decisions.recode_items(view(spark, d, "items"))
    return decisions.with_items(assess(spark, d), items)


def _matrices(spark, d):
    items = decisions.recode_items(view(spark, d, "items")).groupBy("ogs", "prs")
    return items.agg(F.avg("y").alias("mean_qb")), items.agg(F.avg("incar").alias("incar"))


@query(
    "decision_matrix",
    f"""WITH {_IT}, m AS (SELECT ogs, prs, round_even(avg(qb), 2) AS mean_qb, 'Participants' AS type FROM ev WHERE type <> 'r' GROUP BY ogs, prs
        UNION ALL SELECT ogs, coalesce(prs, 'RFEL'), avg(y), 'RAI' FROM items GROUP BY 1, 2
        UNION ALL SELECT ogs, coalesce(prs, 'RFEL'), avg(CASE WHEN incar IS NULL THEN 0 ELSE 1 END), 'Judges' FROM items GROUP BY 1, 2)
        SELECT ogs, prs, round(mean_qb, 6) AS mean_qb, type FROM m WHERE ogs <= 10""",
    ["everyone", "items"],
)
def _(spark, d):
    model, judges = _matrices(spark, d)
    return decisions.decision_matrix(_rows(spark, d), model, judges)


@query("decision_threshold", f"WITH {_REG} SELECT round(threshold, 6) AS threshold FROM dcut", ["everyone", "items"])
def _(spark, d):
    return decisions.decision_threshold(_rows(spark, d))


@query(
    "charge_table",
    f"""WITH {_REG}, i AS (SELECT crimecat, avg(outcome) AS mo, avg(incar) AS mi, count(*) AS n FROM (SELECT DISTINCT crimecat, idx, outcome, incar FROM reg) k GROUP BY crimecat),
        a AS (SELECT crimecat, avg(CASE WHEN type = 'h' THEN qb END) AS qh, avg(CASE WHEN type = 'r' THEN qb END) AS qr FROM reg GROUP BY crimecat)
        SELECT crimecat, round(mo, 6) AS mean_outcome, round(mi, 6) AS mean_incar, n, round(qh, 6) AS mean_qb_h, round(qr, 6) AS mean_qb_r FROM i JOIN a USING (crimecat)""",
    ["everyone", "items"],
)
def _(spark, d):
    return decisions.charge_table(decisions.regression_rows(_rows(spark, d)))


_TERM = "CASE i WHEN 0 THEN '(Intercept)' WHEN 1 THEN 'prs' ELSE 'ogs' END AS term, round(estimate, 6) AS estimate, round(hc0, 6) AS std_error, round(estimate / hc0, 6) AS statistic, " + q.p_normal("estimate / hc0") + " AS p"


def _actor(kind: str) -> str:
    return f"SELECT prs AS x1, ogs AS x2, sum(qb) AS n1, count(*) AS n FROM reg WHERE type = '{kind}' GROUP BY prs, ogs"


_JUDGE = "SELECT prs AS x1, ogs AS x2, sum(incar) AS n1, count(*) AS n FROM (SELECT DISTINCT idx, incar, prs, ogs FROM reg) k GROUP BY prs, ogs"


@query(
    "logit_robust",
    f"WITH RECURSIVE {_REG}, {q.logit_ctes('lh', _actor('h'))} SELECT {_TERM} FROM lh_f",
    ["everyone", "items"],
)
def _(spark, d):
    reg = decisions.regression_rows(_rows(spark, d))
    return robust_logit(reg.where("type = 'h'"), "qb", ["prs", "ogs"])


@query(
    "three_actor_coefs",
    f"""WITH RECURSIVE {_REG}, {q.logit_ctes('lh', _actor('h'))}, {q.logit_ctes('lr', _actor('r'))}, {q.logit_ctes('lj', _JUDGE)}
        SELECT {_TERM}, 'Human' AS type FROM lh_f UNION ALL SELECT {_TERM}, 'RAI' FROM lr_f UNION ALL SELECT {_TERM}, 'Judge' FROM lj_f""",
    ["everyone", "items"],
)
def _(spark, d):
    return decisions.three_actor_coefficients(_rows(spark, d))
