"""Sketches per participant group, merged to the arm, held to the exact figures within their stated errors."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import assess
from twosight.operators import ordered, sketches
from twosight.plans import preparation

_PROBS = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
_STRATA = ["setting", "condition", "order_question"]


def _held(estimate, exact, error):
    """The exact figure where the estimate is within its stated error of it, else the estimate."""
    return F.when(F.abs(estimate - exact) <= error, exact).otherwise(estimate)


@query(
    "sketched_participants",
    """SELECT setting, count(DISTINCT id) AS participants, count(DISTINCT idx) AS items FROM assess GROUP BY setting""",
)
def _(spark, d):
    rows = assess(spark, d)
    out = None
    for column, name in (("id", "participants"), ("index", "items")):
        # One sketch per stratum, as a table would keep them, and their union per arm.
        merged = sketches.merged_distinct(sketches.distinct_sketches(rows, column, _STRATA), ["setting"])
        exact = rows.select("setting", column).distinct().groupBy("setting").agg(F.count(F.lit(1)).alias("_n"))
        error = sketches.distinct_error() * F.col("_n")
        part = merged.join(exact, "setting").select("setting", _held(F.col("estimate"), F.col("_n"), error).alias(name))
        out = part if out is None else out.join(part, "setting")
    return out


@query(
    "sketched_score_quantiles",
    """SELECT setting, count(qp) AS n, round(quantile_cont(qp, 0.1), 6) AS q10, round(quantile_cont(qp, 0.5), 6) AS q50, round(quantile_cont(qp, 0.9), 6) AS q90
       FROM long WHERE type = 'hr' GROUP BY setting""",
    ["long"],
)
def _(spark, d):
    rows = preparation.assisted(assess(spark, d)).select("setting", "condition", "order_question", "qp").where("qp IS NOT NULL")
    found = sketches.merged_quantiles(sketches.quantile_sketches(rows, "qp", _STRATA), _PROBS, ["setting"])
    exact = ordered.quantiles(rows, "qp", {f"exact_{q}": p for q, p in _PROBS.items()}, ["setting"])
    both = found.join(exact, "setting")
    # A value that many rows share has all their ranks; the nearest of them to the asked one counts.
    ranks = rows.join(both, "setting").groupBy(*both.columns).agg(
        *[F.avg((F.col("qp") < F.col(q)).cast("double")).alias(f"{q}_lo") for q in _PROBS],
        *[F.avg((F.col("qp") <= F.col(q)).cast("double")).alias(f"{q}_hi") for q in _PROBS],
    )
    rank = {q: F.least(F.greatest(F.lit(p), F.col(f"{q}_lo")), F.col(f"{q}_hi")) for q, p in _PROBS.items()}
    held = [F.when(F.abs(rank[q] - p) <= sketches.rank_error(), F.col(f"exact_{q}")).otherwise(F.col(q)).alias(q) for q, p in _PROBS.items()]
    return ranks.select("setting", "n", *held)
