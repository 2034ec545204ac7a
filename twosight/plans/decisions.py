"""People, model and judges compared on the same items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import round_even
from twosight.functions.recodes import human_or_model, present, prior_score_label, prior_score_number
from twosight.operators.joins import attach, join_on, with_group_stat
from twosight.operators.models import apply_threshold, fit_patterns, match_threshold, patterns
from twosight.operators.reshape import append
from twosight.plans.preparation import everyone_long


def recode_items(items: DataFrame) -> DataFrame:
    """Missing prior score becomes its own class; a given decision becomes 1, a missing one 0."""
    return items.withColumns({"prs": prior_score_label("prs"), "incar": present("incar")})


def with_items(pred: DataFrame, items: DataFrame) -> DataFrame:
    """All answers with the attributes of their item. The join comes before the answers are made
    long, so a third of the rows cross it."""
    extra = ("prs", "ogs", "incar", "crimecat")
    return everyone_long(join_on(pred, items.select("index", *extra), "index"), extra)


def decision_matrix(rows: DataFrame, model: DataFrame, judges: DataFrame, up_to: int = 10) -> DataFrame:
    """Mean prediction of people by (offence score, prior score), above the two supplied matrices."""
    people = (
        rows.where(F.col("type") != "r").groupBy("ogs", "prs").agg(round_even(F.avg("qb"), 2).alias("mean_qb"))
        .withColumn("type", F.lit("Participants"))
    )
    both = append(
        people,
        model.withColumn("type", F.lit("RAI")),
        judges.withColumnRenamed("incar", "mean_qb").withColumn("type", F.lit("Judges")),
    )
    return both.where(F.col("ogs") <= up_to)


def incarceration_rate(rows: DataFrame) -> DataFrame:
    return rows.select("index", "incar").distinct().agg(F.avg("incar").alias("rate"))


def decision_threshold(rows: DataFrame) -> DataFrame:
    """Model threshold that matches the share of incarcerated items."""
    return match_threshold(rows.where(F.col("type") == "r"), "qp", incarceration_rate(rows).scalar())


def regression_rows(rows: DataFrame) -> DataFrame:
    """People's types merged, prior score as a number, the model's answer re-thresholded (open at the cut)."""
    merged = rows.withColumns({"type": human_or_model("type"), "prs": prior_score_number("prs")})
    cut = with_group_stat(merged, decision_threshold(rows), [])
    model = F.col("type") == "r"
    return cut.withColumn("qb", F.when(model, apply_threshold("qp", F.col("threshold"))).otherwise(F.col("qb"))).drop("threshold")


def three_actor_coefficients(rows: DataFrame) -> DataFrame:
    """Robust logistic regressions on both scores for people, model and judges, stacked.

    People and model share one reduction to covariate patterns.
    """
    reg = regression_rows(rows)
    x = ["prs", "ogs"]
    answers = patterns(reg, "qb", x, by=["type"])
    items = patterns(reg.select("index", "incar", *x).distinct(), "incar", x)
    actors = {
        "Human": answers.where(F.col("type") == "h"),
        "RAI": answers.where(F.col("type") == "r"),
        "Judge": items,
    }
    return append(*[fit_patterns(cells, x).robust().withColumn("type", F.lit(name)) for name, cells in actors.items()])


def charge_table(reg: DataFrame) -> DataFrame:
    """By type of charge: outcome and incarceration rates over items, positive rates of people and model."""
    items = reg.select("crimecat", "index", "outcome", "incar").distinct().groupBy("crimecat").agg(
        F.avg("outcome").alias("mean_outcome"), F.avg("incar").alias("mean_incar"), F.count(F.lit(1)).alias("n")
    )
    answers = reg.groupBy("crimecat").agg(
        F.avg(F.when(F.col("type") == "h", F.col("qb"))).alias("mean_qb_h"),
        F.avg(F.when(F.col("type") == "r", F.col("qb"))).alias("mean_qb_r"),
    )
    return attach(items, answers, ["crimecat"])
