"""Participants, time, pay and demographics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import flag, is_in, round_even, strict
from twosight.functions.recodes import age_band, has_degree, region
from twosight.operators.reshape import longer
from twosight.operators.summary import describe, describe_many, mean_of_ratios, ratio_of_means, share, share_of_distinct

# --- fixed values: pay rule that results must match ---
BASE_PAY = 1.5
SECONDS_PER_HOUR = 3600
# --- end of fixed values ---


def sizes(pred: DataFrame) -> DataFrame:
    """Participants, items, and given score and binary answers.

    Each distinct count reduces its own key in two levels; the answers are summed on the way of the first. A missing
    key counts as one."""
    given = {"score_answers": F.count("qp_hr") + F.count("qp_h"), "binary_answers": F.count("qb_hr") + F.count("qb_h")}
    people = pred.groupBy("id").agg(*[c.alias(name) for name, c in given.items()])
    items = pred.groupBy("index").agg(F.count(F.lit(1))).agg(F.count(F.lit(1))).scalar()
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in given]
    return people.agg(F.count(F.lit(1)).alias("participants"), *sums).select("participants", items.alias("items"), *given)


def hourly_pay(bonus: Column | str, seconds: Column | str) -> Column:
    b, s = (F.col(c) if isinstance(c, str) else c for c in (bonus, seconds))
    return F.try_divide((b + BASE_PAY) * SECONDS_PER_HOUR, s)


def time_and_pay(times: DataFrame) -> DataFrame:
    """Mean, sd and median of survey minutes, bonus and hourly pay."""
    return describe_many(
        times,
        {"minutes": F.col("survey_time") / 60, "bonus": "bonus", "salary": hourly_pay("bonus", "survey_time")},
        na_rm=False,
    )


def answer_times(pred: DataFrame, ids: list[str]) -> DataFrame:
    """One row per timed answer."""
    return longer(pred, ids, ["time_hr", "time_h"], "time", "value").where(F.col("value").isNotNull())


def time_per_answer(pred: DataFrame) -> DataFrame:
    return describe(answer_times(pred, ["id"]), "value")


def total_time(pred: DataFrame, by: str = "setting", unit: float = 60.0) -> DataFrame:
    """Total time per participant, then mean, sd and median over participants, in minutes."""
    per_person = answer_times(pred, [by, "id"]).groupBy(by, "id").agg((F.sum("value") / unit).alias("total"))
    return describe(per_person, "total", [by])


def age_summary(people: DataFrame) -> DataFrame:
    return describe(people, "age", na_rm=False)


def age_table(people: DataFrame) -> DataFrame:
    return share(people.select(age_band("age").alias("age_band")), ["age_band"], digits=2)


def category_table(people: DataFrame, column: str, min_age: int | None = None) -> DataFrame:
    rows = people if min_age is None else people.where(F.col("age") >= min_age)
    return share(rows, [column], digits=2)


def degree_share(people: DataFrame, min_age: int = 25) -> DataFrame:
    return (
        people.where(F.col("age") >= min_age).select(has_degree("education").alias("d"))
        .agg(F.avg("d").alias("mean"), F.sum("d").alias("n"), F.count(F.lit(1)).alias("total"))
    )


def region_counts(people: DataFrame, regions: dict[str, list[str]] | None = None) -> DataFrame:
    """Participants per region; every location outside the listed regions counts as other."""
    return people.groupBy(region("location", regions).alias("region")).agg(F.count(F.lit(1)).alias("n"))


def other_locations(people: DataFrame, listed: list[str]) -> DataFrame:
    """Distinct locations outside the listed ones."""
    return people.select("location").distinct().where(~is_in("location", listed))


def participants_per_arm(pred: DataFrame, by: list[str], within: list[str] | None = None, digits: int | None = 3) -> DataFrame:
    return share_of_distinct(pred, ["id"], by, within or [], digits)


def base_rate(items: DataFrame, digits: int = 3) -> DataFrame:
    return items.agg(round_even(strict(F.avg("y"), "y"), digits).alias("base_rate"))


def prediction_summary(pred: DataFrame, cut: float = 0.5) -> DataFrame:
    """Mean and median of scores and mean of binary answers, for people and model, from one pass."""
    sources = [
        ("human score", F.col("qp_hr")),
        ("human score", F.col("qp_h")),
        ("model score", F.col("qp_r")),
        ("human binary", F.col("qb_hr")),
        ("human binary", F.col("qb_h")),
        ("model binary", flag(F.col("qp_r") > cut)),
    ]
    pairs = [F.struct(F.lit(name).alias("source"), c.cast("double").alias("value")) for name, c in sources]
    long = pred.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    score = F.col("source").endswith("score")
    return describe(long, "value", ["source"]).select("source", "mean", F.when(score, F.col("median")).alias("median"))


def session_times(times: DataFrame) -> DataFrame:
    """Minutes in the survey and in the whole task, the mean of ratios and the ratio of means."""
    survey, task = F.col("survey_time") / 60, F.col("mturk_time") / 60
    both = F.when(task.isNotNull(), survey)
    stats = times.agg(
        strict(F.avg(survey), "survey_time").alias("mean_survey"),
        F.avg(task).alias("mean_task"),
        F.stddev_samp(survey).alias("sd_survey"),
        F.stddev_samp(task).alias("sd_task"),
        mean_of_ratios(task, survey).alias("ratio_per_participant"),
        ratio_of_means(F.when(task.isNotNull(), task), both).alias("ratio_all"),
    )
    medians = describe_many(times, {"survey": survey, "task": task}).select("variable", "median")
    wide = medians.agg(
        F.max(F.when(F.col("variable") == "survey", F.col("median"))).alias("median_survey"),
        F.max(F.when(F.col("variable") == "task", F.col("median"))).alias("median_task"),
    )
    one = wide.select(F.struct("*")).scalar()
    return stats.withColumn("_m", one).select(*stats.columns, "_m.median_survey", "_m.median_task")


def gap_within(times: DataFrame, minutes: tuple[int, ...] = (5, 10, 20), digits: int = 3) -> DataFrame:
    """For each limit: participants whose task took less than that many minutes beyond the survey.

    All limits come from one pass: each row is counted once per limit before the shuffle.
    """
    gap = F.abs(F.col("mturk_time") / 60 - F.col("survey_time") / 60)
    limits = F.array(*[F.struct(F.lit(m).alias("minutes"), (gap < m).alias("within")) for m in minutes])
    rows = times.where(F.col("mturk_time").isNotNull()).select(F.inline(limits))
    return share(rows, ["minutes", "within"], ["minutes"], digits)


def both_times_frame(times: DataFrame, limits: tuple[float, float] = (0.0, 90.0)) -> DataFrame:
    """Survey and task minutes of the participants inside the axis limits."""
    frame = times.select(
        "id", (F.col("survey_time") / 60).alias("survey"), (F.col("mturk_time") / 60).alias("task")
    )
    return frame.where(F.col("survey").between(*limits) & F.col("task").between(*limits))
