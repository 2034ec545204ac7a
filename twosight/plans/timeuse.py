"""Time spent on assessments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twosight.functions.nulls import char_length, flag, std_error
from twosight.operators.joins import attach, join_on
from twosight.operators.layers import box_stats
from twosight.operators.ordered import cumulative_share, ordered_position, quantiles, sample_groups
from twosight.operators.ranks import rank_sum
from twosight.operators.summary import describe, keep_groups


def not_second_look() -> Column:
    """Everything but part 2 of the arm that answers twice."""
    return ~((F.col("survey_part") == 2) & (F.col("setting") == "No anchor"))


def item_times(long: DataFrame) -> DataFrame:
    """Seconds per item over three subsets, from one pass."""
    again = (F.col("survey_part") == 2) & (F.col("setting") == "No anchor") & (F.col("type") == "hr")
    labels = F.filter(
        F.array(F.lit("all"), F.when(not_second_look(), F.lit("single look")), F.when(again, F.lit("second look"))),
        lambda s: s.isNotNull(),
    )
    rows = long.select("time", F.explode(labels).alias("subset"))
    return describe(rows, "time", ["subset"])


def by_time_within_participant(
    long: DataFrame, ties: Sequence[str], keep: Sequence[str] = ("survey_part",)
) -> DataFrame:
    """Answers of each participant from the slowest on: place ``n`` and running share of time ``time_cum``."""
    rows = long.select("id", "time", *[c for c in (*keep, *ties) if c not in ("id", "time")])
    return cumulative_share(rows, "time", [F.col("time").desc_nulls_last(), *ties], ["id"], "time_cum")


def top_share(ordered: DataFrame, tops: Sequence[int] = (1, 4)) -> DataFrame:
    """Running share of time over the answers in the first 1 and first 4 places."""
    first = ordered.where(F.col("n") <= max(tops))
    labels = F.filter(F.array(*[F.when(F.col("n") <= k, F.lit(k)) for k in tops]), lambda k: k.isNotNull())
    rows = first.select("time_cum", F.explode(labels).alias("top"))
    return describe(rows, "time_cum", ["top"]).select("top", F.col("mean").alias("value"), "sd", "median", "n")


def without_top(ordered: DataFrame, top: int = 4) -> DataFrame:
    """Mean time of the answers after the first ``top`` places."""
    t = F.col("time")
    return ordered.where(F.col("n") > top).agg(
        F.avg(t).alias("value"), F.stddev_samp(t).alias("sd"), std_error(t).alias("se"), F.count(F.lit(1)).alias("n")
    )


def decrease_by_participant(ordered: DataFrame, top: int = 4) -> DataFrame:
    """Mean time of each participant over all answers and without the slowest, and their quotient."""
    each = ordered.groupBy("id").agg(
        F.avg("time").alias("mean_time"), F.avg(F.when(F.col("n") > top, F.col("time"))).alias("mean_time_sub")
    )
    rest = each.where(F.col("mean_time_sub").isNotNull())
    return rest.withColumn("decrease", F.try_divide("mean_time", "mean_time_sub"))


def slowest(long: DataFrame, ties: Sequence[str], k: int = 4) -> DataFrame:
    """The ``k`` slowest answers of each participant: place ``n`` and share of all their time so far, ``time_cum``.

    Only ``k`` rows of a participant leave a task, and the totals are sums; nothing sorts all answers.
    """
    rows = long.select("id", "time", *[c for c in ties if c not in ("id", "time")])
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("time").desc_nulls_last(), *ties))
    top = rows.withColumn("n", place).where(F.col("n") <= k).select("id", "n", "time")
    upto = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("id").agg(F.sum("time").alias("_total"))
    run = attach(top.withColumn("_run", F.sum("time").over(upto)), totals, ["id"])
    return run.select("id", "n", "time", F.try_divide("_run", "_total").alias("time_cum"))


def _known(name: str, t: Column) -> list[Column]:
    return [F.count(t).alias(f"{name}_n"), F.sum(t).alias(f"{name}_s")]


def without_slowest(long: DataFrame, ties: Sequence[str], k: int = 4) -> DataFrame:
    """Mean time of the answers after the ``k`` slowest of each participant: totals less those of the slowest."""
    centre = long.agg(F.avg("time")).scalar()
    t = F.col("time") - F.col("_c")
    sums = lambda df: df.withColumn("_c", centre).agg(F.count(F.lit(1)).alias("r"), F.count(t).alias("k"), F.sum(t).alias("s"), F.sum(t * t).alias("q"), F.max("_c").alias("c"))
    every, top = sums(long.select("time")), sums(slowest(long, ties, k).select("time"))
    both = every.select("*", *[top.select(c).scalar().alias(f"top_{c}") for c in ("r", "k", "s", "q")])
    n, s, q = (F.col(c) - F.coalesce(f"top_{c}", F.lit(0)) for c in ("k", "s", "q"))
    sd = F.sqrt(F.try_divide(F.greatest(q - F.try_divide(s * s, n), F.lit(0.0)), n - 1))
    count = F.col("r") - F.col("top_r")
    return both.select(
        (F.col("c") + F.try_divide(s, n)).alias("value"), sd.alias("sd"), F.try_divide(sd, F.sqrt(count.cast("double"))).alias("se"), count.alias("n")
    )


def decrease_without_slowest(long: DataFrame, ties: Sequence[str], k: int = 4) -> DataFrame:
    """Mean time of each participant over all answers and without the ``k`` slowest, and their quotient."""
    t = F.col("time")
    every = long.groupBy("id").agg(*_known("all", t))
    top = slowest(long, ties, k).groupBy("id").agg(*_known("top", t))
    both = attach(every, top, ["id"])
    rest = F.try_divide(F.col("all_s") - F.coalesce("top_s", F.lit(0.0)), F.col("all_n") - F.col("top_n"))
    each = both.select("id", F.try_divide("all_s", "all_n").alias("mean_time"), rest.alias("mean_time_sub"))
    return each.where(F.col("mean_time_sub").isNotNull()).withColumn("decrease", F.try_divide("mean_time", "mean_time_sub"))


def mean_decrease(each: DataFrame) -> DataFrame:
    q = F.try_divide(F.col("mean_time_sub"), F.col("mean_time"))
    return each.agg((1 - F.avg(q)).alias("mean_time_decrease"), F.stddev_samp(q).alias("sd"), F.count(F.lit(1)).alias("n"))


def first_item(rows: DataFrame, order: int) -> DataFrame:
    """Time on one question of the order against all others."""
    flagged = rows.withColumn("first_item", F.col("order_question") == order)
    return describe(flagged, "time", ["first_item"], na_rm=False).select(
        "first_item", F.col("mean").alias("mean_time"), F.col("median").alias("median_time"), F.col("se").alias("se_time")
    )


def first_item_test(rows: DataFrame, order: int) -> DataFrame:
    return rank_sum(rows, "time", flag(F.col("order_question") == order), 0, 1)


def time_by_part(rows: DataFrame) -> DataFrame:
    """Share of each participant's time by part, then mean, median and sd over participants."""
    parts = rows.groupBy("id", "survey_part").agg(F.sum("time").alias("_t"))
    total = F.sum("_t").over(Window.partitionBy("id"))  # as many rows as parts
    shares = parts.withColumn("time_part", F.try_divide(F.col("_t"), total))
    return describe(shares, "time_part", ["survey_part"]).select(
        "survey_part", F.col("mean").alias("mean_time_part"), F.col("median").alias("median_time_part"), "sd"
    )


def accuracy_and_time(rows: DataFrame) -> DataFrame:
    """Accuracy and total minutes of each participant."""
    return rows.groupBy("id").agg(
        F.avg(flag(F.col("qb") == F.col("outcome"))).alias("acc"), (F.sum("time") / 60).alias("total_time")
    )


def time_by_correct(rows: DataFrame) -> DataFrame:
    correct = rows.withColumn("correct", F.col("qb") == F.col("outcome"))
    return describe(correct, "time", ["correct"], na_rm=False).select(
        "correct", F.col("mean").alias("mean_time"), F.col("median").alias("median_time"), "n"
    )


def rank_by_correct(rows: DataFrame, ties: Sequence[str]) -> DataFrame:
    """Place of an item in the participant's ascending times, by whether the answer was right."""
    chosen = rows.select("id", "time", flag(F.col("qb") == F.col("outcome")).alias("correct"), *[t for t in ties if t not in ("id", "time")])
    placed = ordered_position(chosen, [F.col("time").asc_nulls_last(), *ties], ["id"], "rank")
    return describe(placed, "rank", ["correct"]).select(
        "correct", F.col("mean").alias("mean_rank"), F.col("median").alias("median_rank"), "n"
    )


def with_text_length(long: DataFrame, descriptions: DataFrame, width: int = 50) -> DataFrame:
    """Answers with the length of the item's description and its bin.

    Only the length of a text crosses the join, never the text.
    """
    lengths = descriptions.select("index", char_length("description").alias("n_char"))
    return join_on(long, lengths, "index").withColumn("n_char_bin", F.floor(F.col("n_char") / width))


def time_by_length(rows: DataFrame, more_than: int = 200) -> DataFrame:
    """Answer times of the length bins with more than ``more_than`` answers."""
    return describe(rows, "time", ["n_char_bin"]).where(F.col("n_rows") > more_than).select(
        "n_char_bin", F.col("n_rows").alias("n"), "mean", "median"
    )


def rows_of_large_bins(rows: DataFrame, more_than: int = 200) -> DataFrame:
    return keep_groups(rows, ["n_char_bin"], F.count(F.lit(1)) > more_than)


def participant_boxes(
    long: DataFrame, k: int = 100, order_key: Column | None = None, limits: tuple[float, float] = (0.0, 60.0)
) -> DataFrame:
    """Box statistics of answer times for ``k`` sampled participants, numbered by median time."""
    chosen = sample_groups(long, "id", k, order_key).select("id", "time")
    place = ordered_position(
        quantiles(chosen, "time", {"median_time": 0.5}, ["id"]), [F.col("median_time").asc_nulls_last(), "id"], name="ord"
    )
    return join_on(box_stats(chosen, "time", ["id"], limits), place.select("id", "ord"), "id")
