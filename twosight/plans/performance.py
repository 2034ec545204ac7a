"""How well people and model predict, and what people think of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import flag, ratio, round_even, share_of, strict
from twosight.functions.recodes import human_or_model
from twosight.operators.inference import welch_t
from twosight.operators.joins import attach, join_on
from twosight.operators.models import add_rethresholded, match_rate
from twosight.operators.ordered import percentile_rank_desc
from twosight.operators.ranks import spearman
from twosight.plans.preparation import first_answers

# --- fixed values: number of items each accuracy question is about ---
SET_ITEMS = {1: 14, 2: 25, 3: 25}
# --- end of fixed values ---


def right() -> Column:
    """1 when the binary answer equals the outcome."""
    return flag(F.col("qb") == F.col("outcome"))


def operating_point(everyone: DataFrame, digits: int = 3) -> DataFrame:
    """People's positive rate, and the model threshold at which the model reaches it."""
    return match_rate(everyone, F.col("type") == "r", "qp", "qb", digits)


def with_matched_model(everyone: DataFrame, closed: bool = True) -> DataFrame:
    """Append the predictor ``re``: the model at the matched operating point."""
    return add_rethresholded(everyone, operating_point(everyone).select("threshold"), closed=closed)


def beat_model(matched: DataFrame, parts: tuple[int, ...] = (2, 3)) -> DataFrame:
    """Share and number of participants at least as accurate as the model, at both operating points."""
    rows = first_answers(matched).where(F.col("survey_part").isin(*parts))
    kind = human_or_model("type")
    each = rows.groupBy("id").agg(*[F.avg(F.when(kind == k, right())).alias(k) for k in ("h", "r", "re")])
    return each.agg(
        share_of(F.col("h") >= F.col("r")).alias("share_r"),
        F.coalesce(F.sum(flag(F.col("h") >= F.col("r"))), F.lit(0)).alias("n_r"),
        share_of(F.col("h") >= F.col("re")).alias("share_re"),
        F.count(F.lit(1)).alias("participants"),
    )


def _early(everyone: DataFrame, half: int, end: int) -> DataFrame:
    rows = everyone.where((F.col("order_question") < end) & (F.col("type") == "h"))
    return rows.withColumn("first_half", F.col("order_question") < half)


def halves(everyone: DataFrame, half: int = 9, end: int = 17) -> DataFrame:
    """First against second half of part 1."""
    return _early(everyone, half, end).groupBy("first_half").agg(
        F.avg("qb").alias("mean_qb"),
        F.avg("qp").alias("mean_qp"),
        F.avg("outcome").alias("mean_outcome"),
        F.countDistinct("order_question").alias("n_questions"),
        F.avg(right()).alias("accuracy"),
    )


def halves_tests(everyone: DataFrame, half: int = 9, end: int = 17) -> DataFrame:
    """Welch tests of predicted positives and accuracy between the halves."""
    values = F.array(
        F.struct(F.lit("qb").alias("measure"), F.col("qb").cast("double").alias("x")),
        F.struct(F.lit("accuracy").alias("measure"), right().cast("double").alias("x")),
    )
    rows = _early(everyone, half, end).select("first_half", F.inline(values))
    return welch_t(rows, "x", "first_half", True, False, ["measure"])


def by_part(everyone: DataFrame) -> DataFrame:
    """Unassisted answers outside the anchoring arm and the decreasing condition, by part."""
    rows = everyone.where((F.col("type") == "h") & (F.col("setting") == "No anchor") & (F.col("condition") != "Decreasing"))
    return rows.groupBy("survey_part").agg(F.avg(right()).alias("accuracy"), F.avg("qp").alias("risk_estimate"))


def accuracy_by_set(everyone: DataFrame, before: int = 31) -> DataFrame:
    """Accuracy of each participant on the items each question set is about, with its rank.

    Set 1: part 1; set 2: part 2 before order ``before``; set 3: all of part 2.
    """
    rows = first_answers(everyone.where(F.col("type") != "r"))
    part, early = F.col("survey_part"), F.col("order_question") < before
    per_person = rows.groupBy("id").agg(
        F.avg(F.when((part == 1) & early, right())).alias("a1"),
        F.avg(F.when((part != 1) & (part != 3) & early, right())).alias("a2"),
        F.avg(F.when(part == 2, right())).alias("a3"),
    )
    sets = F.array(*[F.struct(F.lit(k).alias("set_q"), F.col(f"a{k}").alias("acc")) for k in (1, 2, 3)])
    long = per_person.select("id", F.inline(sets)).where(F.col("acc").isNotNull())
    return percentile_rank_desc(long, ["acc", "id"], ["set_q"])


def perceived_and_real(answers: DataFrame, accuracy: DataFrame) -> DataFrame:
    return join_on(answers, accuracy, ["id", "set_q"])


def perceived_correlation(both: DataFrame) -> DataFrame:
    """Means and rank correlation of real and perceived accuracy per set."""
    means = both.groupBy("set_q").agg(
        strict(F.avg("acc"), "acc").alias("mean_acc"), strict(F.avg("humanaccuracy"), "humanaccuracy").alias("mean_humanacc")
    )
    return attach(means, spearman(both, "humanaccuracy", "acc", ["set_q"]), ["set_q"])


def perceived_gap(both: DataFrame, na_rm: bool = False) -> DataFrame:
    """Mean distance between perceived and real accuracy, also in items, and how many overestimate."""
    gap, over = F.abs(F.col("acc") - F.col("humanaccuracy")), flag(F.col("humanaccuracy") > F.col("acc"))
    items = F.create_map(*[F.lit(x) for kv in SET_ITEMS.items() for x in kv])
    means = both.groupBy("set_q").agg(
        (F.avg(gap) if na_rm else strict(F.avg(gap), gap)).alias("perc_diff"),
        (F.avg(over) if na_rm else strict(F.avg(over), over)).alias("overestimate"),
    )
    return means.withColumn("diff_n_question", F.col("perc_diff") * items[F.col("set_q")])


def by_class(both: DataFrame, column: str, value: str, name: str, na_rm: bool = False) -> DataFrame:
    """Mean of ``value``, n and share within the set, per class of a survey answer."""
    agg = F.avg(value) if na_rm else strict(F.avg(value), value)
    counts = both.groupBy("set_q", column).agg(agg.alias(name), F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("set_q").agg(F.sum("n").alias("_all"))
    joined = attach(counts, totals, ["set_q"])
    return joined.select("set_q", column, name, "n", round_even(ratio("n", "_all"), 3).alias("prop_n"))
