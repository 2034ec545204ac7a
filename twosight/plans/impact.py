"""How much the model moves people: distance, influence, revisions, stated use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twosight.functions.nulls import bin_floor, col, count_if, flag, share_of, std_error, strict
from twosight.functions.recodes import percent_and_count
from twosight.operators.inference import welch_samples, welch_t
from twosight.operators.joins import join_on
from twosight.operators.layers import box_stats
from twosight.operators.ordered import ordered_position
from twosight.operators.reshape import longer, wider
from twosight.operators.summary import describe, describe_many, mean_se, share


def distance(a: Column | str, b: Column | str = "qp_r") -> Column:
    return F.abs(col(a) - col(b))


def influence(
    h: Column | str = "qp_h", hr: Column | str = "qp_hr", r: Column | str = "qp_r", min_gap: float = 0.05, closed: bool = False
) -> Column:
    """Share of the initial gap to the model that the assisted answer closed.

    NULL unless the initial gap exceeds ``min_gap`` (or reaches it, if ``closed``).
    """
    gap = col(r) - col(h)
    big = F.abs(gap) >= min_gap if closed else F.abs(gap) > min_gap
    return F.when(big, F.try_divide(col(hr) - col(h), gap))


def with_influence(pred: DataFrame, min_gap: float = 0.05, closed: bool = False) -> DataFrame:
    return pred.withColumn("influence", influence(min_gap=min_gap, closed=closed))


# --- distance to the model --------------------------------------------------------------------


def gap_summary(long: DataFrame, by: Sequence[str]) -> DataFrame:
    return describe(long, distance("qp"), by, na_rm=False).select(
        *by, "n", F.col("mean").alias("mean_abs_diff"), F.col("median").alias("median_diff")
    )


def gap_by_score(long: DataFrame, by: Sequence[str], per_unit: int = 5) -> DataFrame:
    """Mean distance with standard error by bins of the model score."""
    rows = long.withColumn("qp_r_bin", bin_floor("qp_r", per_unit))
    return mean_se(rows, distance("qp"), ["qp_r_bin", *by])


def given_model_accuracy(long: DataFrame, arm: Sequence[str] = ("condition", "setting"), more_than: int = 200) -> DataFrame:
    """Distance to and agreement with the model by arm and by the accuracy of the model on the
    participant's own items; small cells are left out.

    Participants are reduced to one row per arm first, so the accuracy is attached to those rows
    and never to the answers.
    """
    per_arm = long.groupBy("id", *arm).agg(
        F.sum(distance("qp")).alias("_gap"),
        F.sum(flag(F.col("qb_r") == F.col("qb"))).alias("_same"),
        F.sum(flag(F.col("qb_r") == F.col("outcome"))).alias("_right"),
        F.count(F.lit(1)).alias("_n"),
    )
    person = Window.partitionBy("id")  # as many rows as arms
    acc = F.sum("_right").over(person) / F.sum("_n").over(person)
    cells = per_arm.withColumn("acc_r", acc).groupBy(*arm, "acc_r").agg(
        (F.sum("_gap") / F.sum("_n")).alias("mean_abs_diff"),
        (F.sum("_same") / F.sum("_n")).alias("agreement"),
        F.sum("_n").alias("n"),
    )
    return cells.where(F.col("n") > more_than)


def disagreement(long: DataFrame, by: Sequence[str] = (), pred: str = "qb") -> DataFrame:
    return mean_se(long, flag(F.col(pred) != F.col("qb_r")), by)


def agreement_by(long: DataFrame, by: Sequence[str]) -> DataFrame:
    return long.groupBy(*by).agg(
        F.avg(distance("qp")).alias("mean_diff"), F.avg(flag(F.col("qb_r") == F.col("qb"))).alias("mean_agreement")
    )


def unassisted_baseline(pair: DataFrame) -> DataFrame:
    """Distance and disagreement before the model was shown."""
    return pair.agg(
        F.avg(distance("qp_h")).alias("mean_abs_diff"), F.avg(flag(F.col("qb_h") != F.col("qb_r"))).alias("disagreement")
    )


# --- influence --------------------------------------------------------------------------------


def influence_by_sign(pair: DataFrame) -> DataFrame:
    """Influence, revision and initial gap by whether the model was above the person."""
    gap = F.col("qp_r") - F.col("qp_h")
    return pair.groupBy((gap > 0).alias("model_higher")).agg(
        F.avg("influence").alias("mean_influence"),
        F.avg(F.abs(F.col("qp_hr") - F.col("qp_h"))).alias("mean_revision"),
        F.avg(gap).alias("size_initial_diff"),
        F.count(F.lit(1)).alias("n"),
    )


def influence_boxes(pair: DataFrame, low: float = -0.5, high: float = 0.3, limits: tuple[float, float] = (-1.6, 1.6)) -> DataFrame:
    """Box statistics of influence by tenths of the initial gap."""
    rows = pair.withColumn("initial_risk_diff", bin_floor(F.col("qp_r") - F.col("qp_h"), 10))
    return box_stats(rows.where(F.col("initial_risk_diff").between(low, high)), "influence", ["initial_risk_diff"], limits)


def influence_by_participant(pair: DataFrame) -> DataFrame:
    """Mean influence and final distance of each participant, numbered in ascending order."""
    per_person = pair.groupBy("id").agg(
        F.avg("influence").alias("mean_influence"), F.avg(distance("qp_hr")).alias("mean_final_diff")
    )
    return ordered_position(per_person, [F.col("mean_influence").asc_nulls_last(), "id"], name="place").drop("place_total")


def influence_by(pair: DataFrame, by: Sequence[str]) -> DataFrame:
    return describe(pair, "influence", by).select(
        *by, F.col("mean").alias("mean_influence"), F.col("median").alias("median_influence"), F.col("n_rows").alias("n")
    )


def before_after(pair: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Distance to the model before and after seeing it, one row each."""
    rows = pair.select(*ids, distance("qp_h").alias("initial_diff"), distance("qp_hr").alias("final_diff"))
    return longer(rows, list(ids), ["initial_diff", "final_diff"])


def behaviour_counts(pair: DataFrame, near: float = 0.1) -> DataFrame:
    """Participants whose every answer matched the model, stayed put, or met it half-way (within ``near``)."""
    middle = F.abs(F.col("qp_r") + F.col("qp_h")) / 2
    tests = {
        "always_matched": distance("qp_hr"),
        "never_revised": distance("qp_hr", "qp_h"),
        "always_averaged": F.abs(middle - F.col("qp_hr")),
    }
    each = pair.groupBy("id").agg(*[F.avg(flag(c <= near)).alias(n) for n, c in tests.items()])
    return each.agg(*[count_if(F.col(n) == 1).alias(n) for n in tests], F.count(F.lit(1)).alias("participants"))


# --- binary revisions -------------------------------------------------------------------------


def revision_stats(pair: DataFrame) -> DataFrame:
    """Shares about revised binary answers, in one pass."""
    h, hr, r = F.col("qb_h"), F.col("qb_hr"), F.col("qb_r")
    revised = flag(h != hr)
    return pair.agg(
        F.avg(revised).alias("revised"),
        std_error(revised).alias("revised_se"),
        F.avg(flag(h == r)).alias("agree_initial"),
        F.avg(flag(hr == r)).alias("agree_final"),
        F.avg(F.when(h != r, flag(hr == r))).alias("switch_when_disagree"),
        F.avg(F.when(h != hr, flag(hr == r))).alias("revision_to_model"),
        F.avg(F.when(h == r, flag(hr != r))).alias("left_model"),
        F.avg(h).alias("initial_positive"),
        F.avg(F.when(h != hr, flag(F.col("outcome") == h))).alias("acc_qb_h"),
        F.avg(F.when(h != hr, flag(F.col("outcome") == hr))).alias("acc_qb_hr"),
        count_if(h != hr).alias("n_revised"),
    )


def agreement_by_verdict(pair: DataFrame) -> DataFrame:
    h, hr, r = F.col("qb_h"), F.col("qb_hr"), F.col("qb_r")
    return pair.groupBy("qb_r").agg(
        F.avg(flag(h == r)).alias("mean_initial"),
        F.avg(flag(hr == r)).alias("mean_final"),
        F.avg(F.when(h != r, flag(hr == r))).alias("switched"),
    )


def transition_shares(pair: DataFrame) -> DataFrame:
    return share(pair, ["qb_h", "qb_hr"])


def switch_direction(pair: DataFrame) -> DataFrame:
    rows = pair.where(F.col("qb_h") != F.col("qb_hr")).withColumn("model_higher", F.col("qp_h") < F.col("qp_r"))
    return share(rows, ["qb_hr", "model_higher"], ["qb_hr"])


def agreement_test(pair: DataFrame) -> DataFrame:
    return welch_samples(pair, flag(F.col("qb_h") == F.col("qb_r")), flag(F.col("qb_hr") == F.col("qb_r")))


def adherence_test(pair: DataFrame) -> DataFrame:
    """Switching to the model after initial disagreement: verdict 0 against verdict 1."""
    return welch_t(pair.where(F.col("qb_h") != F.col("qb_r")), flag(F.col("qb_hr") == F.col("qb_r")), "qb_r", 0, 1)


def revision_matrix(pair: DataFrame) -> DataFrame:
    """Percent of (model, final) answers within each initial answer, to a tenth."""
    out = share(pair, ["qb_h", "qb_r", "qb_hr"], ["qb_h"], digits=3)
    return out.withColumn("prop", F.col("prop") * 100)


def decisions_by_model_decile(long: DataFrame) -> DataFrame:
    return mean_se(long.withColumn("qp_r_binned", bin_floor("qp_r", 10)), "qb", ["qp_r_binned", "type"])


def switches_by_model_decile(pair: DataFrame) -> DataFrame:
    rows = pair.where(F.col("qb_h") != F.col("qb_r")).withColumn("qp_r_binned", bin_floor("qp_r", 10))
    return rows.groupBy("qp_r_binned").agg(
        share_of(F.col("qb_hr") == F.col("qb_r")).alias("value"), F.count(F.lit(1)).alias("n")
    )


def low_score_switches(pair: DataFrame, below: float = 0.5) -> DataFrame:
    """Initial disagreements under a low model score: ``changed`` is 1 when the final answer is negative."""
    rows = pair.where((F.col("qb_h") != F.col("qb_r")) & (F.col("qp_r") < below))
    return rows.withColumn("changed", flag(F.col("qb_hr") == 0))


# --- stated use and trust ---------------------------------------------------------------------


def stated_use(answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stated use, trust and perceived accuracy per arm; a missing answer makes a mean NULL."""
    trusts = flag(F.col("trust") == "Yes")
    means = {"use_binary": "use_binary", "use_likelihood": "use_likelihood", "humanaccuracy": "humanaccuracy"}
    return answers.groupBy(*by).agg(
        *[strict(F.avg(c), c).alias(n) for n, c in means.items()],
        strict(F.avg(trusts), trusts).alias("trust"),
        F.count(F.lit(1)).alias("n"),
    )


def stated_use_center(answers: DataFrame) -> DataFrame:
    """Mean and median stated use over participants."""
    return describe_many(answers, {"use_likelihood": "use_likelihood", "use_binary": "use_binary"}).select(
        "variable", "n", "mean", "median"
    )


def use_by_participant(pair: DataFrame, answers: DataFrame) -> DataFrame:
    """Real and stated use side by side. Answers are reduced to participants before the join."""
    real = pair.groupBy("id").agg(
        F.avg("influence").alias("mean_influence"),
        F.avg(distance("qp_h")).alias("mean_initial_diff"),
        F.avg(distance("qp_hr")).alias("mean_final_diff"),
    )
    stated = answers.select("id", "use_likelihood", "use_binary", flag(F.col("trust") == "Yes").alias("trust"))
    return join_on(real, stated, "id")


def use_by_trust(use: DataFrame) -> DataFrame:
    return use.groupBy("trust").agg(
        *[F.avg(c).alias(c) for c in ("mean_influence", "mean_initial_diff", "mean_final_diff")], F.count(F.lit(1)).alias("n")
    )


def confidence_by_condition(answers: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Shares of confidence classes within (set, condition), one column per condition."""
    rows = share(answers, ["set_q", "condition", "confidence"], ["set_q", "condition"])
    return wider(rows, ["set_q", "confidence"], "condition", list(conditions), "prop")


def arm_text_table(counts: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Cells such as ``16.7% (88)`` with one column per setting."""
    cells = counts.withColumn("text", percent_and_count("prop", "n"))
    return wider(cells, ["condition"], "setting", list(settings), "text")


def items_per_participant(long: DataFrame) -> DataFrame:
    return long.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean_items"))


def model_accuracy(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(flag(F.col("qb_r") == F.col("outcome"))).alias("acc"))
