"""Performance, calibration and influence by group of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import count_if, decile
from twosight.operators.inference import chi_square
from twosight.operators.metrics import with_interval
from twosight.operators.models import fit_logit
from twosight.operators.summary import mean_se
from twosight.plans.impact import influence, influence_by


def calibration(long: DataFrame, group: str) -> DataFrame:
    """Outcome rate by tenths of the estimate and group."""
    rows = long.withColumn("qp_binned", decile("qp"))
    return with_interval(mean_se(rows, "outcome", ["qp_binned", group]).withColumnRenamed("value", "mean_outcome"), "mean_outcome")


def calibration_test(long: DataFrame, group: str) -> DataFrame:
    """Chi-square of outcome against group within each tenth of the estimate."""
    return chi_square(long.withColumn("qp_binned", decile("qp")), "outcome", group, ["qp_binned"])


def calibration_logit(long: DataFrame, group: str, interact: bool = False) -> DataFrame:
    """Logistic regression of the outcome on the estimate and the group (with their product)."""
    return fit_logit(long, "outcome", ["qp"], group, interact).tidy()


def influence_by_group(pair: DataFrame, group: str, by_direction: bool = False) -> DataFrame:
    """Mean and median influence by group, and by whether the model was higher."""
    if not by_direction:
        return influence_by(pair, [group])
    return influence_by(pair.withColumn("model_higher", F.col("qp_h") < F.col("qp_r")), [group, "model_higher"])


def item_influence(long: DataFrame, group: str, least: int = 3, min_gap: float = 0.05) -> DataFrame:
    """Influence per item from its average estimates; items need ``least`` answers of each type.

    One aggregate gives both averages, so the items are neither filtered by a window nor widened.
    """

    def of(kind: str) -> Column:
        return F.when(F.col("type") == kind, F.col("qp"))

    items = long.groupBy("index", group).agg(
        F.avg(of("h")).alias("h"),
        F.avg(of("hr")).alias("hr"),
        F.max("qp_r").alias("qp_r"),
        count_if(F.col("type") == "h").alias("_nh"),
        count_if(F.col("type") == "hr").alias("_nhr"),
    )
    full = items.where((F.col("_nh") >= least) & (F.col("_nhr") >= least)).drop("_nh", "_nhr")
    return full.withColumn("influence", influence("h", "hr", "qp_r", min_gap, closed=True))


def item_influence_summary(items: DataFrame, group: str, by_direction: bool = False) -> DataFrame:
    if not by_direction:
        return influence_by(items, [group])
    return influence_by(items.withColumn("model_higher", F.col("h") < F.col("qp_r")), [group, "model_higher"])
