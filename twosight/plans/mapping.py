"""From risk estimate to binary answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import binomial_se, decile, flag, round_even, share_of, std_error
from twosight.operators.inference import paired_t, welch_samples
from twosight.operators.layers import heat_cells
from twosight.operators.metrics import metric_bundle, metric_pairs, with_interval
from twosight.operators.ordered import category_order
from twosight.operators.summary import share

def _band_tests(score: str = "qp") -> dict:
    s = F.col(score)
    return {
        "below half": s < 0.5,
        "above half": s > 0.5,
        "40 to half": (s >= 0.4) & (s < 0.5),
        "half": s == 0.5,
        "half to 60": (s > 0.5) & (s <= 0.6),
    }


def decile_curve(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of positive answers by tenths of the estimate, with binomial standard errors."""
    rows = long.withColumn("qp_binned", decile("qp"))
    out = rows.groupBy(*by, "qp_binned").agg(F.avg("qb").alias("mean_qb"), F.count(F.lit(1)).alias("n"))
    return with_interval(out.withColumn("se", binomial_se("mean_qb", "n")), "mean_qb")


def exact_curve(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return long.groupBy(*by, "qp").agg(F.avg("qb").alias("mean_qb"), F.count(F.lit(1)).alias("n"))


def _banded(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per (answer, band that holds it), in one pass."""
    labels = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in _band_tests().items()]), lambda b: b.isNotNull()
    )
    return long.select(*by, "qb", F.explode(labels).alias("band"))


def bands(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of positive (and negative) answers in ranges of the estimate."""
    return _banded(long, by).groupBy(*by, "band").agg(
        F.avg("qb").alias("mean_qb"),
        (1 - F.avg("qb")).alias("mean_negative"),
        round_even(std_error("qb"), 3).alias("se"),
        F.count(F.lit(1)).alias("n"),
    )


def band_tests(long: DataFrame) -> DataFrame:
    """Welch tests between the three middle bands."""
    pairs = [("40 to half", "half"), ("40 to half", "half to 60"), ("half to 60", "half")]
    options = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    rows = _banded(long, []).select("qb", "band", F.inline(options))
    side = [F.when(F.col("band") == F.col(s), F.col("qb")) for s in ("a", "b")]
    return welch_samples(rows.where(F.col("band").isin(F.col("a"), F.col("b"))), *side, by=["a", "b"])


def participant_order(long: DataFrame) -> DataFrame:
    """Participants by their lowest estimate with a positive answer."""
    return category_order(long.where(F.col("qb") == 1), "id", F.min("qp")).withColumnRenamed("stat", "min_qp")


def participant_heat(long: DataFrame) -> DataFrame:
    """Share of positive answers per (participant, tenth of the estimate)."""
    return heat_cells(long, {"id": F.col("id"), "binned_qp": decile("qp")}, "qb", "mean_qb")


def consistent_participants(long: DataFrame, more_than: float = 0.9, cut: float = 0.5) -> DataFrame:
    """Participants by whether more than a share of their answers agree with their own estimates."""
    agree = flag(flag(F.col("qp") > cut) == F.col("qb"))
    each = long.where(F.col("qp") != cut).groupBy("id").agg(F.avg(agree).alias("share"))
    return share(each.select((F.col("share") > more_than).alias("consistent")), ["consistent"])


def overall_shares(long: DataFrame, cut: float = 0.5) -> DataFrame:
    qp, qb = F.col("qp"), F.col("qb")
    return long.agg(
        F.avg(qb).alias("mean_qb"),
        share_of(qp > cut).alias("share_above"),
        share_of(qp >= cut).alias("share_from"),
        F.avg(F.when(qp > cut, qp)).alias("mean_qp_above"),
        F.avg(F.when(qp >= cut, qp)).alias("mean_qp_from"),
    )


def estimate_against_answer(long: DataFrame, cut: float = 0.5, paired: bool = False) -> DataFrame:
    """t test of the thresholded estimate (open and closed at the cut) against the binary answer."""
    options = F.array(
        F.struct(F.lit("open").alias("rule"), flag(F.col("qp") > cut).alias("x")),
        F.struct(F.lit("closed").alias("rule"), flag(F.col("qp") >= cut).alias("x")),
    )
    rows = long.select("qb", F.inline(options))
    return (paired_t if paired else welch_samples)(rows, "x", "qb", ["rule"])


def inconsistency_by_second(
    long: DataFrame, limits: tuple[float, float] | None = (3.0, 20.0), cut: float = 0.5
) -> DataFrame:
    """Share of answers that contradict the estimate, by rounded second."""
    rows = long.select(round_even("time").alias("time"), flag(F.col("qb") != flag(F.col("qp") > cut)).alias("inc"))
    if limits:
        rows = rows.where(F.col("time").between(*limits))
    out = rows.groupBy("time").agg(F.avg("inc").alias("mean_inc"), std_error("inc").alias("se_inc"), F.count(F.lit(1)).alias("n"))
    return with_interval(out, "mean_inc", "se_inc")


def _two_predictors(long: DataFrame, cut: float) -> DataFrame:
    both = F.array(
        F.struct(F.lit("score").alias("source"), flag(F.col("qp") > cut).alias("pred")),
        F.struct(F.lit("binary").alias("source"), F.col("qb").cast("int").alias("pred")),
    )
    return long.where(F.col("qp") != cut).select("outcome", F.inline(both))


def score_and_binary_bundle(long: DataFrame, cut: float = 0.5) -> DataFrame:
    """Metrics of the thresholded estimate and of the binary answer; estimates at the cut are left out."""
    return metric_bundle(_two_predictors(long, cut), ["source"], pred="pred")


def score_and_binary_tests(long: DataFrame, cut: float = 0.5) -> DataFrame:
    return metric_pairs(_two_predictors(long, cut), "source", [("score", "binary")], pred="pred")
