"""Tests on moments and contingency tables: Welch and paired t, Pearson correlation, chi-square."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twosight.functions.nulls import col
from twosight.functions.pvalues import p_chi2, p_student


def _moments(value: Column, suffix: str) -> list[Column]:
    return [
        F.count(value).alias(f"n_{suffix}"),
        F.avg(value).alias(f"mean_{suffix}"),
        F.var_samp(value).alias(f"var_{suffix}"),
    ]


def welch_columns(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unequal-variance t from ``n_/mean_/var_`` of samples a and b."""
    ea = F.try_divide(F.col("var_a"), F.col("n_a"))
    eb = F.try_divide(F.col("var_b"), F.col("n_b"))
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(ea + eb))
    parts = F.try_divide(ea * ea, F.col("n_a") - 1) + F.try_divide(eb * eb, F.col("n_b") - 1)
    out = moments.select(
        *keys, "n_a", "n_b", "mean_a", "mean_b", t.alias("t"), F.try_divide(F.pow(ea + eb, F.lit(2.0)), parts).alias("dof")
    )
    return out.withColumn("p", p_student("t", "dof"))


def welch_t(
    df: DataFrame, value: Column | str, group: Column | str, a, b, by: Sequence[str] = ()
) -> DataFrame:
    """Two-sample t test of ``value`` between the rows with ``group == a`` and ``group == b``.

    One aggregate for all groups of ``by``; missing values are left out.
    """
    return welch_samples(df, F.when(col(group) == a, col(value)), F.when(col(group) == b, col(value)), by)


def welch_samples(df: DataFrame, a: Column | str, b: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """The same test for two columns; a row may contribute to both samples (unpaired)."""
    va, vb = col(a).cast("double"), col(b).cast("double")
    return welch_columns(df.groupBy(*by).agg(*_moments(va, "a"), *_moments(vb, "b")), by)


def paired_t(df: DataFrame, a: Column | str, b: Column | str, by: Sequence[str] = ()) -> DataFrame:
    gap = col(a).cast("double") - col(b).cast("double")
    m = df.groupBy(*by).agg(F.count(gap).alias("n"), F.avg(gap).alias("mean_diff"), F.stddev_samp(gap).alias("_sd"))
    t = F.try_divide(F.col("mean_diff") * F.sqrt(F.col("n").cast("double")), F.col("_sd"))
    out = m.select(*by, "n", "mean_diff", t.alias("t"), (F.col("n") - 1).cast("double").alias("dof"))
    return out.withColumn("p", p_student("t", "dof"))


def correlation_t(r: Column, n: Column) -> Column:
    """t of a correlation; infinite for a perfect one of more than two pairs."""
    whole = (F.abs(r) >= 1) & (n > 2)
    return F.when(whole, F.signum(r) * float("inf")).otherwise(r * F.sqrt(F.try_divide(n - 2, 1 - r * r)))


def pearson_test(df: DataFrame, x: Column | str, y: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation with its t test; pairs with a missing side are left out."""
    pair = df.select(*by, col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y"))
    pair = pair.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    r = pair.groupBy(*by).agg(F.corr("_x", "_y").alias("r"), F.count(F.lit(1)).alias("n"))
    out = r.withColumn("t", correlation_t(F.col("r"), F.col("n"))).withColumn("dof", (F.col("n") - 2).cast("double"))
    return out.withColumn("p", p_student("t", "dof"))


def chi_square(df: DataFrame, a: Column | str, b: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson chi-square of two categories per group; 2x2 tables get the continuity correction.

    Only the contingency table (levels x levels per group) reaches the windows.
    """
    table = (
        df.select(*by, col(a).alias("_a"), col(b).alias("_b")).dropna(subset=["_a", "_b"])
        .groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).cast("double").alias("o"))
    )
    rows, cols = Window.partitionBy(*by, "_a"), Window.partitionBy(*by, "_b")
    marginal = table.withColumns({"r": F.sum("o").over(rows), "c": F.sum("o").over(cols)})
    # Cells that never occur add nothing to sum(o^2 / (r c)), so the table need not be completed.
    sums = marginal.groupBy(*by).agg(
        F.sum("o").alias("n"),
        F.count_distinct("_a").alias("rows"),
        F.count_distinct("_b").alias("cols"),
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("_q"),
        F.max_by(F.struct("o", "r", "c"), F.col("o")).alias("_cell"),
    )
    n, r, c = F.col("n"), F.col("_cell.r"), F.col("_cell.c")
    gap = F.abs(F.col("_cell.o") - r * c / n)
    corrected = F.pow(gap - F.least(F.lit(0.5), gap), F.lit(2.0)) * F.try_divide(n * n * n, r * (n - r) * c * (n - c))
    plain = n * (F.col("_q") - 1)
    two_by_two = (F.col("rows") == 2) & (F.col("cols") == 2)
    dof = ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("double")
    out = sums.select(
        *by,
        n.cast("long").alias("n"),
        F.when(dof > 0, F.when(two_by_two, corrected).otherwise(plain)).alias("chi2"),
        F.when(dof > 0, dof).alias("dof"),
    )
    return out.withColumn("p", p_chi2("chi2", "dof"))
