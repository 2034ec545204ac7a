"""Grand and grouped summaries, frequency tables and small-cell rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import col, ratio, round_even, std_error
from twosight.operators.joins import attach
from twosight.operators.ordered import ordered_cells, quantile_expr


def describe(
    df: DataFrame,
    value: Column | str,
    by: Sequence[str] = (),
    na_rm: bool = True,
    probs: dict[str, float] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """``n, mean, sd, se, median, min, max`` (and further quantiles) of one column, exactly, in one pass.

    ``na_rm=False`` returns NULL statistics for a group with a missing value. ``se`` divides by the
    number of rows of the group, missing ones included.
    """
    cells = ordered_cells(df, value, by, ranges)
    mean = F.try_divide(F.max("s_total"), F.max("n_total").cast("double"))
    squares = F.sum(F.col("_n") * F.pow(F.col("value") - F.col("s_total") / F.col("n_total"), F.lit(2.0)))
    sd = F.when(F.max("n_total") > 1, F.sqrt(squares / (F.max("n_total") - 1)))
    stats = {
        "mean": mean,
        "sd": sd,
        "se": sd / F.sqrt(F.max("rows_total").cast("double")),
        "median": quantile_expr(0.5),
        "min": F.min("value"),
        "max": F.max("value"),
        **{name: quantile_expr(p) for name, p in (probs or {}).items()},
    }
    # Groups whose values are all missing keep a row; their mean divides by nothing.
    known = cells.withColumn("n_total", F.nullif(F.col("n_total"), F.lit(0)))
    if not na_rm:
        complete = F.max("n_total") == F.max("rows_total")
        stats = {name: F.when(complete, c) for name, c in stats.items()}
    return known.groupBy(*by).agg(
        F.coalesce(F.max("n_total"), F.lit(0)).alias("n"),
        F.max("rows_total").alias("n_rows"),
        *[c.alias(name) for name, c in stats.items()],
    )


def describe_many(
    df: DataFrame,
    values: dict[str, Column | str],
    by: Sequence[str] = (),
    na_rm: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """``describe`` for several columns at once: one row per (group, variable), still one pass."""
    pairs = [F.struct(F.lit(name).alias("variable"), col(c).cast("double").alias("_value")) for name, c in values.items()]
    long = df.select(*by, F.inline(F.array(*pairs)))
    return describe(long, "_value", [*by, "variable"], na_rm, ranges=ranges)


def mean_se(df: DataFrame, value: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """``value`` (mean), ``se`` and ``n`` rows per group."""
    v = col(value).cast("double")
    return df.groupBy(*by).agg(F.avg(v).alias("value"), std_error(v).alias("se"), F.count(F.lit(1)).alias("n"))


def share(
    df: DataFrame, by: Sequence[str], within: Sequence[str] = (), digits: int | None = None, scale: float = 1.0
) -> DataFrame:
    """Frequency table: ``n`` per combination of ``by`` and ``prop``.

    ``prop`` is the share of the grand total, or of the total of the ``within`` keys when given.
    """
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if within:
        totals = counts.groupBy(*within).agg(F.sum("n").alias("_total"))
        counts = attach(counts, totals, list(within))
        total = F.col("_total")
    else:
        total = counts.agg(F.sum("n")).scalar()
    prop = ratio("n", total)
    prop = prop if digits is None else round_even(prop, digits)
    return counts.select(*by, "n", (prop * scale if scale != 1.0 else prop).alias("prop"))


def share_of_distinct(
    df: DataFrame, unit: Sequence[str], by: Sequence[str], within: Sequence[str] = (), digits: int | None = 3
) -> DataFrame:
    """Frequency table over distinct units (for example participants per arm)."""
    return share(df.select(*unit, *[b for b in by if b not in unit]).distinct(), by, within, digits)


def keep_groups(df: DataFrame, by: Sequence[str], test: Column) -> DataFrame:
    """Rows of the groups that pass an aggregate test, e.g. ``count(*) >= 3``."""
    good = df.groupBy(*by).agg(test.alias("_keep")).where("_keep").drop("_keep")
    return attach(df, good, list(by), "left_semi") if by else df


def ratio_of_means(a: Column, b: Column) -> Column:
    return F.try_divide(F.avg(a), F.avg(b))


def mean_of_ratios(a: Column, b: Column) -> Column:
    return F.avg(F.try_divide(a, b))

