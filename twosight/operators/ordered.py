"""Order-dependent operators that never put a whole group into one task.

Everything here rests on ``prefix_sums``: rows are range-partitioned by (group, order), summed
inside each range, and shifted by the totals of the earlier ranges of the same group. A group that
holds a third of all rows is spread over a third of the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twosight.functions.nulls import col
from twosight.operators.joins import attach, with_group_stat
from twosight.session import stable


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: dict[str, Column],
    by: Sequence[str] = (),
    ranges: int | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """Add ``<name>_before`` (sum over earlier rows of the group) and ``<name>_total`` (sum over the
    group) for every entry of ``sums``.

    ``order`` must be unique within a group: aggregate to cells first, or append tie-breakers.
    ``keep_range`` also returns the number of the row's range, by which ``join_stat_by_range`` spreads
    a large group.
    """
    keys = list(by)
    order_cols = [col(o) for o in order]
    work = ranged(df.select("*", *[c.alias(f"_x_{name}") for name, c in sums.items()]), order, keys, ranges)
    lump = ["_range", *keys]
    earlier = Window.partitionBy(*lump).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    inside = work.select("*", *[F.sum(f"_x_{n}").over(earlier).alias(f"_in_{n}") for n in sums])
    # One row per (range, group); a group has at most as many rows here as there are ranges.
    sizes = work.groupBy(*lump).agg(*[F.sum(f"_x_{n}").alias(f"_size_{n}") for n in sums])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *lump,
        *[F.sum(f"_size_{n}").over(ahead).alias(f"_off_{n}") for n in sums],
        *[F.sum(f"_size_{n}").over(group).alias(f"{n}_total") for n in sums],
    )
    zero = F.lit(0)
    return attach(inside, offsets, lump).select(
        *df.columns,
        *[(F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_off_{n}", zero)).alias(f"{n}_before") for n in sums],
        *[F.col(f"{n}_total") for n in sums],
        *(["_range"] if keep_range else []),
    )


def ranged(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """The rows, written, with the number ``_range`` of their range in the order of (``by``, ``order``).

    The range boundaries come from a sample, so whatever reads the ranges more than once must read one written copy.
    """
    spread = [*by, *[col(o) for o in order]]
    out = df.repartitionByRange(ranges, *spread) if ranges else df.repartitionByRange(*spread)
    return stable(out.withColumn("_range", F.spark_partition_id()))


def join_stat_by_range(rows: DataFrame, stat: DataFrame, by: Sequence[str]) -> DataFrame:
    """Give every ordered row the statistic of its group without bringing the group together.

    The statistic goes to the (range, group) pairs first, at most one per range for a large group,
    and from there to the rows, so both joins are spread over the ranges.
    """
    keys = list(by)
    if not keys:
        return with_group_stat(rows, stat, [])
    pairs = attach(rows.select("_range", *keys).distinct(), stat, keys)
    return attach(rows, pairs, ["_range", *keys])


def ordered_position(
    df: DataFrame,
    order: Sequence[Column | str],
    by: Sequence[str] = (),
    name: str = "n",
    ranges: int | None = None,
) -> DataFrame:
    """Row number 1..N in sorted order within each group, plus ``<name>_total`` = N."""
    out = prefix_sums(df, order, {name: F.lit(1)}, by, ranges)
    return out.withColumn(name, F.col(f"{name}_before") + 1).drop(f"{name}_before")


def cumulative_share(
    df: DataFrame,
    value: str,
    order: Sequence[Column | str],
    by: Sequence[str] = (),
    name: str = "share_cum",
    ranges: int | None = None,
) -> DataFrame:
    """Row number ``n`` and running share of ``value`` up to and including the row."""
    out = prefix_sums(df, order, {"_n": F.lit(1), "_v": F.col(value)}, by, ranges)
    return out.select(
        *df.columns,
        (F.col("_n_before") + 1).alias("n"),
        F.try_divide(F.col("_v_before") + F.col(value), F.col("_v_total")).alias(name),
    )


def percentile_rank_desc(
    df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "rank", ranges: int | None = None
) -> DataFrame:
    """``1 - position/N`` in ascending order: the best row of a group gets 0."""
    out = ordered_position(df, order, by, "_pos", ranges)
    return out.withColumn(name, 1 - F.col("_pos") / F.col("_pos_total")).drop("_pos", "_pos_total")


def value_cells(df: DataFrame, value: Column | str, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """One row per (group, value) with its number of rows ``n``; a missing value forms a cell too."""
    return df.select(*by, col(value).cast("double").alias(name)).groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))


def _pick(position: Column) -> Column:
    """Aggregate: the value at a 0-based position among the non-missing values of the group."""
    inside = (F.col("n_before") <= position) & (position < F.col("n_before") + F.col("_n"))
    return F.max(F.when(inside, F.col("value")))


def quantile_expr(p: float) -> Column:
    """Aggregate over prefix-summed cells: interpolated quantile (linear between order statistics)."""
    h = (F.col("n_total") - 1) * F.lit(float(p))
    low, high = _pick(F.floor(h)), _pick(F.ceil(h))
    part = F.max(h - F.floor(h))
    return low + part * (high - low)


def ordered_cells(df: DataFrame, value: Column | str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Value cells with the counts below each value: ``value, n, _n, n_before, n_total, s_total, rows_total``.

    ``_n`` is 0 for the cell of missing values, so positions and totals concern known values only.
    ``_range`` says which range of the sort a cell belongs to.
    """
    cells = value_cells(df, value, by).withColumn("_n", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    return prefix_sums(
        cells,
        [F.col("value").asc_nulls_first()],
        {"n": F.col("_n"), "s": F.coalesce(F.col("value") * F.col("n"), F.lit(0.0)), "rows": F.col("n")},
        by,
        ranges,
        keep_range=True,
    )


def quantiles(
    df: DataFrame, value: Column | str, probs: dict[str, float], by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Exact quantiles of any group size: no group is held in memory."""
    cells = ordered_cells(df, value, by, ranges)
    return cells.groupBy(*by).agg(*[quantile_expr(p).alias(name) for name, p in probs.items()])


def sample_groups(df: DataFrame, key: str, k: int, order_key: Column | None = None, seed: int = 0) -> DataFrame:
    """All rows of ``k`` groups chosen by the smallest seeded hash of their key (repeatable)."""
    order = order_key if order_key is not None else F.xxhash64(F.col(key), F.lit(seed))
    chosen = df.select(key).distinct().orderBy(order, F.col(key)).limit(k)
    return df.join(chosen, key, "left_semi")


def category_order(df: DataFrame, key: str, statistic: Column, ranges: int | None = None) -> DataFrame:
    """One row per category with its statistic and its place ``ord`` in ascending order (ties by key)."""
    stats = df.groupBy(key).agg(statistic.alias("stat"))
    return ordered_position(stats, [F.col("stat").asc_nulls_last(), F.col(key)], name="ord", ranges=ranges).drop(
        "ord_total"
    )
