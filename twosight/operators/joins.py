"""Equi-joins. No side is hinted: Catalyst broadcasts a side whose measured size is small and
AQE splits skewed partitions of the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join keeping one copy of the key columns (a missing key matches a missing key)."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on])
    return left.join(renamed, test, how).drop(*[f"_r_{k}" for k in on])


def join_on(left: DataFrame, right: DataFrame, on: str | list[str], null_safe: bool = False) -> DataFrame:
    """Inner join on common key columns; keys that are never missing use plain equality."""
    keys = [on] if isinstance(on, str) else list(on)
    return attach(left, right, keys) if null_safe else left.join(right, keys, "inner")


def keep_matching(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    keys = [on] if isinstance(on, str) else list(on)
    return left.join(right.select(*keys), keys, "left_semi")


def keep_unmatched(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    return left.join(right.select(*keys), keys, "left_anti")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on every column the two frames share."""
    common = [c for c in left.columns if c in right.columns]
    return attach(left, right, common)


def with_group_stat(df: DataFrame, stat: DataFrame, by: list[str]) -> DataFrame:
    """Give every row the statistic of its group.

    A window over ``by`` would hold a whole group in one task; an aggregate with map-side partial
    sums joined back does not. Without groups the one-row statistic is a scalar subquery.
    """
    if by:
        return attach(df, stat, list(by))
    one = stat.select(F.struct(*stat.columns)).scalar()
    return df.withColumn("_stat", one).select(*df.columns, *[F.col("_stat")[c].alias(c) for c in stat.columns])
