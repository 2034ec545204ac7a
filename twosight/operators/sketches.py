"""Approximate counts and quantiles from mergeable sketches, for tables whose strata are kept and combined later.

The exact operators stay the rule; these are for callers who choose them. A sketch is a binary column of bounded size,
so strata can be stored, merged and asked again without their rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import col

#: Size parameters: 2 ** LG buckets of a HyperLogLog sketch, K of a quantile sketch.
LG, K = 14, 800


def distinct_error(lg: int = LG, sigmas: float = 3.0) -> float:
    """The relative error of a distinct count that is exceeded by chance only beyond so many standard deviations."""
    return sigmas * 1.04 / math.sqrt(2**lg)


def rank_error(k: int = K) -> float:
    """The error of a quantile's rank, as a share of the rows, that holds with 99% for one quantile."""
    return 2.296 / k**0.9021


def distinct_sketches(df: DataFrame, value: Column | str, by: Sequence[str] = (), lg: int = LG) -> DataFrame:
    """One HyperLogLog sketch ``sketch`` of the known values, of any type, per group; partial sketches are merged map-side."""
    known = F.when(col(value).isNotNull(), F.xxhash64(col(value)))
    return df.groupBy(*by).agg(F.hll_sketch_agg(known, F.lit(lg)).alias("sketch"))


def merged_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``estimate`` of the distinct values per coarser group of merged sketches."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def quantile_sketches(df: DataFrame, value: Column | str, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """One quantile sketch ``sketch`` of the known values per group."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probs: dict[str, float], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``n`` and the quantiles per coarser group of merged sketches; each is one of the values."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_sketch"))
    asked = [F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return merged.select(*by, F.kll_sketch_get_n_double("_sketch").alias("n"), *asked)
