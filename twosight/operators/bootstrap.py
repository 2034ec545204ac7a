"""Bootstrap interval of the area under the curve.

A resample of N rows with replacement is a multinomial draw over the (score, label) cells of a
group. The draw is split top-down: super-blocks, blocks of at most ``block_cells`` scores, cells.
Each split is seeded by (seed, group, place in the tree), so the result does not depend on how the
data is partitioned, and every task holds one block, whatever the size of the group.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twosight.functions.nulls import col, count_if
from twosight.operators.ordered import prefix_sums
from twosight.session import stable

# Ship these functions by value: workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FANOUT = 1000


def _generator(seed: int, group: int, level: int, node: int) -> np.random.Generator:
    return np.random.default_rng([seed, group & 0xFFFFFFFFFFFFFFFF, level, node])


def _split(weights: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(replicates x children) multinomial split of each replicate's draws."""
    return rng.multinomial(draws, weights / weights.sum())


def _root(b: int, seed: int):
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_super")
        draws = np.full(b, int(pdf["_size"].iloc[0]), dtype=np.int64)
        counts = _split(pdf["_w"].to_numpy(float), draws, _generator(seed, int(pdf["_group"].iloc[0]), 0, 0))
        return pd.DataFrame({"_group": pdf["_group"], "_super": pdf["_super"], "_draws": list(counts.T)})

    return draw


def _children(seed: int):
    def draw(blocks: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        group, node = int(blocks["_group"].iloc[0]), int(blocks["_super"].iloc[0])
        draws = np.asarray(parent["_draws"].iloc[0], dtype=np.int64)
        counts = _split(blocks["_w"].to_numpy(float), draws, _generator(seed, group, 1, node))
        return pd.DataFrame({"_group": blocks["_group"], "_block": blocks["_block"], "_draws": list(counts.T)})

    return draw


def _leaf(seed: int):
    def draw(cells: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("_s")
        group, node = int(cells["_group"].iloc[0]), int(cells["_block"].iloc[0])
        draws = np.asarray(parent["_draws"].iloc[0], dtype=np.int64)
        weights = np.concatenate([cells["pos"].to_numpy(float), cells["neg"].to_numpy(float)])
        rng = _generator(seed, group, 2, node)
        m = len(cells)
        rows = []
        for r, k in enumerate(draws):
            counts = _split(weights, k, rng)
            pos, neg = counts[:m], counts[m:]
            below = np.cumsum(neg) - neg
            rows.append((group, node, r, pos.sum(), neg.sum(), float((pos * (below + neg / 2.0)).sum())))
        return pd.DataFrame(rows, columns=["_group", "_block", "replicate", "pos", "neg", "u"])

    return draw


def bootstrap_auc_replicates(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    by: Sequence[str] = (),
    b: int = 300,
    seed: int = 0,
    size: str = "group",
    block_cells: int = 20_000,
    ranges: int | None = None,
) -> DataFrame:
    """``replicate, auc`` per group. ``size="total"`` draws the row count of the whole frame from
    every group, ``"group"`` the group's own row count."""
    keys = list(by)
    known = df.select(*keys, col(label).cast("int").alias("_y"), col(score).cast("double").alias("_s")).where(
        F.col("_y").isin(0, 1) & F.col("_s").isNotNull()
    )
    cells = known.groupBy(*keys, "_s").agg(
        count_if(F.col("_y") == 1).alias("pos"), count_if(F.col("_y") == 0).alias("neg")
    )
    cells = cells.withColumn("_group", F.xxhash64(F.lit(0), *[F.col(k) for k in keys]))
    placed = prefix_sums(cells, ["_s"], {"cell": F.lit(1)}, [*keys, "_group"], ranges)
    placed = stable(
        placed.select(*keys, "_group", "_s", "pos", "neg", F.floor(F.col("cell_before") / block_cells).alias("_block"))
    )
    blocks = (
        placed.groupBy("_group", "_block").agg(F.sum(F.col("pos") + F.col("neg")).alias("_w"))
        .withColumn("_super", F.floor(F.col("_block") / _FANOUT))
    )
    supers = blocks.groupBy("_group", "_super").agg(F.sum("_w").alias("_w"))
    if size == "total":
        supers = supers.withColumn("_size", blocks.agg(F.sum("_w")).scalar())
    else:
        # At most one row per block_cells * _FANOUT scores of the group.
        supers = supers.withColumn("_size", F.sum("_w").over(Window.partitionBy("_group")))
    root = supers.groupBy("_group").applyInPandas(_root(b, seed), "_group long, _super long, _draws array<long>")
    drawn = (
        blocks.groupBy("_group", "_super").cogroup(root.groupBy("_group", "_super"))
        .applyInPandas(_children(seed), "_group long, _block long, _draws array<long>")
    )
    per_block = (
        placed.drop(*keys).groupBy("_group", "_block").cogroup(drawn.groupBy("_group", "_block"))
        .applyInPandas(_leaf(seed), "_group long, _block long, replicate int, pos long, neg long, u double")
    )
    # Blocks are ordered by score: a positive beats every negative drawn in an earlier block.
    ahead = (
        Window.partitionBy("_group", "replicate").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    lower = F.coalesce(F.sum("neg").over(ahead), F.lit(0))
    totals = (
        per_block.withColumn("u", F.col("u") + F.col("pos") * lower)
        .groupBy("_group", "replicate").agg(F.sum("u").alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    )
    pairs = F.col("p").cast("double") * F.col("q")
    replicates = totals.select("_group", "replicate", F.try_divide("u", pairs).alias("auc"))
    names = placed.groupBy(*keys, "_group").agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
    return names.join(replicates, "_group").select(*keys, "n", "replicate", "auc")


def bootstrap_auc(
    df: DataFrame,
    label: Column | str,
    score: Column | str,
    by: Sequence[str] = (),
    b: int = 300,
    seed: int = 0,
    size: str = "group",
    block_cells: int = 20_000,
    ranges: int | None = None,
) -> DataFrame:
    """Per group the mean of the replicates and their 2.5% and 97.5% quantiles."""
    reps = bootstrap_auc_replicates(df, label, score, by, b, seed, size, block_cells, ranges)
    interval = F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975)))  # b values per group
    out = reps.groupBy(*by).agg(
        F.avg("auc").alias("mean"), interval.alias("_q"), F.count(F.lit(1)).alias("replicates"), F.max("n").alias("n")
    )
    return out.select(*by, "mean", F.col("_q")[0].alias("lb"), F.col("_q")[1].alias("ub"), "replicates", "n")
