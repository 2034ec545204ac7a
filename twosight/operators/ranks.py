"""Rank statistics from value cells.

Rows are first reduced to one row per (group, value) with class counts; average ranks follow from
the counts below each value. No rank is ever computed by sorting a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import col, count_if
from twosight.functions.pvalues import p_chi2, p_normal, p_student
from twosight.operators.inference import correlation_t
from twosight.operators.ordered import join_stat_by_range, prefix_sums, ranged


def _average_rank(n: str, before: str) -> Column:
    return F.col(before) + (F.col(n) + 1) / F.lit(2.0)


def _tie_term(n: str) -> Column:
    t = F.col(n).cast("double")
    return t * t * t - t


def auc(
    df: DataFrame, label: Column | str, score: Column | str, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Area under the ROC curve for event ``label == 1``; equal scores count one half."""
    known = df.select(*by, col(label).cast("int").alias("_y"), col(score).cast("double").alias("_s")).dropna(
        subset=["_y", "_s"]
    )
    cells = known.groupBy(*by, "_s").agg(
        count_if(F.col("_y") == 1).alias("pos"), count_if(F.col("_y") == 0).alias("neg")
    )
    ranked = prefix_sums(cells, ["_s"], {"neg": F.col("neg")}, by, ranges)
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    sums = ranked.groupBy(*by).agg(
        F.sum(wins).alias("_u"), F.sum("pos").alias("n_pos"), F.max("neg_total").alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return sums.select(*by, F.try_divide("_u", pairs).alias("auc"), "n_pos", "n_neg")


def auc_spread(
    df: DataFrame, label: Column | str, score: Column | str, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """``auc, sd, n_pos, n_neg``: the area under the ROC curve and its standard deviation from placement values.

    The placement of an event is the share of non-events below its score, that of a non-event the share of events
    above; equal scores count one half. The variance of the area is the sum of the two placement variances, each over
    its own number of rows (DeLong). NULL where a class has fewer than two rows.
    """
    known = df.select(*by, col(label).cast("int").alias("_y"), col(score).cast("double").alias("_s")).dropna(subset=["_y", "_s"])
    cells = known.groupBy(*by, "_s").agg(count_if(F.col("_y") == 1).alias("pos"), count_if(F.col("_y") == 0).alias("neg"))
    ranked = prefix_sums(cells, ["_s"], {"neg": F.col("neg"), "pos": F.col("pos")}, by, ranges)
    event = F.try_divide(F.col("neg_before") + F.col("neg") / 2.0, F.col("neg_total"))
    other = 1 - F.try_divide(F.col("pos_before") + F.col("pos") / 2.0, F.col("pos_total"))
    sums = ranked.select(*by, "pos", "neg", event.alias("_e"), other.alias("_o")).groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * F.col("_e")).alias("_e1"),
        F.sum(F.col("pos") * F.col("_e") * F.col("_e")).alias("_e2"), F.sum(F.col("neg") * F.col("_o")).alias("_o1"),
        F.sum(F.col("neg") * F.col("_o") * F.col("_o")).alias("_o2"),
    )

    def part(n: str, first: str, second: str) -> Column:
        count = F.col(n).cast("double")
        return F.try_divide(F.greatest(F.col(second) - F.try_divide(F.col(first) * F.col(first), count), F.lit(0.0)), count * (count - 1))

    sd = F.sqrt(part("n_pos", "_e1", "_e2") + part("n_neg", "_o1", "_o2"))
    return sums.select(*by, F.try_divide(F.col("_e1"), F.col("n_pos").cast("double")).alias("auc"), sd.alias("sd"), "n_pos", "n_neg")


def rank_sum(
    df: DataFrame,
    value: Column | str,
    group: Column | str,
    a,
    b,
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Rank-sum test of ``value`` between ``group == a`` and ``group == b``: ``w`` of sample a, ``z``
    with continuity and tie correction, two-sided ``p``.

    All strata of ``by`` are tested in one job.
    """
    rows = df.select(*by, col(value).cast("double").alias("_v"), col(group).alias("_g")).where(
        F.col("_v").isNotNull() & F.col("_g").isin([a, b])
    )
    cells = rows.groupBy(*by, "_v").agg(count_if(F.col("_g") == a).alias("na"), F.count(F.lit(1)).alias("n"))
    ranked = prefix_sums(cells, ["_v"], {"n": F.col("n")}, by, ranges)
    s = ranked.groupBy(*by).agg(
        F.sum(F.col("na") * _average_rank("n", "n_before")).alias("_ra"),
        F.sum("na").alias("n_a"),
        F.max("n_total").alias("_n"),
        F.sum(_tie_term("n")).alias("_ties"),
    )
    n, na = F.col("_n").cast("double"), F.col("n_a").cast("double")
    nb = n - na
    w = F.col("_ra") - na * (na + 1) / 2
    gap = w - na * nb / 2
    variance = na * nb / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("_ties"), n * (n - 1)), F.lit(0.0)))
    z = F.try_divide(gap - F.signum(gap) * 0.5, F.sqrt(variance))
    both = (na > 0) & (nb > 0)
    out = s.select(
        *by, "n_a", (F.col("_n") - F.col("n_a")).alias("n_b"), F.when(both, w).alias("w"), F.when(both, z).alias("z")
    )
    return out.withColumn("p", p_normal("z"))


def kruskal(
    df: DataFrame, value: Column | str, group: Column | str, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Kruskal-Wallis ``h`` with tie correction over any number of groups."""
    rows = df.select(*by, col(value).cast("double").alias("_v"), col(group).alias("_g")).dropna(subset=["_v", "_g"])
    classes = ranged(rows.groupBy(*by, "_v", "_g").agg(F.count(F.lit(1)).alias("c")), ["_v", "_g"], by, ranges)
    cells = classes.groupBy(*by, "_v").agg(F.sum("c").alias("n"))
    ranked = prefix_sums(cells, ["_v"], {"n": F.col("n")}, by, ranges).select(
        *by, "_v", _average_rank("n", "n_before").alias("_rank"), "n", "n_total"
    )
    # The cell's own size rides along once per class; c/n shares it out so that it is counted once. A common value of
    # many classes lies in several ranges: its rank goes to the (range, value) pairs and from there to the classes.
    scored = join_stat_by_range(classes, ranked, [*by, "_v"])
    per_class = scored.groupBy(*by, "_g").agg(
        F.sum(F.col("c") * F.col("_rank")).alias("_r"),
        F.sum("c").cast("double").alias("_m"),
        F.max("n_total").cast("double").alias("_n"),
        F.sum(F.col("c") * (F.col("n").cast("double") * F.col("n") - 1)).alias("_ties"),
    )
    s = per_class.groupBy(*by).agg(
        F.sum(F.col("_r") * F.col("_r") / F.col("_m")).alias("_q"),
        F.max("_n").alias("_n"),
        F.sum("_ties").alias("_ties"),
        F.count(F.lit(1)).alias("groups"),
    )
    n = F.col("_n")
    h = F.try_divide(
        F.lit(12.0) / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.try_divide(F.col("_ties"), n * n * n - n)
    )
    enough = F.col("groups") > 1
    out = s.select(
        *by,
        n.cast("long").alias("n"),
        "groups",
        F.when(enough, h).alias("h"),
        F.when(enough, (F.col("groups") - 1).cast("double")).alias("dof"),
    )
    return out.withColumn("p", p_chi2("h", "dof"))


def spearman(
    df: DataFrame, x: Column | str, y: Column | str, by: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Rank correlation with average ranks and its t approximation; incomplete pairs are left out."""
    pairs = df.select(*by, col(x).cast("double").alias("_x"), col(y).cast("double").alias("_y")).dropna(
        subset=["_x", "_y"]
    )
    joint = ranged(pairs.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("c")), ["_x", "_y"], by, ranges)

    def ranks(v: str, name: str) -> DataFrame:
        cells = joint.groupBy(*by, v).agg(F.sum("c").alias("n"))
        ranked = prefix_sums(cells, [v], {"n": F.col("n")}, by, ranges)
        return ranked.select(
            *by, v, (_average_rank("n", "n_before") - (F.col("n_total") + 1) / F.lit(2.0)).alias(name)
        )

    # A common value of one side goes with many of the other; the ranges of (value, other) split it, for each side anew.
    by_x = join_stat_by_range(joint, ranks("_x", "rx"), [*by, "_x"]).drop("_range")
    both = join_stat_by_range(ranged(by_x, ["_y", "_x"], by, ranges), ranks("_y", "ry"), [*by, "_y"])
    s = both.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * F.col("rx") * F.col("ry")).alias("_xy"),
        F.sum(F.col("c") * F.col("rx") * F.col("rx")).alias("_xx"),
        F.sum(F.col("c") * F.col("ry") * F.col("ry")).alias("_yy"),
    )
    rho = F.try_divide("_xy", F.sqrt(F.col("_xx") * F.col("_yy")))
    out = s.select(*by, "n", rho.alias("rho")).withColumn("t", correlation_t(F.col("rho"), F.col("n")))
    return out.withColumn("p", p_student("t", (F.col("n") - 2).cast("double")))
