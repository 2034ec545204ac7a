"""Classification-metric bundles: every rate of every group from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import col, flag
from twosight.operators.bootstrap import bootstrap_auc
from twosight.operators.inference import welch_columns
from twosight.operators.ranks import auc
from twosight.operators.reshape import append, wider

# --- fixed values: metric labels and interval factor that results must match ---
POSITIVE = "Fraction of predicted positives"
ACCURACY = "Accuracy"
FPR = "False positive rate (FPR)"
FNR = "False negative rate (FNR)"
PPV = "Positive predicted value (PPV)"
AUC = "Area under the curve (AUC)"
BASE = "Base rate"
Z95 = 1.96
# --- end of fixed values ---

METRIC_ORDER = [POSITIVE, ACCURACY, FPR, FNR, PPV, AUC, BASE]


def _definitions(label: Column, pred: Column) -> dict[str, tuple[Column, Column]]:
    """Per metric: which rows count, and the 0/1 value averaged over them."""
    everyone = F.lit(True)
    wrong = flag(pred != label)
    return {
        POSITIVE: (everyone, pred),
        ACCURACY: (everyone, flag(pred == label)),
        FPR: (label == 0, wrong),
        FNR: (label == 1, wrong),
        PPV: (pred == 1, label),
        BASE: (everyone, label),
    }


def metric_moments(
    df: DataFrame,
    by: Sequence[str] = (),
    label: Column | str = "outcome",
    pred: Column | str = "qb",
    metrics: Sequence[str] = (POSITIVE, ACCURACY, FPR, FNR, PPV),
    na_rm: bool = False,
) -> DataFrame:
    """``n, mean, var`` of the 0/1 values behind each metric, one row per (group, metric).

    With ``na_rm=False`` a missing value among the rows that count makes the metric NULL.
    """
    chosen = {m: d for m, d in _definitions(col(label).cast("int"), col(pred).cast("int")).items() if m in metrics}
    aggs = []
    for k, (counts, value) in enumerate(chosen.values()):
        v = F.when(counts, value.cast("double"))
        aggs += [
            F.count(v).alias(f"_n{k}"),
            F.count(F.when(counts, 1)).alias(f"_rows{k}"),
            F.avg(v).alias(f"_m{k}"),
            F.var_samp(v).alias(f"_v{k}"),
        ]

    def known(name: str, k: int) -> Column:
        c = F.col(f"{name}{k}")
        return c if na_rm else F.when(F.col(f"_n{k}") == F.col(f"_rows{k}"), c)

    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.lit(METRIC_ORDER.index(m)).alias("ord"),
            F.col(f"_rows{k}").alias("n"),
            known("_m", k).alias("mean"),
            known("_v", k).alias("var"),
        )
        for k, m in enumerate(chosen)
    ]
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def with_interval(df: DataFrame, value: str = "value", se: str = "se", z: float = Z95) -> DataFrame:
    """Add ``lb`` and ``ub`` = value -/+ z standard errors."""
    return df.withColumns({"lb": F.col(value) - z * F.col(se), "ub": F.col(value) + z * F.col(se)})


def metric_bundle(
    df: DataFrame,
    by: Sequence[str] = (),
    label: Column | str = "outcome",
    pred: Column | str = "qb",
    score: Column | str | None = None,
    base_rate: bool = False,
    b: int | None = None,
    seed: int = 0,
    size: str = "group",
    na_rm: bool = False,
) -> DataFrame:
    """``metric, value, se, lb, ub, n`` per group.

    With ``score`` the area under the curve is added; with ``b`` its value is the mean of ``b``
    bootstrap replicates and lb/ub are their 2.5% and 97.5% quantiles.
    """
    names = [m for m in METRIC_ORDER if m != AUC and (m != BASE or base_rate)]
    m = metric_moments(df, by, label, pred, names, na_rm)
    out = m.select(
        *by, "metric", "ord", F.col("mean").alias("value"), F.sqrt(F.col("var") / F.col("n")).alias("se"), "n"
    )
    out = with_interval(out).withColumns(
        {c: F.when(F.col("metric") != BASE, F.col(c)) for c in ("se", "lb", "ub")}
    )
    out = out.select(*by, "metric", "ord", "value", "se", "lb", "ub", "n")
    if score is None:
        return out
    tag = [F.lit(AUC).alias("metric"), F.lit(METRIC_ORDER.index(AUC)).alias("ord")]
    if b is None:
        area = auc(df, label, score, by).select(*by, *tag, F.col("auc").alias("value"), (F.col("n_pos") + F.col("n_neg")).alias("n"))
    else:
        area = bootstrap_auc(df, label, score, by, b=b, seed=seed, size=size).select(
            *by, *tag, F.col("mean").alias("value"), "lb", "ub", "n"
        )
    return append(out, area)


def metric_pairs(
    df: DataFrame,
    group: str,
    pairs: Sequence[tuple],
    by: Sequence[str] = (),
    label: Column | str = "outcome",
    pred: Column | str = "qb",
    metrics: Sequence[str] = (POSITIVE, ACCURACY, FPR, FNR, PPV),
    na_rm: bool = True,
) -> DataFrame:
    """Welch tests of each metric between the listed pairs of groups, from the same moments."""
    m = metric_moments(df, [*by, group], label, pred, metrics, na_rm)
    options = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    rows = m.select("*", F.inline(options)).where(F.col(group).isin(F.col("a"), F.col("b")))
    keys = [*by, "metric", "ord", "a", "b"]

    def side(s: str) -> list[Column]:
        hit = F.col(group) == F.col(s)
        return [F.max(F.when(hit, F.col(c))).alias(f"{c}_{s}") for c in ("n", "mean", "var")]

    return welch_columns(rows.groupBy(*keys).agg(*side("a"), *side("b")), keys)


def metrics_wide(bundle: DataFrame, group: str, names: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """One column of metric values per group."""
    return wider(bundle, [*keys, "metric", "ord"], group, names, "value")
