"""Operating points and logistic regression with classical and robust standard errors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import col, count_if, round_even
from twosight.functions.pvalues import normal_two_sided, p_normal
from twosight.operators.joins import attach, with_group_stat
from twosight.session import stable

#: Steps of a logistic fit; one that needs more raises.
MAX_STEPS = 50


# --- operating points -------------------------------------------------------------------------


def _thresholds_below(score: Column, grid: int) -> Column:
    """How many of the thresholds i/grid, i = 0..grid, lie strictly below the score."""
    step = F.lit(1.0 / grid)
    guess = F.floor(score * grid).cast("int")
    start = F.greatest(guess - 1, F.lit(0))
    near = sum(
        (F.when((start + k <= grid) & ((start + k) * step < score), 1).otherwise(0) for k in range(1, 4)),
        F.when(start * step < score, 1).otherwise(0),
    )
    return F.least(start, F.lit(grid + 1)) + near


def _rows_above(i: Column) -> Column:
    """Rows above threshold number ``i``: bin k of the map (at most grid+2 of them) exceeds thresholds 0..k-1."""
    return F.aggregate(
        F.map_entries("_bins"),
        F.lit(0).cast("long"),
        lambda acc, e: acc + F.when(e["key"] > i, e["value"]).otherwise(F.lit(0)),
    )


def share_above(df: DataFrame, score: Column | str, by: Sequence[str] = (), grid: int = 100) -> DataFrame:
    """Share of scores above each threshold i/grid: ``threshold, share`` from one aggregate.

    Every score adds to one of grid+2 bins; the shares are suffix sums over those bins.
    """
    s = col(score).cast("double")
    bins = (
        df.select(*by, s.alias("_s")).where(F.col("_s").isNotNull())
        .groupBy(*by, _thresholds_below(F.col("_s"), grid).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    )
    total = bins.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_k", "_n"))).alias("_bins")
    )
    above = _rows_above(F.col("_i"))
    steps = total.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid))))
    return steps.select(
        *by, (F.col("_i") * F.lit(1.0 / grid)).alias("threshold"), F.try_divide(above, F.col("n")).alias("share"), "n"
    )


def match_threshold(
    df: DataFrame, score: Column | str, target: float | Column, by: Sequence[str] = (), grid: int = 100
) -> DataFrame:
    """Largest threshold on the grid whose share of scores above it is still at least ``target``.

    ``target`` may be a number, a one-value subquery (``frame.scalar()``) or an aggregate of ``share_above``.
    """
    goal = target if isinstance(target, Column) else F.lit(float(target))
    shares = share_above(df, score, by, grid)
    return shares.groupBy(*by).agg(F.max(F.when(F.col("share") >= goal, F.col("threshold"))).alias("threshold"))


def match_rate(
    df: DataFrame, model: Column, score: Column | str, answer: Column | str, digits: int = 3, grid: int = 100
) -> DataFrame:
    """``rate`` of positive answers among the rows outside ``model`` (rounded), and the largest
    ``threshold`` at which the model rows exceed the threshold at least that often.

    One pass: every row adds to one of 2 x (grid + 2) cells; the rest works on those cells.
    """
    s = col(score).cast("double")
    cells = (
        df.select(model.alias("_m"), s.alias("_s"), col(answer).cast("double").alias("_a"))
        .groupBy("_m", F.when(F.col("_m"), _thresholds_below(F.col("_s"), grid)).alias("_k"))
        .agg(F.count("_s").alias("_n"), F.sum("_a").alias("_sum"), F.count("_a").alias("_known"))
    )
    one = cells.agg(
        round_even(
            F.try_divide(F.sum(F.when(~F.col("_m"), F.col("_sum"))), F.sum(F.when(~F.col("_m"), F.col("_known")))), digits
        ).alias("rate"),
        F.sum(F.when(F.col("_m"), F.col("_n"))).alias("_all"),
        F.map_from_entries(F.collect_list(F.when(F.col("_m") & F.col("_k").isNotNull(), F.struct("_k", "_n")))).alias("_bins"),
    )
    steps = one.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(grid))))
    share = F.try_divide(_rows_above(F.col("_i")), F.col("_all"))
    fits = F.when(share >= F.col("rate"), F.col("_i") * F.lit(1.0 / grid))
    return steps.select("rate", fits.alias("_t")).groupBy("rate").agg(F.max("_t").alias("threshold"))


def apply_threshold(score: Column | str, threshold: Column | float, closed: bool = False) -> Column:
    """1 when the score exceeds the threshold (or reaches it, if ``closed``), 0 otherwise."""
    s = col(score)
    return (s >= threshold if closed else s > threshold).cast("int")


def add_rethresholded(
    long: DataFrame, threshold: DataFrame, source: str = "r", name: str = "re", closed: bool = True
) -> DataFrame:
    """Append a predictor ``name``: the rows of ``source`` with ``qb`` set by the matched threshold.

    Each row of ``source`` is emitted twice by one narrow pass, so the input is not read again, and
    columns that a query does not use are still pruned.
    """
    cut = with_group_stat(long, threshold, [])
    copies = F.when(F.col("type") == source, F.array("type", F.lit(name))).otherwise(F.array("type"))
    doubled = cut.withColumn("_type", F.explode(copies))
    again = F.col("_type") == name
    new = {
        "type": F.col("_type"),
        "qb": F.when(again, apply_threshold("qp", F.col("threshold"), closed)).otherwise(F.col("qb")),
    }
    return doubled.select(*[new[c].alias(c) if c in new else F.col(c) for c in long.columns])


# --- logistic regression ----------------------------------------------------------------------


def patterns(
    df: DataFrame, y: Column | str, numeric: Sequence[str] = (), category: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct covariate pattern with the counts of y = 1 and y = 0, written once.

    ``_t0, _t1, ...`` hold the numeric covariates, ``_c`` the category as text. The fit and the robust
    errors read this frame many times; the source is scanned only once.
    """
    terms = [F.col(c).cast("double").alias(f"_t{i}") for i, c in enumerate(numeric)]
    if category is not None:
        terms.append(F.col(category).cast("string").alias("_c"))
    rows = df.select(*by, col(y).cast("int").alias("_y"), *terms)
    names = [c for c in rows.columns if c not in (*by, "_y")]
    return stable(
        rows.dropna(subset=["_y", *names]).groupBy(*by, *names)
        .agg(count_if(F.col("_y") == 1).alias("_n1"), count_if(F.col("_y") == 0).alias("_n0"))
    )


class LogitFit:
    """A fitted model: term names, estimates, classical errors, and its covariate patterns with their
    non-zero design entries ``_e`` (place of the term, value) and fitted probability ``_mu``."""

    def __init__(self, terms: list[str], beta: np.ndarray, se: np.ndarray, cells: DataFrame):
        self.terms, self.beta, self.se, self.cells = terms, beta, se, cells

    def _table(self, se: np.ndarray) -> DataFrame:
        rows = [
            (t, float(b), float(s), float(b / s), normal_two_sided(b / s)) for t, b, s in zip(self.terms, self.beta, se)
        ]
        schema = "term string, estimate double, std_error double, statistic double, p double"
        return self.cells.sparkSession.createDataFrame(rows, schema)

    def tidy(self) -> DataFrame:
        """``term, estimate, std_error, statistic, p`` with model-based errors."""
        return self._table(self.se)

    def robust(self) -> DataFrame:
        """The same with heteroskedasticity-consistent (HC0 sandwich) errors."""
        bread, meat = self._cross_products()
        inverse = np.linalg.inv(bread)
        return self._table(np.sqrt(np.diag(inverse @ meat @ inverse)))

    def _cross_products(self) -> tuple[np.ndarray, np.ndarray]:
        """X'WX and the sum of squared scores, from the pairs of a pattern's non-zero entries.

        A pattern has few of them however many levels there are; the driver gets the p x p sums."""
        mu = F.col("_mu")
        w = (F.col("_n1") + F.col("_n0")) * mu * (1 - mu)
        r = F.col("_n1") * (1 - mu) * (1 - mu) + F.col("_n0") * mu * mu
        one = self.cells.select(w.alias("_w"), r.alias("_r"), "_e", F.explode("_e").alias("a"))
        two = one.select("_w", "_r", "a", F.explode("_e").alias("b")).where("a.i <= b.i")
        product = F.col("a.x") * F.col("b.x")
        sums = two.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j"))
        sums = sums.agg(F.sum(F.col("_w") * product).alias("w"), F.sum(F.col("_r") * product).alias("r"))
        bread, meat = np.zeros((2, len(self.terms), len(self.terms)))
        for i, j, a, b in sums.collect():
            bread[i, j] = bread[j, i] = a
            meat[i, j] = meat[j, i] = b
        return bread, meat


def _entries(numeric: int, levels: int, interact: bool) -> Column:
    """The non-zero design entries of a pattern: intercept, numeric terms, its level, and their products.

    Level number ``_i`` counts down from the last in code-point order; number ``levels - 1``, the first, is the base.
    """
    def entry(place, value) -> Column:
        return F.struct(place.cast("int").alias("i"), value.alias("x"))

    values = [F.col(f"_t{k}") for k in range(numeric)]
    plain = F.array(entry(F.lit(0), F.lit(1.0)), *[entry(F.lit(k + 1), v) for k, v in enumerate(values)])
    if levels < 2:
        return plain
    at = F.lit(levels - 2) - F.col("_i")
    own = [entry(at + 1 + numeric, F.lit(1.0))]
    if interact:
        own += [entry(at + 1 + numeric + (k + 1) * (levels - 1), v) for k, v in enumerate(values)]
    return F.when(F.col("_i") < levels - 1, F.concat(plain, F.array(*own))).otherwise(plain)


def fit_patterns(cells: DataFrame, numeric: Sequence[str], category: str | None = None, interact: bool = False) -> LogitFit:
    """Binomial GLM with logit link on covariate patterns; the optimiser runs as Spark jobs over them.

    A category is one sparse vector: a 0/1 term for every level but the first in code-point order and, if
    asked, its products with the numeric terms. The number of levels has no bound here; the GLM itself
    raises beyond the number of terms that it can solve for.
    """
    names = [f"_t{i}" for i in range(len(numeric))]
    parts, levels = list(names), []
    if category is not None:
        index = StringIndexer(inputCol="_c", outputCol="_i", stringOrderType="alphabetDesc").fit(cells)
        levels = list(reversed(index.labels))
        cells = index.transform(cells)
        if len(levels) > 1:
            cells = OneHotEncoder(inputCols=["_i"], outputCols=["_level"]).fit(cells).transform(cells)
            parts.append("_level")
            for n in names if interact else []:
                cells = Interaction(inputCols=[n, "_level"], outputCol=f"{n}_level").transform(cells)
                parts.append(f"{n}_level")
    dummies = [f"{category}{v}" for v in levels[1:]]
    terms = ["(Intercept)", *numeric, *dummies, *[f"{c}:{d}" for c in numeric if interact for d in dummies]]
    # One row per pattern with its share of positives: the optimiser then starts from those shares.
    # (0/1 rows with large weights would start it far away, where Newton steps can diverge.)
    n = (F.col("_n1") + F.col("_n0")).cast("double")
    rows = cells.withColumns({"_y": F.col("_n1") / n, "_w": n, "_e": _entries(len(names), len(levels), interact)})
    rows = VectorAssembler(inputCols=parts, outputCol="_x").transform(rows)
    model = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol="_mu", tol=1e-12, maxIter=MAX_STEPS
    ).fit(rows)
    if model.summary.numIterations >= MAX_STEPS:
        raise ArithmeticError(f"the logistic fit did not converge in {MAX_STEPS} steps")
    errors = model.summary.coefficientStandardErrors
    # The encoder counts levels down from the last; the terms run upwards.
    place = [0, *range(1, len(names) + 1)]
    for block in range(1 + interact * len(names) if dummies else 0):
        start = 1 + len(names) + block * len(dummies)
        place += range(start + len(dummies) - 1, start - 1, -1)
    beta = np.array([model.intercept, *model.coefficients.toArray()])[place]
    se = np.array([errors[-1], *errors[:-1]])[place]
    return LogitFit(terms, beta, se, model.transform(rows).select("_n1", "_n0", "_e", "_mu"))


def fit_logit(
    df: DataFrame,
    y: Column | str,
    numeric: Sequence[str] = (),
    category: str | None = None,
    interact: bool = False,
) -> LogitFit:
    return fit_patterns(patterns(df, y, numeric, category), numeric, category, interact)


def logit(df: DataFrame, y: Column | str, numeric: Sequence[str] = (), category: str | None = None, interact: bool = False) -> DataFrame:
    return fit_logit(df, y, numeric, category, interact).tidy()


def robust_logit(df: DataFrame, y: Column | str, numeric: Sequence[str] = (), category: str | None = None, interact: bool = False) -> DataFrame:
    return fit_logit(df, y, numeric, category, interact).robust()


def logit_levels(df: DataFrame, y: Column | str, numeric: Sequence[str], category: str, tol: float = 1e-10) -> DataFrame:
    """``term, estimate, std_error, statistic, p`` of a logit fit with a category of any number of levels.

    Newton's system is diagonal in the levels, bordered by the few numeric terms: the levels are eliminated from it, which
    leaves one equation per numeric term (its Schur complement), and each level's own step follows from theirs. A step is one
    aggregate per level and the sums of those, linear in patterns and levels; the driver sees only the numeric terms. The
    terms are those of ``logit``: the first level in code-point order is the base. A level with one outcome only has no
    finite effect and tells nothing of the others: it gets an infinite estimate without errors and is never the base.
    """
    cells = patterns(df, y, numeric, category)
    t = [F.col(f"_t{i}") for i in range(len(numeric))]
    size = len(t)
    kinds = cells.groupBy("_c").agg(F.sum("_n1").alias("_n1"), F.sum("_n0").alias("_n0"))
    start = F.log(F.col("_n1").cast("double") / F.col("_n0"))
    levels = stable(kinds.where("_n1 > 0 and _n0 > 0").select("_c", start.alias("_a"), F.lit(float("inf")).alias("_step")))
    slopes = np.zeros(size)
    for _ in range(MAX_STEPS):
        line = sum((F.lit(float(b)) * x for b, x in zip(slopes, t)), F.col("_a"))
        n = (F.col("_n1") + F.col("_n0")).cast("double")
        mu = 1 / (1 + F.exp(-line))
        rows = attach(cells, levels, ["_c"]).select("*", (n * mu * (1 - mu)).alias("_w"), (F.col("_n1") - n * mu).alias("_r"))
        per = rows.groupBy("_c").agg(
            F.max("_a").alias("_a"), F.max("_step").alias("_step"), F.sum("_w").alias("w"), F.sum("_r").alias("r"),
            F.array(*[F.sum(F.col("_w") * x) for x in t]).cast("array<double>").alias("c"),
            F.array(*[F.sum(F.col("_r") * x) for x in t]).cast("array<double>").alias("s"),
            F.array(*[F.sum(F.col("_w") * a * b) for a in t for b in t]).cast("array<double>").alias("d"),
        )
        per = stable(per)
        c = [F.col("c")[i] for i in range(size)]
        found = per.agg(
            F.max(F.abs("_step") / (1 + F.abs("_a"))).alias("step"), F.count(F.lit(1)).alias("levels"),
            *[F.sum(F.col("s")[i] - c[i] * F.col("r") / F.col("w")).alias(f"g{i}") for i in range(size)],
            *[F.sum(F.col("d")[i * size + j] - c[i] * c[j] / F.col("w")).alias(f"h{i}_{j}") for i in range(size) for j in range(size)],
        ).first()
        if not found["levels"]:
            break
        complement = np.array([[found[f"h{i}_{j}"] for j in range(size)] for i in range(size)], float).reshape(size, size)
        move = np.linalg.solve(complement, np.array([found[f"g{i}"] for i in range(size)], float)) if size else np.zeros(0)
        if found["step"] < tol and np.all(np.abs(move) < tol * (1 + np.abs(slopes))):
            break
        own = F.col("r") - sum((c[i] * float(m) for i, m in enumerate(move)), F.lit(0.0))
        levels = per.select("_c", (F.col("_a") + own / F.col("w")).alias("_a"), (own / F.col("w")).alias("_step"))
        slopes = slopes + move
    else:
        raise ArithmeticError(f"the logistic fit did not converge in {MAX_STEPS} steps")
    schema = "term string, estimate double, std_error double"
    spark = df.sparkSession
    base = per.orderBy("_c").first()
    lone = kinds.where("_n1 = 0 or _n0 = 0").select(
        F.concat(F.lit(category), "_c").alias("term"), F.when(F.col("_n1") > 0, float("inf")).otherwise(float("-inf")).alias("estimate"), F.lit(None).cast("double").alias("std_error")
    )
    if base is None:
        out = lone
    else:
        spread = np.linalg.inv(complement) if size else np.zeros((0, 0))
        lean = np.array(base["c"], float) / base["w"]
        few = [("(Intercept)", float(base["_a"]), float(np.sqrt(1 / base["w"] + lean @ spread @ lean)))]
        few += [(name, float(b), float(np.sqrt(v))) for name, b, v in zip(numeric, slopes, np.diag(spread))]
        apart = [F.col("c")[i] / F.col("w") - float(lean[i]) for i in range(size)]
        tilt = sum((apart[i] * apart[j] * float(spread[i, j]) for i in range(size) for j in range(size)), F.lit(0.0))
        others = per.where(F.col("_c") != base["_c"]).select(
            F.concat(F.lit(category), "_c").alias("term"), (F.col("_a") - float(base["_a"])).alias("estimate"), F.sqrt(1 / F.col("w") + 1 / base["w"] + tilt).alias("std_error")
        )
        out = spark.createDataFrame(few, schema).unionByName(others).unionByName(lone)
    out = out.withColumn("statistic", F.try_divide("estimate", "std_error"))
    return out.withColumn("p", p_normal("statistic"))
