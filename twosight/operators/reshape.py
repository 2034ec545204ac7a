"""Wide/long reshaping. Long forms are one narrow pass, never a union of scans."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSESSMENT_KEYS = (
    "id", "index", "order_question", "survey_part", "setting", "condition", "outcome",
)


def select_matching(df: DataFrame, pattern: str, plus: Sequence[str] = ()) -> DataFrame:
    """Columns whose name contains the pattern, then the named ones."""
    chosen = [c for c in df.columns if re.search(pattern, c)]
    return df.select(*chosen, *[c for c in plus if c not in chosen])


def strip_from_names(df: DataFrame, text: str) -> DataFrame:
    """Remove the first occurrence of ``text`` from every column name."""
    return df.toDF(*[c.replace(text, "", 1) for c in df.columns])


def mutate_each(df: DataFrame, columns: Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def append(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; columns missing in one frame become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def longer(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "type", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in values], name, value)


def wider(
    df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence, values_from: str | Column
) -> DataFrame:
    """One column per listed name. The names are given, so no extra job looks for them."""
    value = F.col(values_from) if isinstance(values_from, str) else values_from
    return df.groupBy(*keys).pivot(names_from, list(names)).agg(F.first(value, ignorenulls=True))


def paired_longer(
    df: DataFrame, ids: Sequence[str], variants: dict[str, dict[str, Column | str]], name: str = "type"
) -> DataFrame:
    """Wide to long keeping measures that belong together in one row.

    ``variants`` maps each type label to its measures, e.g. ``{"h": {"qp": "qp_h", "qb": "qb_h"}}``.
    """
    # Only the label is exploded; each measure is then picked by it. Measures that a query does not
    # use are pruned down to the scan, which an exploded array of structs would prevent.
    measures = list(dict.fromkeys(m for columns in variants.values() for m in columns))
    exploded = df.withColumn(name, F.explode(F.array(*[F.lit(label) for label in variants])))

    def pick(measure: str) -> Column:
        out = F
        for label, columns in variants.items():
            c = columns.get(measure)
            if c is not None:
                out = out.when(F.col(name) == label, F.col(c) if isinstance(c, str) else c)
        return out

    return exploded.select(*ids, name, *[pick(m).alias(m) for m in measures])


def assessments_long(
    predictions: DataFrame,
    types: Sequence[str] = ("h", "hr"),
    keep: Sequence[str] | None = None,
    complete: Sequence[str] = ("qp",),
) -> DataFrame:
    """One row per given answer: ``type`` with its ``qp``, ``qb`` and ``time`` next to the model's
    ``qp_r`` and ``qb_r``.

    A row is dropped when a column of ``complete`` is missing: ``("qp",)`` drops unanswered ones;
    name more columns to require all of them.
    """
    have = predictions.columns
    ids = [c for c in (*(keep or ASSESSMENT_KEYS), "grp", "race") if c in have]
    model = [c for c in ("qp_r", "qb_r") if c in have]
    variants = {
        t: {
            "qp": f"qp_{t}",
            "qb": f"qb_{t}",
            **({"time": f"time_{t}"} if f"time_{t}" in have else {}),
        }
        for t in types
    }
    long = paired_longer(predictions, list(dict.fromkeys([*ids, *model])), variants)
    return long.dropna(how="any", subset=list(complete))


def question_sets_long(df: DataFrame, ids: Sequence[str] = ("id",), sets: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Answers of question sets ``<name>_<k>`` to one row per (participant, set) with ``set_q``.

    A question that a set did not ask becomes NULL.
    """
    asked: dict[int, dict[str, str]] = {}
    for k in sets:
        part = select_matching(df.drop(*ids), rf"_{k}$")
        asked[k] = dict(zip(strip_from_names(part, f"_{k}").columns, part.columns))
    names = list(dict.fromkeys(n for columns in asked.values() for n in columns))
    label = F.explode(F.array(*[F.lit(k) for k in sets]))
    exploded = df.withColumn("set_q", label)

    def pick(n: str) -> Column:
        out = F
        for k, columns in asked.items():
            if n in columns:
                out = out.when(F.col("set_q") == k, F.col(columns[n]))
        return out

    return exploded.select(*ids, "set_q", *[pick(n).alias(n) for n in names])


def positives_by_name(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of given answers per column and in all, as one row."""
    counts = [F.count(c).alias(c) for c in columns]
    total = sum((F.count(c) for c in columns[1:]), F.count(columns[0]))
    return df.agg(*counts, total.alias("total"))
