"""From raw tables to the frames that the analyses use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twosight.functions.nulls import fraction, if_known, matches
from twosight.functions.recodes import confidence_class, rank_class
from twosight.operators.joins import join_on, keep_matching
from twosight.operators.reshape import ASSESSMENT_KEYS, assessments_long, mutate_each, question_sets_long


def arms(pred: DataFrame, *columns: str) -> DataFrame:
    """Distinct participants with their arm."""
    return pred.select("id", *(columns or ("condition", "setting"))).distinct()


def drop_fast(pred: DataFrame, seconds: float) -> DataFrame:
    """Leave out rows answered in under ``seconds`` (the unassisted answer decides where there is one)."""
    alone, helped = F.col("time_h"), F.col("time_hr")
    return pred.where((alone.isNotNull() & (alone >= seconds)) | (alone.isNull() & (helped >= seconds)))


def only_participants(pred: DataFrame, people: DataFrame, test: Column) -> DataFrame:
    """Rows of the participants that pass a test on their own table."""
    return keep_matching(pred, people.where(test), "id")


def used_items(items: DataFrame, pred: DataFrame, key: str = "index") -> DataFrame:
    """Items that occur in the predictions."""
    return keep_matching(items, pred.select(key).distinct(), key)


def first_answers(long: DataFrame) -> DataFrame:
    """All answers except the unassisted ones of part 2, which an assisted answer follows."""
    return long.where(~((F.col("type") == "h") & (F.col("survey_part") == 2)))


def everyone_long(pred: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """People and model in one column; rows with any missing entry are dropped.

    ``extra`` columns (of joined items) are carried along and may be missing.
    """
    keys = [c for c in ASSESSMENT_KEYS if c in pred.columns]
    return assessments_long(pred, ("h", "hr", "r"), keep=(*keys, *extra), complete=(*keys, "qp", "qb"))


def perception_long(perception: DataFrame, arm: DataFrame | None = None, wrong_total: str = "25") -> DataFrame:
    """Parsed and recoded survey answers, one row per (participant, question set).

    Answers to the second accuracy question that were given out of the wrong number of items
    (``wrong_total``) are dropped; fractions become numbers, five-level answers three classes.
    """
    names = perception.columns

    def those(prefix: str) -> list[str]:
        return [c for c in names if c.removeprefix(prefix) in ("_1", "_2", "_3") and c.startswith(prefix)]

    out = perception.withColumn(
        "humanaccuracy_2", if_known(matches("humanaccuracy_2", wrong_total), F.lit(None), F.col("humanaccuracy_2"))
    )
    out = mutate_each(out, [*those("use_binary"), *those("use_likelihood"), *those("humanaccuracy")], fraction)
    out = mutate_each(out, those("confidence"), confidence_class)
    out = mutate_each(out, those("humanaccuracy_comparison"), rank_class)
    if arm is not None:
        out = join_on(out, arm, "id")
    ids = ["id", *[c for c in ("condition", "setting") if arm is not None and c in arm.columns]]
    return question_sets_long(out, ids)


def part_two(pred: DataFrame, setting: str | None = None) -> DataFrame:
    out = pred.where(F.col("survey_part") == 2)
    return out if setting is None else out.where(F.col("setting") == setting)


def assisted(pred: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Answers given after seeing the model."""
    return assessments_long(pred, ("hr",), keep)
