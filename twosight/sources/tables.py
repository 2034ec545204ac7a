"""Readers. Schemas are declared, never inferred: inference costs a scan and is unstable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_QUESTION_SETS = (1, 2, 3)

# Table schemas as DDL; keys are 64-bit so that they hold at any number of participants or items.
SCHEMAS: dict[str, str] = {
    "predictions": (
        "id BIGINT, index BIGINT, order_question INT, survey_part INT, setting STRING, condition STRING, "
        "qp_h DOUBLE, qp_hr DOUBLE, qp_r DOUBLE, qb_h INT, qb_hr INT, qb_r INT, "
        "time_h DOUBLE, time_hr DOUBLE, outcome INT"
    ),
    "perception": ", ".join(
        [f"humanaccuracy_{k} STRING" for k in _QUESTION_SETS]
        + [f"use_binary_{k} STRING" for k in _QUESTION_SETS[1:]]
        + [f"use_likelihood_{k} STRING" for k in _QUESTION_SETS[1:]]
        + [f"confidence_{k} STRING" for k in _QUESTION_SETS]
        + [f"humanaccuracy_comparison_{k} STRING" for k in _QUESTION_SETS]
        + [f"trust_{k} STRING" for k in _QUESTION_SETS[1:]]
        + ["id BIGINT"]
    ),
    "demographics": (
        "age INT, gender STRING, race STRING, education STRING, location STRING, ml_familiarity STRING, id BIGINT"
    ),
    "time_payment": "id BIGINT, survey_time INT, mturk_time INT, bonus DOUBLE",
    "items": "index BIGINT, y INT, race STRING",
    "items_full": "index BIGINT, prs STRING, ogs INT, incar STRING, crimecat STRING",
    "descriptions": "index BIGINT, description STRING",
    "model_matrix": "ogs INT, prs STRING, mean_qb DOUBLE",
    "judge_matrix": "ogs INT, prs STRING, incar DOUBLE",
}


def _schema(schema: str | T.StructType) -> str | T.StructType:
    return SCHEMAS.get(schema, schema) if isinstance(schema, str) else schema


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """Header CSV with ``NA`` for missing. ``schema`` is a name in ``SCHEMAS``, DDL text or a StructType."""
    return (
        spark.read.schema(_schema(schema))
        .option("header", True)
        .option("sep", sep)
        .option("nullValue", "NA")
        .option("enforceSchema", False)
        .csv(path)
    )


def read_tsv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_parquet(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
