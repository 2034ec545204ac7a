"""The corpus pipeline: documents to a mixed training set, in stages that are each written and read again."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twosight.llm import benchmark, common, language, lines, mixing, neardup
from twosight.llm.queries import HELD_PERCENT, RUN_WORDS, SHINGLE, table

#: The stages run EM and compare sets, which SQL doesn't express; tests/llm compares them with brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a language: null texts and texts without letters. A null lang becomes the language found.

    The rest stay as they are, a given lang too. The model is learned from the texts and languages of the documents it
    judges; where no language is given, all texts with letters stay, without lang."""
    learned = common.written(language.train(docs, F.lit(True)))
    if learned.isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs.select("*"), learned)
    found = found.where(F.col("lang_pred") != language.UNDETERMINED)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; n_chars follows the text. A document none of whose words are left goes."""
    found = lines.without_repeats(docs, RUN_WORDS)
    found = found.where((F.col("removed_lines") == 0) | (F.col("removed_lines") < F.col("n_lines")))
    return found.withColumn("n_chars", F.when(F.col("removed_lines") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity 0.8, the smallest id stays.

    Of equal ids one row stays. Null and blank texts are like nothing and stay; a text of fewer than five words is one shingle."""
    return neardup.near_duplicates(docs, percent=80, n=5).where("representative").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold at least 80% of a benchmark item's five-word shingles. Null and blank texts and items
    hold nothing; an item of fewer than five words is one shingle. Repeated rows are judged alike."""
    return benchmark.without(docs, table(spark, sf_dir, "benchmark"), HELD_PERCENT, SHINGLE).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, output: str | None = None) -> DataFrame:
    """Every remaining document with the words that the mix takes of it (0: none), repeats counted. Null and blank texts
    take nothing; repeated rows are separate documents. output: a folder to which the mixed texts are written, as Parquet
    in the order of their slots (slot, source, rank, at, doc_id, first_word, last_word, text, doc_at)."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0, output=output)


_left: dict[str, list[str]] = {}


def tidy(stage):
    """The stage, first deleting the scratch tables that the stage before it made and nothing else reads any more: what
    that stage returned has been written and read again."""

    @functools.wraps(stage)
    def started(spark: SparkSession, docs: DataFrame, sf_dir: str, **options) -> DataFrame:
        app = spark.sparkContext.applicationId
        common.discard(spark, _left.pop(app, []), keep=docs)
        before = set(common.folders(spark))
        found = stage(spark, docs, sf_dir, **options)
        _left[app] = [folder for folder in common.folders(spark) if folder not in before]
        return found

    return started


STAGES = [
    ("language_id", tidy(language_id)),
    ("line_dedup", tidy(line_dedup)),
    ("near_dedup", tidy(near_dedup)),
    ("decontamination", tidy(decontamination)),
    ("mixture", tidy(mixture)),
]


def run(spark: SparkSession, sf_dir: str, output: str | None = None) -> DataFrame:
    """The stages over documents, each result written as Parquet in the shared scratch folder and read as the next one's docs.

    output: a folder for the mixed texts, the training set; without it only the report of the mix is returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        options = {"output": output} if name == "mixture" and output is not None else {}
        docs = common.written(stage(spark, docs, sf_dir, **options))
    return docs
