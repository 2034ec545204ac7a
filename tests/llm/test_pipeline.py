"""The pipeline's stages on messy and empty tables, each written and read again."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline

BASE = " ".join(f"word{i}" for i in range(60))
PASSAGE = " ".join(f"item{i}" for i in range(20))
ROWS = [
    (1, BASE, "en", "a", len(BASE), "x"), (2, BASE, "en", "b", len(BASE), "x"), (2, BASE, "en", "b", len(BASE), "x"), (3, None, "en", "a", 0, "x"),
    (4, "", None, None, 0, "x"), (5, "12 34", "en", "a", 5, "x"), (6, f"before it {PASSAGE} after it", "en", "b", 1, "x"), (None, "other words altogether here", "en", None, 1, "x"),
    (7, "Ein ganz anderer Text mit eigenen Worten", "de", "c", 40, "x"), (8, "long " + " ".join(f"w{i}" for i in range(30_000)), "en", "c", 1, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string"


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame([(0, PASSAGE), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def staged(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out/{name}")
        docs = spark.read.parquet(f"{folder}/out/{name}")
        kept[name] = docs
    return kept


def test_messy_documents(spark, folder):
    kept = staged(spark, spark.createDataFrame(ROWS, SCHEMA), folder)
    ids = lambda name: sorted((r.doc_id for r in kept[name].select("doc_id").collect()), key=str)
    for name in ("language_id", "line_dedup", "near_dedup", "decontamination"):
        assert kept[name].columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert ids("language_id") == [1, 2, 2, 6, 7, 8, None]
    # Later copies of a whole line of many words leave nothing behind.
    assert ids("line_dedup") == ids("near_dedup") == [1, 6, 7, 8, None]
    assert ids("decontamination") == ids("mixture") == [1, 7, 8, None]
    assert all(r.taken <= 2 * r["size"] for r in kept["mixture"].collect())


def test_languages_are_filled_in(spark, folder):
    """A null lang becomes the language found; a given one stays, right or wrong."""
    rows = [(i, f"the ship and the harbour number {i}", "en") for i in range(20)] + [(i, f"das Schiff und der Hafen mit Nummer {i}", "de") for i in range(20, 40)]
    rows += [(40, "the harbour and the ship", None), (41, "der Hafen und das Schiff", None), (42, "the ship and the harbour", "de"), (43, "1 2 3", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'a' as source", "length(text) as n_chars")
    found = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, folder).collect()}
    assert [found.get(i) for i in range(40, 44)] == ["en", "de", "de", None] and 43 not in found and len(found) == 43


def test_empty_documents(spark, folder):
    kept = staged(spark, spark.createDataFrame([], SCHEMA), folder)
    assert all(docs.count() == 0 for docs in kept.values())


def test_run(spark, sf_dir, tmp_path):
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    rows = corpus_pipeline.run(spark, sf_dir, output=f"{tmp_path}/mix").toPandas()
    texts = spark.read.parquet(f"{tmp_path}/mix").select("doc_id", "text").collect()
    taken = dict(zip(rows.doc_id, rows.taken))
    assert sum(len(r.text.split()) for r in texts) == rows.taken.sum() and {r.doc_id for r in texts} == {i for i, n in taken.items() if n}
    by = rows.groupby("source").agg(size=("size", "sum"), said=("source_size", "first"), taken=("taken", "sum"), target=("target", "first"))
    assert len(rows) and (by["size"] == by.said).all() and (abs(by.taken - by.target) <= 1).all() and (rows.taken <= 2 * rows["size"]).all()
