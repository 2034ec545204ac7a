"""Operator 11: how filters act together in every order, from one table of failing ids per filter joined by left-semi and left-anti joins."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, let, words, written

#: A filter says which texts fail; the text it is given is never null.
Filter = Callable[[Column], Column]


def few_words(least: int) -> Filter:
    return lambda text: F.size(words(text)) < least


def repeated_words(percent: int) -> Filter:
    return lambda text: let(words(text), lambda w: 100 * F.size(F.array_distinct(w)) < percent * F.size(w))


def capitals(percent: int) -> Filter:
    return lambda text: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > percent * F.length(text)


def holds(pattern: str) -> Filter:
    return lambda text: text.rlike(pattern)


def failing_ids(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter], copies: str | None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The number of documents per part (part, total), and for each filter the written table of the documents that fail it.

    Rows are (row, part, good, toxic): row tells documents apart even where ids repeat or are null; good and toxic say
    whether any label row of the document's id has quality 1 or toxic 1. The texts are read once, and only their
    verdicts and a SHA-256 go on. The filter named by copies fails what is identical to the text of any smaller id: all
    rows but those whose (text, id) is the first of its text, so that a text of a third of all rows is many keys.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    marked = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), *(fails(text).alias(f"fails_{name}") for name, fails in filters.items()),
    )
    one = lambda c: F.coalesce(F.max(labels[c] == 1), F.lit(False))
    told = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    marked = written(marked.join(told, "id", "left").fillna(False, ["good", "toxic"]))
    totals = marked.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    kept = ["row", "part", "good", "toxic"]
    tables = {name: written(marked.where(f"fails_{name}").select(*kept)) for name in filters}
    if copies:
        first = marked.groupBy("digest").agg(F.min("id").alias("id"))
        tables[copies] = written(marked.where("id is not null").join(first, ["digest", "id"], "left_anti").select(*kept))
    return written(totals), tables


def failure_sets(tables: dict[str, DataFrame]) -> DataFrame:
    """Per part and set of failed filters (mask: bit i for the i-th table) the documents n, good and toxic.

    The tables are taken in turn. Those known from earlier tables that fail this one as well (left semi: its redundant
    removals) get its bit, those that don't (left anti) stay, and failing ids not yet known (left anti: its own
    removals) are added. Every join is on the row number, one document per key.
    """
    known = None
    for bit, table in enumerate(tables.values()):
        fresh = table.withColumn("mask", F.lit(1 << bit))
        if known is None:
            known = fresh
            continue
        redundant = known.join(table, "row", "left_semi").withColumn("mask", F.col("mask").bitwiseOR(F.lit(1 << bit)))
        others = known.join(table, "row", "left_anti")
        new = written(redundant.unionByName(others).unionByName(fresh.join(known, "row", "left_anti")))
        if bit > 1:
            drop(known)
        known = new
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return known.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter], copies: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    Filters have names of one letter; the one named by copies, the last, fails texts identical to that of a smaller id.
    kept are the documents left after the step, removed those that this step removes, redundant those that fail its
    filter but went before, unique_fails those that fail its filter only; good_lost and toxic_lost are the removed with
    such a label; shapley is what the step's filter removes, added up over all orders.

    The failing ids meet in joins that are independent of the order; the steps of all orders follow from the documents
    per set of failed filters (2 ** filters at most in a part), so the work with ids is the same for any number of orders.
    Null texts are empty texts, a null part is the part ''. Every row is a document of its own, repeated rows too. A null
    id is smaller than none and has no labels. Parts without failures have rows with zeros; an empty table gives none.
    """
    totals, tables = failing_ids(docs, labels, filters, copies, id_col, text_col, part_col)
    names = list(tables)
    bits = {name: 1 << i for i, name in enumerate(names)}
    steps = [
        {"filter_order": "".join(order), "step": at + 1, "own": bits[order[at]], "before": sum(bits[x] for x in order[:at])}
        for order in permutations(names)
        for at in range(len(names))
    ]
    known = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, before: int>>")
    cells = totals.join(failure_sets(tables), "part", "left").select("*", F.inline(known))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda c, when, name: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(name)
    rows = cells.groupBy("part", "filter_order", "step", "own").agg(
        (F.max("total") - F.coalesce(F.sum(F.when(fails | gone, F.col("n"))), F.lit(0))).alias("kept"),
        count("n", fails & ~gone, "removed"),
        count("n", fails & gone, "redundant"),
        count("n", F.col("mask") == F.col("own"), "unique_fails"),
        count("good", fails & ~gone, "good_lost"),
        count("toxic", fails & ~gone, "toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")
