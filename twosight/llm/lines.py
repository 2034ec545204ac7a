"""Operator 6: repeated runs of lines by distributed prefix doubling over line numbers; later copies are deleted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop, named, numbered, positional, running_totals, written

_BLANK = r"^[\x20\x09-\x0D]*\z"


def line_table(table: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Documents (_row, base, end) and the lines that occur more than once (pos, end, name, words).

    The lines with words of all documents stand end to end, documents in the order of id (null last) and row number:
    pos is a line's place, end the place after its document's last line. name is the place of the line's first occurrence.
    """
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(_BLANK))
    entry = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("words"))
    rows = written(table.select("_row", F.col(id_col).alias("_id"), F.transform(kept, entry).alias("_lines")).where(F.size("_lines") > 0))
    # The lines go with their documents into the order, so that none has to be joined to its place.
    sized = rows.withColumn("_n", F.size("_lines").cast("long"))
    laid = running_totals(sized, [F.col("_id").asc_nulls_last(), F.col("_row")], "_n", "base")
    drop(rows)
    placed = written(laid.select("_row", "base", (F.col("base") + F.col("_n")).alias("end")))
    every = laid.select("base", (F.col("base") + F.col("_n")).alias("end"), F.posexplode("_lines").alias("_at", "_line"))
    every = written(every.select((F.col("base") + F.col("_at")).alias("pos"), "end", "_line.a", "_line.b", "_line.words"))
    drop(laid)
    first = every.groupBy("a", "b").agg(F.min("pos").alias("name"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    named = written(every.join(first.hint("merge"), ["a", "b"]).select("pos", "end", "name", "words"))
    drop(every)
    return placed, named


def doubled(level: DataFrame, length: int) -> DataFrame:
    """From the intervals of runs of length lines those of twice the length: (pos, end, name).

    A run of 2 * length lines is the pair of the names at pos and pos + length. Runs with equal pairs are one interval,
    named by its first place; intervals of a single run are dropped, since no longer run from there can repeat."""
    other = level.select((F.col("pos") - length).alias("pos"), F.col("name").alias("_next"))
    pairs = level.where(F.col("pos") + length < F.col("end")).join(other.hint("merge"), "pos").select("pos", "end", "name", "_next")
    first = pairs.groupBy("name", "_next").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return pairs.join(first.hint("merge"), ["name", "_next"]).select("pos", "end", F.col("_first").alias("name"))


def repeated_runs(named: DataFrame, min_words: int) -> DataFrame:
    """The maximal runs of lines that are later copies: (pos, end, length, original), with at least min_words words.

    Prefix doubling names the runs of 1, 2, 4, ... lines by their first places until no run repeats. A place that is not
    the first of its run goes on to the longest of these, the first also stays behind for the others. Then, by halving
    steps, the places that share a run are grouped by the lines that follow: where several agree they go on with the
    longer run, named by its first place, and that first place again stays behind for those that don't, so each place
    meets every earlier one that shares more lines with it. What is left where a place is not the first is its longest
    copy of any earlier place. Of neighbouring places only those whose run reaches beyond the one before are kept.
    """
    levels, k = [named.select("pos", "end", "name")], 0
    while True:
        level = written(doubled(levels[-1], 1 << k))
        if level.isEmpty():
            drop(level)
            break
        levels.append(level)
        k += 1
    places = None
    for k, level in enumerate(levels):
        here = level.select("pos", "end", "name", F.lit(1 << k).cast("long").alias("length"), F.lit(k).alias("k"))
        if k + 1 < len(levels):
            here = here.join(levels[k + 1].where("name < pos").select("pos").hint("merge"), "pos", "left_anti")
        places = here if places is None else places.unionByName(here)
    places = written(places)
    for k in range(len(levels) - 2, -1, -1):
        names = levels[k].select(F.col("pos").alias("_p"), "end", F.col("name").alias("_next"))
        tried = places.where(F.col("k") > k).withColumn("_p", F.col("pos") + F.col("length")).where("_p < end")
        tried = written(tried.join(names.hint("merge"), ["_p", "end"]).drop("_p"))
        first = tried.groupBy("name", "length", "_next").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        longer = written(tried.join(first.hint("merge"), ["name", "length", "_next"]).select("pos", "end", "length", "k", "_first"))
        gone = longer.where("_first < pos").select("pos", "length")
        up = longer.select("pos", "end", F.col("_first").alias("name"), (F.col("length") + (1 << k)).alias("length"), "k")
        new = written(places.join(gone.hint("merge"), ["pos", "length"], "left_anti").unionByName(up))
        for old in (places, tried, longer):
            drop(old)
        places = new
    best = places.where("name < pos").select("pos", "end", "length", F.col("name").alias("original"))
    before = best.select((F.col("pos") + 1).alias("pos"), "end", (F.col("length") - 1).alias("_rest"))
    runs = best.join(before.hint("merge"), ["pos", "end"], "left").where("_rest is null or _rest < length").drop("_rest")
    total = F.sum("words").over(Window.partitionBy("end").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = named.select("pos", "words", total.alias("_sum"))
    last = sums.select((F.col("pos") + 1).alias("_stop"), F.col("_sum").alias("_to"))
    runs = runs.withColumn("_stop", F.col("pos") + F.col("length")).join(sums.hint("merge"), "pos").join(last.hint("merge"), "_stop")
    out = written(runs.where(F.col("_to") - F.col("_sum") + F.col("words") >= min_words).select("pos", "end", "length", "original"))
    for level in [*levels[1:], places]:
        drop(level)
    return out


def without_repeats(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later copies of repeated line runs deleted from the text; adds n_lines, removed_lines, removed_runs.

    Lines end at a line feed and are compared exactly. Lines without words don't count: they match nothing, interrupt no
    run and stay. A run of lines is deleted where it stands in an earlier place as well (a document with a smaller id, of
    equal or null ids the row that comes first, or further up in the same document; the places may overlap) and has at least
    min_words words. removed_runs lists the first line (from 0, counting lines with words) and the length of each run;
    runs may overlap. A text without deletions is returned unchanged, null and empty texts too; a text whose lines all
    go is empty. Every row stays, repeated rows lose their lines like other copies. All columns are kept; columns of docs
    that have the names of the new ones are replaced.
    """
    docs, names = positional(docs.drop("n_lines", "removed_lines", "removed_runs"))
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    table = numbered(docs, "_row")
    placed, known = line_table(table, id_col, text_col)
    runs = repeated_runs(known, min_words)
    span = F.struct((F.col("pos") - F.col("base")).cast("int").alias("first"), F.col("length").cast("int").alias("length"))
    own = written(runs.join(placed.hint("merge"), "end").groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("removed_runs")))
    rows = table.join(own.hint("merge"), "_row", "left").drop("_row")
    empty = F.array().cast(own.schema["removed_runs"].dataType)
    rows = rows.withColumn("removed_runs", F.coalesce("removed_runs", empty))
    schema = rows.withColumn("n_lines", F.lit(0)).withColumn("removed_lines", F.lit(0)).schema
    text_at, runs_at = rows.columns.index(text_col), rows.columns.index("removed_runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = re.compile(_BLANK.replace("z", "Z"))
        for batch in batches:
            texts, totals, gone = [], [], []
            for text, found in zip(batch.column(text_at), batch.column(runs_at), strict=True):
                text = text.as_py()
                lines = (text or "").split("\n")
                filled = [i for i, x in enumerate(lines) if not blank.match(x)]
                edge = np.zeros(len(filled) + 1, np.int64)
                for run in found.as_py():
                    edge[run["first"]] += 1
                    edge[run["first"] + run["length"]] -= 1
                dead = {filled[i] for i in np.flatnonzero(np.cumsum(edge)[:-1])}
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in dead) if dead else text)
                totals.append(len(filled))
                gone.append(len(dead))
            columns = [*batch.columns, pa.array(totals, pa.int32()), pa.array(gone, pa.int32())]
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_lines", "removed_lines"])

    return rows.mapInArrow(cut, schema).select(*named(names), "n_lines", "removed_lines", "removed_runs")
