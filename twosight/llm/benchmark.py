"""Operator 7: test items inside long documents, by size-partitioned MinHash containment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, lower_ascii, named, positional, words, written


def shingles(w: Column, width: Column | int) -> Column:
    """The distinct runs of width words, joined by blanks; none if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    count = F.size(w) - width
    runs = F.transform(F.sequence(F.lit(0), count), lambda i: F.array_join(F.slice(w, i + 1, width), " "))
    return F.array_distinct(F.when(count >= 0, runs).otherwise(F.array().cast("array<string>")))


def prepared(items: DataFrame, percent: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """One row per item with words: item_id, width, item (shingles), size, need, sketch (hashes), band.

    An item of fewer than n words is one shingle of all its words. need is the least number of shingles that makes
    percent of them. sketch holds the size - need + 1 smallest of the shingles' hashes, a MinHash sample under one
    hash function: a document with need of the shingles misses at most size - need, so it holds one of the sample.
    band is the item's size class, a power of two.
    """
    rows = items.select(items[id_col].alias("item_id"), words(lower_ascii(items[text_col])).alias("_w")).where(F.size("_w") > 0)
    rows = rows.withColumn("width", F.least(F.size("_w"), F.lit(n))).withColumn("item", let(F.col("_w"), lambda w: shingles(w, F.col("width"))))
    rows = rows.withColumn("size", F.size("item")).withColumn("need", F.ceil(F.col("size") * percent / 100).cast("int"))
    hashes = F.array_sort(F.transform("item", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("sketch", F.slice(hashes, F.lit(1), F.col("size") - F.col("need") + 1))
    return rows.withColumn("band", F.floor(F.log2("size")).cast("int")).drop("_w")


def contained(
    docs: DataFrame, items: DataFrame, percent: int = 80, n: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, item_id, item_shingles, found, text_key) of documents that hold at least percent of an item's shingles.

    Words are lower-cased by A-Z and end at ASCII white space; a shingle is n of them. Items are partitioned by size:
    each size class has its own bound on hashes (the largest in its samples) and on a document's length, so that a
    document's shingle is looked up only if some class can have it. What meets a sampled hash is a candidate; its whole
    text is then compared with the item by the shingles' exact words. No pair can be missed, so there is no recall to tune.
    The samples are written first, so Spark knows their size and broadcasts them only below its threshold; above it the
    same join shuffles both sides and splits hot keys.

    Null and blank documents and items hold nothing. Repeated rows are found each; repeated items too. text_key is
    made from the text alone, two 64-bit hashes, and joins the result back to whole rows. Other columns are not returned.
    """
    ready = written(prepared(items, percent, n, item_id_col, item_text_col).withColumn("item_no", F.monotonically_increasing_id()))
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    rows = docs.select(docs[id_col].alias("doc_id"), key.alias("text_key"), docs[text_col].alias("text"))
    # At most n widths and 31 size classes.
    bounds = ready.groupBy("width", "band").agg(F.max(F.element_at("sketch", -1)).alias("most"), F.min("need").alias("need")).collect()
    samples = ready.select("width", "item_no", "need", F.explode("sketch").alias("hash"))
    samples = written(samples.coalesce(1) if not bounds else samples)
    parts = []
    split = rows.select("text_key", words(lower_ascii(F.col("text"))).alias("_w"))
    for width in sorted({b["width"] for b in bounds}):
        classes = [b for b in bounds if b["width"] == width]
        length = F.size("_w") - width + 1
        runs = split.withColumn("_i", F.explode(F.when(length >= min(b["need"] for b in classes), F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))))
        run = F.concat_ws(" ", *(F.get("_w", F.col("_i") + k) for k in range(width)))
        hashed = runs.select("text_key", length.alias("_n"), F.xxhash64(run).alias("hash"))
        able = F.lit(False)
        for b in classes:
            able = able | ((F.col("hash") <= b["most"]) & (F.col("_n") >= b["need"]))
        found = hashed.where(able).join(samples.where(F.col("width") == width).drop("width"), "hash").where("_n >= need")
        parts.append(found.select("text_key", "item_no"))
    if not parts:
        parts.append(samples.select(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("text_key"), "item_no").limit(0))
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    candidates = written(candidates.distinct())
    kept = ready.select("item_no", "item_id", "width", "item", "size", "need")
    pairs = rows.join(candidates.hint("merge"), "text_key").join(kept, "item_no")
    held = let(words(lower_ascii(F.col("text"))), lambda w: F.size(F.array_intersect("item", shingles(w, F.col("width")))))
    pairs = pairs.withColumn("found", F.explode(let(held, lambda x: F.filter(F.array(x), lambda y: y >= F.col("need")))))
    return pairs.select("doc_id", "item_id", F.col("size").alias("item_shingles"), "found", "text_key")


def without(docs: DataFrame, items: DataFrame, percent: int = 80, n: int = 5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text holds no item (see contained); empty texts stay."""
    docs, names = positional(docs)
    text_col = f"c{names.index(text_col)}"
    found = contained(docs.withColumn("_id", F.lit(0)), items, percent, n, id_col="_id", text_col=text_col)
    bad = written(found.select(F.col("text_key.a").alias("_a"), F.col("text_key.b").alias("_b")).distinct())
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.join(bad.hint("merge"), (F.xxhash64(text) == F.col("_a")) & (F.xxhash64(F.lit(1), text) == F.col("_b")), "left_anti").select(*named(names))
