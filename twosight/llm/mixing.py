"""Operator 1: mixing sources to target weights by a low-discrepancy schedule of equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, drop, let, running_totals, written

#: Golden-ratio points in whole numbers: slot i lies at (i * STEP mod MODULUS) / MODULUS. MODULUS is prime, STEP its golden section.
MODULUS, STEP = 2_147_483_647, 1_327_217_885
#: Words of the mix in one file, to the next whole block.
FILE_WORDS = 4_000_000
BLANKS, _BLANK = " \t\n\v\f\r", r"[\x20\x09-\x0D]"


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size).

    Weights repeat along the sources in code-point order, null last. The targets add up to share times all sizes,
    in proportion to the weights, and stop at cap times the source's size; the excess goes to the others by weight.
    That is target = min(cap * size, level * weight) for one level, and the level is the largest of those
    that follow when the sources with the least cap per weight are taken as full, for any number of full ones.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.cast("int", F.pmod(place, F.lit(len(weights)))) + 1)
    rows = sizes.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    full = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    room = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(full), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    rows = rows.withColumn("_level", F.try_divide(room, open_weight))
    level = F.max("_level").over(every)
    return rows.withColumn("target", F.least(F.col("_cap"), level * F.col("weight"))).drop("_cap", "_level")


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int, n_sources: int, chunk: int = 4096) -> DataFrame:
    """The slots (source_no, rank, slot): golden-ratio points mapped through the cumulative targets, ranked per source.

    A source gets as many slots as its quota: surplus slots are left free, and where the points fall short by a few
    (their discrepancy grows with the logarithm of their number) the missing ranks follow after the last slot.
    The points meet the intervals by equal cells of [0, 1); with eight cells per source the work stays in proportion
    to slots plus sources, whatever the weights are.
    """
    cells = 8 * max(n_sources, 1)
    order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("target").over(Window.partitionBy())
    bounds = sources.withColumn("_hi", F.sum("target").over(order) / total)
    bounds = bounds.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("source_no")), F.lit(0.0)))
    bounds = bounds.withColumn("_hi", F.when(F.col("source_no") == n_sources - 1, F.lit(2.0)).otherwise(F.col("_hi")))
    at = lambda x: F.least(F.floor(F.col(x) * cells), F.lit(cells - 1)).cast("int")
    bounds = bounds.where("_hi > _lo and quota > 0").withColumn("_cell", F.explode(F.sequence(at("_lo"), at("_hi"))))
    points = spark.range(n_slots).withColumnRenamed("id", "slot")
    points = points.withColumn("_u", F.pmod(F.pmod("slot", F.lit(MODULUS)) * F.lit(STEP), F.lit(MODULUS)) / F.lit(float(MODULUS)))
    points = points.withColumn("_cell", F.floor(F.col("_u") * cells).cast("int"))
    hit = points.join(bounds, "_cell").where("_u >= _lo and _u < _hi").select("slot", "source_no", "quota")
    hit = written(hit.withColumn("_chunk", F.floor(F.col("slot") / chunk)))
    counts = hit.groupBy("source_no", "_chunk").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("source_no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_chunk", "source_no").orderBy("slot"))
    ranked = hit.withColumn("_in", inside).join(counts.drop("_n"), ["source_no", "_chunk"])
    ranked = ranked.withColumn("rank", F.col("_before") + F.col("_in") - 1).where("rank < quota")
    given = hit.groupBy("source_no").agg(F.count("*").alias("_n"))
    short = sources.where("quota > 0").join(given, "source_no", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where("_n < quota")
    late = short.withColumn("rank", F.explode(F.sequence(F.col("_n"), F.col("quota") - 1)))
    late = late.withColumn("slot", F.lit(n_slots) + F.col("rank"))
    return ranked.select("source_no", "rank", "slot").unionByName(late.select("source_no", "rank", "slot"))


def _laid(docs: DataFrame, weights: Sequence[float], share: float, cap: float, seed: int, block: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """One row per document with its key (source, _h, doc_id, size) and place _start, and its source's row of the second frame."""
    # Written first: dealing into ranges reads its rows twice, once for the sample, and the texts should be counted once.
    sized = written(_keyed(docs, seed, id_col, text_col, source_col).drop("text"))
    order = [F.col("source").asc_nulls_last(), F.col("_h"), F.col("doc_id"), F.col("size")]
    laid = running_totals(sized, order, "size", "_start")
    drop(sized)
    sizes = laid.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("_start").alias("_base"))
    quota = F.ceil(F.floor("target") / block).cast("long")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = written(targets(sizes, weights, share, cap).withColumn("quota", quota).withColumn("source_no", number))
    placed = written(laid.join(sources, laid["source"].eqNullSafe(sources["source"])).drop(sources["source"]))
    drop(laid)
    return placed, sources


def _keyed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = docs[text_col]
    return docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), docs[id_col], text).alias("_h"), F.xxhash64(F.lit(seed), text, docs[id_col]).alias("_g"), text.alias("text"),
    )


def _pieces(docs: DataFrame, placed: DataFrame, sources: DataFrame, cap: float, block: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows of pieces(), with doc_at to tell equal documents apart, dealt and sorted into files but not yet written."""
    n_slots, longest, n_sources = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.max("quota"), F.lit(0)), F.count("*")).first()
    slots = schedule(docs.sparkSession, sources.select("source_no", "target", "quota"), int(n_slots), int(n_sources))
    rounds = placed.where("size > 0").withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(max(0, -int(-cap // 1) - 1)))))
    rounds = rounds.withColumn("_from", F.col("_start") - F.col("_base") + F.col("_round") * F.col("source_size"))
    rounds = rounds.withColumn("_to", F.least(F.col("_from") + F.col("size"), F.floor("target"))).where("_from < _to")
    per = lambda x: F.floor(x / block)
    parts = rounds.select("_start", "source_no", "_from", "_to", F.explode(F.sequence(per(F.col("_from")), per(F.col("_to") - 1))).alias("rank"))
    start = F.greatest(F.col("_from"), F.col("rank") * block)
    parts = parts.withColumn("at", start).withColumn("_n", F.least(F.col("_to"), (F.col("rank") + 1) * block) - start)
    piece = F.struct("slot", "rank", "at", (F.col("at") - F.col("_from")).cast("int").alias("first_word"), F.col("_n").cast("int").alias("n_words"))
    spans = parts.join(slots, ["source_no", "rank"]).groupBy("_start").agg(F.collect_list(piece).alias("_spans"))
    spans = written(placed.where("size > 0").select("_start", "doc_id", "source", "size", "_h", "_g").join(spans, "_start"))
    # Rows with equal hashes have equal ids and texts, so one text serves them all. Both sides are dealt by the hashes
    # alone, so the texts that the aggregate has dealt are not dealt again for the join.
    # That a text has a word is seen at its first one; the words are counted in _laid.
    texts = _keyed(docs, seed, id_col, text_col, source_col).where(F.col("text").rlike(WORD[:-1])).groupBy("_h", "_g").agg(F.any_value("text").alias("text"))
    both = texts.join(spans.hint("merge"), ["_h", "_g"]).select("_start", "doc_id", "source", "size", "_spans", "text")
    # The text is cut before each word, so a word keeps the white space that follows it; that of the last word goes.
    # Documents taken in one piece each time, which most are, need no cutting.
    in_part = lambda x: x["n_words"] < F.col("size")
    cut = F.when(F.exists("_spans", in_part), F.split(F.ltrim("text", F.lit(BLANKS)), f"(?<={_BLANK})(?={WORD[:-1]})"))
    piece_text = lambda w, x: F.rtrim(F.when(in_part(x), F.array_join(F.slice(w, x["first_word"] + 1, x["n_words"]), "")).otherwise(F.ltrim("text", F.lit(BLANKS))), F.lit(BLANKS))
    texted = let(cut, lambda w: F.transform(F.col("_spans"), lambda x: F.struct(x.alias("p"), piece_text(w, x).alias("text"))))
    rows = both.select("_start", "doc_id", "source", F.explode(texted).alias("_x"))
    rows = rows.select(
        "_x.p.slot", "source", "_x.p.rank", "_x.p.at", "doc_id", "_x.p.first_word",
        (F.col("_x.p.first_word") + F.col("_x.p.n_words") - 1).alias("last_word"), "_x.text", F.col("_start").alias("doc_at"),
    )
    # A piece's file follows from its slot, so nothing is sampled for it.
    per_file = max(1, FILE_WORDS // block)
    files = (int(n_slots) + int(longest)) // per_file + 1
    return rows.repartitionById(files, F.floor(F.col("slot") / per_file).cast("int")).sortWithinPartitions("slot", "at")


def pieces(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    block: int = 1024, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself, as files in the order of slot and at: slot, source, rank, at, doc_id, first_word, last_word, text.

    Each source's documents are laid end to end in the order of a seeded hash and cut into equal blocks of words; going
    round again, a block may run over the end into the start. Slot by slot the schedule names a source, whose next block
    (rank) is taken; its last block is cut at the whole words of the target. A block is one row for each document it
    reaches into: at is the row's first word in the source's sequence, rounds included, first_word and last_word (from 0)
    are its words in the document, text is the document from the one to the other, white space between them unchanged.

    Null and blank texts give no rows, as does an empty table. Null is a source of its own, the last. Repeated rows and
    ids are separate documents. With a share above cap every source is taken cap times. The files last until the scratch tables are cleared.
    """
    placed, sources = _laid(docs, weights, share, cap, seed, block, id_col, text_col, source_col)
    return written(_pieces(docs, placed, sources, cap, block, seed, id_col, text_col, source_col).drop("doc_at"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
    block: int = 1024, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    output: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, taken, first_slot.

    size is the number of words. taken is the number of words in the texts of the document's pieces, counted in the mixed
    rows that pieces() writes, repeats included, and so never exceeds cap times its size; first_slot is the first slot that
    takes any of them, null if none does. output names a folder for the mix: it is written there as Parquet, the rows of
    pieces() with doc_at (which tells equal documents apart), and the report is counted in these files; without it the rows
    are counted as they come.

    Null and blank texts have size 0 and take nothing. Null is a source of its own, the last. Repeated rows and ids
    are separate documents. An empty table gives no rows. With a share above cap every source is taken cap times. Other
    columns of docs are not returned.
    """
    placed, sources = _laid(docs, weights, share, cap, seed, block, id_col, text_col, source_col)
    mixed = _pieces(docs, placed, sources, cap, block, seed, id_col, text_col, source_col)
    if output is not None:
        mixed.write.option("compression", "zstd").parquet(output)
        mixed = docs.sparkSession.read.schema(mixed.schema).parquet(output)
    taken = mixed.groupBy(F.col("doc_at").alias("_at")).agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("_taken"), F.min("slot").alias("first_slot"))
    out = placed.join(taken, (F.col("_start") == F.col("_at")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "weight", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
