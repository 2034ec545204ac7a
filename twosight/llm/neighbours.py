"""Operator 8: nearest neighbours from balanced posting lists whose centroids are searched by a graph in memory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, written

#: Distinct vectors the centroids are fitted on at most, lists at most, and distinct vectors wanted per list.
FIT_ROWS, MOST_LISTS, PER_LIST = 65_536, 16_384, 128
#: Distinct vectors of a list that one task scores at a time.
BLOCK = 4096
#: Lists that a query reads in its first round; every further round doubles the lists read.
FIRST_LISTS = 16


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 11) -> np.ndarray:
    """Means of a tree of even halves: each part is cut at the median along the line between two means of its own."""
    rng, parts = np.random.default_rng(seed), [np.arange(len(x))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        parts.sort(key=len)
        part = parts.pop()
        own = x[part]
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            near = ((own - a) ** 2).sum(axis=1) <= ((own - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = own[near].mean(axis=0), own[~near].mean(axis=0)
        order = np.argsort(own @ (b - a), kind="stable")
        parts += [part[order[: len(order) // 2]], part[order[len(order) // 2 :]]]
    return np.stack([x[p].mean(axis=0) for p in parts])


class Graph:
    """Centroids joined to their nearest ones and to a few far ones, searched best-first for many vectors at a time."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, far: int = 4, seed: int = 5):
        self.centroids = centroids.astype(np.float32)
        self.squares = (self.centroids**2).sum(axis=1)
        n = len(centroids)
        near = np.zeros((n, min(degree, n)), np.int32)
        for at in range(0, n, 1024):
            d = self.squares[None] - 2 * self.centroids[at : at + 1024] @ self.centroids.T
            near[at : at + 1024] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        links = np.sort(np.concatenate([near, np.random.default_rng(seed).integers(0, n, (n, far), dtype=np.int32)], axis=1), axis=1)
        # Of equal links all but one lead to the centroid itself, which has been seen when they are followed.
        twice = np.c_[np.zeros((n, 1), bool), links[:, 1:] == links[:, :-1]]
        self.links = np.where(twice, np.arange(n, dtype=np.int32)[:, None], links)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found, nearest first, and their squared distances; -1 and infinity where there are none.

        Where half of all centroids are wanted, all are compared.
        """
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        x, own = x.astype(np.float32), (x.astype(np.float32) ** 2).sum(axis=1)[:, None]
        width = min(width, n)
        if 2 * width >= n:
            far = np.maximum(self.squares[None] - 2 * x @ self.centroids.T + own, 0)
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            return order.astype(np.int32), far[rows, order]
        start = np.unique(np.linspace(0, n - 1, min(n, max(16, int(n**0.5)))).astype(np.int32))
        seen, place = np.zeros((len(x), n), bool), np.zeros((len(x), n), np.int32)
        seen[:, start] = True
        beam = np.broadcast_to(start, (len(x), len(start))).copy()
        far = np.maximum(self.squares[start][None] - 2 * x @ self.centroids[start].T + own, 0)
        done, at_once = np.zeros(beam.shape, bool), max(1, width // 8)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            beam, far, done = beam[rows, order], far[rows, order], done[rows, order]
            todo = ~done & np.isfinite(far)
            live = np.flatnonzero(todo.any(axis=1))
            if not len(live):
                return np.where(np.isfinite(far), beam, -1), far
            # The nearest ones not yet followed, a few at a time; those that stand in for missing ones lead to a seen one.
            some, at = live[:, None], np.argsort(~todo[live], axis=1, kind="stable")[:, :at_once]
            open_ = todo[some, at]
            done[some, at] = True
            near = np.where(open_[:, :, None], self.links[beam[some, at]], start[0]).reshape(len(live), -1)
            new, number = ~seen[some, near], np.arange(near.shape[1])
            place[some, near] = number
            new &= place[some, near] == number
            seen[some, near] = True
            r, c = np.nonzero(new)
            to = near[r, c]
            near_far = np.full((len(x), near.shape[1]), np.inf, np.float32)
            near_id = np.zeros((len(x), near.shape[1]), np.int32)
            near_far[live[r], c] = np.maximum(self.squares[to] - 2 * np.einsum("ij,ij->i", x[live[r]], self.centroids[to]) + own[live[r], 0], 0)
            near_id[live[r], c] = to
            beam, far = np.concatenate([beam, near_id], axis=1), np.concatenate([far, near_far], axis=1)
            done = np.concatenate([done, np.zeros(near_far.shape, bool)], axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct rows (id, vec): ids that are not null, vectors without null or non-finite components and not zero,
    all of the commonest length (of equally common ones the longer)."""
    x = vectors[vector_col]
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(vectors[id_col].isNotNull() & x.isNotNull() & fine).select(vectors[id_col].alias("id"), x.alias("vec"))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def nearest(
    vectors: DataFrame, query, k: int = 20, ratio: float = 1.25, replicas: int = 4, boundary: float = 1.1, width: int = 64,
    id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, recall: float | None = 0.95,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row that meets query (a condition on id) its k nearest found.

    Nearness is the inner product in double precision, of equals the smaller id first; all rows but the query's own
    are candidates. Equal vectors are one entry of the index that keeps its k + 1 smallest ids, since no others can be
    among the k nearest. One more component, which makes all entries equally long, turns the largest inner product into
    the least distance. Centroids are fitted on at most fit_rows entries (those with the smallest hash); every entry is
    put into the list of its nearest centroid, and into those of up to `replicas` centroids at most `boundary` times as
    far. A query is to read all lists whose centroids are at most `ratio` times as far as the nearest, and more until these
    hold 8 * (k + 1) entries. It reads them nearest first, in rounds that each double the lists read, and ends before the
    last one when it has k + 1 entries of which the round brought at most (1 - recall) * k. So the lists read follow from the
    data: few where they are clustered, all where no order of the lists tells near from far. With recall None all are read.
    A list gives a query only entries that reach the worst of its k + 1 best of earlier rounds, which loses none.
    The graph is searched for `width` centroids at first, and where these don't suffice for
    four times as many, and so on up to all. Long lists are scored in blocks.

    Null ids, and vectors that are null, zero, of another length, or hold null or non-finite components take no part.
    Repeated rows (same id and vector) are one. An id with several vectors has one ranking, the best of theirs, and stands
    in others once, with its best score. With fewer candidates than k, all that were found are returned; an
    empty table gives no rows. Other columns are not returned.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.distinct().withColumn("_place", place).where(F.col("_place") <= k + 1)
    entries = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = written(entries.withColumn("entry", F.monotonically_increasing_id()))
    asked = written(rows.where(query).distinct().join(entries.select("vec", "entry"), "vec").select("id", "entry"))
    square = F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, longest = entries.agg(F.count("*"), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def longer(x: np.ndarray, as_query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(longest - (x**2).sum(axis=1), 0))
        return np.c_[x, extra]

    sample = entries.orderBy(F.xxhash64("vec"), "entry").limit(fit_rows).select("vec").toPandas()["vec"]
    lists = int(min(MOST_LISTS, max(1, n // PER_LIST)))
    centroids = balanced_centroids(longer(np.stack(sample.to_list()).astype(float)), lists)
    graph = spark.sparkContext.broadcast(Graph(centroids))

    def assigned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                found, far = graph.value.search(longer(np.stack(part["vec"].to_list()).astype(float)), 32)
                found, far = found[:, :replicas], np.sqrt(far[:, :replicas])
                r, c = np.nonzero((found >= 0) & (far <= boundary * far[:, :1] + 1e-6))
                yield pd.DataFrame({"entry": part["entry"].to_numpy()[r], "list": found[r, c], "ids": part["ids"].to_numpy()[r], "vec": part["vec"].to_numpy()[r]})

    kind = entries.schema["vec"].dataType.simpleString()
    id_kind = rows.schema["id"].dataType.simpleString()
    posted = written(entries.mapInPandas(assigned, f"entry long, list int, ids array<{id_kind}>, vec {kind}"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("size"))
    held = np.zeros(len(centroids), np.int64)
    for row in sizes.collect():  # one row per list, at most MOST_LISTS
        held[row["list"]] = row["size"]
    held = spark.sparkContext.broadcast(held)

    def chosen(frames: Iterator[pd.DataFrame], upto: int) -> Iterator[pd.DataFrame]:
        """Adds the lists and blocks that a query reads in the round, the lists read with it, and whether no more are to follow."""
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256].reset_index(drop=True)
                x, todo, wide = longer(np.stack(part["vec"].to_list()).astype(float), True), np.arange(len(part)), max(width, upto)
                lists, blocks, read, last = ([None] * len(part) for _ in range(4))
                # Where all centroids found are within reach, or hold too few entries, more are looked for, in the end all of them.
                while len(todo):
                    found, far = graph.value.search(x[todo], wide)
                    far = np.sqrt(far)
                    every = found.shape[1] >= len(held.value)
                    before = np.cumsum(np.where(found >= 0, held.value[found], 0), axis=1)
                    before = np.c_[np.zeros(len(found)), before[:, :-1]]
                    within = (found >= 0) & ((far <= ratio * far[:, :1] + 1e-6) | (before < 8 * (k + 1)))
                    ended = every | ~within[:, -1] & (found[:, -1] >= 0)
                    for i, wanted_, end in zip(todo, (f[w] for f, w in zip(found, within, strict=True)), ended, strict=True):
                        if end or len(wanted_) >= upto:
                            old, first = part["read"][i], wanted_[:upto]
                            new = first[~np.isin(first, old)]
                            count = -(-held.value[new] // BLOCK)
                            again = np.repeat(np.arange(len(new)), count)
                            lists[i], blocks[i] = new[again], np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                            read[i], last[i] = np.concatenate([np.asarray(old, np.int32), new]), bool(end and len(wanted_) <= upto)
                    todo, wide = np.array([i for i in todo if lists[i] is None], int), 4 * wide
                yield part.assign(lists=lists, blocks=blocks, read=read, last=last)[["query", "vec", "floor", "lists", "blocks", "read", "last"]]

    blocks = F.ceil(F.col("size") / BLOCK)
    posted = posted.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("entry"), blocks).cast("int")).drop("size")

    def scored(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(part):
            p, least = np.stack(part["vec"].to_list()).astype(float), np.array([x[0] for x in part["ids"]])
            entry, ids = part["entry"].to_numpy(), part["ids"].to_numpy()
            for at in range(0, len(queries), 256):
                some = queries.iloc[at : at + 256]
                q, floor = np.stack(some["qvec"].to_list()).astype(float), some["floor"].to_numpy(float, na_value=np.nan)
                rough = q @ p.T
                slack = 1e-9 * np.sqrt((q**2).sum(axis=1) * (p**2).sum(axis=1).max())
                reach = ~(rough < (floor - slack)[:, None])
                many = reach.sum(axis=1) > k + 1
                r, c = np.nonzero(reach & ~many[:, None])
                # The products of the best are summed again in one fixed order, so equal pairs have equal scores everywhere.
                # Ties at the edge are kept by score first, so more than k + 1 are looked at.
                top = np.lexsort((np.broadcast_to(least, (many.sum(), len(p))), -np.round(rough[many], 12)), axis=1)[:, : k + 1]
                r, c = np.concatenate([r, np.repeat(np.flatnonzero(many), top.shape[1])]), np.concatenate([c, top.ravel()])
                score = (q[r] * p[c]).sum(axis=1)
                fine = ~(score < floor[r])
                r, c = r[fine], c[fine]
                out.append(pd.DataFrame({"query": some["query"].to_numpy()[r], "entry": entry[c], "score": score[fine], "ids": ids[c]}))
        # The empty frame has the types of a full one: a list that no query reads, or that holds nothing, gives it.
        none = {"query": np.zeros(0, np.int64), "entry": np.zeros(0, np.int64), "score": np.zeros(0), "ids": np.zeros(0, object)}
        return pd.concat(out) if out else pd.DataFrame(none)

    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    wanted = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select(F.col("entry").alias("query"), "vec")
    wanted = wanted.withColumn("floor", F.lit(None).cast("double")).withColumn("read", F.lit([]).cast("array<int>"))
    tasks, upto, near_ones = spark.sparkContext.defaultParallelism, FIRST_LISTS, None
    while True:
        picked = wanted.repartition(tasks, "query").mapInPandas(
            partial(chosen, upto=upto), f"query long, vec {kind}, floor double, lists array<int>, blocks array<int>, read array<int>, last boolean"
        )
        picked = written(picked)
        asks = picked.select("query", F.col("vec").alias("qvec"), "floor", F.explode(F.arrays_zip("lists", "blocks")).alias("_at"))
        asks = asks.select("query", "qvec", "floor", F.col("_at.lists").alias("list"), F.col("_at.blocks").alias("block"))
        hits = asks.groupBy("list", "block").cogroup(posted.groupBy("list", "block")).applyInPandas(scored, f"query long, entry long, score double, ids array<{id_kind}>")
        hits, old = hits.withColumn("round", F.lit(upto)), near_ones
        once = (hits.unionByName(old) if old else hits).groupBy("query", "entry")
        once = once.agg(F.max("score").alias("score"), F.any_value("ids").alias("ids"), F.min("round").alias("round"))
        near_ones = written(once.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n"))
        gained = near_ones.groupBy("query").agg(
            F.count("*").alias("_held"), F.min("score").alias("_least"), F.sum(F.when(F.col("round") == upto, 1).otherwise(0)).alias("_new")
        )
        enough = (F.col("_held") > k) & (F.lit(recall is not None) & (F.col("_new") <= (1 - (recall or 0)) * k + 1e-9))
        wanted = picked.where(~F.col("last")).join(gained, "query", "left").where(~F.coalesce(enough, F.lit(False)))
        wanted = written(wanted.select("query", "vec", F.when(F.col("_held") > k, F.col("_least")).alias("floor"), "read"))
        for gone in [picked, *([old] if old else [])]:
            drop(gone)
        if wanted.isEmpty():
            break
        upto *= 2
    hits = near_ones
    pair = F.struct((-F.col("score")).alias("_s"), "id", "score")
    hits = hits.select("query", "score", F.explode("ids").alias("id")).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(pair)), 1, k + 1).alias("near"))
    out = asked.join(hits, asked["entry"] == hits["query"])
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    pairs = out.select(F.col("id").alias("query_id"), F.explode(near).alias("_near")).groupBy("query_id", F.col("_near.id").alias("id")).agg(F.max("_near.score").alias("score"))
    ranked = pairs.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(pair)), 1, k).alias("near"))
    ranked = ranked.select("query_id", F.posexplode("near").alias("_at", "_near"))
    return ranked.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_near.id").alias("vec_id"), F.col("_near.score").alias("score"))
