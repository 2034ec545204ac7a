"""Operator 3: near duplicates by MinHash bands, odd sketches and exact shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, named, numbered, positional, written

#: Chance that a pair just at the threshold shares no band, and that its sketches differ too much: both bounds are about this.
MISS = 2e-6
#: Bits of an odd sketch.
BITS = 1024
#: Members of a bucket in one block; two blocks meet in a task.
BLOCK = 256
#: Bytes of text whose words are hashed at a time.
PIECE = 1 << 22
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, as far as they were asked for."""

    up = down = np.ones(1, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            both = []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                steps = np.full(n, base, _U)
                steps[0] = 1
                both.append(np.cumprod(steps, dtype=_U))
            cls.up, cls.down = both
        return cls.up[:n], cls.down[:n]


def word_hashes(joined: bytes) -> np.ndarray:
    """A 64-bit hash of each word of words joined by single blanks, from prefix sums of a polynomial in the bytes."""
    out = []
    while joined:
        cut = len(joined) if len(joined) <= PIECE else joined.find(b" ", PIECE)
        piece, joined = (joined, b"") if cut in (-1, len(joined)) else (joined[:cut], joined[cut + 1 :])
        codes = np.frombuffer(piece, np.uint8)
        up, down = _Powers.of(len(codes) + 1)
        sums = np.r_[_U(0), np.cumsum((codes.astype(_U) + _U(1)) * up[:-1], dtype=_U)]
        gaps = np.flatnonzero(codes == 32)
        starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(codes)]
        out.append(_mix((sums[ends] - sums[starts]) * down[starts] ^ _mix((ends - starts).astype(_U))))
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_sets(texts: list[str | None], n: int) -> tuple[list[bytes | None], list[np.ndarray]]:
    """Of each text: a 128-bit key of its word sequence (null without words), and the hashes of its distinct shingles."""
    words = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    joined = [b" ".join(w) for w in words]
    keys = [hashlib.md5(j, usedforsecurity=False).digest() if j else None for j in joined]
    hashes = word_hashes(b" ".join(j for j in joined if j))
    sets, at = [], 0
    for w in words:
        own = hashes[at : at + len(w)]
        at += len(w)
        if not len(own):
            sets.append(own)
            continue
        width = min(n, len(own))
        value = np.full(len(own) - width + 1, width, _U)
        for k in range(width):
            value = _mix(value * _U(0x9E3779B97F4A7C15) + own[k : len(own) - width + 1 + k])
        sets.append(np.unique(value))
    return keys, sets


def shingle_words(text: str | None, n: int) -> set[tuple[bytes, ...]]:
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


class Plan:
    """Rows per band, bands and the sketch limit for a threshold: a pair at it is lost with a chance of about MISS."""

    def __init__(self, threshold: float, rows: int = 6):
        self.rows = rows
        self.bands = max(1, math.ceil(math.log(MISS) / math.log(1 - threshold**rows))) if threshold < 1 else 1
        self.samples = self.rows * self.bands
        # Each differing sample flips at most two bits; six deviations above their expected number are let through.
        away = self.samples * (1 - threshold)
        self.limit = 2 * math.ceil(away + 6 * math.sqrt(away * threshold) + 1)
        rng = np.random.default_rng(31)
        self.factors = rng.integers(0, 2**64, self.samples, dtype=_U) | _U(1)
        self.shifts = rng.integers(0, 2**64, self.samples, dtype=_U)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """MinHash samples of sets that are not empty, (sets, samples)."""
        out = np.empty((len(sets), self.samples), _U)
        at = 0
        while at < len(sets):
            stop, size = at, 0
            while stop < len(sets) and (stop == at or size + len(sets[stop]) <= 1 << 16):
                size += len(sets[stop])
                stop += 1
            flat = np.concatenate(sets[at:stop])
            starts = np.cumsum([0, *map(len, sets[at:stop])])[:-1]
            for k in range(self.samples):
                out[at:stop, k] = np.minimum.reduceat(flat * self.factors[k] + self.shifts[k], starts)
            at = stop
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A hash of each band's samples."""
        value = np.broadcast_to(np.arange(1, self.bands + 1, dtype=_U), (len(minima), self.bands)).copy()
        for k in range(self.rows):
            value = _mix(value * _U(0x9E3779B97F4A7C15) + minima[:, k :: self.rows])
        return value.view(np.int64)

    def sketches(self, minima: np.ndarray) -> np.ndarray:
        """Odd sketches: every (place, sample) flips one of BITS bits, so equal samples cancel in the XOR of two sketches."""
        bits, every = np.zeros((len(minima), BITS), np.uint8), np.arange(len(minima))
        for k in range(self.samples):
            bits[every, (_mix(minima[:, k] + _U((k + 1) * 0xD6E8FEB86659FD93 % 2**64)) >> _U(32)).astype(np.int64) % BITS] ^= 1
        return np.packbits(bits, axis=1).view(np.int64)


def sketched(docs: DataFrame, plan: Plan, n: int, text_col: str) -> DataFrame:
    place = docs.columns.index(text_col)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                keys, sets = shingle_sets(batch.column(place).to_pylist(), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                bands, sketch = [[]] * len(sets), [[]] * len(sets)
                if full:
                    minima = plan.minima([sets[i] for i in full])
                    for i, a, b in zip(full, plan.keys(minima), plan.sketches(minima), strict=True):
                        bands[i], sketch[i] = a, b
                long_list = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, long_list), pa.array(sketch, long_list)],
                    [*batch.schema.names, "_key", "n_shingles", "_bands", "_sketch"],
                )

    empty = F.array().cast("array<bigint>")
    schema = docs.select("*", F.lit(None).cast("binary").alias("_key"), F.lit(0).cast("long").alias("n_shingles"), empty.alias("_bands"), empty.alias("_sketch")).schema
    return docs.mapInArrow(made, schema)


def _close(a: str, b: str, limit: int, percent: int):
    """Whether two rows' sizes and sketches allow the similarity."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    x, y = F.col(f"{a}._sketch"), F.col(f"{b}._sketch")
    away = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, BITS // 64)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (away <= limit)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose full shingle sets are similar. texts: _row, _text."""
    pairs = written(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("_row")).unionByName(pairs.select(F.col("b").alias("_row"))).distinct()
    wanted = written(texts.join(wanted.hint("merge"), "_row"))
    left, right = wanted.toDF("a", "_ta"), wanted.toDF("b", "_tb")
    both = pairs.join(left, "a").join(right, "b")

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep, last, last_set = [], None, set()
            for a, b in zip(frame["_ta"], frame["_tb"], strict=True):
                if b is not last:
                    last, last_set = b, shingle_words(b, n)
                own = shingle_words(a, n)
                common = len(own & last_set)
                keep.append(100 * common >= percent * (len(own) + len(last_set) - common))
            yield frame.loc[keep, ["a", "b"]]

    out = written(both.mapInPandas(compared, "a long, b long"))
    drop(wanted)
    drop(pairs)
    return out


def compared_in_blocks(labelled: DataFrame, nodes: DataFrame, texts: DataFrame, plan: Plan, percent: int, n: int) -> DataFrame:
    """Links (a, b) that join components within buckets. labelled: band, head, _row, root.

    Of each bucket with several components, the members outside its largest component meet all its members, by blocks
    of BLOCK; a task holds two blocks. A pair is looked at in the first band that it shares, if its roots differ and
    its sketches are close enough; then its full shingle sets are compared. Only links that join two components not
    joined before in that task leave it, fewer than the task has members.
    """
    counts = labelled.groupBy("band", "root").agg(F.count("*").alias("_c"))
    counts = counts.groupBy("band").agg(F.sum("_c").alias("_all"), F.max("_c").alias("_most"), F.max_by("root", "_c").alias("major")).where("_most < _all and _all > 2")
    counts = counts.select("band", "major", F.ceil(F.col("_all") / BLOCK).cast("int").alias("_right"), F.ceil((F.col("_all") - F.col("_most")) / BLOCK).cast("int").alias("_left"))
    open_ = written(labelled.where("_row <> head").join(counts, "band"))
    rows = nodes.join(open_.select("_row").distinct(), "_row")
    rows = written(texts.join(rows.hint("merge"), "_row"))
    block = lambda x: F.pmod(F.xxhash64("_row"), F.col(x)).cast("int")
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    left = open_.where("root <> major").withColumn("_l", block("_left")).withColumn("_r", every("_right")).withColumn("_side", F.lit(0))
    right = open_.withColumn("_r", block("_right")).withColumn("_l", every("_left")).withColumn("_side", F.lit(1))
    both = left.unionByName(right).select("band", "_l", "_r", "_side", "_row", "root", "major").join(rows, "_row")

    def linked(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_row")
        sides = frame["_side"].to_numpy()
        own = frame.drop_duplicates("_row").reset_index(drop=True)
        place = {r: i for i, r in enumerate(own["_row"])}
        at = frame["_row"].map(place).to_numpy()
        lefts, rights = at[sides == 0], at[sides == 1]
        row, root = own["_row"].to_numpy(), own["root"].to_numpy()
        bands, sketch = np.stack(own["_bands"].to_list()), np.stack(own["_sketch"].to_list()).view(_U)
        numbers: dict[tuple, int] = {}
        sets = [np.array([numbers.setdefault(s, len(numbers)) for s in shingle_words(t, n)], np.int64) for t in own["_text"]]
        sizes = np.array([len(s) for s in sets])
        band, major = frame["band"].iloc[0], frame["major"].iloc[0]
        parent = {r: r for r in root.tolist()}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links, mark = [], np.zeros(len(numbers), bool)
        for i in lefts:
            js = rights[(root[rights] != root[i]) & ((root[rights] == major) | (row[rights] > row[i]))]
            low, high = np.minimum(sizes[js], sizes[i]), np.maximum(sizes[js], sizes[i])
            js = js[(low * 100 >= high * percent) & (np.bitwise_count(sketch[js] ^ sketch[i]).sum(axis=1) <= plan.limit)]
            shared = bands[js] == bands[i]
            js = js[bands[i][shared.argmax(axis=1)] == band] if len(js) else js
            if not len(js):
                continue
            mark[sets[i]] = True
            common = np.add.reduceat(mark[np.concatenate([sets[j] for j in js])], np.cumsum([0, *sizes[js]])[:-1], dtype=np.int64)
            mark[sets[i]] = False
            for j in js[common * 100 >= percent * (sizes[js] + sizes[i] - common)]:
                x, y = find(root[i]), find(root[j])
                if x != y:
                    parent[x] = y
                    links.append((row[i], row[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return written(both.groupBy("band", "_l", "_r").applyInPandas(linked, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of the nodes of edges (a, b), root the smallest node of the component.

    Alternates the large-star and small-star steps: neighbours above a node, then those below it, move to the smallest
    neighbour, until nothing moves. A node's neighbours never meet in one task: the smallest comes from a partial
    aggregate and goes back by a join whose skewed keys Spark splits.
    """
    edges = written(edges.where("a <> b").distinct())
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        down = written(down)
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        new = written(moved.unionByName(low.toDF("a", "b")).distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(edges)
        drop(down)
        edges = new
        if state == before or not state[0]:
            roots = edges.toDF("node", "root")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = state


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds n_shingles, component_id and representative to the documents.

    Words are lower-cased by A-Z and end at ASCII white space. A document's set holds its distinct shingles of n words;
    with fewer words, the whole sequence as one. Two documents are linked if 100 * common >= percent * union, counted on
    the words themselves. component_id is the smallest id in the component, null ids last; representative is true for
    one row of each component, the first by (id, row number).

    1. Equal word sequences become one class by a 128-bit key, so copies are never compared.
    2. Every member of a band's bucket is checked against the bucket's first member; pairs whose odd sketches are too
       far apart are dropped, the rest are confirmed on full sets. This joins the copies of a text in linear work.
    3. In buckets that still hold several components, members outside the largest are checked against all members of
       other components, in blocks. So every pair that shares a band is compared or already joined.

    Null and blank texts have no shingles and are linked with nothing, each a component of its own. Repeated rows and ids
    are linked like any equal texts. An empty table gives no rows. All columns are kept; columns of docs with the names
    of the new ones are replaced.
    """
    plan = Plan(percent / 100, rows)
    docs, names = positional(docs.drop("n_shingles", "component_id", "representative"))
    id_col, text_col = (f"c{names.index(c)}" for c in (id_col, text_col))
    table = numbered(sketched(docs, plan, n, text_col), "_row")
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_row").alias("row"))
    sets = written(table.where("_key is not null").groupBy("_key").agg(F.min("_row").alias("node"), F.min(first).alias("first")))
    nodes = written(table.select("_row", "n_shingles", "_bands", "_sketch").join(sets.select(F.col("node").alias("_row")), "_row"))
    texts = table.select("_row", F.col(text_col).alias("_text"))
    banded = nodes.select("_row", F.explode("_bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("_row").alias("head"), F.count("*").alias("_n")).where("_n > 1")
    members = written(banded.join(heads.drop("_n"), "band"))
    thin = nodes.select("_row", "n_shingles", "_sketch")
    star = members.where("_row <> head").select(F.col("_row").alias("a"), F.col("head").alias("b")).distinct()
    close = star.join(thin.alias("x"), F.col("a") == F.col("x._row")).join(thin.alias("y"), F.col("b") == F.col("y._row"))
    links = confirmed(close.where(_close("x", "y", plan.limit, percent)).select("a", "b"), texts, percent, n)
    joined = written(components(links))

    labelled = members.join(joined.withColumnRenamed("node", "_row"), "_row", "left").withColumn("root", F.coalesce("root", "_row"))
    labelled = written(labelled)
    more = compared_in_blocks(labelled, nodes, texts, plan, percent, n)
    roots = written(components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    owned = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = owned.groupBy("root").agg(F.min("first").alias("_first"))
    owned = owned.join(least, "root").select("_key", "_first")
    full = table.where("_key is not null").join(owned, "_key")
    bare = table.where("_key is null").withColumn("_first", first)
    out = full.unionByName(bare).withColumn("component_id", F.col("_first.id")).withColumn("representative", F.col("_first.row") == F.col("_row"))
    return out.select(*named(names), "n_shingles", "component_id", "representative")
