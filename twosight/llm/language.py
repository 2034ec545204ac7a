"""Operator 10: languages of a document by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

#: n-gram buckets (a power of two), and the languages a model may hold: the model has BUCKETS * 4 bytes per language.
BUCKETS, MOST_LANGUAGES = 1 << 16, 256
#: Characters taken together; a longer text is counted in pieces of this size.
PIECE = 1 << 20
#: n-grams times languages that texts judged together may have; a text with more is judged alone.
CELLS = 1 << 22
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets of a text's letter trigrams and their counts; null if it has no letter. What is no letter counts as one blank."""
    if not text:
        return None
    total, found, carry = None, False, np.zeros(0, np.uint32)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        found = found or bool(letter.any())
        codes = np.where(letter, codes, np.uint32(32))
        codes = np.concatenate([carry if at else np.array([32], np.uint32), codes, np.array([32] if at + PIECE >= len(text) else [], np.uint32)])
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
        if len(codes) > 2:
            mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
            mixed ^= mixed >> np.uint32(15)
            counted = np.bincount((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16), minlength=BUCKETS)
            total = counted if total is None else total + counted
        carry = codes[-2:]
    if not found:
        return None
    at = np.flatnonzero(total)
    return at, total[at]


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, bucket, n) over every text where learn holds and the language is known."""
    rows = docs.where(learn & docs[lang_col].isNotNull()).select(docs[text_col].alias("text"), docs[lang_col].alias("lang"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BUCKETS, np.int64))

        def rows_of() -> Iterator[pa.RecordBatch]:
            for lang, total in held.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                if (grams := gram_counts(text.as_py())) is not None:
                    at, n = grams
                    held[lang.as_py()][at] += n
                    if len(held) > 64:
                        yield from rows_of()
        yield from rows_of()

    counts = rows.mapInArrow(counted, "lang string, bucket long, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log-smoothed trigram shares: languages in code-point order, shares[bucket, language]."""

    def __init__(self, counts: DataFrame):
        counts = written(counts)
        names = [r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
        if len(names) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would not fit a broadcast")
        self.names = sorted(names)
        shares = np.ones((BUCKETS, len(names)))
        # A language holds at most BUCKETS rows, so this is bounded by the model itself.
        for part in counts.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n")).toLocalIterator():
            shares[np.array(part["at"]), self.names.index(part["lang"])] += 2.0 * np.array(part["n"])
        drop(counts)
        self.shares = (shares / shares.sum(axis=0)).astype(np.float32)


def _fit(p: np.ndarray, n: np.ndarray, owner: np.ndarray, starts: np.ndarray, use: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for many texts at a time: p and n are an n-gram's shares and count, owner its text, use the languages allowed.

    Returns the proportions and the log-likelihood of each text."""
    p, use = np.ascontiguousarray(p.T), use.T
    weight = (use / use.sum(axis=0)).astype(np.float32)
    total = np.add.reduceat(n, starts)
    for _ in range(rounds):
        each = n / (p * weight[:, owner]).sum(axis=0)
        weight = weight * np.add.reduceat(p * each, starts, axis=1) / total
    mixed = (p * weight[:, owner]).sum(axis=0)
    return weight.T.copy(), np.add.reduceat(n * np.log(mixed), starts)


def infer(counts: list[tuple[np.ndarray, np.ndarray]], shares: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Proportions of the languages of each text, over the set of languages that wins.

    EM over all languages orders them for each text; the sets of its 1, 2, ... most likely ones are fitted anew, and
    the one with the best log-likelihood less penalty * (languages - 1) * log(n-grams) is kept; of equals the smaller.
    Larger sets are fitted only for texts in which a bound on every mixture's likelihood lets one of them win; the number
    of languages in a set has no other limit.
    """
    at = [buckets for buckets, _ in counts]
    starts = np.cumsum([0, *map(len, at)])[:-1]
    owner = np.repeat(np.arange(len(counts)), [len(x) for x in at])
    n = np.concatenate([c for _, c in counts]).astype(np.float32)
    p = shares[np.concatenate(at)]
    every = np.ones((len(counts), shares.shape[1]), np.float32)
    first, reached = _fit(p, n, owner, starts, every, rounds)
    place = np.argsort(np.argsort(-first, axis=1, kind="stable"), axis=1)
    total = np.add.reduceat(n, starts)
    size = np.log(total)
    best, best_value = _fit(p, n, owner, starts, (place < 1).astype(np.float32), 1)
    # By Jensen's inequality no mixture exceeds the one reached by more than total * log(largest mean of p over it).
    over = p * (n / np.einsum("ij,ij->i", p, first[owner]))[:, None]
    gap = total * np.log(np.add.reduceat(over, starts, axis=0).max(axis=1) / total)
    bound = reached + np.maximum(gap, 0) + 1e-5 * np.abs(reached)
    for k in range(2, shares.shape[1] + 1):
        open_ = bound - penalty * (k - 1) * size > best_value
        some = np.flatnonzero(open_)
        if not len(some):
            break
        held = open_[owner]
        new = np.repeat(np.arange(len(some)), [len(at[i]) for i in some])
        own = np.r_[0, np.flatnonzero(np.diff(new)) + 1]
        weight, value = _fit(p[held], n[held], new, own, (place[some] < k).astype(np.float32), rounds)
        value = value - penalty * (k - 1) * size[some]
        better = value > best_value[some]
        best[some[better]], best_value[some[better]] = weight[better], value[better]
    return best


def together(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbouring texts, as many at a time as their sizes add up to at most `most`, one at least."""
    first = held = 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield slice(first, i)
            first, held = i, 0
        held += size
    if sizes:
        yield slice(first, len(sizes))


def identify(
    docs: DataFrame, counts: DataFrame, penalty: float = 4.0, rounds: int = 8, text_col: str = "text",
) -> DataFrame:
    """Adds lang_pred, score and languages (map of language to proportion) to the documents.

    lang_pred is the language with the largest proportion in the chosen set, score that proportion; of equals the
    first in code-point order. A text that is null or has no letter, and any text if no language was learned, is und
    with score 0 and an empty map. Every row is kept, repeated or not, with its other columns; columns of docs that
    have the names of the new ones are replaced.
    """
    docs = docs.drop("lang_pred", "score", "languages")
    model = Model(counts)
    names = model.names
    shared = docs.sparkSession.sparkContext.broadcast(model.shares)
    place = docs.columns.index(text_col)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                found = [gram_counts(x.as_py()) for x in batch.column(place)]
                known = [i for i, c in enumerate(found) if c is not None and names]
                lang, score, mixed = [UNDETERMINED] * len(found), [0.0] * len(found), [[] for _ in found]
                if known:
                    counted = [found[i] for i in known]
                    parts = together([len(c[0]) * len(names) for c in counted], CELLS)
                    part = np.concatenate([infer(counted[x], shares, penalty, rounds) for x in parts])
                    for i, row in zip(known, part, strict=True):
                        top = int(row.argmax())
                        lang[i], score[i] = names[top], min(1.0, float(row[top]))
                        mixed[i] = [(names[k], float(row[k])) for k in np.flatnonzero(row > 1e-4)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))],
                    [*batch.schema.names, "lang_pred", "score", "languages"],
                )

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(map() as map<string,double>)").alias("languages")).schema
    return docs.mapInArrow(named, schema)
