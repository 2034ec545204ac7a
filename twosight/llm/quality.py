"""Operator 9: quality scores by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of each kind, positive and unlabelled, that the classifier is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 20_000
#: Bins of each feature, by its quantiles over the rows fitted on.
BINS = 12
#: A long text's words are looked at in pieces of this many characters, whose counts add up.
PIECE = 1 << 20
FEATURES = (
    "log_words word_length long_words upper capital_words all_caps letters digits blanks symbols exclaims pipes ends ends_odd "
    "distinct top_word repeats distinct_pairs lines line_words line_repeats sentence_words inner_symbols short_words code_signs"
).split()
_PUNCTUATION = set(".,;:?!'\"()-")
_SENTENCE_END = re.compile(r"[.!?](?:\s|$)")


def features(text: str | None) -> list[float]:
    """Shares and means that describe a text; all zero for a null or blank one. No list of words is used."""
    text = text or ""
    n_words = letters_in_words = long_words = short = caps = capital = ends = ends_odd = inner = repeats = 0
    counts: Counter = Counter()
    pairs: set[int] = set()
    last = None
    at = 0
    while at < len(text):
        stop = at + PIECE
        if stop < len(text):  # to the end of the word
            while stop < len(text) and not text[stop].isspace():
                stop += 1
        words = text[at:stop].split()
        at = stop
        if not words:
            continue
        n_words += len(words)
        counts.update(words)
        repeats += sum(map(str.__eq__, words[1:], words)) + (words[0] == last)
        pairs.update(map(hash, zip(words, words[1:])))
        last = words[-1]
    for word, n in counts.items():
        size = len(word)
        letters_in_words += n * size
        long_words += n * (size > 14)
        short += n * (size < 3)
        if word.isupper():
            caps += n * (size > 1)
        elif word[0].isupper():
            capital += n
        end = word[-1]
        if not end.isalnum():
            ends += n
            ends_odd += n * (end not in _PUNCTUATION or word[-2:-1] == end)
        inner += n * (not word.strip(".,;:?!'\"()-*#%&$|").isalnum())
    if not n_words:
        return [0.0] * len(FEATURES)
    # Counts by character: all of them in one pass over the encoded text.
    chars = Counter()
    for start in range(0, len(text), PIECE):
        chars.update(text[start : start + PIECE])
    size = len(text)
    count = lambda test: sum(n for c, n in chars.items() if test(c)) / size
    lines = text.split("\n")
    filled = [x for x in lines if x.strip()]
    sentences = len(_SENTENCE_END.findall(text)) or 1
    return [
        np.log1p(n_words), letters_in_words / n_words, long_words / n_words, count(str.isupper), capital / n_words, caps / n_words,
        count(str.isalpha), count(str.isdigit), count(str.isspace), count(lambda c: not c.isalnum() and not c.isspace() and c not in _PUNCTUATION),
        chars["!"] / size, chars["|"] / size, ends / n_words, ends_odd / n_words, len(counts) / n_words, max(counts.values()) / n_words,
        repeats / n_words, len(pairs) / n_words, np.log1p(len(lines)), n_words / max(1, len(filled)), 1 - len(set(filled)) / max(1, len(filled)),
        n_words / sentences, inner / n_words, short / n_words, count(lambda c: c in "{}<>=_/\\[]"),
    ]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, x) with the features of every whole text."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return rows.mapInArrow(measured, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Classifier:
    """An additive model over binned features, fitted with the non-negative positive-unlabelled risk."""

    def __init__(self, positive: np.ndarray, every: np.ndarray, cuts: list[np.ndarray], share: tuple[float, float] | None = None, rounds: int = 400):
        """positive: features of trusted positives; every: features of rows whatever their label; cuts: inner bin edges per
        feature; share: the share of positives among rows with either label and its standard error, where both labels occur."""
        self.cuts = cuts
        p, u = self.binned(positive), self.binned(every)
        tail, error = self._tail(p, u, rounds)
        if share is not None:
            # Two estimates of one prior, each by its precision; the tail's own slack adds to its chance error.
            a, b = 1 / (error**2 + 0.05**2), 1 / max(share[1], 1e-3) ** 2
            tail = (a * tail + b * share[0]) / (a + b)
        self.prior = float(np.clip(tail, 0.05, 0.98))
        self.weights = self._descend(p, u, self.prior, rounds)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Places in the weights: one per feature."""
        return np.stack([np.searchsorted(c, x[:, k], side="right") + k * (BINS + 1) for k, c in enumerate(self.cuts)], axis=1)

    @staticmethod
    def _value(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        return weights[places].sum(axis=1) + weights[-1]

    def _tail(self, p: np.ndarray, u: np.ndarray, rounds: int, folds: int = 5) -> tuple[float, float]:
        """The class prior from a plain classifier of positive rows against all: the least ratio of P(row above t) to
        P(positive above t), over t that at least half of the positives exceed, raised by its standard error, and that error.

        Every row is ranked by a classifier that has not seen it: one that has ranks its own positives too high."""
        sp, su = np.zeros(len(p)), np.zeros(len(u))
        for fold in range(folds):
            inside = lambda x, f=fold: np.arange(len(x)) % folds == f
            if not (~inside(p)).any() or not (~inside(u)).any():
                continue
            ranker = self._descend(p[~inside(p)], u[~inside(u)], 0.5, rounds // 2, plain=True)
            sp[inside(p)], su[inside(u)] = self._value(ranker, p[inside(p)]), self._value(ranker, u[inside(u)])
        cuts = np.quantile(sp, np.linspace(0, 0.5, 51))
        up = np.array([(su >= t).mean() for t in cuts])
        pp = np.maximum(np.array([(sp >= t).mean() for t in cuts]), 1e-9)
        error = np.sqrt(up * (1 - up) / len(u) + (up / pp) ** 2 * pp * (1 - pp) / len(p)) / pp
        at = int(np.argmin(up / pp + error))
        return float((up / pp + error)[at]), float(error[at])

    def _descend(self, p: np.ndarray, u: np.ndarray, prior: float, rounds: int, plain: bool = False) -> np.ndarray:
        """Adam over the whole batch. The risk is prior * l(p, 1) + max(0, l(u, 0) - prior * l(p, 0)), with the logistic
        loss l. Where the second part is below 0, steps go against it, as the non-negative estimator asks."""
        size = len(self.cuts) * (BINS + 1) + 1
        w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        grad_of = lambda places, g: np.r_[np.bincount(places.ravel(), np.repeat(g, places.shape[1]), size - 1), g.sum()]
        for t in range(1, rounds + 1):
            sp, su = sigmoid(self._value(w, p)), sigmoid(self._value(w, u))
            as_one = grad_of(p, (sp - 1) / len(p))
            if plain:
                grad = 0.5 * as_one + 0.5 * grad_of(u, su / len(u))
            else:
                rest = grad_of(u, su / len(u)) - prior * grad_of(p, sp / len(p))
                loss = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
                grad = prior * as_one + rest if loss >= 0 else -rest
            grad = grad + 1e-4 * w
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._value(self.weights, self.binned(x)), -30, 30)))


def bin_edges(rows: DataFrame) -> list[np.ndarray]:
    """The distinct inner edges of BINS bins of equal numbers of rows per feature, over all rows."""
    wanted = [float(q) for q in np.linspace(0, 1, BINS + 1)[1:-1]]
    found = rows.agg(*[F.percentile_approx(F.col("x")[k], wanted, 1000).alias(f"f{k}") for k in range(len(FEATURES))]).first()
    return [np.unique(np.array(edges or [], float)) for edges in found]


def fit(rows: DataFrame, labels: DataFrame, learn: Column, most: int = FIT_ROWS, label: str = "quality") -> Classifier | None:
    """The classifier from rows (doc_id, x): trusted positives are labelled 1; the rows that stand for all are those
    that may be learned from, whatever their label, so that it doesn't matter how many have none.

    Of each of the two about `most` rows are read, by a hash cut-off that follows from their number. Bin edges, numbers
    and the share of positives cover all rows. An id with labels that differ counts as unlabelled. None if there is no positive.
    """
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
    joined = rows.where(learn).join(one, "doc_id", "left")
    known = F.when(F.col("_low") == F.col("_high"), F.col("_low"))
    joined = written(joined.select("x", known.alias("known"), F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)).alias("_h")))
    ones, zeros, n = joined.agg(F.count_if(F.col("known") == 1), F.count_if(F.col("known") == 0), F.count(F.lit(1))).first()
    if not ones:
        return None
    parts = []
    for sample, size in ((joined.where(F.col("known") == 1), ones), (joined, n)):
        some = sample.where(F.col("_h") <= int(min(1.0, most / size) * (1 << 30))).select("_h", "x").toPandas()
        some = some.iloc[np.lexsort((some["x"].map(tuple), some["_h"]))] if len(some) else some
        parts.append(np.array(some["x"].tolist(), float).reshape(len(some), len(FEATURES)))
    share = (ones / (ones + zeros), float(np.sqrt(ones * zeros / (ones + zeros) ** 3))) if zeros else None
    return Classifier(*parts, bin_edges(joined), share) if all(map(len, parts)) else None


def judge(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.3, most: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out (learn does not hold), score, predicted (1 if score >= threshold).

    learn is a condition on doc_id that says which documents' labels may be used; null counts as no. Scores depend on
    the text alone. Null and blank texts are scored from their zero features. If no document that may be learned from is
    labelled 1, every score is 0.5. Repeated rows each get a row; other columns are not returned.
    """
    rows = written(described(docs, id_col, text_col))
    learn = F.coalesce(learn, F.lit(False))
    model = fit(rows, labels, learn, most)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            s = model.score(x) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (~learn).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
