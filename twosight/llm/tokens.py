"""Operator 2: token counts by rank-synchronous merging of byte pairs in ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens held at a time, and pre-tokens whose counts a worker remembers.
HELD, REMEMBERED = 500_000, 1_000_000
_NONE = np.int64(1) << 40


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class Merger:
    """Counts tokens with the merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[x] for x in _byte_letters()], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.levels = self._hashed(keys, made)
        self.pattern = regex.compile(PRE_TOKEN)
        special = sorted((t["content"] for t in spec.get("added_tokens") or ()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    @staticmethod
    def _hashed(keys: np.ndarray, made: np.ndarray) -> list[tuple]:
        """Pairs in a few hash tables; a pair whose place is taken goes to the next, until none is left."""
        levels, left, bits, factor = [], np.arange(len(keys)), 20, 0x9E3779B97F4A7C15
        while len(left):
            places = (keys[left].astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)
            _, one = np.unique(places, return_index=True)
            table = np.full(1 << bits, -1, np.int64)
            rank = np.full(1 << bits, _NONE, np.int64)
            symbol = np.zeros(1 << bits, np.int64)
            at = places[one].astype(np.int64)
            table[at], rank[at], symbol[at] = keys[left[one]], left[one], made[left[one]]
            levels.append((np.uint64(factor), np.uint64(64 - bits), table, rank, symbol))
            left = np.delete(left, one)
            bits, factor = max(8, bits - 4), (factor * 6364136223846793005 + 1442695040888963407) % 2**64 | 1
        return levels

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; pairs without a merge rank _NONE."""
        keys = left * self.size + right
        rank, symbol = np.full(len(keys), _NONE), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for factor, shift, table, ranks, symbols in self.levels:
            k = keys[open_]
            at = ((k.astype(np.uint64) * factor) >> shift).astype(np.int64)
            same = table[at] == k
            rank[open_[same]], symbol[open_[same]] = ranks[at[same]], symbols[at[same]]
            open_ = open_[~same & (table[at] >= 0)]
            if not len(open_):
                break
        return rank, symbol

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each piece. All pieces lie end to end in one array; in each step every piece that still has
        a pair with a merge applies its lowest-rank pair, wherever it occurs, from the left."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        counts = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        while len(symbols) > 1:
            inside = owner[:-1] == owner[1:]
            rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
            rank[:-1][inside], made[:-1][inside] = self.ranks(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(rank, starts)
            live = np.repeat(least, sizes)
            hit = np.flatnonzero((rank == live) & (live < _NONE))
            if not len(hit):
                break
            # Hits on neighbouring places overlap (a pair of equal symbols): every second one of such a run counts.
            head = np.r_[True, np.diff(hit) > 1]
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
            symbols[hit] = made[hit]
            np.subtract.at(counts, owner[hit], 1)
            keep = live < _NONE
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        self.known.update(zip(new, self.merge([x.encode() for x in new]).tolist(), strict=True))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text. Pre-tokens are held in groups of about HELD, also within one long text."""
        totals = np.zeros(len(texts), np.int64)
        held: list[tuple[int, list[str]]] = []
        n = 0

        def flush() -> None:
            nonlocal n
            parts = [set(x).difference(self.known) for _, x in held]
            new = list(set().union(*parts)) if parts else []
            if len(self.known) + len(new) > REMEMBERED:  # learn() then forgets the old ones
                self.known.clear()
                new = list(set().union(*(x for _, x in held)))
            if new:
                self.learn(new)
            for i, x in held:
                totals[i] += sum(map(self.known.__getitem__, x))
            held.clear()
            n = 0

        for i, text in enumerate(texts):
            pieces = [text or ""]
            if self.special and text:
                pieces = self.special.split(text)
                totals[i] += len(pieces) - 1
            for piece in pieces:
                if len(piece) <= 4 * HELD:
                    held.append((i, self.pattern.findall(piece)))
                    n += len(held[-1][1])
                    if n >= HELD:
                        flush()
                    continue
                found = (m.group() for m in self.pattern.finditer(piece))
                while part := list(islice(found, HELD)):
                    held.append((i, part))
                    flush()
        flush()
        return totals


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The counts are those of the vocabulary's library for the whole text, without begin and end tokens; the strings of
    added tokens inside a text are one token each, as is its default. path names the vocabulary file, which every
    executor has. Null and empty texts have 0 bytes and 0 tokens. Rows are kept as they are, repeated or with null id;
    other columns are not returned.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n = tool.count(part.column("text").to_pylist())
                lengths = [0 if x is None else x for x in pa.compute.binary_length(part.column("text")).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
