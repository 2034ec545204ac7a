"""Operator 5: URL rules in a trie over reversed host labels and path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one pickled trie that may be broadcast. A larger list is cut into several tries, applied one after another.
TRIE_BYTES = 32 << 20


class Node:
    """labels: next host label, from the right. segments: next whole path segment. ends: (rest of a path, fit)."""

    __slots__ = ("labels", "segments", "ends")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.ends: list[tuple[str, tuple]] = []


def build(rules: Iterable[tuple[int, str, str, str]]) -> Node:
    """The trie of (number, verdict, host, path). A fit is (host labels, path length, -number, rule, verdict): the greatest wins."""
    root = Node()
    for number, verdict, host, path in rules:
        node, labels = root, host.split(".")
        for label in reversed(labels):
            node = node.labels.setdefault(label, Node())
        *whole, rest = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.ends.append((rest, (len(labels), len(path), -number, host + path, verdict)))
        node.ends.sort(key=lambda e: e[1], reverse=True)
    return root


def longest(root: Node, host: str, path: str) -> tuple | None:
    """The fit with the longest host, then the longest path."""
    chain, node = [], root
    for label in reversed(host.split(".")) if host else ():
        if (node := node.labels.get(label)) is None:
            break
        chain.append(node)
    segments = path.split("/")
    for node in reversed(chain):
        way = [(node, segments[0])]
        for segment, rest in zip(segments, segments[1:]):
            if (node := node.segments.get(segment)) is None:
                break
            way.append((node, rest))
        for node, rest in reversed(way):
            # The rest of a rule's path may end inside the segment that follows.
            for end, fit in node.ends:
                if rest.startswith(end):
                    return fit
    return None


def split_url(url):
    """Host and path columns: host after the first ://, up to / ? # or the end, A-Z lower-cased; path up to ? or #."""
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def tries(rules: Sequence[tuple[str, str, str]], most: int = TRIE_BYTES) -> list[bytes]:
    """The rules as pickled tries, none over most bytes unless it holds a single rule."""
    todo, out = [[(i, *rule) for i, rule in enumerate(rules)]], []
    while todo:
        part = todo.pop()
        data = pickle.dumps(build(part))
        if len(data) <= most or len(part) <= 1:
            out.append(data)
        else:
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return out


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow", most: int = TRIE_BYTES,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule that fits; else null), verdict.

    rules are (verdict, host, path). A rule fits its host and all subdomains of it if the url's path starts with the
    rule's. The longest host wins, then the longest path, whatever the verdicts are; of equal rules the first.
    Without a rule the verdict is default. A null url, or one without ://, has empty host and path and no rule.
    Rows are kept as they are, repeated or with null id; other columns are not returned.
    """
    host, path = split_url(pages[url_col])
    fit = "struct<labels:int,length:int,place:int,rule:string,verdict:string>"
    rows = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in (x.split(":") for x in fit[7:-1].split(","))))
    schema = rows.schema
    names = schema.names[3:]
    for data in tries(rules, most):
        shared = pages.sparkSession.sparkContext.broadcast(data)

        def fitted(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            root = pickle.loads(shared.value)
            for frame in frames:
                old = [None if r is None else (int(a), int(b), int(c), r, v) for a, b, c, r, v in zip(*(frame[n] for n in names), strict=True)]
                new = [longest(root, h, p) for h, p in zip(frame["host"], frame["path"], strict=True)]
                best = [max((x for x in pair if x), default=(None,) * 5) for pair in zip(old, new, strict=True)]
                fits = pd.DataFrame(best, columns=names, index=frame.index)
                for n in names[:3]:
                    fits[n] = fits[n].astype("Int32")
                yield pd.concat([frame.iloc[:, :3], fits], axis=1)

        rows = rows.mapInPandas(fitted, schema)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
