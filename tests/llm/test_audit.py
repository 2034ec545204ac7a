"""The filter audit against brute force over every order."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

from twosight.llm import audit
from twosight.llm.queries import AUDIT_FILTERS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [
    None, "", " \n", "short", LONG, LONG, LONG, LONG + " # mark", "WORDS " * 150, "same same " * 80 + "$", LONG.upper(), LONG.upper() + " &", "Ünï " * 99, "x|y",
    " ".join(f"W{i}" for i in range(101)), " ".join(f"long{i}" for i in range(60_000)), "é" * 9 + "A", "é" * 10 + "A",
]
LANGS = ["en", "de", None, ""]


def rows():
    out = [(i, t, LANGS[i % 4], "s", 1) for i, t in enumerate(TEXTS)]
    out += [(i + 100, t, LANGS[i % 3], "s", 1) for i, t in enumerate(TEXTS)]
    return out + [out[4], out[4], (None, LONG, "en", "s", 1), (None, None, None, "s", 1), (-5, "x|y", "fr", "s", 1), (200, LONG + " clean", "it", "s", 1)]


LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (101, None, 1)]


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    judged = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, *_ in docs),
        }
        judged.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = {}
    for part in {j[0] for j in judged}:
        own, shapley = [j for j in judged if j[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(removed)
                all_failing = sum(f in j[1] for j in own)
                out[part, "".join(order), step] = [len(left), len(removed), all_failing - len(removed), sum(j[1] == {f} for j in own), sum(j[2] for j in removed), sum(j[3] for j in removed), f]
        for key in out:
            if key[0] == part:
                out[key][6] = shapley[out[key][6]]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, part string, good int")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("row", F.lit(1))


def test_every_order(tables):
    got = audit.audit(*tables, AUDIT_FILTERS, copies="E")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {(r.part, r.filter_order, r.step): list(r)[3:] for r in got.collect()}
    assert found == brute(rows(), LABELS)
    assert len(found) == 5 * 600 and all(v[0] == 1 and v[1] == 0 for k, v in found.items() if k[0] == "it")


def test_empty_tables(tables):
    docs, labels = tables
    assert audit.audit(docs.where("false"), labels, AUDIT_FILTERS, copies="E").count() == 0
    found = audit.audit(docs, labels.where("false"), AUDIT_FILTERS, copies="E").agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert found[0] == found[1] == 0 < found[2]


def test_no_filter_fails(spark):
    docs = spark.createDataFrame([(1, LONG, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit(docs, labels, {"A": audit.few_words(3), "D": audit.holds("#")}).collect()
    assert sorted((r.filter_order, r.step, r.kept, r.removed) for r in got) == [("AD", 1, 1, 0), ("AD", 2, 1, 0), ("DA", 1, 1, 0), ("DA", 2, 1, 0)]
