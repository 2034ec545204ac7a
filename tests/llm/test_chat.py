"""Layout fingerprints, canonical turns, the template and its reading back."""

from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from twosight.llm import chat

RECORDS = {
    1: {"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": None}, {"role": "gpt", "content": "c", "weight": 1}], "meta": {"a.b": [1]}},
    2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": 7}]},
    3: {"dialog": {"turns": [{"speaker": "user", "utterance": "u"}], "id": 4}},
    4: {"instruction": "do", "input": "this", "output": "done", "output_tokens": 3},
    5: {"instruction": "do", "output": "done"},
    6: {"system": "be", "prompt": "p", "completion": "</s>[INST] ok [/INST]"},
    7: {"prompt": "p", "response": None},
    8: {"context": None, "question": "q", "answer": "a"},
    9: {"title": "none of these"},
    10: {"messages": []},
    11: {"conv_id": 77, "turn": 3, "role": "user", "text": "row"},
    12: [1, 2],
    13: {"a": {"messages": [{"role": "user", "content": "not here"}]}},
}
EXPECTED = {
    1: ("messages", [("system", "s"), ("user", ""), ("assistant", "c")]),
    2: ("conversations", [("user", "q"), ("assistant", "7")]),
    3: ("nested_turns", [("user", "u")]),
    4: ("instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    5: ("instruction", [("user", "do"), ("assistant", "done")]),
    6: ("prompt_completion", [("system", "be"), ("user", "p"), ("assistant", "</s>[INST] ok [/INST]")]),
    7: ("prompt_response", [("user", "p"), ("assistant", "")]),
    8: ("question_answer", [("user", "q"), ("assistant", "a")]),
    9: (None, []), 10: (None, []), 77: ("turn_rows", [("user", "row")]), 12: (None, []), 13: (None, []), 14: (None, []), 15: (None, []),
}


@pytest.fixture(scope="module")
def records(spark):
    rows = [(k, json.dumps(v), "x", "y") for k, v in RECORDS.items()] + [(14, None, "x", "y"), (15, "{broken", "x", "y")]
    return spark.createDataFrame(rows, "id long, record string, layout string, _key string")


def test_records_of_many_layouts(records):
    rows = chat.record_turns(records, "id", "record").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.conv, r.at if r.at is not None else -1)):
        layout, turns = found.setdefault(r.conv, (r.layout, []))
        assert layout == r.layout
        if r.role is not None:
            turns.append((r.role, r.text))
    assert found == EXPECTED
    assert chat.record_turns(records.where("false"), "id", "record").count() == 0
    assert {r.conv for r in chat.silent(chat.record_turns(records, "id", "record")).collect()} == {9, 10, 12, 13, 14, 15}


def test_paths_of_records_and_schemas_agree(spark):
    record = {"b": {"c d": [{"x": [[1]], "y": None}], "e": {}}, "a`b": True, "f": [], "g": 1.5}
    v = spark.range(1).select(F.try_parse_json(F.lit(json.dumps(record))).alias("v"))
    assert v.select(chat.record_paths(F.col("v"))).first()[0] == sorted({"b.`c d`[].x[][]", "b.`c d`[].y", "b.e", "`a``b`", "f[]", "g"})
    typed = spark.createDataFrame([], "b struct<`c d`: array<struct<x: array<array<int>>, y: string>>, e: string>, `a``b`: boolean, f: array<int>, g: double")
    assert sorted(chat.schema_paths(typed.schema)) == v.select(chat.record_paths(F.col("v"))).first()[0]


def test_tables(spark):
    rows = [(1, "a", [("human", "q"), ("gpt", None)]), (2, "b", []), (3, "c", None)]
    table = spark.createDataFrame(rows, "id long, text string, messages array<struct<role: string, content: string>>")
    got = sorted(chat.table_turns(table, "id").collect(), key=str)
    assert [(r.conv, r.at, r.role, r.text) for r in got] == [(1, 0, "user", "q"), (1, 1, "assistant", ""), (2, None, None, None), (3, None, None, None)]
    flat = spark.createDataFrame([(5, "do", "done", 1)], "id long, instruction string, output string, conv long")
    assert [(r.role, r.text, r.layout) for r in chat.table_turns(flat, "id").collect()] == [("user", "do", "instruction"), ("assistant", "done", "instruction")]
    with pytest.raises(ValueError, match="no layout"):
        chat.table_turns(spark.range(1), "id")


TURNS = [
    (1, 2, "assistant", "z é\U0001f600 <|im_end|>\n<|im_start|>user\nhi"), (1, 1, "user", None), (1, 0, "system", r"<\s> </s> [INST] [\\/INST] <<SYS>>"),
    (2, None, "user", "no turn number"), (2, 0, None, ""), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"),
    (None, 5, "odd role\n<|im_end|>", "x"), (3, 0, "assistant", ""), (4, 0, "user", "w " * 200_000),
]


def test_formatting_is_read_back(spark):
    table = spark.createDataFrame([(*t, 1, 2) for t in TURNS], "conv_id long, turn long, role string, text string, conv long, _turn long")
    made = chat.read_back(chat.formatted(chat.table_turns(table, "conv_id"))).collect()
    assert {r.conv for r in made} == {1, 2, 3, 4, None}
    for r in made:
        want = [(role or "", text or "") for c, at, role, text in sorted((t for t in TURNS if t[0] == r.conv), key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))]
        assert [tuple(t) for t in r.turns] == want and r.n_turns == len(want)
        assert r.loss_texts == [text for role, text in want if role == "assistant"]
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == len(want)
        for other in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert other not in r.formatted
        for span, text in zip(r.loss, r.loss_texts, strict=True):
            raw = r.formatted[span.start : span.start + span.chars]
            assert raw.replace("\\", "") == text.replace("\\", "") and r.formatted[span.start + span.chars :].startswith(chat.CLOSE)
    assert chat.formatted(chat.table_turns(table.where("false"), "conv_id")).count() == 0


def test_escape_round_trip(spark):
    pieces = ["<", "\\", "\\\\", "[", "/", "s>", "INST]", "|im_start|>", "|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "|endoftext|>", "a", "\n", "é"]
    texts = []

    @settings(max_examples=400, database=None)
    @given(st.lists(st.sampled_from(pieces), max_size=12).map("".join))
    def collect(text):
        texts.append(text)

    collect()
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    made = table.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"))
    for r in made.collect():
        assert r.t == r.u
        assert not any(c in r.e for c in ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_no_python_in_the_plan(spark, records):
    plan = chat.read_back(chat.formatted(chat.record_turns(records, "id", "record")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow", "Cartesian", "NestedLoop"))
    assert plan.count("Exchange hashpartitioning") == 1
