import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harvestline.llm import chat_format as cf

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    chats = {}
    for conv, turn, role, text in rows:
        chats.setdefault(conv, []).append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    return {c: [(r[1], t[1]) for _, r, t in sorted(turns)] for c, turns in chats.items()}


def check(spark, rows, df=None):
    df = spark.createDataFrame(rows, TURNS) if df is None else df
    want = plain(rows)
    formatted = cf.format_chats(cf.turn_rows(df))
    for r in cf.read_back(formatted).collect():
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["learnt"] == [t for role, t in turns if role == "assistant"]
    for r in formatted.collect():
        masked = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_mask"]]
        inner = r["formatted"].replace(cf.TURN, "").replace(cf.END, "")
        assert not any(c in inner for c in cf.CONTROL if c != "\\")
        assert len(masked) == sum(role == "assistant" for role, _ in want[r["conv_id"]])
    for r in cf.chat_report(df).collect():
        turns = want[r["conv_id"]]
        learnt = "".join(t for role, t in turns if role == "assistant")
        told = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(learnt))
        assert r["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    return formatted


NASTY = [*cf.CONTROL, "\\n", "\\l", "\\\\", "\n", cf.TURN, cf.END, "<", "|", "assistant", "é\U0001f600", " ", "$1", "[/INST"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", ""]), st.lists(st.sampled_from(NASTY), max_size=8)), min_size=5, max_size=30))
def test_any_text_reads_back(spark, turns):
    check(spark, [(i % 4, i, role, "".join(parts)) for i, (role, parts) in enumerate(turns)])


def test_awkward_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "assistant", None), (1, 2, None, ""), (None, 1, "assistant", "x"), (2, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS piece", "2 AS number", "3 AS formatted", "'z' AS layout", "4 AS part")
    check(spark, rows, df)


def test_long_conversation(spark):
    check(spark, [(1, i, ("user", "assistant")[i % 2], f"text {i}") for i in range(3000)])


def test_empty_table(spark):
    assert cf.chat_report(spark.createDataFrame([], TURNS)).collect() == []


RECORDS = [
    ({"role": "user", "text": "hi"}, "turn", [("user", "hi")]),
    ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"response": "r", "prompt": "p"}, "answer", [("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": 7}, "question", [("user", "q"), ("assistant", "7")]),
    ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction_input", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": None}, "instruction_input", [("user", "i"), ("assistant", None)]),
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "h"), ("assistant", "g")]),
    ({"unheard": 1}, None, []),
    ([1, 2], None, []),
]


def test_layouts_are_told_by_their_fingerprint(spark):
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(RECORDS)] + [(98, "not json"), (99, None)]
    got = {r["id"]: r for r in cf.canonical_turns(spark.createDataFrame(rows, "id long, record string")).collect()}
    assert len(got) == len(rows)
    for i, (_, layout, turns) in enumerate(RECORDS):
        assert (got[i]["layout"], [(t["role"], t["text"]) for t in got[i]["turns"]]) == (layout, turns), i
    assert got[98]["layout"] is None and got[99]["layout"] is None


@pytest.mark.parametrize(("name", "paths"), [(n, p) for n, p, _ in cf.LAYOUTS])
def test_typed_and_json_records_have_one_fingerprint(spark, name, paths):
    record = next(r for r, layout, _ in RECORDS if layout == name)
    df = spark.createDataFrame([(json.dumps(record),)], "record string")
    schema = spark.read.json(spark.createDataFrame([(json.dumps(record),)], "record string").rdd.map(lambda r: r[0])).schema
    assert cf.schema_paths(schema) == sorted(paths)
    (row,) = df.select(cf.fingerprint(cf.F.parse_json("record")).alias("a"), cf.fingerprint_of(cf.schema_paths(schema)).alias("b")).collect()
    assert row["a"] == row["b"]


def test_unknown_typed_layout_is_refused(spark):
    with pytest.raises(ValueError, match="no mapping"):
        cf.turn_rows(spark.createDataFrame([(1, 0, "x")], "conv_id long, turn long, body string"))


def read(turns):
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in cf.read_back(cf.format_chats(turns)).collect()}


def test_records_of_all_layouts_through_to_chats(spark):
    further = {"id": 7, "source": "x", "meta": {"role": "r"}, "system": None}
    rows = [(i, 0, json.dumps({**r, **more})) for more in ({}, further) for i, (r, layout, _) in enumerate(RECORDS) if layout]
    rows = [(k, turn, record) for k, (_, turn, record) in enumerate(rows)]
    want = [[(role, text or "") for role, text in turns] for _, layout, turns in RECORDS if layout] * 2
    got = read(cf.record_rows(spark.createDataFrame(rows, "conv_id long, turn long, record string")))
    assert got == dict(enumerate(want))


def test_further_keys_inside_messages_and_empty_lists(spark):
    records = [
        {"messages": [{"role": "user", "content": "u", "name": "n", "weight": 1}, {"role": "assistant", "content": "a"}], "id": 1},
        {"messages": []},
        {"messages": [1, 2]},
        {"messages": "text"},
        {"messages": None},
        {"role": "user", "text": "t", "input": "x", "prompt": "p"},
        {"instruction": "i", "input": "x", "output": "o", "answer": "a"},
        {"prompt": "p"},
    ]
    rows = [(i, json.dumps(r), "mine", 3) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "id long, record string, layout string, paths long")
    got = {r["id"]: r for r in cf.canonical_turns(df).collect()}
    assert [got[i]["layout"] for i in range(len(records))] == ["messages", "messages", None, None, None, "turn", "instruction_input", None]
    turns = [[(t["role"], t["text"]) for t in got[i]["turns"]] for i in range(len(records))]
    assert turns == [[("user", "u"), ("assistant", "a")], [], [], [], [], [("user", "t")], [("user", "i\n\nx"), ("assistant", "o")], []]
    assert all(r["paths"] == 3 for r in got.values())


def test_columns_called_like_fields_of_other_layouts(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, None, None), (None, 0, "assistant", "c")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS input", "'y' AS prompt", "7 AS answer", "'z' AS row", "1 AS paths", "2 AS record")
    check(spark, rows, df)


def test_typed_lists_of_messages(spark):
    rows = [(1, 0, [("u", "user", 1), ("a", "assistant", 2)]), (2, 0, []), (3, 0, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, messages array<struct<content string, role string, weight int>>")
    assert read(cf.turn_rows(df)) == {1: [("user", "u"), ("assistant", "a")]}
