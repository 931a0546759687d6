import json

from pyspark.sql import functions as F

from logclew.llm import chat

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, "messages"),
    ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "shared"),
    ({"conversations": [{"from": "human", "value": "q"}], "system": "s", "x": {"y": 1}}, "shared_system"),
    ({"prompt": "a", "completion": "b"}, "completion"),
    ({"prompt": "a", "response": "b", "id": 3}, "response"),
    ({"system": "s", "prompt": "a", "response": "b"}, "system_response"),
    ({"question": "a", "answer": "b"}, "question"),
    ({"instruction": "a", "output": "b"}, "instruction"),
    ({"instruction": "a", "input": "i", "output": "b"}, "instruction_input"),
    ({"prompt": "a", "response": None}, "prompt"),
    ({"title": "a"}, None),
    ([1, 2], None),
    ("text", None),
]
WANT = {
    "messages": [("user", "hi"), ("assistant", "yo")],
    "shared": [("user", "hi"), ("assistant", "yo")],
    "shared_system": [("system", "s"), ("user", "q")],
    "completion": [("user", "a"), ("assistant", "b")],
    "response": [("user", "a"), ("assistant", "b")],
    "system_response": [("system", "s"), ("user", "a"), ("assistant", "b")],
    "question": [("user", "a"), ("assistant", "b")],
    "instruction": [("user", "a"), ("assistant", "b")],
    "instruction_input": [("system", "a"), ("user", "i"), ("assistant", "b")],
    "prompt": [("user", "a")],
}


def test_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(99, None), (98, "{broken")]
    records = spark.createDataFrame(rows, "id int, record string")
    got = {r.conv_id: r for r in chat.canonical_turns(records, "id", "record").collect()}
    for i, (_, layout) in enumerate(RECORDS):
        assert got[i].layout == layout, RECORDS[i]
        turns = None if layout is None else WANT[layout]
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == turns
    assert got[99].layout is None and got[98].layout is None


def test_fingerprints_of_layouts_differ():
    paths = [tuple(x.paths) for x in chat.LAYOUTS]
    assert len(set(paths)) == len(paths)


HARD = [
    "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\n", "\\l \\b \\s \\n \\\\", "a < b [x] <|", "<<SYS>>x<</SYS>>",
    "", "ünï 😀 code", "line\nbreak\n\n", "$1 \\$1",
]


def test_escape_is_reversible_and_hides_marks(spark):
    rows = spark.createDataFrame([(t,) for t in HARD], "t string")
    escaped = chat.escape(F.col("t"))
    for r in rows.select("t", escaped.alias("e"), chat.unescape(escaped).alias("u"),
                         chat.unescape(chat.escape(F.col("t"), True)).alias("v")).collect():
        assert r.u == r.t == r.v
        assert not any(m in r.e for m in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    assert rows.where(F.col("t") == "a < b [x] <|").select(escaped).first()[0] == "a < b [x] \\l|"


def test_read_back_and_loss_mask(spark):
    turns = []
    for c in range(4):
        for n, text in enumerate(HARD):
            role = ("user", "assistant", "tool\nx", None)[(n + c) % 4]
            turns.append((c, n // 2, role, None if text == "" else text))
    table = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    formatted = chat.format_turns(chat.canonical_turns(chat.records_of(table), "conv_id", "record"))
    read = formatted.select(
        "conv_id", "formatted", "loss", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("said"),
    )
    for r in read.collect():
        mine = sorted((t, role or "", text or "") for c, t, role, text in turns if c == r.conv_id)
        assert [tuple(t) for t in r.turns] == [(role, text) for _, role, text in mine]
        assert r.said == "".join(text for _, role, text in mine if role == "assistant")
        assert len(r.loss) == sum(role == "assistant" for _, role, _ in mine)


def test_plain_layouts_are_used(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "q"),
            (2, 2, "assistant", "a"), (3, 0, "user", "q"), (4, 0, "assistant", "a"), (5, 0, "tool", "t")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = chat.canonical_turns(chat.records_of(table), "conv_id", "record").collect()
    layouts = {r.conv_id: r.layout for r in got}
    assert layouts == {1: "response", 2: "instruction_input", 3: "prompt", 4: "shared", 5: "messages"}
    # "instruction" stands for the system turn there.
    assert {r.conv_id: [t.role for t in r.turns] for r in got}[2] == ["system", "user", "assistant"]


def test_main_path_is_native(spark):
    from logclew.llm.queries import op10_schema_fingerprint

    plan = op10_schema_fingerprint(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    records = chat.records_of(none)
    assert chat.format_turns(chat.canonical_turns(records, "conv_id", "record")).count() == 0
