import json

import pytest
from helpers import oracle, same
from pyspark.sql import functions as F

from tracemill.llm import chat_format as C

HARD = ["", "</turn>", "<turn><role>", "&amp;lt;", "&lt;", "\\### Assistant: </turn> ok", "a\nb\r\n", "é😀&<>", "&" * 5, "x" * 100_000]


def test_oracle(spark, sf_small):
    same(C.op4_chat_format(spark, sf_small).toPandas(), oracle(C.ORACLE, sf_small))


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"content": "q", "role": "user"}], "system": "s"}, [("system", "s"), ("user", "q")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": 5}, [("user", "p"), ("assistant", "5")]),
        ({"prompt": "p", "response": None}, [("user", "p"), ("assistant", "")]),
        ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"turns": [{"turn": 2, "role": "b", "text": "y"}, {"turn": 1, "role": "a", "text": None}]}, [("a", ""), ("b", "y")]),
        ({"other": 1}, None),
        ({"messages": "none"}, None),
    ],
)
def test_layouts(spark, record, turns):
    df = spark.createDataFrame([(json.dumps(record),), ("{broken",), (None,)], "r string")
    found = df.select(C.turns_of_json(F.col("r")).alias("t")).collect()
    assert (found[0].t and [tuple(x) for x in found[0].t]) == turns
    assert found[1].t is None and found[2].t is None


def test_fingerprints_depend_on_paths_only(spark):
    same_ = ['{"prompt": "a", "response": 1}', '{"response": 2.5, "prompt": null}']
    df = spark.createDataFrame([(x,) for x in (*same_, '{"prompt": "a", "answer": 1}')], "r string")
    a, b, c = (r[0] for r in df.select(C.fingerprint_json(F.col("r"))).collect())
    assert a == b != c
    typed = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    assert [tuple(x) for x in typed.select(C.turns_of_columns(typed, ["prompt", "completion"])).first()[0]] == [("user", "p"), ("assistant", "c")]
    with pytest.raises(ValueError):
        C.turns_of_columns(typed, ["prompt"])


def test_round_trip_of_hard_texts_and_loss(spark):
    turns = [("assistant" if i % 2 else HARD[-2], t) for i, t in enumerate(HARD)]
    df = spark.createDataFrame([("c", turns), ("empty", [])], "conv_id string, turns array<struct<role: string, text: string>>")
    out = C.formatted(df)
    back = out.select("conv_id", C.read_turns(F.col("formatted")).alias("t"), C.read_loss(F.col("formatted"), F.col("loss")).alias("l"), "formatted", "loss").collect()
    assert [tuple(x) for x in back[0].t] == turns and back[1].t == []
    assert back[0].l == "".join(t for r, t in turns if r == "assistant") and back[1].l == ""
    assert [back[0].formatted[s.start : s.start + s.length] for s in back[0].loss] == [t.replace("&", "&amp;").replace("<", "&lt;") for r, t in turns if r == "assistant"]


def test_edges(spark):
    rows = spark.createDataFrame([(None, 1, None, None), (1, 2, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "z"), (1, 1, "assistant", "z")], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in C.digests(C.formatted(C.conversations_from_rows(rows.withColumn("turns", F.lit(1))))).collect()}
    assert found[1].n_turns == 4 and found[1].loss_chars == 2 and found[None].n_turns == 1
    assert C.digests(C.formatted(C.conversations_from_rows(rows.limit(0)))).collect() == []


def test_very_long_texts_and_clashing_columns(spark):
    text = "a <b> & c " * 100_000
    rows = spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", text)], "conv_id long, turn long, role string, text string")
    for name in ("turns", "formatted", "loss", "row", "ROW_", "learnt"):
        rows = rows.withColumn(name, F.lit("mine"))
    (r,) = C.digests(C.formatted(C.conversations_from_rows(rows))).collect()
    assert (r.n_turns, r.loss_chars) == (2, len(text))
