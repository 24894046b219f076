"""Chat formatting: exact round trips, layouts by fingerprint, odd inputs."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from folioscore.llm import chat

NASTY = [
    "", "plain", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\", "\\\\<|", "<\\|turn|>", "a\nb\r\n\tc",
    "[[INST]]", "<s></s><s>", "<<SYS>>x<</SYS>>", 'quote " and \u2028 ü 😀', "$1 \\1 $0", "x" * 5000, "<|" * 50,
]


def formatted(spark, records):
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "id long, record string, layout string")
    done = chat.format_turns(chat.canonical_turns(df, "record"))
    return done.select(
        "id", "layout", "turns", "segments", "formatted",
        chat.read_turns(F.col("formatted")).alias("read"), chat.loss_text(F.col("segments")).alias("loss"),
    ).orderBy("id").collect()


def pairs(turns):
    return [(t["role"], t["text"]) for t in turns]


def test_round_trip(spark):
    convs = [[(role, t) for role in ("system", "user", "assistant", "<|text|>", "")] for t in NASTY]
    convs.append([("assistant", a) for a in NASTY])
    rows = formatted(spark, [json.dumps({"messages": [{"role": r, "content": t} for r, t in c]}) for c in convs])
    for r, conv in zip(rows, convs):
        assert pairs(r["read"]) == conv
        assert r["loss"] == "".join(t for role, t in conv if role == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        inside = [s["text"] for i, s in enumerate(r["segments"]) if i % 3 == 1]
        assert not any(re.search(r"<\||</?s>|</?SYS>|\[/?INST\]", t) for t in inside)
        assert r["formatted"].count("<|turn|>") == len(conv)


def test_layouts(spark):
    qa = [("user", "q"), ("assistant", "a")]
    cases = [
        ({"messages": [{"content": "q", "role": "user"}, {"role": "assistant", "content": "a"}]}, "messages", qa),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "from_value", qa),
        ({"response": "a", "prompt": "q"}, "prompt_response", qa),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", qa),
        ({"instruction": "q", "output": "a"}, "instruction", qa),
        ({"instruction": "q", "input": "", "output": "a"}, "instruction_input", qa),
        ({"instruction": "q", "input": "i", "output": "a"}, "instruction_input", [qa[0], ("user", "i"), qa[1]]),
        ({"system": "s", "prompt": "q", "response": "a"}, "system_prompt_response", [("system", "s"), *qa]),
        ({"prompt": None, "response": ""}, "prompt_response", [("user", ""), ("assistant", "")]),
        ({"messages": [{"role": None, "content": None}]}, "messages", [("", "")]),
        # fields that no layout knows change nothing, two layouts at once are none
        ({"prompt": "q", "response": "a", "score": 1, "meta": {"prompt": 2}}, "prompt_response", qa),
        ({"messages": [{"role": "user", "content": "q", "id": 7}, {"role": "assistant", "content": "a"}], "source": "x"}, "messages", qa),
        ({"prompt": "q", "response": "a", "output": "b"}, "unknown", []),
        ({"prompt": "q"}, "unknown", []),
        ({"messages": []}, "unknown", []),
    ]
    rows = formatted(spark, [json.dumps(c[0]) for c in cases])
    for r, (_, layout, turns) in zip(rows, cases):
        assert (r["layout"], pairs(r["turns"])) == (layout, turns)


def test_broken_records(spark):
    rows = formatted(spark, [None, "", "{", "[]", "3"])
    assert {(r["layout"], r["formatted"]) for r in rows} == {("unknown", "")}
    assert formatted(spark, []) == []


def test_very_long_texts_keep_their_digests(spark):
    """A turn above the JSON reader's limit, and a record that only its length keeps from being read."""
    times = chat.JSON_STRING // 5 + 1
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "</s>x")], "conv_id long, turn long, role string, text string")
    long = rows.withColumn("text", F.when(F.col("turn") == 1, F.repeat("text", times)).otherwise(F.col("text")))
    done = chat.format_turns(chat.canonical_turns(chat.records_of(long), "record")).select("layout", "turns", "segments")
    loss = done.select("layout", F.size("turns"), F.sha2(chat.loss_text(F.col("segments")), 256)).first()
    assert tuple(loss) == ("prompt_response", 2, hashlib.sha256(b"</s>x" * times).hexdigest())
    records = long.where("turn = 1").select(F.to_json(F.struct(F.col("text").alias("prompt"), "role")).alias("record"))
    with pytest.raises(Exception, match="too long for the JSON reader"):
        chat.canonical_turns(records, "record").select(F.size("turns")).collect()


def test_given_columns_of_helper_names(spark):
    df = spark.createDataFrame([(1, '{"prompt":"q","response":"a"}', 5, 6)], "id int, record string, _record int, _print int")
    r = chat.canonical_turns(df, "record").first()
    assert (r["_record"], r["_print"], r["layout"]) == (5, 6, "prompt_response")


def test_records_of_rows(spark):
    rows = [
        (1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, "system", "s"), (2, 1, "user", "u"),
        (2, 2, "assistant", "a"), (3, None, None, "x"), (3, 0, "user", "b"), (3, 0, "user", "a"),
        (3, 0, "user", "a"), (None, 0, "user", "n"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, record int")
    got = {
        r["conv_id"]: (r["layout"], pairs(r["turns"]))
        for r in chat.canonical_turns(chat.records_of(df), "record").collect()
    }
    assert got == {
        1: ("prompt_response", [("user", "hi"), ("assistant", "")]),
        2: ("system_prompt_response", [("system", "s"), ("user", "u"), ("assistant", "a")]),
        3: ("messages", [("", "x"), ("user", "a"), ("user", "a"), ("user", "b")]),
        None: ("messages", [("user", "n")]),
    }
