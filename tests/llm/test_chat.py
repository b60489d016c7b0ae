"""Formatting, its reverse, and prefix-target examples."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from curatrix.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment string, start long"


def rows():
    rng = random.Random(3)
    pieces = [*chat.CONTROLS, "\\", "<", "s>", "/", "[INST", "]", " ", "\n", "é", "a", "\\\\<s>"]
    say = lambda: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
    out = [(c, t, rng.choice(["user", "assistant", "system", "</s>", ""]), say()) for c in range(30) for t in range(rng.randint(1, 7))]
    out += [(50, 0, None, None), (50, 1, "assistant", None), (51, None, "assistant", "late"), (51, 0, "user", "x"), (52, 1, "user", "tie"),
            (52, 1, "assistant", "tie"), (52, 1, "assistant", "tie"), (None, 0, "user", "null id"), (None, 1, "assistant", "reply"),
            (53, 0, "user", "w " * 200_000), (53, 1, "assistant", "<s>" * 50_000)]
    return out + [(54, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(400)]


def conversations(data):
    out = {}
    for conv, turn, role, text in data:
        out.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in out.items()}


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)


def test_read_back(spark):
    data = rows()
    got = {r["conv_id"]: r for r in chat.read_back(chat.expand(chat.format_turns(frame(spark, data).repartition(5)), 1000)).collect()}
    want = conversations(data)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == set(want)
    for conv, turns in want.items():
        reply = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(reply), sha(reply))
        assert got[conv]["n_examples"] == sum(r == "assistant" for r, _ in turns)


def test_examples_are_prefixes_with_one_trainable_reply(spark):
    data = [r for r in rows() if r[0] != 53]
    formatted = chat.format_turns(frame(spark, data))
    expanded = chat.expand(formatted, 200)
    parts = expanded.where("kind = 'context'").collect()
    assert max(len(r["text"]) for r in parts) < 200 + formatted.selectExpr("max(length(segment)) AS m").first()["m"]
    assert all(chat.SEGMENT.match(r["text"]) and r["text"].endswith(chat.CLOSE) for r in parts)
    got = chat.examples(expanded).collect()
    want = conversations(data)
    assert len(got) == sum(r == "assistant" for turns in want.values() for r, _ in turns)
    for r in got:
        turns = want[r["conv_id"]][: r["place"] + 1]
        segments = chat.SEGMENT.findall(r["text"])
        assert [(chat.unescape(a), chat.unescape(b)) for a, b in segments] == turns
        assert chat.unescape(r["text"][r["loss_start"]:r["loss_end"]]) == turns[-1][1]
        assert r["text"][r["loss_end"]:] == chat.CLOSE
    rest = expanded.where("kind = 'rest'").count()
    assert rest == sum(len(t) - 1 - max([i for i, (r, _) in enumerate(t) if r == "assistant"], default=-1) for t in want.values())


def test_an_example_that_is_no_prefix_is_an_error(spark):
    data = [(1, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(6)]
    expanded = chat.expand(chat.format_turns(frame(spark, data)))
    for turn in (1, 3):  # a context of an earlier target, and an earlier reply
        text = F.when((F.col("place") == turn + 2) & (F.col("kind") == "context"), F.replace("text", F.lit("turn 0"), F.lit("turn 9")))
        with pytest.raises(Exception, match="prefix"):
            chat.read_back(expanded.withColumn("text", F.coalesce(text, "text"))).collect() if turn == 1 else \
                chat.read_back(expanded.where("place <> 3")).collect()


def test_empty_table(spark):
    expanded = chat.expand(chat.format_turns(frame(spark, [])))
    assert expanded.count() == 0 and chat.read_back(expanded).count() == 0 and chat.examples(expanded).count() == 0
