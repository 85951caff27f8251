from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from citegrid.llm import chat_format

SCHEMA = "conv bigint, turn bigint, role string, text string, pos string, window string, n string, tokens string"


def talk(seed: int = 5):
    luck = random.Random(seed)
    words = ["<|im_end|>", "<|im_start|>", "<\\|im_end|>", "<\\\\|", "<", "|", "\\", "\n", "assistant", "é", "中文", "😀", "<|im_end|>\n"]
    say = lambda n: "".join(luck.choice(words) + luck.choice(["", " "]) for _ in range(n))
    rows = []
    for c in range(30):
        if c % 3 == 0:
            rows.append((c, 0, "system", say(luck.choice([0, 5, 900 if c % 9 == 0 else 20]))))
        rows += [(c, 1 + k, luck.choice(["user", "assistant", "tool\nx\\n\\", None]), say(luck.choice([0, 1, 30, 200, 3000 if c == 4 else 90]))) for k in range(luck.choice([0, 1, 2, 9, 40]))]
    rows += [(50, k, "user" if k % 2 else "assistant", None) for k in range(700)]  # one hot conversation of empty turns
    rows += [(51, 3, "assistant", "twice"), (51, 3, "assistant", "twice"), (52, None, "assistant", "no turn"), (52, 1, "user", "a"), (None, 1, "assistant", "no conversation")]
    return rows


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@pytest.fixture(scope="module")
def rows():
    return talk()


@pytest.fixture(scope="module")
def windows(spark, rows):
    df = spark.createDataFrame([(*r, "p", "w", "n", "t") for r in rows], SCHEMA).repartition(5)
    found = chat_format.formatted(df, "conv", "turn", "role", "text", budget=64, history=16).cache()
    return found


def by_conversation(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        found[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:3])] for c, v in found.items()}


def test_digests_are_the_conversations(windows, rows):
    want = {}
    for c, turns in by_conversation(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        want[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(windows, "conv").collect()}
    assert got == want


def test_windows_keep_to_the_budget_and_repeat_what_went_before(windows, rows):
    turns = by_conversation(rows)
    found = defaultdict(list)
    for w in windows.orderBy("conv", "window").collect():
        found[w["conv"]].append(w)
    for c, ws in found.items():
        all_, at = turns[c], 0
        system = all_[0][0] == "system"
        for w in ws:
            pieces = w["text"].split("<|im_end|>\n")
            assert pieces.pop() == "" and all(p.startswith("<|im_start|>") for p in pieces)
            texts = [unescape(p.split("\n", 1)[1]) for p in pieces]
            new = texts[w["n_repeated"] :]
            assert new == [t for _, t in all_[at : at + len(new)]]
            assert not system or texts[0] == all_[0][1]
            past = w["n_repeated"] - (system and at > 0)
            assert texts[system and at > 0 : w["n_repeated"]] == [t for _, t in all_[at - past : at]]
            head = len(all_[0][1].split()) + 4 if system else 0
            body = len(new) - (system and at == 0)
            assert body == 1 or w["n_tokens"] <= 64 or head > 32
            spans = [unescape(w["text"][s["begin"] : s["begin"] + s["n"]]) for s in w["loss"]]
            assert spans == [t for r, t in all_[at : at + len(new)] if r == "assistant"]
            at += len(new)
        assert at == len(all_)


def test_no_python_and_empty_tables(spark, windows):
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    empty = spark.createDataFrame([], SCHEMA)
    assert chat_format.report(empty, "conv", "turn", "role", "text").count() == 0


def test_one_conversation_over_all_partitions(spark):
    df = spark.range(5000).select(F.lit(1).cast("long").alias("conv"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("x "), F.col("id")).alias("text"))
    placed = chat_format.placed(df, "conv", "turn", "role", "text", 64, 16).orderBy("pos").collect()
    assert [r["pos"] for r in placed] == list(range(1, 5001)) and all(r["sys"] == 6 for r in placed)
    assert [r["start"] for r in placed[1:]] == list(range(0, 6 * 4999, 6))
