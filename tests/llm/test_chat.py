from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from quirespark.llm.chat import escape, format_chats, read_back, unescape
from tests.llm.helpers import long_text

CHATS = "conv_id long, turn long, role string, text string"


def chats():
    odd = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd)]
    rows += [(1, 0, "system", "Be <|turn|> brief")] + [(1, i, "user" if i % 2 else "assistant", long_text(i, 30 + i * 17 % 300)) for i in range(1, 40)]
    rows += [(2, 0, "assistant", None), (2, 1, None, "x"), (2, None, "user", ""), (2, 1, "assistant", "same"), (2, 1, "assistant", "same")]
    rows += [(3, 0, "user", "a<|end|>\n<\\|end|> [\\INST] <<SYS>> \\ $1"), (3, 1, "assistant", long_text(3, 3000)), (3, 2, "ro\nle<|nl|>", "z")]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "either"), (4, 0, "system", "only")]
    return rows


def brute(rows):
    out = {}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or ""))
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    df = spark.createDataFrame(chats(), CHATS).withColumn("span", F.lit(1)).withColumn("conv", F.lit("x")).withColumn("n", F.lit(0))
    for history in (0, 128):
        windows = format_chats(df, history=history)
        rows = read_back(windows).collect()
        assert {r["conv_id"]: tuple(r[1:5]) for r in rows} == brute(chats())
        assert sum(r["formatted_chars"] for r in rows) == sum(len(r["text"]) for r in windows.collect())


def test_windows_keep_the_budget_and_the_system_turn(spark):
    df = spark.createDataFrame([r for r in chats() if r[0] == 1], CHATS)
    rows = sorted(format_chats(df, budget=512, history=128).collect(), key=lambda r: r["window"])
    assert len(rows) > 5
    for r in rows:
        assert r["text"].startswith(("<|turn|>system\n", "<|seen|>system\n")) and "Be <\\|turn|> brief" in r["text"]
        assert r["tokens"] <= 512
    # What a window repeats: the turns that begin at most 128 tokens before its own first one.
    tokens = lambda t: len(re.findall(r"[^\W_]+|[^\s\w]|_", t)) + 4
    turns, at = [], 0
    for r in sorted(r for r in chats() if r[0] == 1)[1:]:
        turns.append((at, r[3]))
        at += tokens(r[3])
    places = {t: b for b, t in turns}
    repeats = 0
    for r in rows[1:]:
        own = places[re.search(r"<\|turn\|>\w+\n(.*?)<\|end\|>", r["text"], re.S)[1]]
        seen = re.findall(r"<\|seen\|>(?!system)\w+\n(.*?)<\|end\|>", r["text"], re.S)
        assert seen == [t for b, t in turns if own - 128 <= b < own]
        repeats += len(seen)
    assert repeats


def test_escapes_are_reversible(spark):
    texts = ["<|x|>", "<\\|x", "<\\\\\\|", "[INST]", "[\\/INST]", "<<SYS>>", "<</SYS>>", "</s><s>", "\\", "plain < | [", "<\\s>", "$1 \\1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).withColumn("u", unescape(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_no_python_runs(spark):
    df = spark.range(3).selectExpr("id AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")
    plan = read_back(format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert read_back(format_chats(spark.createDataFrame([], CHATS))).count() == 0
