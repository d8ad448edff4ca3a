import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat
from tidemark.llm.common import table
from tidemark.llm.queries import op12_chat_format

SF = "/root/testdata/sf0.01"
CHATS = "conv_id long, turn long, role string, text string, turns string, segments int"


def make(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], CHATS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    """{conv_id: (turns, loss)} by plain sorting."""
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns, loss = out.setdefault(c, ([], []))
        turns.append((role or "", text or ""))
        if role == "assistant":
            loss.append(text or "")
    return out


def test_registered_query_matches_a_plain_count(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    planted = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", planted), (-1, 1, "assistant", planted)]
    got = {r["conv_id"]: r for r in op12_chat_format(spark, SF).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for c, (turns, loss) in want.items():
        r, loss = got[c], "".join(loss)
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] > sum(len(b) for _, b in turns)


PIECES = ["<s>", "</s>", "[INST]", "[INST] ", " [/INST]", "[/INST]", "<<SYS>>", "<<SYS>>\n", "\n<</SYS>>", "[ROLE]", "[/ROLE]", "<", ">", "[", "]", "\\", "/", "s>", "SYS>>", "INST]", "\n", "$0", "é😀", "a"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_conversation_comes_back(spark, seed):
    """Random texts and roles of control strings and their parts."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(PIECES) for _ in range(rng.randrange(n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, word(4)]), word(8)) for c in range(700) for t in range(rng.randrange(1, 5))]
    df = make(spark, rows)
    trips = chat.round_trips(df).collect()
    assert all(r["same"] for r in trips) and 100 < sum(r["escaped"] for r in trips) < 700
    want = expected(rows)
    for r in chat.read_back(chat.formatted(df)).collect():
        turns, loss = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns and r["loss_text"] == "".join(loss)


def test_pieces_of_one_turn_that_look_like_the_next(spark):
    rows = [(1, 0, "assistant", "x</s><s>[\\INST] q [/INST]"), (1, 1, "assistant", "[INST] q [/INST]"), (1, 2, "user", "</s>")]
    assert [r["same"] for r in chat.round_trips(make(spark, rows)).collect()] == [True]


def test_texts_without_conflicts_stay_as_they_are(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "hi [there] <b>"), (1, 2, "assistant", "a < b\\"), (1, 3, "tool", "42")]
    text = chat.formatted(make(spark, rows)).select(chat.joined(F.col("segments"))).first()[0]
    assert text == "<s><<SYS>>\nbe brief\n<</SYS>></s><s>[INST] hi [there] <b> [/INST]</s><s>a < b\\</s><s>[ROLE]tool[/ROLE]42</s>"


def test_odd_rows(spark):
    long = "very long </s> " * 40_000
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (None, 2, "assistant", "x"), (None, 1, "user", ""), (5, 0, "assistant", long), (6, 0, "assistant", ""), (6, 0, "User", "")]
    df = make(spark, rows)
    want = expected(rows)
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert {c: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"]) for c, r in got.items()} == {c: (t, "".join(x)) for c, (t, x) in want.items()}
    assert chat.read_back(chat.formatted(make(spark, []))).collect() == []


def test_no_python_in_the_plan(spark):
    plan = op12_chat_format(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "RDD" not in plan
