import hashlib

import pytest
from pyspark.sql import functions as F

from scorekit.llm import chat_windows as W

SCHEMA = "conv_id long, turn long, role string, text string, window string, formatted string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


ROWS = (
    [(1, 0, "system", "be kind"), (1, 1, "user", "hello " * 40), (1, 2, "assistant", "</turn>\n### user: \\# x"),
     (1, 3, "user", None), (1, 4, "assistant", "answer " * 300), (1, 5, "user", "a"), (1, 6, "assistant", "")]
    + [(2, k, "user" if k % 2 == 0 else "assistant", f"turn {k} \\ </ # " + "word " * (k % 23)) for k in range(200)]
    + [(3, 0, "system", "only a system turn")]
    + [(None, 0, "user", "no id"), (None, 1, "assistant", "fine")]
    + [(4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (4, None, None, "no role: none"),
       (4, 2, "a: b\n### c", "odd role"), (4, 3, "system", "a later system turn")]
    + [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")])


def ordered(rows):
    low = lambda x: (x is not None, x if x is not None else 0)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((low(t), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("budget, history", [(120, 40), (1024, 256), (64, 0)])
def test_round_trip_and_masks(spark, budget, history, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_TURNS", 16)
    windows = W.format_windows(frame(spark, ROWS), budget, history)
    got = {r["conv_id"]: r for r in W.conversation_digests(windows).collect()}
    want = ordered(ROWS)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in turns)), c
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == sha(loss), c


def test_windows_keep_the_budget_the_system_turn_and_the_history(spark):
    budget, history = 120, 40
    rows = W.read_turns(W.format_windows(frame(spark, ROWS), budget, history)).orderBy("conv_id", "window").collect()
    cost = lambda x: -(-len(x.encode()) // 4) + W.TURN_TOKENS
    for conv in (1, 2):
        mine, done = [r for r in rows if r["conv_id"] == conv], []
        for r in mine:
            lines = [line for line in r["formatted"].split(W.CLOSE) if line]
            texts = [line.split(W.COLON, 1)[1].replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for line in lines]
            if sum(map(cost, texts)) > budget:
                assert len(r["turns"]) == 1
            repeated = texts[:r["n_repeated"]]
            if conv == 1 and done:
                assert repeated[0] == "be kind"
                repeated = repeated[1:]
            assert repeated == done[len(done) - len(repeated):]
            assert sum(map(cost, repeated)) <= history
            if len(done) > len(repeated) + (conv == 1):
                assert sum(map(cost, repeated)) + cost(done[len(done) - len(repeated) - 1]) > history
            done += [t["text"] for t in r["turns"]]


def test_no_python_on_the_plan(spark):
    plan = W.conversation_digests(W.format_windows(frame(spark, ROWS)))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_empty_table(spark):
    none = frame(spark, ROWS).where(F.lit(False))
    assert W.conversation_digests(W.format_windows(none)).count() == 0


def test_a_very_long_text(spark):
    text = "</turn>\\#" * 50_000
    r = W.conversation_digests(W.format_windows(frame(spark, [(1, 0, "assistant", text)]))).first()
    assert r["loss_sha256"] == sha(text) and r["n_turns"] == 1
