"""Windows against the rule in plain Python, and exact reading back."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shardloom.llm import chat
from shardloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def escape(x):
    return x.replace("\\", "\\b").replace("<", "\\l")


def plain(turns, budget, history, most):
    """[(formatted, loss)] of one conversation; turns: (role, text) in order."""
    tokens = [len(t.encode().split()) + chat.MARKS for _, t in turns]
    led = bool(turns) and turns[0][0] == "system"
    room = max(1, budget - history - (tokens[0] if led else 0))
    start, at = [], 0
    for k, n in enumerate(tokens):
        start.append(0 if led and k == 0 else at)
        at += 0 if led and k == 0 else n
    groups, last = [], None
    for k in range(len(turns)):
        if led and k == 0:
            place = 0
        else:
            b = start[k] // room
            place = 2 * b + (start[k] > b * room and start[k] + tokens[k] > (b + 1) * room)
        if last is None or place > last:
            groups.append([])
        groups[-1].append(k)
        last = place
    out = []
    for w, own in enumerate(groups):
        begin = own[0]
        spare = min(history, max(0, budget - (tokens[0] if led else 0) - tokens[begin]))
        old = [k for k in range(max(0, begin - most), begin) if not (led and k == 0) and start[begin] - start[k] <= spare]
        text, loss = "", []
        for k, again in [*([(0, True)] if led and w else []), *((k, True) for k in old), *((k, False) for k in own)]:
            role, body = turns[k]
            text += f"<{'again' if again else 'turn'}:{escape(role).replace('>', chr(92) + 'g')}>"
            if role == "assistant" and not again:
                loss.append((len(text), len(text) + len(escape(body))))
            text += escape(body) + "</turn>\n"
        out.append((text, loss))
    return out


def grouped(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in by.items()}


@pytest.mark.parametrize(("budget", "history", "most"), [(512, 128, 4), (40, 15, 3), (5, 0, 2), (1, 1, 1)])
def test_windows(spark, budget, history, most):
    rng = random.Random(budget)
    words = ["a", "bb", "</turn>", "<turn:user>", "\\", "\\l", "\\b", "<again:x>", "é😀", "\n"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 12)):
            role = "system" if turn == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "tool>\\<"])
            rows.append((conv, turn, role, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40)))))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    done = chat.windows(frame, budget, history, most)
    got = defaultdict(list)
    for r in sorted(done.collect(), key=lambda r: (r.conv_id, r.window)):
        got[r.conv_id].append((r.formatted, [tuple(x) for x in r.loss]))
    assert got == {c: plain(t, budget, history, most) for c, t in grouped(rows).items()}
    for r in done.select("n_tokens", "excess", F.size(F.filter(chat.read_turns(F.col("formatted")), lambda t: t["again"] & (t["role"] != "system"))).alias("old"), F.size(F.filter(chat.read_turns(F.col("formatted")), lambda t: ~t["again"] & (t["role"] != "system"))).alias("new")).collect():
        assert r.excess == max(0, r.n_tokens - budget)
        assert not r.excess or (r.new <= 1 and not r.old)
    back = defaultdict(list)
    for r in done.select("conv_id", "window", chat.read_turns(F.col("formatted")).alias("t")).orderBy("conv_id", "window").collect():
        back[r.conv_id] += [(x.role, x.text) for x in r.t if not x.again]
    assert back == grouped(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    want = {}
    for conv, turns in grouped(rows).items():
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = sum(len(f) for f, _ in plain(turns, chat.BUDGET, chat.HISTORY, chat.HISTORY_TURNS))
        want[conv] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op9_chat"](spark, SF).collect()}
    assert got == want


def test_long_turns_and_texts(spark):
    rows = [(1, 0, "system", "s " * 600), (1, 1, "user", "u " * 300), (1, 2, "assistant", "a " * 10), (2, 0, "user", "q " * 450), (2, 1, "assistant", "r " * 40), (2, 2, "user", "t " * 480), (3, 0, "user", "x <" * 400_000), (3, 1, "assistant", "\\" * 300_000)]
    rows += [(4, k, "user", "") for k in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id, r.window, r.n_tokens, r.excess) for r in chat.windows(frame).collect())
    assert [x for x in got if x[0] < 3] == [(1, 0, 904, 392), (1, 1, 614, 102), (2, 0, 452, 0), (2, 1, 42, 0), (2, 2, 482, 0)]
    assert [x[2:] for x in got if x[0] == 3] == [(400_003, 399_491), (3, 0)]
    assert all(x[2] <= 512 and x[3] == 0 for x in got if x[0] == 4)


def test_odd_rows(spark):
    rows = [(None, 1, None, None, 1), (None, None, "user", "x", 2), (1, 1, "assistant", "y", 3), (1, 1, "assistant", "y", 3)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    got = sorted((r.conv_id or -1, r.formatted) for r in chat.windows(frame).collect())
    assert got == [(-1, "<turn:user>x</turn>\n<turn:></turn>\n"), (1, "<turn:assistant>y</turn>\n" * 2)]
    assert chat.windows(frame.limit(0)).count() == 0
