"""Chat windows, read back and checked by plain code."""

import hashlib
import random

from spanloom.llm import chat


def talks():
    rng = random.Random(5)
    rows = []
    for c in range(25):
        for t in range(rng.choice([1, 2, 7, 60])):
            role = "system" if t == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant"])
            text = " ".join(rng.choice(["word", "&amp;", "<|im_end|>", "&lt;|", "a\nb", "é😀", "<|"]) for _ in range(rng.choice([0, 3, 40, 700])))
            rows.append((c, t, role, text, "x"))
    rows += [(50, 0, None, None, "x"), (51, None, "assistant", "no turn", "x"), (52, 3, "user", "tie", "x"), (52, 3, "assistant", "tie", "x"), (52, 3, "assistant", "tie", "x")]
    rows += [(53, 0, "role\n<|im_end|>", "odd role", "x"), (None, 0, "assistant", "null id", "x")]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(talks() if rows is None else rows, "conv_id long, turn long, role string, text string, window string")


def ordered(rows):
    out = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def test_digests_come_back_from_the_windows(spark):
    got = {r.conv_id: r for r in chat.digest(chat.windows(frame(spark))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    truth = ordered(talks())
    assert got.keys() == truth.keys()
    for c, turns in truth.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_windows_keep_their_budgets(spark):
    tokens = lambda text: len(text.split()) + chat.MARK_TOKENS
    truth = ordered(talks())
    several = 0
    for r in chat.windows(frame(spark), budget=200, history=60).collect():
        turns = truth[r.conv_id]
        first = r.window - 1
        own = turns[first : first + r.n_own]
        assert len(own) == 1 or sum(tokens(t) for _, t in own) <= 200
        history = 0
        while first - history > 0 and sum(tokens(t) for _, t in turns[first - history - 1 : first]) <= 60:
            history += 1
        system = next((i for i, (role, _) in enumerate(turns) if role == "system"), None)
        extra = system is not None and system < first - history
        assert r.n_repeated == history + extra
        marks = r.formatted.count(chat.START)
        assert marks == r.formatted.count(chat.END) == r.n_own + r.n_repeated
        several += r.window > 1
        lead = ([turns[system]] if extra else []) + turns[first - history : first]
        write = lambda x: f"{chat.START}{esc(x[0]).replace(chr(10), '&#10;')}\n{esc(x[1])}{chat.END}\n"
        esc = lambda s: s.replace("&", "&amp;").replace("<|", "&lt;|")
        assert r.formatted == "".join(map(write, lead + own))
        assert "".join(r.formatted[s.start : s.start + s.size] for s in r.loss_spans) == "".join(esc(t) for role, t in own if role == "assistant")
    assert several > 20


def test_empty_and_native(spark):
    out = chat.digest(chat.windows(frame(spark, talks()[:1]).where("false")))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
