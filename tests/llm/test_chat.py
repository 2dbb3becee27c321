import hashlib
import random

import pytest

from lodestone.llm import chat


def test_escape_round_trip():
    rng = random.Random(0)
    parts = [*chat.CONTROLS, "\\", "<", "|", "[", "end", "\n", "é", "/"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(8)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROLS)
        assert chat.parse(chat.template([("us%er\n", t)])) == ("us%er\n", t)


def test_spans_and_history():
    turns = [("user", "b a"), ("assistant", "a b"), ("user", ""), ("assistant", "<s>")]
    text, ends, spans, at = chat.render_all(chat.template, turns)
    assert text == chat.template(turns) and at == [] and ends[-1] == len(text)
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]
    opened = lambda ts: "BOS" + "".join(f"[{r}]{t}" for r, t in ts)
    text, ends, spans, _ = chat.render_all(opened, turns)
    assert [text[a:b] for a, b in spans] == [t for _, t in turns] and text == opened(turns)
    last_only = lambda ts: "".join(f"{r}:{t if i == len(ts) - 1 or r == 'user' else '-'};" for i, (r, t) in enumerate(ts))
    text, ends, spans, at = chat.render_all(last_only, turns)
    assert text == last_only(turns) and at[0] == 2 and ends == []
    assert text[spans[0][0] : spans[0][1]] == "b a" and spans[1] is None


def test_long_conversations_stream(monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 500)
    turns = [(("user", "assistant")[i % 2], f"text {i} " * (i % 4)) for i in range(700)]
    b = chat.Blocks(1, chat.template, "assistant", False)
    rows = [r for t in turns for r in b.add(*t)] + b.close()
    assert "".join(r["text"] for r in rows) == chat.template(turns)
    assert len(b.stream.turns) <= chat.PREFIX + 1 and [r["block"] for r in rows] == list(range(len(rows)))
    assert [chat.unescape(r["text"][s["start"] : s["end"]]) for r in rows for s in r["loss"]] == [t for r, t in turns if r == "assistant"]
    far = lambda ts: chat.template(ts) if len(ts) < 100 else "x" + chat.template(ts)
    assert "".join(chat.render_all(far, turns[:120])[0]) == far(turns[:120])


def test_operator(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(30), None, -5]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "sys\ntem", None]), rng.choice(["", None, "</s>[INST] ok", "é😀", "\\<|end|>\n"])))
    rows += [(40, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)] + [(1, 3, "user", "tie"), (1, 3, "user", "tie"), (2, None, "user", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, block string").repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert got.keys() == by.keys()
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        want = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.template([(r, x) for _, r, x in ts])))
        assert tuple(got[c])[1:] == want
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.parse("nothing")
