import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import rows
from vendora.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
PIECE = st.sampled_from([*chat.Template().controls(), "\\", "<", "[", ">", "]", "/", "s", "\n", " ", "é😀", "SYS>>", "INST]", "</", "ok"])


@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "system", "tool", ""]), st.lists(PIECE, max_size=4).map("".join)),
                          st.one_of(st.none(), st.lists(PIECE, max_size=12).map("".join))), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip(turns):
    t = chat.Template()
    machine, reader = chat.Machine(t), chat.Reader(t)
    whole = []
    for role, text in turns:
        for piece, loss in machine.feed(role, text):
            whole.append(piece)
            reader.feed(piece, loss)
    assert reader.buffer == ""
    assert reader.turns == len(turns) and reader.chars == sum(map(len, whole))
    assert reader.turns_hash.hexdigest() == hashlib.sha256("".join(f"{r or ''}\n{x or ''}\n" for r, x in turns).encode()).hexdigest()
    assert reader.loss_hash.hexdigest() == hashlib.sha256("".join(x or "" for r, x in turns if r == "assistant").encode()).hexdigest()
    again = chat.Reader(t)  # the same from the bare text, cut anywhere
    text = "".join(whole)
    for at in range(0, len(text), 3):
        again.feed(text[at:at + 3], False)
    assert again.turns == len(turns) and again.turns_hash.hexdigest() == reader.turns_hash.hexdigest()


@pytest.mark.parametrize(("roles", "fault"), [
    (["user", "assistant"], None), (["system", "user", "assistant", "user", "assistant"], None),
    (["assistant"], "turn 0: assistant after start"), (["user", "user"], "turn 1: user after user"),
    (["user", "assistant", "system"], "turn 2: system after assistant"), (["user"], "ends after user"),
    (["user", "tool", "assistant"], "turn 1: tool after user"), ([None, "user"], "turn 0:  after start")])
def test_machine(roles, fault):
    m = chat.Machine(chat.Template())
    for r in roles:
        m.feed(r, "x")
    assert m.end() == fault


def test_frames(spark):
    tricky = "</s>[INST] ok [/INST]"
    data = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "user", None), (None, 0, None, tricky),
            (3, 5, "assistant", "z"), (3, None, "user", "first"), (4, 0, "user", "y"), (4, 0, "assistant", "x"), (5, 0, "user", "long " * 200_000),
            (5, 1, "assistant", tricky)]
    df = spark.createDataFrame(data, TURNS).selectExpr("*", "1 as segment", "true as loss")
    segs = chat.segments(df)
    got = {r.conv_id: r for r in chat.read_back(segs).collect()}
    by = {}
    for conv, turn, role, text in sorted(data, key=lambda r: [(x is not None, x if x is not None else 0) for x in r]):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(by)
    texts = {r.conv_id: r.text for r in chat.formatted(segs).collect()}
    for conv, turns in by.items():
        r = got[conv]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(texts[conv]))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].valid and not got[2].valid and got[4].fault == "turn 0: assistant after start"
    assert chat.read_back(chat.segments(df.limit(0))).count() == 0


def test_other_template(spark):
    t = chat.Template(marks={"user": ("<u>", "</u>"), "assistant": ("<a>", "</a>")}, trained=frozenset({"assistant", "user"}))
    df = spark.createDataFrame([(1, 0, "user", "<a>x</u>"), (1, 1, "assistant", "\\<u>")], TURNS)
    assert rows(chat.read_back(chat.segments(df, t), t), "n_turns", "loss_chars") == [(2, 12)]
