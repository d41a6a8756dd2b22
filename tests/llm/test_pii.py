import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from tests.llm.helpers import DOCS, docs
from vendora.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def card(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_seeds_are_the_typed_patterns():
    rng = random.Random(2)
    pieces = ["a", "B9", "@", ".", "..", "-", "_", "%", "+", "+1", " ", "(", ")", "256", "25.4.0.1", "1.2.3.4.5", "007.1.1.1", "\n", "é",
              "x.y@z.com", "@@", "a@b", "a@b.c_d@e.f", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (555) 010-9999", "+", "1  2", "99999999"]
    for _ in range(6000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.seeds(text) == base(text), text


def test_long_texts_take_linear_time():
    for piece in ("a", "1", "1.", "a@", "+1 ", "1 ", "(1) ", "[at]", "a.b@", "1:", "+1" + " " * 50, "a [at] b [dot] "):
        text = piece * (300_000 // len(piece))
        start = time.time()
        known = pii.seeds(text)
        pii.candidates(text, known)
        assert time.time() - start < 8, piece


def corpus(rng):
    """Phones with and without their plus after known words, and decoys."""
    texts = []
    for i in range(8):
        texts.append(f"Please ring me on +49 30 55501{i:03d} tomorrow")
        texts.append(f"Order total {5550000 + i} units; part 77{i}-000-{i}111 shipped")
        texts.append(f"mail sent by user{i}@mail.example.com today")
        texts.append(f"charged to card {card(rng)} thanks")
        texts.append(f"login from host 10.0.{i}.7 ok")
    texts += ["Please ring me on (030) 5550-777 tomorrow", "do ring me on 555-01-99-55!", "mail sent by bob [at] example [dot] org today",
              "mail sent by root@localhost today", "login from host fe80:0:0:0:1:2:3:4 ok", "charged to card 1234.5678.9012.3456 thanks",
              "the code 030 5550 888 is no number to call", "ring me on time 2024-01-01", "Größe 😀 ring me on 555-7777-66"]
    # ``ext`` has two seeds of its own; the rest it owes to numbers found after ``ring me on``.
    return texts + ["call ext +49 30 1110001 now", "call ext +49 30 1110002 now"]


def expected(texts, support=pii.SUPPORT, confidence=pii.CONFIDENCE, rounds=pii.ROUNDS):
    """Graph and rounds over plain dictionaries."""
    spots = []
    for row, text in enumerate(texts):
        text = text or ""
        known = base(text)
        spots += [(row, 1 << k, 1 << k, s, e) for k, s, e in known] + [(row, 0, m, s, e) for m, s, e in pii.candidates(text, known)]
    graph = defaultdict(dict)
    for row, seed, looks, s, e in spots:
        for p in pii.contexts(texts[row], s, e):
            i = pii.instance(texts[row][s:e])
            a, b = graph[p].get(i, (0, 0))
            graph[p][i] = (a | seed, b | looks)
    found, accepted = {}, {}
    for _ in range(rounds):
        accepted = {}
        for p, members in graph.items():
            for k in range(4):
                score = [1000 if seed >> k & 1 else found.get((i, k), 0) for i, (seed, _) in members.items()]
                rate = sum(score) // (len(members) + 1)
                if sum(x > 0 for x in score) >= support and rate >= confidence:
                    accepted[p, k] = rate
        found = {}
        for p, members in graph.items():
            for i, (seed, looks) in members.items():
                for k in range(4):
                    if not seed and looks >> k & 1 and (p, k) in accepted:
                        found[i, k] = max(found.get((i, k), 0), accepted[p, k])
    out = defaultdict(list)
    for row, seed, looks, s, e in spots:
        if not seed:
            rates = [(accepted.get((p, k), 0) if looks >> k & 1 else 0, -k) for p in pii.contexts(texts[row], s, e) for k in range(4)]
            if rates and max(rates)[0]:
                out[row].append((-max(rates)[1], s, e))
    return out


def check(spark, texts, **how):
    got = {r["doc_id"]: r for r in pii.scan(docs(spark, texts).selectExpr("*", "1 as row", "2 as base", "'z' as pat"), **how).collect()}
    more = expected(texts, **how)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        mine, r = base(text or ""), got[i]
        assert r["base_sha256"] == hashlib.sha256(listed(mine).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(m[0] == k for m in mine) for k in range(4)]
        assert r["spans"] == listed(mine + more[i]) and r["n_found"] == len(more[i]), text
    return got, more


def test_contexts_find_unseen_identifiers(spark):
    texts = corpus(random.Random(4)) + [None, "", "no data here", "ring me on +49 30 55501001 " * 40]
    got, more = check(spark, texts)
    at = {t: i for i, t in enumerate(texts)}
    found = {t: [texts[i][s:e] for _, s, e in more[i]] for t, i in at.items() if more[i]}
    assert found["Please ring me on (030) 5550-777 tomorrow"] == ["(030) 5550-777"]
    assert found["mail sent by bob [at] example [dot] org today"] == ["bob [at] example [dot] org"]
    assert found["mail sent by root@localhost today"] == ["root@localhost"]
    assert found["login from host fe80:0:0:0:1:2:3:4 ok"] == ["fe80:0:0:0:1:2:3:4"]
    assert found["charged to card 1234.5678.9012.3456 thanks"] == ["1234.5678.9012.3456"]
    assert "the code 030 5550 888 is no number to call" not in found
    assert not any(t.startswith("Order total") for t in found)


def test_found_instances_support_further_patterns(spark):
    texts = [f"ring me on +49 30 55501{i:03d}" for i in range(30)]
    texts += [f"ring me on 030 77{i:05d}" for i in range(6)] + [f"or by fax: 030 77{i:05d}" for i in range(6)]  # the same six, and one more
    texts += ["or by fax: 030 8888888"]
    _, more = check(spark, texts, rounds=1)
    assert not more[len(texts) - 1]
    _, more = check(spark, texts, rounds=3, confidence=600)
    assert more[len(texts) - 1]


def test_copies_lend_no_support(spark):
    texts = ["ring me on +49 30 5550100 now"] * 50 + ["ring me on 030 5550777 now"]
    got, more = check(spark, texts)
    assert not any(more.values())


def test_small_tables(spark):
    assert pii.scan(docs(spark, [])).count() == 0
    rows = [(None, "a@b.cc", "en", "s", 1), (None, None, "en", "s", 1), (3, "a@b.cc", "en", "s", 1), (3, "a@b.cc", "en", "s", 1)]
    got = sorted((str(r["doc_id"]), r["spans"]) for r in pii.scan(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("3", "email:0:6"), ("3", "email:0:6"), ("None", ""), ("None", "email:0:6")]


@pytest.mark.parametrize("text, start, end, wanted", [
    ("Tel.: 123", 6, 9, ["1 :", "2 tel :"]), ("a\nb 5", 4, 5, ["1 b"]), ("no 12 x 5, then", 8, 9, ["1 x", "2 0 x", "3 no 0 x", "+ x _ then"]), ("5", 0, 1, []),
    ("q" * 80 + " w 5", 83, 84, ["1 w"])])
def test_contexts(text, start, end, wanted):
    assert pii.contexts(text, start, end) == wanted
