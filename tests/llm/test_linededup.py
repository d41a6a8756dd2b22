import random

import numpy as np

from tests.llm.helpers import DOCS, docs, words
from vendora.llm import linededup as ld


def within_one(a, b):
    """Edit distance over words of at most one, by the textbook table."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1] <= 1


def brute(texts, least=5):
    """(id, text) pairs to remaining texts, comparing all lines with all."""
    def place(k, no):
        doc = texts[k][0]
        return (doc is not None, doc if doc is not None else 0, no)
    lines = [(k, no, words(line)) for k, (_, t) in enumerate(texts) if t is not None for no, line in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    near = lambda w, w2: w == w2 or (min(len(w), len(w2)) >= least and within_one(w, w2))
    gone = {(k, no) for k, no, w in lines
            if any(place(k2, no2) < place(k, no) and near(w, w2) for k2, no2, w2 in lines)}
    return [None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (k, no) not in gone)
            for k, (_, t) in enumerate(texts)]


def run(spark, texts):
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    got = ld.line_dedup(d).collect()
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in got))


def want(texts):
    return sorted((i is not None, i or 0, t is not None, t or "") for (i, _), t in zip(texts, brute(texts)))


def test_random_lines_match_brute_force(spark):
    rng = random.Random(11)
    vocab = ["a", "b", "c", "dé"]
    texts = [(i, "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    assert run(spark, texts) == want(texts)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [(3, None), (4, ""), (5, "\n\n"), (6, "one two three four five"), (2, "ONE two, three four five!\nshort line\nshort line"),
             (7, "one two three four"), (8, "one two three four five six"), (None, "zero two three four five"), (9, long),
             (10, long.replace("w77 ", "changed ")), (11, long.replace("w1 ", "")), (12, "x " + long), (13, long + " " + long),
             (14, "p q r s t u"), (14, "p q r s t u"), (15, "keep\none two three four five\nkeep"), (16, "p q r s t")]
    assert run(spark, texts) == want(texts)


def test_very_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    got = run(spark, [(1, long), (2, long.replace("w30000 ", "")), (3, long.replace("w7 ", "x ").replace("w9 ", "y ")), (4, "w0 " + long)])
    assert [t == "" for *_, t in got] == [False, True, False, True]


def test_shared_ids_with_different_texts(spark):
    texts = [(1, "one two three four five\nfirst row"), (2, "alpha beta gamma delta eps\nsecond"), (2, "one two three four five\nthird row of it")]
    assert run(spark, texts) == want(texts)


def test_hot_variant_keeps_only_the_earliest(spark):
    texts = [(i, f"page {i} of the whole report\nown text {i}") for i in range(300)]
    got = run(spark, texts)
    assert sum("report" in t for *_, t in got) == 1 and all("own text" in t for *_, t in got)


def test_dedup_updates_columns_and_drops_emptied(spark):
    d = docs(spark, ["one two three four five\nrest of this", "one two three four six", "", None, "one two three four five\nmore"]).selectExpr("*", "1 as line_drop", "2 as h")
    got = {r.doc_id: r for r in ld.dedup(d).collect()}
    assert ld.dedup(d).columns == d.columns
    assert set(got) == {0, 2, 3, 4}
    assert (got[4].text, got[4].n_chars, got[0].n_chars) == ("more", 4, len("one two three four five\nrest of this"))
    assert ld.dedup(docs(spark, [])).count() == 0


def test_polynomial_hashes():
    rng = random.Random(1)
    lines = [[rng.choice("abcdé").encode() for _ in range(n)] for n in (1, 2, 5, 6, 9, 30)]
    h = ld.Hashes([w for x in lines for w in x], np.array([len(x) for x in lines]))

    def whole(words):
        one = ld.Hashes(words, np.array([len(words)]))
        return one.whole[0][0], one.whole[1][0]
    for k, line in enumerate(lines):
        for p in range(len(line)):
            rest = line[:p] + line[p + 1:]
            if rest:
                assert whole(rest) == tuple(h.without(j)[h.starts[k] + p] for j in (0, 1))
    # the half of a line hashes like the same half of another line, wherever it stands
    a, b = ([w.encode() for w in t.split()] for t in ("q w e r t y", "q w e x t y z"))
    ha, hb = (ld.Hashes(x, np.array([len(x)])).halves() for x in (a, b))
    assert ha[0] == hb[0] == hb[2]
    a, b = ([w.encode() for w in t.split()] for t in ("x b c d e f", "y y y d e f"))
    assert ld.Hashes(a, np.array([6])).halves()[1] == ld.Hashes(b, np.array([6])).halves()[1]


def test_shuffled_instead_of_broadcast(spark, monkeypatch):
    texts = [(i, f"page {i} of the whole report\nown text number {i} here now") for i in range(40)]
    expected = run(spark, texts)
    from vendora.llm import common
    monkeypatch.setattr(ld, "maybe_broadcast", lambda df, *a, **k: common.maybe_broadcast(df, 1, limit=0))
    assert run(spark, texts) == expected


def test_short_copies_fold_to_the_earliest(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "c", "dé"]
    texts = [(i, "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    texts += [(200, "All rights reserved\nown one"), (201, "all rights, reserved.\n--\n--\nown one"), (202, "all rights"), (-1, "own one"),
              (203, None), (204, "one two three four five\none two three four"), (205, "one two three four six\none two three four")]
    seen, expected = set(), []
    for i, t in sorted(texts):
        left = []
        for line in (t or "").split("\n"):
            w = tuple(words(line))
            if not (w and w in seen) and line != "one two three four six":  # that one by the edit bound
                left.append(line)
            seen.add(w)
        expected.append((i, None if t is None else "\n".join(left)))
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS)
    got = sorted((r.doc_id, r.text) for r in ld.line_dedup(d).collect())
    assert got == expected
