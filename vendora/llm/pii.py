"""Personal data: typed patterns as seeds, and contextual patterns bootstrapped
from them.

1. One pass over the texts finds the seeds (email, ip, card, phone by their forms
   and checks) and the candidates: other spans that could be one of the kinds by
   their looks (numbers of fitting length in any punctuation, addresses without a
   dot or with ``(at)`` and ``[dot]``, IPv6). Each comes with the lexical patterns
   around it on its line: its last one, two and three words and marks, and the last
   one with the next word. All later steps read this small table, not the texts.
2. Patterns and instances (normalised spans) make a graph; an edge is kept once
   however often it repeats, so copied pages lend no weight. A round scores each
   pattern for a kind by the scores of its instances, out of all instances it has,
   of whatever kind or none; patterns of enough support and confidence pass it on to
   the candidates they surround that look like the kind; these count in the next
   round. Scores are integers, so the result does not depend on the order of work.
3. Candidates within a pattern accepted in the last round become spans of its kind.

Skew: a hot pattern or instance is folded before it shuffles; found instances and
accepted patterns are broadcast only after a count, else both sides shuffle.

Defined results: a null text is an empty one and has no spans; null and repeated
ids are judged row by row; equal rows have equal results; offsets are code points;
found spans never overlap seeds or one another; spans are listed by kind, then
start; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendora.llm.common import maybe_broadcast, stored

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5      # different instances that a pattern must have for a kind
CONFIDENCE = 700  # of 1000, to be accepted
ROUNDS = 3
WINDOW = 60      # characters of context

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive runs: a failed attempt never scans its run again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Looks of candidates.
_HOST = re.compile(r"[A-Za-z0-9-]++")
_AT = re.compile(r" ?[\[(]at[\])] ?")
_SPELLED = re.compile(r"[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+])\(?[0-9](?:[ ().\-/]{0,2}[0-9])++(?![0-9A-Za-z])")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[:=#@]")
_NEXT = re.compile(r"[^\w\n]{0,3}([^\W\d_]+)")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))


def _left(text: str, at: int, low: int) -> int:
    while at > low and text[at - 1] in _LOCAL:
        at -= 1
    return at


def seeds(text: str) -> list[Span]:
    """(kind, start, end) of the typed patterns, by kind, then start."""
    out: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:  # a local part ends at its @, so every match stands around one
        start, m = _left(text, at, low), None
        if start < at:
            m = _DOMAIN.match(text, at + 1)
        if m:
            out.append((0, start, m.end()))
            low = m.end()
        at = text.find("@", m.end() if m else at + 1)
    out += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and _luhn(d):
                out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _looks(text: str) -> Iterator[tuple[int, int, int]]:
    """(kinds as a bit mask, start, end) of spans that could be one of the kinds."""
    at = text.find("@")
    while at >= 0:
        m, start = _HOST.match(text, at + 1), _left(text, at, 0)
        if m and start < at:
            yield 1, start, m.end()
        at = text.find("@", at + 1)
    if "at" in text:
        for a in _AT.finditer(text):
            m, start = _SPELLED.match(text, a.end()), _left(text, a.start(), 0)
            if m and start < a.start():
                yield 1, start, m.end()
    for m in _IPV6.finditer(text):
        yield 2, *m.span()
    for m in _NUMBER.finditer(text):
        n = len(_digits(m.group()))
        if 7 <= n <= 19:
            yield (8 if n <= 15 else 0) | (4 if n >= 13 else 0), *m.span()


def candidates(text: str, known: list[Span]) -> list[tuple[int, int, int]]:
    """Of ``_looks`` what overlaps neither a seed nor an earlier candidate."""
    taken = sorted((s, e) for _, s, e in known)
    starts, reach, high = [s for s, _ in taken], [], 0
    for _, e in taken:
        high = max(high, e)
        reach.append(high)
    out, end = [], 0
    for mask, s, e in sorted(_looks(text), key=lambda c: (c[1], -c[2])):
        k = bisect_right(starts, e - 1)  # seeds that start before the end
        if s >= end and not (k and reach[k - 1] > s):
            out.append((mask, s, e))
            end = e
    return out


def instance(text: str) -> str:
    """Name of what a span holds: the digits of numbers, else lower case."""
    return text.lower() if any(c.isalpha() or c == ":" for c in text) or "@" in text else _digits(text)


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span, within its line."""
    low = max(0, start - WINDOW)
    left = text[low:start]
    whole = low == 0 or not text[low - 1].isalnum()
    if "\n" in left:
        left, whole = left[left.rindex("\n") + 1:], True
    tokens = ["0" if t[0].isdigit() else t for t in _TOKEN.findall(left.lower())]
    if not whole and left[:1].isalnum():
        tokens = tokens[1:]  # cut off by the window
    out = [f"{n} {' '.join(tokens[-n:])}" for n in (1, 2, 3) if len(tokens) >= n]
    follows = _NEXT.match(text, end, end + WINDOW)
    if tokens and follows:
        out.append(f"+ {tokens[-1]} _ {follows.group(1).lower()}")
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.list_(pa.struct([("seed", pa.int32()), ("looks", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                             ("inst", pa.string()), ("pats", pa.list_(pa.string()))]))
_SQL = ("array<struct<kind:int,start:int,end:int>>", "array<struct<seed:int,looks:int,start:int,end:int,inst:string,pats:array<string>>>")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, base, spots): the seeds, and all spans with context."""
    for batch in batches:
        base, spots = [], []
        for value in batch["text"]:
            text = value.as_py() or ""
            known = seeds(text)
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in known])
            every = [(1 << k, 1 << k, s, e) for k, s, e in known] + [(0, m, s, e) for m, s, e in candidates(text, known)]
            spots.append([{"seed": seed, "looks": m, "start": s, "end": e, "inst": instance(text[s:e]), "pats": contexts(text, s, e)}
                          for seed, m, s, e in every])
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(base, _SPANS), pa.array(spots, _FOUND)], ["row", "base", "spots"])


def read(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, spots), one row per row of ``docs``, stored."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = f"row long, base {_SQL[0]}, spots {_SQL[1]}"
    # The id rides in the row number's place: ids of any type and nulls stay as they are.
    keyed = rows.select(F.struct("row", "doc_id").alias("row"), "text")
    typed = schema.replace("row long", f"row struct<row:bigint,doc_id:{docs.schema['doc_id'].dataType.simpleString()}>")
    return stored(keyed.mapInArrow(_read, typed).select("row.row", "row.doc_id", "base", "spots"), "pii-rows")


def _per_kind(make) -> list[Column]:
    return [make(k).alias(f"c{k}") for k in range(len(KINDS))]


def learn(rows: DataFrame, support: int = SUPPORT, confidence: int = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """(pat, c0 .. c3): the accepted patterns with their confidence of 1000 for
    each kind, 0 if it is not accepted for it."""
    spots = rows.select(F.explode("spots").alias("s")).select("s.seed", "s.looks", "s.inst", F.explode(F.array_distinct("s.pats")).alias("pat"))
    edges = spots.groupBy("pat", "inst").agg(F.bit_or("seed").alias("seed"), F.bit_or("looks").alias("looks"))
    edges = stored(edges, "pii-edges")
    # No pattern of fewer instances than the support can be accepted in any round.
    able = edges.groupBy("pat").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("pat")
    edges = stored(edges.join(maybe_broadcast(stored(able, "pii-able")), "pat"), "pii-graph")

    def has(mask: str, k: int) -> Column:
        return F.col(mask).bitwiseAND(F.lit(1 << k)) != 0

    kinds = range(len(KINDS))
    found = None
    accepted = None
    for _ in range(rounds):
        scored = edges
        if found is not None:
            scored = edges.join(maybe_broadcast(found), "inst", "left")
        score = [F.when(has("seed", k), 1000).otherwise(F.coalesce(F.col(f"s{k}"), F.lit(0)) if found is not None else F.lit(0)) for k in kinds]
        sums = scored.groupBy("pat").agg(
            F.count("*").alias("n"), *[F.sum(score[k]).alias(f"sum{k}") for k in kinds],
            *[F.count_if(score[k] > 0).alias(f"of{k}") for k in kinds])
        rate = [F.call_function("div", F.col(f"sum{k}"), F.col("n") + 1).cast("int") for k in kinds]
        good = [(F.col(f"of{k}") >= support) & (rate[k] >= confidence) for k in kinds]
        accepted = sums.select("pat", *_per_kind(lambda k: F.when(good[k], rate[k]).otherwise(F.lit(0))))  # noqa: B023
        accepted = stored(accepted.where(F.greatest(*[F.col(f"c{k}") for k in kinds]) > 0), "pii-patterns")
        reached = edges.where("seed = 0").join(maybe_broadcast(accepted), "pat")
        found = reached.groupBy("inst").agg(*[F.max(F.when(has("looks", k), F.col(f"c{k}")).otherwise(F.lit(0))).alias(f"s{k}") for k in kinds])
        found = stored(found.where(F.greatest(*[F.col(f"s{k}") for k in kinds]) > 0), "pii-found")
    return accepted


def discovered(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(row, kind, start, end, confidence) of the candidates within a pattern, of
    the kind that it gives most confidence."""
    spots = (rows.select("row", F.explode(F.filter("spots", lambda s: s["seed"] == 0)).alias("s"))
             .select("row", "s.start", "s.end", "s.looks", F.explode(F.array_distinct("s.pats")).alias("pat")))
    met = spots.join(maybe_broadcast(patterns), "pat")
    options = [F.struct(F.when(F.col("looks").bitwiseAND(F.lit(1 << k)) != 0, F.col(f"c{k}")).otherwise(F.lit(0)).alias("c"), F.lit(-k).alias("k"))
               for k in range(len(KINDS))]
    best = met.groupBy("row", "start", "end").agg(F.max(F.greatest(*options)).alias("best")).where(F.col("best")["c"] > 0)
    return best.select("row", (-F.col("best")["k"]).alias("kind"), "start", "end", F.col("best")["c"].alias("confidence"))


def _listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, support: int = SUPPORT, confidence: int = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans, n_found (spans that the contexts added)."""
    rows = read(docs)
    more = discovered(rows, learn(rows, support, confidence, rounds))
    more = more.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    out = rows.select("row", "doc_id", "base").join(maybe_broadcast(stored(more, "pii-more")), "row", "left")
    found = F.coalesce("more", F.expr(f"cast(array() as {_SQL[0]})"))
    return out.select(
        "doc_id", *[F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],  # noqa: B023
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", found)).alias("spans"), F.size(found).cast("long").alias("n_found"))
