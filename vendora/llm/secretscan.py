r"""Secret scan by assignment-aware lexing.

The text is lexed as one stream of names, literals, operators, brackets and line
ends, as source and configuration files of many kinds write them, and read as
pairs of a target name and a value: ``name = "x"``, ``name: x``, ``"name": "x"``,
``cfg["name"] = "x"``, ``--name=x``, ``<name>x</name>``, ``scheme://user:x@host``.
A value is a literal, a name, or a sum of both; ``+=`` adds to the value before. It
goes on over line ends after an operator, before an indented ``+`` and in brackets:
literals in lists, parentheses and call arguments are its parts, unless they have a
key of their own. A triple-quoted or YAML block value is a literal per line, and is
read for pairs besides. ``$NAME``, ``${NAME}`` and ``@name`` are NAME, also in
strings of double quotes or backticks. Unquoted words on a line of their own or in
lists count as literals if they hold a digit, in calls not at all.
Each name keeps its parts by reference, however many, and a sensitive target walks
each of them once per score, so a literal that reaches a sensitive name through constants is found
where it is written. A literal's score is that of the target name's words times
its own (length, variety, no placeholder); scores from ``LEAST`` on count.

Three base patterns are matched on the whole text besides: ``assign``, ``access``
and ``hex``. Spans of the method are of kind ``lexed`` (the pair's own literal) or
``flow`` (a literal that came through a constant). Offsets are code points.

Scale: one streaming pass of Arrow batches, no shuffle, linear in the text;
byte-level tests skip texts that no pattern can match.

Defined results: null and empty texts have no spans and score 0; repeated rows
give equal rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# The base patterns, the characters that count and how many at least.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = [*BASE, "lexed", "flow"]
LEAST = 0.4

# How strongly a word of a name speaks for a secret, and words
# that speak against one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "passcode": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "apikey": 1.0, "apitoken": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.9,
    "bearer": 0.9, "private": 0.6, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "clientsecret": 1.0, "signature": 0.5,
    "salt": 0.5, "cookie": 0.5, "session": 0.5, "jwt": 0.9, "pin": 0.5, "otp": 0.6, "encryption": 0.5, "connectionstring": 0.7,
}
PAIRED = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9,
          ("encryption", "key"): 0.9, ("account", "key"): 0.9, ("master", "key"): 0.9, ("shared", "key"): 0.9,
          ("connection", "string"): 0.7, ("client", "secret"): 1.0}
AGAINST = {"public": 0.3, "name": 0.3, "file": 0.3, "path": 0.3, "url": 0.4, "uri": 0.4, "type": 0.3, "length": 0.2, "len": 0.2,
           "count": 0.2, "max": 0.3, "min": 0.3, "limit": 0.3, "expires": 0.3, "expiry": 0.3, "ttl": 0.2, "field": 0.4, "label": 0.3,
           "policy": 0.3, "hint": 0.3, "prompt": 0.3, "regex": 0.2, "pattern": 0.2, "example": 0.4, "endpoint": 0.4, "header": 0.5}
PLACEHOLDERS = {"changeme", "change_me", "password", "passwd", "secret", "token", "example", "test", "none", "null", "nil", "true",
                "false", "undefined", "todo", "tbd", "redacted", "placeholder", "default", "string", "str", "required", "optional"}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


class Literal(NamedTuple):
    start: int
    end: int
    text: str


# Lexemes. A quoted string may hold escapes; a path is names joined by dots,
# arrows or subscripts; a bare word is an unquoted value.
_LEXEME = re.compile(r"""
    (?P<newline>\n)
  | (?P<element><(?P<tag>[A-Za-z_][\w.-]*)(?:\x20[^<>\n]*)?>(?P<inner>[^<>\n]*)</(?P=tag)>)
  | (?P<url>[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@"']*:(?P<userpass>[^\s/@"']+)@)
  | (?P<triple>\"\"\"|''')
  | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<op>:=|=>|==|!=|<=|>=|\+=|=|:|\+)
  | (?P<name>\$\{[A-Za-z_]\w*\}|--?[A-Za-z][\w-]*|[A-Za-z_$@][\w$]*(?:(?:\.|->|::)[A-Za-z_]\w*|-(?=[A-Za-z])\w+|\[["'][\w.-]+["']\])*)
  | (?P<bracket>[()\[\]{}])
  | (?P<bare>[^\s"'`,;{}()\[\]<>=:]+)
  | (?P<other>\S)
""", re.VERBOSE)
_SET = {"=", ":", ":=", "=>", "+="}
_SET_NEXT = re.compile(r"[^\S\n]*(?::=|=>|\+=|=(?!=)|:)")
_MARK = re.compile(r"[=:>]")
_BARE = re.compile(r"[^\s\"'`,;{}()<>]+")
_ITEM = re.compile(r"[^\s\"'`,;{}()<>\[\]=:]+")
_ALONE = re.compile(r"[^\S\n]*[;,]?[^\S\n]*(?:#[^\n]*)?(?:\n|\Z)")
_PLUS_NEXT = re.compile(r"\s*\n[^\S\n]+\+(?![=+])")
_BLOCK = re.compile(r"[^\S\n]*[|>][-+0-9]{0,2}[^\S\n]*\n")
_INDENT = re.compile(r"[^\S\n]*")
_REFERENCE = re.compile(r"\$(?:\{([A-Za-z_]\w*)\}|([A-Za-z_]\w*))")
_BRACKETS = re.compile(r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|[()\[\]{}]""")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def name_score(name: str) -> float:
    """How strongly the words of a target name speak for a secret."""
    last = re.split(r"\.|->|::|\[", name)
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", " ".join(last[-2:]))
    words = [w.lower() for w in re.findall(r"[A-Za-z]+|\d+", spaced)]
    if not words:
        return 0.0
    best = max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE.get("".join(words), 0.0)]
               + [PAIRED.get(p, 0.0) for p in zip(words, words[1:], strict=False)])
    return best * min([AGAINST.get(w, 1.0) for w in words[-1:]] + [1.0])


def literal_score(text: str) -> float:
    """How much a literal looks like a secret: long and varied, no placeholder."""
    low = text.lower()
    if len(text) < 6 or low in PLACEHOLDERS or re.search(r"\$\{|\$\(|\{\{|%\(|^<.*>$|^\*+$|^x+$|\byour[_ -]|://$|\s\S+\s", low):
        return 0.0
    n = len(text)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(text).values())
    mixed = sum(bool(re.search(p, text)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return max(0.0, min(1.0, 0.25 * min(entropy, 4.0) * 0.7 + 0.1 * mixed))


class Part(NamedTuple):
    """A literal, or names of constants; with both the literal counts only if
    none of the names is a constant."""
    names: tuple[str, ...]
    literal: Literal | None


class _Pair:
    """An assignment being read: ``want`` while a value must follow."""

    __slots__ = ("targets", "op", "parts", "want", "crossed", "named", "joins", "indent")

    def __init__(self, target: str, op: str, named: bool, indent: int):
        self.targets, self.op, self.named, self.indent = [target], op, named, indent
        self.parts: list[Part] = []
        self.want, self.crossed, self.joins = True, False, False


class _Frame:
    """What is open: the text itself, or the brackets up to ``end`` whose
    literals go to the pair ``sink`` unless they have a key of their own."""

    __slots__ = ("end", "sink", "pair", "listed")

    def __init__(self, end: int, sink: _Pair | None = None, listed: bool = False):
        self.end, self.sink, self.listed = end, sink, listed
        self.pair: _Pair | None = None


def _plain(name: str) -> str:
    """$NAME, ${NAME} and @name as NAME."""
    return name.strip("${}") if name.startswith("${") else name.lstrip("-$@")


def _matched(text: str) -> dict[int, int]:
    """Places of the brackets that close, to those of their closing ones."""
    opened: dict[str, list[int]] = {"(": [], "[": [], "{": []}
    out = {}
    for m in _BRACKETS.finditer(text):
        if m[0] in opened:
            opened[m[0]].append(m.start())
        elif m[0] in _CLOSES and opened[_CLOSES[m[0]]]:
            out[opened[_CLOSES[m[0]]].pop()] = m.start()
    return out


def _lines(text: str, start: int, end: int) -> Iterator[Part]:
    """Each line from ``start`` to ``end`` as a literal, without its margins."""
    while start < end:
        stop = text.find("\n", start, end)
        stop = end if stop < 0 else stop
        line = text[start:stop]
        if word := line.strip():
            at = start + line.index(word)
            yield Part((), Literal(at, at + len(word), word))
        start = stop + 1


def _block_end(text: str, pos: int, indent: int) -> int:
    """Where the lines from ``pos`` on that are blank or deeper than ``indent`` end."""
    while pos < len(text):
        first = _INDENT.match(text, pos).end()
        if first < len(text) and text[first] != "\n" and first - pos <= indent:
            break
        stop = text.find("\n", first)
        pos = len(text) if stop < 0 else stop + 1
    return pos


def _string(m: re.Match) -> list[Part]:
    """A quoted string; $NAME and ${NAME} in it are names too."""
    inner = m["string"][1:-1]
    whole = Literal(m.start() + 1, m.end() - 1, inner)
    names = () if m["string"][0] == "'" or "$" not in inner else tuple(a or b for a, b in _REFERENCE.findall(inner))
    if names and _REFERENCE.sub("", inner):
        return [Part(names, None), Part((), whole)]
    return [Part(names, whole)]


def pairs(text: str) -> Iterator[tuple[str, str, list[Part]]]:
    """(target name, operator, parts) of each pair, in the order they end.

    The text is one stream of lexemes. A line end closes a value, but not inside
    brackets, after an operator or before an indented ``+``. Parts of the text
    outside any value are only looked at from the lines that hold an operator."""
    frames = [_Frame(len(text) + 1)]
    matched: dict[int, int] | None = None
    pos, fresh_line, line = 0, True, 0
    prev: re.Match | None = None  # the lexeme before, if it may be a target
    call = -1  # where a name of a value ends: a bracket right there belongs to it
    run_end, last_digit = -1, -1

    def done(frame: _Frame) -> list[tuple[str, str, list[Part]]]:
        pair, frame.pair = frame.pair, None
        return [(t, pair.op, pair.parts) for t in pair.targets] if pair and pair.parts else []

    while True:
        frame = frames[-1]
        if fresh_line and frame.pair is None and frame.sink is None:
            mark = _MARK.search(text, pos, frame.end)
            if mark is None and len(frames) == 1:
                return
            line = pos = max(pos, text.rfind("\n", pos, mark.start()) + 1) if mark else max(pos, frame.end)
        fresh_line = False
        m = _LEXEME.search(text, pos)
        at = m.start() if m else len(text) + 1
        closing = False
        while len(frames) > 1 and frames[-1].end <= at:
            closing = frames[-1].end == at
            yield from done(frames.pop())
            frame, prev = frames[-1], None
            if frame.pair is not None:
                frame.pair.want = frame.pair.joins = False
        if m is None:
            yield from done(frame)
            return
        pos, kind, pair = m.end(), m.lastgroup, frame.pair
        before, prev = prev, None
        if closing:  # the bracket or the quotes that end a frame
            call = pos
            continue

        if kind == "newline":
            fresh_line, line = True, pos
            if pair is not None:
                if pair.want:
                    pair.crossed = True
                elif frame.sink is None and not _PLUS_NEXT.match(text, at):
                    yield from done(frame)
            continue

        if kind == "element" or kind == "url":
            yield from done(frame)
            group, target = ("inner", m["tag"]) if kind == "element" else ("userpass", "password")
            yield target, "=", [Part((), Literal(m.start(group), m.end(group), m[group]))]
            continue

        if kind == "op":
            op = m["op"]
            if op == "+":
                if pair is not None and not pair.want:
                    pair.want, pair.joins = True, False
                continue
            if op not in _SET or before is None:
                yield from done(frame)
                continue
            named = before.lastgroup == "name"
            target = _plain(before["name"]) if named else before["string"][1:-1]
            if pair is not None and pair.want and not pair.parts and not pair.crossed and op == "=":
                if pair.op == ":" and pair.named and named:
                    pair.op = "="  # name: type = value
                    continue
                if pair.op == "=":
                    pair.targets.append(target)  # a = b = value
                    continue
            yield from done(frame)
            if target:
                frame.pair = pair = _Pair(target, op, named, _INDENT.match(text, line).end() - line)
                if op == ":" and (block := _BLOCK.match(text, pos)):
                    pair.parts += _lines(text, block.end(), _block_end(text, block.end(), pair.indent))
                    pair.want, pos = False, block.end() - 1
            continue

        if kind == "triple":
            end = text.find(m["triple"], pos)
            if end >= 0:
                into = pair if pair is not None and pair.want else frame.sink if pair is None else None
                if pair is not None and into is None:
                    yield from done(frame)
                if into is not None:
                    into.parts += _lines(text, pos, end)
                    frames.append(_Frame(end))  # what it holds is read as text of its own
            continue

        if kind == "bracket":
            if m[0] in _CLOSES:
                yield from done(frame)
                continue
            into = pair if pair is not None and (pair.want or call == at) else frame.sink if pair is None else None
            if matched is None and into is not None:
                matched = _matched(text)
            if into is not None and matched.get(at, -1) >= 0:
                frames.append(_Frame(min(matched[at], frame.end), into, m[0] != "("))
            else:
                yield from done(frame)
            continue

        if kind == "string":
            prev = m
            key = _SET_NEXT.match(text, pos) is not None
            inside = frame.sink is not None
            if pair is not None and (pair.want or pair.joins and inside) and not (key and (pair.crossed or inside and not pair.want)):
                pair.parts += _string(m)
                pair.want, pair.joins = False, True
            else:
                yield from done(frame)
                if pair is None and inside and not key:
                    frame.sink.parts += _string(m)
            continue

        if kind == "name" or kind == "bare":
            if m[0] == "\\" and text.startswith("\n", pos):
                pos += 1  # the line goes on
                prev = before
                continue
            prev = m if kind == "name" else None
            into = pair if pair is not None and pair.want else frame.sink if pair is None else None
            if into is None:
                yield from done(frame)
                into = frame.sink
            if into is None:
                continue
            inside = frame.sink is not None
            if inside:
                end = max(_ITEM.match(text, at).end() if kind == "bare" or m[0][0] != "$" else 0, pos)
                digit = bool(re.search(r"\d", text[at:end]))
                key = _SET_NEXT.match(text, pos) is not None
            else:
                if at >= run_end:
                    word = _BARE.match(text, at)
                    run_end = word.end()
                    last_digit = max((run_end - 1 - i for i, c in enumerate(reversed(word[0])) if c.isdigit()), default=-1)
                end = max(run_end, pos)
                digit = last_digit >= at
                key = bool(_SET_NEXT.match(text, pos) or not digit and _SET_NEXT.match(text, end))
            if key and (inside or not digit or into.crossed):
                if into.crossed and into is pair:
                    yield from done(frame)  # "a =", and the next line has a pair of its own
                if not _SET_NEXT.match(text, pos):
                    pos = end
                continue
            if into is pair and pair.crossed and not pair.parts and (not pair.indent < at - line or not _ALONE.match(text, end)):
                yield from done(frame)
                continue
            called = text.startswith("(", pos)
            subscript = kind == "name" and m[0].endswith("]")
            names = ()
            literal = None
            if kind == "name" and not called:
                names = (_plain(m[0]),)
            scheme = kind == "name" and m[0].lower() in ("bearer", "basic")
            if scheme:
                names = ()
            elif called or subscript:
                end = pos
            else:
                if text[end - 1] == "+" and end > pos and text[end:end + 1] in ("\"", "'", "`", "\n", " ", "("):
                    end -= 1  # the sum goes on
                word = text[at:end]
                if kind == "name":
                    names += tuple(_plain(x) for x in word.split("+")[1:] if x)
                if digit and (kind == "bare" or frame.listed) if inside else digit or not into.crossed:
                    literal = Literal(at, end, word.rstrip("."))
            if names or literal is not None:
                into.parts.append(Part(names, literal))
            call = pos if kind == "name" else -1
            pos = max(pos, end) if not scheme else pos
            if pos > m.end():
                prev = None
            if scheme and (word := _INDENT.match(text, pos)) and (rest := _BARE.match(text, word.end())):
                into.parts.append(Part((), Literal(rest.start(), rest.end(), rest[0])))
                pos, prev = rest.end(), None
            if into is pair:
                pair.want, pair.joins = False, False
            continue

        yield from done(frame)  # other: separators, signs


class _Constant:
    """A constant's value: literals and the constants it is built from, by
    reference; ``seen`` is the highest target score it was walked with."""

    __slots__ = ("parts", "seen")

    def __init__(self, parts: list[Literal | _Constant]):
        self.parts, self.seen = parts, 0.0

    def literals(self, score: float) -> Iterator[tuple[str, Literal]]:
        """("lexed" or "flow", literal) in order, without the constants that were
        walked with this score or a higher one before."""
        self.seen = score
        todo = [iter(self.parts)]
        while todo:
            part = next(todo[-1], None)
            if part is None:
                todo.pop()
            elif isinstance(part, Literal):
                yield ("lexed" if len(todo) == 1 else "flow"), part
            elif part.seen < score:
                part.seen = score
                todo.append(iter(part.parts))


def lexed(text: str, least: float = LEAST) -> list[Span]:
    """Literals of sensitive targets, own and through constants."""
    constants: dict[str, _Constant] = {}
    best: dict[tuple[int, int], Span] = {}
    for target, op, parts in pairs(text):
        value: list[Literal | _Constant] = []
        for part in parts:  # a bare word that names a constant is that constant
            value += [constants[x] for x in part.names if x in constants] or [part.literal] * (part.literal is not None)
        if op == "+=" and target in constants:
            value.insert(0, constants[target])
        constants[target] = constant = _Constant(value)
        name = name_score(target)
        if name == 0.0:
            continue
        for kind, lit in constant.literals(name):
            score = name * literal_score(lit.text)
            old = best.get((lit.start, lit.end))
            if score >= least and (old is None or score > old.score):
                best[lit.start, lit.end] = Span(kind, lit.start, lit.start + len(lit.text), round(score, 6))
    return list(best.values())


_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")


def _long_hex(raw: bytes) -> bool:
    """Whether 24 hex digits stand in a row."""
    run = _HEX[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8):  # runs of 2, 4, 8, 16
        run = run[:-step] & run[step:]
        if step == 4:
            eight = run
    return bool((run[:-8] & eight[16:]).any())


def base_spans(text: str) -> list[Span]:
    raw = text.encode("utf-8", "replace")
    low = raw.lower()
    able = {"assign": any(w in low for w in _WORDS), "access": b"AKIA" in raw, "hex": len(raw) >= 24 and _long_hex(raw)}
    return [Span(kind, m.start(), m.end(), 1.0) for kind, (pattern, part, least) in BASE.items() if able[kind]
            for m in pattern.finditer(text) if len(m[part]) >= least]


def _joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in order)


def summary(text: str | None) -> tuple:
    """(n_assign, n_access, n_hex, base_sha256, spans, score) of one text."""
    text = text or ""
    base = base_spans(text)
    more = lexed(text) if "=" in text or ":" in text or "</" in text else []
    n = Counter(s.kind for s in base)
    return (n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more),
            max((s.score for s in more), default=0.0))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "score"]
    for batch in batches:
        cols = list(zip(*(summary(t.as_py()) for t in batch["text"]), strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                         ["doc_id", *names])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts per base kind, base_sha256,
    spans (all kinds) and the best score of the lexer's literals."""
    schema = StructType([docs.schema["doc_id"], *(StructField(n, LongType()) for n in ("n_assign", "n_access", "n_hex")),
                         StructField("base_sha256", StringType()), StructField("spans", StringType()), StructField("score", DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)
