r"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads the turns of a conversation in order, checks each role against
the states it may follow, and emits text segments with a loss flag: opening mark,
text, closing mark. Only texts of trained roles carry loss. Marks are control
strings that cannot stand inside a text: escaping doubles each backslash and puts
one after the first character of every control string, and dropping each
backslash before any character undoes that. ``Reader`` rebuilds turns and loss
text from segments alone.

Scale: one shuffle on the conversation, sorted by turn; machine and reader then
stream over the sorted rows and hold one turn at a time, so a conversation of any
length needs no more memory than its longest turn.

Defined results: null text and null role count as empty; turns with equal numbers
are ordered by role and text, nulls first, and repeated rows are turns of their
own; the null conversation is a conversation; roles without marks of their own
carry their name inside the generic marks; a conversation that breaks the order
is formatted in full and reported, with the first fault; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Template:
    """Marks (opening, closing) per role, the marks of any other role, the roles
    that are trained on, and the machine: which roles may follow which state."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<<TURN>>", "<<TEXT>>", "<</TURN>>")
    trained: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "start": frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        """Control strings: all marks without surrounding white space."""
        return sorted({m.strip() for pair in [*self.marks.values(), self.other] for m in pair}, key=lambda m: (-len(m), m))


class Escaper:
    def __init__(self, template: Template):
        self._find = re.compile("|".join(map(re.escape, template.controls())))

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        return self._find.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


class Machine:
    """Segments of one conversation, turn by turn."""

    def __init__(self, template: Template):
        self.template, self.escaper = template, Escaper(template)
        self.state, self.turn, self.fault = template.start, 0, None

    def feed(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        role, text, t = role or "", text or "", self.template
        if self.fault is None and role not in t.follows.get(self.state, ()):
            self.fault = f"turn {self.turn}: {role} after {self.state}"
        self.state, self.turn = role, self.turn + 1
        body = self.escaper.escape(text)
        if role in t.marks:
            before, after = t.marks[role]
        else:
            before, after = t.other[0] + self.escaper.escape(role) + t.other[1], t.other[2]
        return [(before, False), (body, role in t.trained), (after, False)]

    def end(self) -> str | None:
        """The first fault of the conversation, if any."""
        if self.fault is None and self.state not in self.template.ends:
            self.fault = f"ends after {self.state}"
        return self.fault


class Reader:
    """Reads segments back: whole turns from the text, and the text under loss."""

    def __init__(self, template: Template):
        self.template, self.buffer = template, ""
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = Escaper.unescape(text)
            self.loss_chars += len(plain)
            self.loss_hash.update(plain.encode())
        self.buffer += text
        while (found := self._turn()) is not None:
            role, body, size = found
            self.buffer = self.buffer[size:]
            self.turns += 1
            self.turns_hash.update(f"{role}\n{body}\n".encode())

    def _turn(self) -> tuple[str, str, int] | None:
        for role, (before, after) in self.template.marks.items():
            if self.buffer.startswith(before):
                end = self.buffer.find(after, len(before))
                return None if end < 0 else (role, Escaper.unescape(self.buffer[len(before):end]), end + len(after))
        opening, middle, closing = self.template.other
        if self.buffer.startswith(opening):
            end = self.buffer.find(closing, len(opening))
            if end >= 0:
                cut = self.buffer.index(middle, len(opening))
                return (Escaper.unescape(self.buffer[len(opening):cut]),
                        Escaper.unescape(self.buffer[cut + len(middle):end]), end + len(closing))
        return None


def _segments(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, current, number = None, None, 0
        kind = pa.int64()
        rows: list[tuple] = []

        def finish() -> None:
            rows.append((current, number, "", False, True, machine.end()))

        def flush() -> pa.RecordBatch:
            names = ["conv_id", "segment", "text", "loss", "last", "fault"]
            types = [kind, pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if machine is None or conv != current:
                    if machine is not None:
                        finish()
                    machine, current, number = Machine(template), conv, 0
                for piece, loss in machine.feed(role, text):
                    rows.append((conv, number, piece, loss, False, None))
                    number += 1
            yield flush()
        if machine is not None:
            finish()
            yield flush()
    return run


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, segment, text, loss, last, fault): the formatted text is the
    texts of a conversation in order of ``segment``; its ``last`` row is empty
    and carries the order's first fault (null if the order is right)."""
    out = StructType([StructField("conv_id", turns.schema["conv_id"].dataType), StructField("segment", LongType()),
                      StructField("text", StringType()), StructField("loss", BooleanType()),
                      StructField("last", BooleanType()), StructField("fault", StringType())])
    return (turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "text").mapInArrow(_segments(template or Template()), out))


def _digests(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(template)
        for batch in batches:
            out: list[tuple] = []
            for conv, text, loss, last, fault in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "loss", "last", "fault")), strict=True):
                reader.feed(text, loss)
                if last:
                    if reader.buffer:
                        raise ValueError(f"conversation {conv}: the formatted text does not read back")
                    out.append((conv, reader.turns, reader.turns_hash.hexdigest(), reader.loss_chars,
                                reader.loss_hash.hexdigest(), reader.chars, fault is None, fault))
                    reader = Reader(template)
            if out:
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "fault"]
                types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    return run


def read_back(segs: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation what its segments hold: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, valid, fault. ``segs`` must come
    straight from ``segments`` (each conversation together and in order)."""
    out = StructType([segs.schema["conv_id"], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
                      StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()),
                      StructField("formatted_chars", LongType()), StructField("valid", BooleanType()), StructField("fault", StringType())])
    return segs.mapInArrow(_digests(template or Template()), out)


def formatted(segs: DataFrame) -> DataFrame:
    """(conv_id, text): whole formatted conversations, for export."""
    return (segs.groupBy("conv_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda s: s["text"]), "").alias("text")))
