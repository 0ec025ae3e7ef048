"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role what stands before and after its text and
whether its text is under the loss mask.  The machine walks the turns of a
conversation: a transition it does not have marks the conversation as out of
order, and each turn emits segments of text with a flag for the loss.  Control
strings inside a text are escaped, so that the output reads back as it went in.

Rows are partitioned by conversation and sorted by turn within their partition,
then stream through: one turn at a time is in memory, however long a conversation
is.  Reading back streams the segments the same way.

Defined results: null text counts as empty; a null role is the role ``""``; a null
turn comes first; a conversation out of order is kept and marked, not left out, so that
the caller decides; rows of equal turn go by role, then text; a null conversation id
is a conversation of its own; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workers


class Role(NamedTuple):
    """Marks around a role's text; ``loss``: whether the text is trained on."""

    before: str
    after: str
    loss: bool = False


#: Roles by name; the empty one that stands for any other gives the name itself.
TEMPLATE: dict[str, Role] = {
    "system": Role("<<SYS>>\n", "\n<</SYS>>\n\n"),
    "user": Role("[INST] ", " [/INST]"),
    "assistant": Role(" ", " </s>", True),
}
OTHER = Role("[ROLE]", "[/ROLE]")
NAME_END = "[:]"
#: From what was last to what may come; None is the start.
TRANSITIONS: dict[str | None, tuple[str, ...]] = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "</s>", "<s>", "[ROLE]", "[/ROLE]", NAME_END)
_ESCAPED = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_UNESCAPED = re.compile(r"\\(.)", re.S)
_CODES = {"\\": "\\", **{c: chr(97 + i) for i, c in enumerate(CONTROL)}}
_STRINGS = {v: k for k, v in _CODES.items()}
SEGMENTS = "conv_id long, turn_no long, segment int, text string, loss boolean, in_order boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


def escape(text: str) -> str:
    """``text`` without any control string: each becomes a backslash and a letter."""
    return _ESCAPED.sub(lambda m: "\\" + _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: _STRINGS[m[1]], text)


def segments_of(role: str, text: str) -> list[tuple[str, bool]]:
    """A turn's segments: text and whether it is under the loss mask."""
    if role in TEMPLATE:
        r = TEMPLATE[role]
        return [(r.before, False), (escape(text), r.loss), (r.after, False)]
    return [(OTHER.before + escape(role) + NAME_END, False), (escape(text), False), (OTHER.after, False)]


class Machine:
    """The state of one conversation: ``step`` returns whether all is in order so far."""

    def __init__(self) -> None:
        self.last: str | None = None
        self.in_order = True

    def step(self, role: str) -> bool:
        self.in_order &= role in TRANSITIONS.get(self.last, ())
        self.last = role
        return self.in_order


class Reader:
    """Reads formatted text, fed in any pieces, back into turns.

    A piece is text and its flag.  What is not yet a whole turn waits.
    """

    def __init__(self) -> None:
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.waiting: list[str] = []
        self.closing = ""
        self.masked: list[str] = []

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        self.waiting.append(text)
        if loss:
            self.masked.append(text)
        elif any(text.endswith(r.after) for r in (*TEMPLATE.values(), OTHER)):
            self._turn()

    def _turn(self) -> None:
        """Reads whole turns off what waits."""
        text = "".join(self.waiting)
        at = 0
        while at < len(text):
            role, start, end, after = self._next(text, at)
            if end < 0:
                break
            self.turns += 1
            self.all.update(f"{role}\n{unescape(text[start:end])}\n".encode("utf-8", "surrogatepass"))
            at = end + len(after)
        self.waiting = [text[at:]] if at < len(text) else []
        if at:
            plain = unescape("".join(self.masked))
            self.masked = []
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))

    @staticmethod
    def _next(text: str, at: int) -> tuple[str, int, int, str]:
        if text.startswith(OTHER.before, at):
            named = text.find(NAME_END, at)
            start = named + len(NAME_END)
            return unescape(text[at + len(OTHER.before) : named]), start, text.find(OTHER.after, start) if named >= 0 else -1, OTHER.after
        for role, r in TEMPLATE.items():
            if text.startswith(r.before, at):
                start = at + len(r.before)
                return role, start, text.find(r.after, start), r.after
        return "", at, -1, ""


def _streamed(df: DataFrame, order: list) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def formatted(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to segments in order: ``SEGMENTS``."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    workers.ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine, n = object(), Machine(), 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != now:
                    now, machine, n = conv, Machine(), 0
                ok = machine.step(role)
                out += [(conv, n, k, s, loss, ok) for k, (s, loss) in enumerate(segments_of(role, text))]
                n += 1
            yield _batch(out, [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_())])

    return _streamed(rows, [F.col("turn").asc_nulls_first(), "role", "text"]).mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Segments to one row a conversation: ``READ``."""

    workers.ship(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, ok = None, None, True
        fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("in_order", pa.bool_())]

        def row() -> tuple:
            if reader.waiting:
                raise ValueError(f"conversation {now}: the formatted text does not end with a whole turn")
            return (now, reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars, ok)

        for batch in batches:
            out = []
            for conv, text, loss, good in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append(row())
                    now, reader = conv, Reader()
                reader.feed(text, loss)
                ok = good
            yield _batch(out, fields)
        if reader is not None:
            yield _batch([row()], fields)

    return _streamed(segments, ["turn_no", "segment"]).mapInArrow(run, READ)


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))
