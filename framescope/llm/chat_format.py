"""Conversations as training texts, by incremental rendering with a template that is only called, never looked into.

A template renders a list of (role, text) as one string. The renderings of successive prefixes of a conversation are
compared: what the next one adds is that turn's span. Where an assistant speaks, the turn is rendered once more with a
probe in place of its text; what stands before and after the probe bounds the part of the span that carries the loss.
A template whose next rendering doesn't begin with the previous one rewrites history, and one whose turn looks
different after a stand-in for the earlier turns depends on it. Both are counted, and such conversations have no spans.

Rendering all prefixes takes the square of a conversation's length, so conversations are cut into parts: blocks of
``BLOCK`` turn numbers, rendered on their own behind the stand-in. A block is dealt out by conversation and number, so
the parts of one large conversation are made by many tasks. A block in which many rows have one turn number, or whose
texts are long, is cut further while it streams through its task.

Defined results: rows of a conversation stand by turn, then role and text; nulls come first and count as empty. Rows
that repeat are turns of their own. Null is a conversation like others. Further columns of the input, whatever their
names, aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framescope.llm.common import quoted

Turn = tuple[str, str]
#: Turn numbers of a block; turns and code points after which a part ends.
BLOCK, PART_TURNS, PART_CHARS = 64, 64, 1 << 20
PROBE = "\ue000"
ASSISTANT = "assistant"

# The control strings of the template below. Inside texts, one backslash more follows their first character.
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:INST|SYS|TURN|SAYS)\]|/?s>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:INST|SYS|TURN|SAYS)\]|/?s>)")
_MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), ASSISTANT: (" ", " </s>")}
_OTHER, _SAYS, _END = "[TURN] ", " [SAYS] ", " [/TURN]"
OPENING = "<s>"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: Sequence[Turn]) -> str:
    """A conversation with its turns marked and control strings inside texts escaped."""
    out = [OPENING]
    for role, text in turns:
        before, after = _MARKS.get(role) or (f"{_OTHER}{escape(role)}{_SAYS}", _END)
        out += (before, escape(text), after)
    return "".join(out)


def read(formatted: str) -> list[Turn]:
    """The turns of a rendered conversation or of a later part of one."""
    turns, at = [], len(OPENING) if formatted.startswith(OPENING) else 0
    while at < len(formatted):
        if formatted.startswith(_OTHER, at):
            says = formatted.index(_SAYS, at)
            role, after, start = unescape(formatted[at + len(_OTHER) : says]), _END, says + len(_SAYS)
        else:
            role = next(r for r, (before, _) in _MARKS.items() if formatted.startswith(before, at))
            after, start = _MARKS[role][1], at + len(_MARKS[role][0])
        end = formatted.index(after, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(after)
    return turns


@dataclass(frozen=True)
class Template:
    """``render`` makes a string of turns; ``read`` and ``unescape`` undo it. ``stand_in`` are turns that take the place of
    earlier ones where a conversation is cut."""

    render: Callable[[Sequence[Turn]], str] = render
    read: Callable[[str], list[Turn]] = read
    unescape: Callable[[str], str] = unescape
    stand_in: tuple[Turn, ...] = (("user", ""), (ASSISTANT, ""))


@dataclass
class Rendered:
    """A part as text, the bounds of each turn in it, those of the text under the loss (else None), and what was found."""

    text: str
    spans: list[tuple[int, int]]
    losses: list[tuple[int, int] | None]
    rewrites: int


def render_prefixes(template: Template, turns: Sequence[Turn], history: Sequence[Turn] = ()) -> Rendered:
    """Render ``turns`` one prefix longer at a time, behind ``history``, whose own rendering is left out.

    ``rewrites`` counts prefixes that the next rendering doesn't begin with, and turns in which the text can't be
    located; bounds are empty then.
    """
    messages = list(history)
    before = template.render(messages) if messages else ""
    base = len(before)
    spans: list[tuple[int, int]] = []
    losses: list[tuple[int, int] | None] = []
    rewrites = 0
    for role, text in turns:
        messages.append((role, text))
        now = template.render(messages)
        rewrites += not now.startswith(before)
        spans.append((len(before) - base, len(now) - base))
        loss = None
        if role == ASSISTANT:
            probed = template.render([*messages[:-1], (role, PROBE)])
            at = probed.find(PROBE, len(before))
            end = len(now) - (len(probed) - at - len(PROBE))
            if at < 0 or end < at or now[:at] != probed[:at] or now[end:] != probed[at + len(PROBE) :]:
                rewrites += 1
            else:
                loss = (at - base, end - base)
        losses.append(loss)
        before = now
    if rewrites:
        spans, losses = [(0, 0)] * len(turns), [None] * len(turns)
    return Rendered(before[base:], spans, losses, rewrites)


def render_part(template: Template, turns: Sequence[Turn]) -> tuple[str, Rendered]:
    """What a conversation that begins with these turns has in front of them, and their rendering as a later part."""
    whole, part = render_prefixes(template, turns), render_prefixes(template, turns, template.stand_in)
    if whole.rewrites:
        return "", whole
    if not whole.text.endswith(part.text) or part.rewrites:  # the turns look different behind other turns
        return "", Rendered(whole.text, [(0, 0)] * len(turns), [None] * len(turns), 1)
    return whole.text[: len(whole.text) - len(part.text)], part


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
PART_FIELDS = [
    T.StructField("block", T.LongType()),
    T.StructField("part", T.LongType()),
    T.StructField("whole", T.BooleanType()),
    T.StructField("opening", T.StringType()),
    T.StructField("formatted", T.StringType()),
    T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("losses", T.ArrayType(_SPAN)),
    T.StructField("rewrites", T.LongType()),
]


def _streamed(df: DataFrame, key: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[Iterator[tuple]], Iterable[tuple]]], limit: int = 4 << 20) -> DataFrame:
    """``key`` and new fields: a function of all rows of a partition, one at a time, gives tuples that begin with the key."""
    schema = T.StructType([df.schema[key], *fields])
    kinds = [to_arrow_type(f.dataType) for f in schema]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for k in range(0, len(b), 512) for row in zip(*(c.to_pylist() for c in b.slice(k, 512).columns), strict=True))
        out: list[tuple] = []
        size = 0
        for made in make()(rows):
            out.append(made)
            size += 64 + sum(len(v) for v in made if isinstance(v, (str, list)))
            if size > limit:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return df.mapInArrow(run, schema)


def format_conversations(df: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Parts of conversations as text, in the order of ``block`` and ``part``.

    ``whole`` says that there is no other part. A training text is the first part's ``opening`` followed by the
    ``formatted`` of all parts. ``spans`` and ``losses`` hold the bounds of the turns, and of the assistants' texts, in
    ``formatted``; both are zero and empty where the template ``rewrites`` history.
    """
    number = F.coalesce(F.floor(quoted(turn_col).cast("long") / block), F.lit(0)).cast("long")
    rows = df.select(
        quoted(conv_col).alias("conv"),
        number.alias("block"),
        F.lit(False).alias("mark"),
        quoted(turn_col).cast("long").alias("turn"),
        quoted(role_col).cast("string").alias("role"),
        quoted(text_col).cast("string").alias("text"),
    )
    # Block 0 learns from a row without a text that its conversation has other blocks.
    marks = rows.where("block <> 0").groupBy("conv").agg(F.lit(0).cast("long").alias("block"), F.lit(True).alias("mark"))
    order = ("conv", "block", "mark", "turn", "role", "text")
    dealt = rows.unionByName(marks, allowMissingColumns=True).select(*order).repartition("conv", "block").sortWithinPartitions("conv", "block", F.desc("mark"), "turn", "role", "text")

    def make():
        def parts(rows: Iterator[tuple]) -> Iterator[tuple]:
            key: Any = None
            more, place, turns, size = False, 0, [], 0

            def done(last: bool) -> tuple:
                opening, made = render_part(template, turns)
                losses = [{"start": x[0], "end": x[1]} for x in made.losses if x]
                spans = [{"start": a, "end": b} for a, b in made.spans]
                return (*key, place, last and not more and place == 0, opening, made.text, spans, losses, made.rewrites)

            for conv, number, mark, _, role, text in rows:
                if (conv, number) != key:
                    if turns:
                        yield done(True)
                    key, more, place, turns, size = (conv, number), number != 0, 0, [], 0
                if mark:
                    more = True
                    continue
                if turns and (len(turns) == PART_TURNS or size + len(text or "") > PART_CHARS):
                    yield done(False)
                    place, turns, size = place + 1, [], 0
                turns.append((role or "", text or ""))
                size += len(text or "")
            if turns:
                yield done(True)

        return parts

    return _streamed(dealt, "conv", PART_FIELDS, make).withColumnRenamed("conv", conv_col)


DIGEST_FIELDS = [
    T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()),
    T.StructField("formatted_chars", T.LongType()),
    T.StructField("rewrites", T.LongType()),
]


class Digest:
    """What formatted parts hold, read back from them in order."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.rewrites = 0

    def add(self, template: Template, opening: str, formatted: str, losses: list[dict], rewrites: int) -> None:
        for role, text in template.read(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in losses:
            text = template.unescape(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.chars += len(opening) + len(formatted)
        self.rewrites += rewrites

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites


def read_back(parts: DataFrame, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation: counts and digests of its turns and of the text under the loss, from the formatted parts.

    Whole conversations are read where they are; only the parts of others are brought together, and streamed.
    """
    fields = [T.StructField("block", T.LongType()), T.StructField("part", T.LongType()), *DIGEST_FIELDS, *PART_FIELDS[3:5], *PART_FIELDS[6:]]
    fields[-1] = T.StructField("part_rewrites", T.LongType())
    nothing = (None,) * len(DIGEST_FIELDS)

    def alone():
        def rows(parts: Iterator[tuple]) -> Iterator[tuple]:
            for conv, block, part, whole, opening, formatted, _, losses, rewrites in parts:
                if whole:
                    digest = Digest()
                    digest.add(template, opening, formatted, losses, rewrites)
                    yield (conv, block, part, *digest.row(), None, None, None, None)
                else:
                    yield (conv, block, part, *nothing, opening, formatted, losses, rewrites)

        return rows

    def together():
        def rows(read: Iterator[tuple]) -> Iterator[tuple]:
            key: Any = ()
            digest = None
            for conv, _, _, *made in read:
                if digest is not None and conv != key:
                    yield (key, *digest.row())
                    digest = None
                if made[0] is not None:
                    yield (conv, *made[: len(DIGEST_FIELDS)])
                    continue
                opening, formatted, losses, rewrites = made[len(DIGEST_FIELDS) :]
                first = digest is None
                if first:
                    key, digest = conv, Digest()
                digest.add(template, opening if first else "", formatted, losses, rewrites)
            if digest is not None:
                yield (key, *digest.row())

        return rows

    parts = parts.select(quoted(conv_col).alias("conv"), *(f.name for f in PART_FIELDS))
    dealt = _streamed(parts, "conv", fields, alone).repartition("conv").sortWithinPartitions("conv", "block", "part")
    return _streamed(dealt, "conv", DIGEST_FIELDS, together).withColumnRenamed("conv", conv_col)


def with_control_strings(df: DataFrame, conv: Column, text: str) -> DataFrame:
    """The four columns with one conversation more, in which a user and an assistant say ``text``."""
    more = df.sparkSession.range(2).select(conv.cast(df.schema["conv_id"].dataType).alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit(ASSISTANT)), (F.col("id") + 1).cast("int")).alias("role"), F.lit(text).alias("text"))
    return df.select("conv_id", "turn", "role", "text").unionByName(more)
