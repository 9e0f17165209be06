"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the marker before a turn, the one after it and whether the
turn's text is trained on; and for each state the roles that may follow. The machine walks
the turns of a conversation in order, emits text segments with their loss flags and notes the
first turn that breaks the order. Control strings inside roles and texts are broken by a
backslash after their first character (and backslashes are doubled), so that no text can
form a marker and every text is restored exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Work


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    start: str = "<s>"
    roles: dict[str, Turn] = field(default_factory=lambda: {"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[ASST]", "</s>", True)})
    #: Around the name of a role that the template doesn't know; its text ends with `other_after`.
    other_name: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    other_after: str = "[/TURN]"
    #: Roles that may follow each state; the state is the last role, or "" at the start.
    order: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: Control strings of other public templates that texts must not smuggle in either.
    guarded: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")

    def controls(self) -> list[str]:
        own = [self.start, *self.other_name, self.other_after, *(x for t in self.roles.values() for x in (t.before, t.after)), *self.guarded]
        if any(len(x) < 2 or "\\" in x for x in own) or len({self.start, *self.other_name, self.other_after, *(t.before for t in self.roles.values()), *(t.after for t in self.roles.values())}) < 4 + 2 * len(self.roles):
            raise ValueError("control strings need two characters, no backslash, and must differ")
        return sorted(set(own), key=lambda x: (-len(x), x))


class Formatter:
    def __init__(self, template: Template) -> None:
        self.template, controls = template, template.controls()
        either = "|".join(map(re.escape, controls))
        self.guard = re.compile(rf"\\|(?=(?:{either}))(.)", re.DOTALL)
        self.control = re.compile(either)
        self.firsts = {x[0] for x in controls} | {"\\"}

    def escape(self, text: str) -> str:
        if not any(x in text for x in self.firsts):
            return text
        return self.guard.sub(lambda m: m[1] + "\\" if m[1] else "\\\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\)|\\", lambda m: m[1] or "", text) if "\\" in text else text

    def turn(self, state: str | None, role: str, text: str) -> tuple[list[tuple[str, bool]], bool]:
        """The segments of a turn after the given state (None: no turn yet), and whether the order allows it."""
        t = self.template
        kind = t.roles.get(role)
        head = t.start if state is None else ""
        allowed = role in t.order.get(state or "", ())
        if kind:
            parts = [(head + kind.before, False), (self.escape(text), kind.loss), (kind.after, False)]
        else:
            parts = [(f"{head}{t.other_name[0]}{self.escape(role)}{t.other_name[1]}", False), (self.escape(text), False), (t.other_after, False)]
        return [x for x in parts if x[0]], allowed

    def parse(self, formatted: str) -> tuple[str, str]:
        """The role and text of one formatted turn (the start marker may lead)."""
        t = self.template
        at = len(t.start) if formatted.startswith(t.start) else 0
        for role, kind in t.roles.items():
            if formatted.startswith(kind.before, at):
                end = self.control.search(formatted, at + len(kind.before))
                if end and end[0] == kind.after and end.end() == len(formatted):
                    return role, self.unescape(formatted[at + len(kind.before) : end.start()])
        if formatted.startswith(t.other_name[0], at):
            close = self.control.search(formatted, at + len(t.other_name[0]))
            if close and close[0] == t.other_name[1]:
                end = self.control.search(formatted, close.end())
                if end and end[0] == t.other_after and end.end() == len(formatted):
                    return self.unescape(formatted[at + len(t.other_name[0]) : close.start()]), self.unescape(formatted[close.end() : end.start()])
        raise ValueError("not a formatted turn")


SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each turn: conv_id, place (from 0), allowed, segments (text, loss); sorted by place within its partition.

    The concatenated segment texts of a conversation's turns in order are its formatted text.
    Turns are ordered by turn (nulls first), ties by role and text. Null texts and roles count as
    empty, rows with a null conv_id form one conversation, repeated rows are turns of their own,
    unknown roles are kept with their name and not trained on, and turns out of order are kept
    with allowed = false. Turns stream through: no conversation is held as a whole.
    """
    held = template or Template()
    held.controls()
    kind = df.schema[conv_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, state, at, place = Formatter(held), None, (), 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at != (conv,):
                    at, state, place = (conv,), None, 0
                parts, allowed = form.turn(state, role, text)
                rows.append((place, allowed, [{"text": x, "loss": y} for x, y in parts]))
                state, place = role, place + 1
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], SEGMENTS)], ["conv_id", "place", "allowed", "segments"])

    empty = F.lit("")
    given = df.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text"), F.col(turn_col).alias("turn"))
    ordered = given.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").drop("turn")
    return ordered.mapInArrow(run, f"conv_id {kind.simpleString()}, place long, allowed boolean, segments array<struct<text:string,loss:boolean>>")


def read_turns(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted turns back: a row for each conversation with conv_id, n_turns, turns_sha256 (of role, newline, text, newline
    for each turn), loss_chars, loss_sha256 (of all text under the loss mask, unescaped), formatted_chars, in_order.

    Digests are carried from turn to turn, so a conversation of any length needs constant memory.
    """
    held = template or Template()
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, at, own = Formatter(held), (), None

        def done(rows: list, key_type: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(x, t or key_type) for x, t in zip(cols, types)], names)

        def row() -> tuple:
            return (*at, own[0], own[1].hexdigest(), own[2], own[3].hexdigest(), own[4], own[5])

        key_type = pa.int64()
        for batch in batches:
            rows, key_type = [], batch.column(0).type
            for conv, allowed, segments in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if at != (conv,):
                    if own:
                        rows.append(row())
                    at, own = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                whole = "".join(x["text"] for x in segments)
                role, text = form.parse(whole)
                own[0] += 1
                own[1].update(f"{role}\n{text}\n".encode())
                for x in segments:
                    if x["loss"]:
                        plain = form.unescape(x["text"])
                        own[2] += len(plain)
                        own[3].update(plain.encode())
                own[4] += len(whole)
                own[5] &= allowed
            yield done(rows, key_type)
        if own:
            yield done([row()], key_type)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "allowed", "segments")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean")


def round_trip(df: DataFrame, template: Template | None = None) -> DataFrame:
    """Formats conversations (conv_id, turn, role, text), writes the turns to the shared folder and reads them back."""
    work = Work(df.sparkSession, "chat")
    return read_turns(work.write(format_turns(df, template), "turns"), template)
