"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template says how each role's turn opens and closes, whether its text counts for the loss, and which role may follow
which. Turns stream through the machine in order; each gives three segments (opening, text, closing) with a loss flag of
its own. Control strings inside texts and role names are escaped reversibly, so `read_back` restores every turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodmark.llm.common import n_partitions

SEGMENTS = "conv_id long, seq long, turn_no long, segment string, text string, loss boolean, valid boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


@dataclass(frozen=True)
class Template:
    """`opens`: role to opening. `other`: opening of any further role, around its escaped name. `follows`: state to the roles
    that may come next; the state is the last accepted role, or "start". Control strings hold no backslash and don't overlap themselves."""

    opens: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### Role ", ": ")
    close: str = "</turn>\n"
    marks: tuple[str, ...] = ("### ", "</turn>")
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {"start": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})

    def escape(self, text: str) -> str:
        """A backslash is doubled; where a mark begins, one is put behind its first character."""
        return re.sub(r"\\|" + "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in self.marks), lambda m: m[0] + "\\", text)

    def escape_name(self, name: str) -> str:
        return self.escape(name).replace(self.other[1][0], self.other[1][0] + "\\")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"(.)\\", lambda m: m[1], text, flags=re.DOTALL)

    def opening(self, role: str) -> str:
        return self.opens.get(role) or self.other[0] + self.escape_name(role) + self.other[1]

    def role_at(self, text: str) -> tuple[str, int]:
        """The role whose turn opens at the start of text, and where its opening ends."""
        for role, opening in self.opens.items():
            if text.startswith(opening):
                return role, len(opening)
        head, tail = self.other
        if text.startswith(head):
            stop = re.compile(r"(?:[^\\" + re.escape(tail[0]) + r"]\\?|\\\\|" + re.escape(tail[0]) + r"\\)*?" + re.escape(tail), re.DOTALL).match(text, len(head))
            if stop:
                return self.unescape(text[len(head) : stop.end() - len(tail)]), stop.end()
        raise ValueError("no turn of this template opens here")


PLAIN = Template()


def format_turns(turns: DataFrame, template: Template = PLAIN) -> DataFrame:
    """Segments of turns (conv_id, turn, role, text) in order: conv_id, seq, turn_no, segment, text, loss, valid.

    Texts and roles that are null are empty; rows of a turn number that repeats, or is null (first), go by role and text. An
    order that the template doesn't allow is formatted all the same: from that turn on `valid` is false, and the machine goes
    on from its last accepted state. Rows without conv_id make a conversation of their own. Further columns are ignored.
    A conversation streams through one task in sorted order, of which no more than a batch is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, ok, seq, turn_no = object(), "start", True, 0, 0
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
        for b in batches:
            rows = []
            for conv_id, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
                if conv_id != conv:
                    conv, state, ok, seq, turn_no = conv_id, "start", True, 0, 0
                if role in template.follows.get(state, ()):
                    state = role
                else:
                    ok = False
                for kind, piece in (("open", template.opening(role)), ("text", template.escape(text)), ("close", template.close)):
                    rows.append((conv_id, seq, turn_no, kind, piece, kind == "text" and role in template.loss, ok))
                    seq += 1
                turn_no += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in SEGMENTS.split(", ")])

    n = n_partitions(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


class _Reader:
    """Reads one conversation back from its segments' text and loss flags; holds one turn at a time."""

    def __init__(self, template: Template):
        self.template, self.held, self.masked = template, [], []
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.valid = True

    def take(self, text: str, loss: bool, valid: bool) -> None:
        self.chars += len(text)
        self.held.append(text)
        self.valid &= valid
        if loss:
            self.masked.append(text)
        if text.endswith(self.template.close):
            self._turn()

    def _turn(self) -> None:
        whole = "".join(self.held)
        role, at = self.template.role_at(whole)
        stop = whole.index(self.template.close, at)
        if stop + len(self.template.close) != len(whole):
            raise ValueError("a turn closes before its end")
        text = self.template.unescape(whole[at:stop])
        self.turns.update(f"{role}\n{text}\n".encode())
        said = self.template.unescape("".join(self.masked))
        self.loss.update(said.encode())
        self.loss_chars += len(said)
        self.n += 1
        self.held, self.masked = [], []

    def row(self) -> tuple:
        if self.held:
            raise ValueError("a conversation ends within a turn")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_back(segments: DataFrame, template: Template = PLAIN) -> DataFrame:
    """One row for each conversation, from what `format_turns` gave, in its order: digests of the turns and of all text under
    the loss mask, both unescaped, and the length of the formatted text in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader = None, None
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            rows = []
            for conv_id, seq, text, loss, valid in zip(*[b.column(c).to_pylist() for c in ("conv_id", "seq", "text", "loss", "valid")]):
                if reader is None or seq == 0:
                    if reader is not None:
                        rows.append((conv, *reader.row()))
                    conv, reader = conv_id, _Reader(template)
                reader.take(text, loss, valid)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv, *reader.row()), kinds)], names)

    return segments.mapInArrow(run, READ)
