"""Chat formatting by a finite-state machine over roles.

A template is data: what opens and closes a role's turn, which roles are learnt,
and the machine's steps (state, role, what is put before the turn). The machine
reads the roles of a conversation in order. A role that has no step from the
current state is a fault: its turn is marked, formatted all the same, and the
machine goes on from that role.

Texts may hold the template's own control strings. Each gets one more backslash
after its first character, however many it has, so that what is read back is the
text again and no text can open or close a turn.

Rows are dealt to ranges of (conversation, turn), so that a conversation of any
length is formatted by many tasks. A range's first row takes its state from the
last row of the range before: a table of one row a range.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.ordered import in_order, range_of
from lectern.storage import written

#: The state before the first turn; no role is named so.
START = "\0start"


@dataclass(frozen=True)
class Turn:
    """How the turns of a role read: open, a space, the text, a space, close. learn: the text is under the loss mask."""

    open: str
    close: str
    learn: bool = False


@dataclass(frozen=True)
class Template:
    """turns by role; named: for all other roles, whose name stands between its open and close before the turn;
    steps: (state, role) to what is put before the turn. A state is START or the role read last."""

    turns: dict[str, Turn]
    named: Turn
    other: Turn
    steps: dict[tuple[str, str], str]
    first: str

    @cached_property
    def controls(self) -> tuple[str, ...]:
        """All control strings: a bracket, characters that are neither brackets nor white space nor backslashes."""
        marks = {m for t in [*self.turns.values(), self.named, self.other] for m in (t.open, t.close)}
        marks |= {self.first, *self.steps.values()} - {""}
        if bad := [m for m in marks if not re.fullmatch(r"[<\[][^<\[\s\\]+", m)]:
            raise ValueError(f"no control strings: {bad}")
        return tuple(sorted(marks))

    def pattern(self, slashes: str) -> str:
        """A control string with so many backslashes after its first character, by the two groups before its rest."""
        rest = "|".join(sorted({re.escape(m[1:]) for m in self.controls}))
        return rf"([<\[])({slashes})(?={rest})"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(r"\\*+"), r"$1$2\\")

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern(r"\\+"), lambda m: m[1] + m[2][1:], text)


TEMPLATE = Template(
    turns={"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[ANS]", "</s>", learn=True)},
    named=Turn("[ROLE]", "[/ROLE]"),
    other=Turn("[TURN]", "[/TURN]"),
    first="<s>",
    steps={(START, "system"): "<s>", (START, "user"): "<s>", ("system", "user"): "", ("user", "assistant"): "", ("assistant", "user"): ""},
)


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order with ``state``: the role read last in the same conversation, START for its first row; null for a
    range's first row."""
    last: tuple | None = None
    for b in batches:
        states = []
        for row in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), strict=True):
            states.append(None if last is None else last[1] if last[0] == row[0] else START)
            last = row
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(states, pa.string())], names=[*b.schema.names, "state"])


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, at, role, state, valid and segments of every turn of ``conversations`` (conv_id, turn, role, text).

    at rises with conv_id and a conversation's turns, in the order of turn, null first; turns with the same number are
    ordered by role, then by a hash of the text. segments is an array of (text, learn), to be joined without anything
    between; the texts of learnt roles are segments of their own. state is the machine's before the turn, valid whether
    it has a step for the role. Null roles and texts are empty; an empty role is one that the template doesn't name. Rows
    without a conv_id are one conversation, the first. Repeated rows are turns of their own. Other columns are ignored;
    an empty table gives no rows. Texts are taken whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.xxhash64(text).alias("tie"),
        text.alias("text"),
    )
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"))
    ordered = in_order(rows, *order, name="chat-rows", then=(_states, "state string"))
    # the state at a range's first row: its own conversation may have begun before
    ends = ordered.groupBy(range_of(F.col("at")).alias("_range")).agg(F.max_by(F.struct("conv_id", "role"), "at").alias("_last"))
    before = ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_last"))
    before = before.select(F.col("_range"), F.col("_last.conv_id").alias("_conv"), F.col("_last.role").alias("_role"))
    joined = ordered.join(F.broadcast(before), F.col("state").isNull() & (range_of(F.col("at")) == F.col("_range")), "left")
    same = F.col("_role").isNotNull() & F.col("conv_id").eqNullSafe(F.col("_conv"))
    placed = joined.withColumn("state", F.coalesce("state", F.when(same, F.col("_role")).otherwise(F.lit(START))))
    steps = F.create_map(*[F.lit(x) for (s, r), before in template.steps.items() for x in (f"{s}\0{r}", before)])
    step = F.try_element_at(steps, F.concat("state", F.lit("\0"), "role"))
    lead = F.coalesce(step, F.when(F.col("state") == START, F.lit(template.first)).otherwise(F.lit("")))
    body = template.escaped(F.col("text"))
    role = F.col("role")
    segment = lambda x, learn: F.struct(x.alias("text"), F.lit(learn).alias("learn"))
    turn = lambda head, t: F.array(
        segment(F.concat(lead, head, F.lit(f"{t.open} ")), False), segment(body, t.learn), segment(F.lit(f" {t.close}"), False)
    )
    name = F.concat(F.lit(f"{template.named.open} "), template.escaped(role), F.lit(f" {template.named.close} "))
    segments = F.when(F.lit(False), turn(F.lit(""), template.other))
    for r, t in template.turns.items():
        segments = segments.when(role == r, turn(F.lit(""), t))
    return placed.select("conv_id", "at", "role", "state", step.isNotNull().alias("valid"), segments.otherwise(turn(name, template.other)).alias("segments"))


def read_turn(formatted: str, template: Template = TEMPLATE) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head = "|".join(re.escape(x) for x in {template.first, *template.steps.values()} - {""})
    rest = re.match(f"(?:{head})?", formatted).end()
    for role, t in template.turns.items():
        if formatted.startswith(f"{t.open} ", rest) and formatted.endswith(f" {t.close}"):
            return role, template.unescape(formatted[rest + len(t.open) + 1 : -len(t.close) - 1])
    n, t = template.named, template.other
    between = f" {n.close} {t.open} "
    if not formatted.startswith(f"{n.open} ", rest) or not formatted.endswith(f" {t.close}") or (at := formatted.find(between, rest)) < 0:
        raise ValueError(f"no turn of the template: {formatted[:60]!r}")
    return template.unescape(formatted[rest + len(n.open) + 1 : at]), template.unescape(formatted[at + len(between) : -len(t.close) - 1])


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_faults long"


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """What the output of format_conversations says of each conversation, read from its segments alone.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars and loss_sha256 (the texts
    under the loss mask, unescaped), formatted_chars, n_faults. A digest is taken turn by turn, so a conversation streams
    past one task, which keeps the hash's state and one batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Read | None = None
        for b in batches:
            out = []
            for conv, valid, segments in zip(*(b.column(c).to_pylist() for c in ("conv_id", "valid", "segments")), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Read(conv)
                now.add([(s["text"], s["learn"]) for s in segments], valid, template)
            if out:
                yield _batch(out)
        if now is not None:
            yield _batch([now.row()])

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, READ)


class _Read:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.chars, self.loss_chars, self.faults = conv_id, 0, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segments: list[tuple[str, bool]], valid: bool, template: Template) -> None:
        whole = "".join(t for t, _ in segments)
        role, text = read_turn(whole, template)
        self.n += 1
        self.chars += len(whole)
        self.faults += not valid
        self.turns.update(f"{role}\n{text}\n".encode())
        for t, learn in segments:
            if learn:
                learnt = template.unescape(t)
                self.loss_chars += len(learnt)
                self.loss.update(learnt.encode())

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.faults


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
