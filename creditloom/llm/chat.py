r"""Conversations as training windows of a token budget.

A conversation's turns are added up; a window takes whole turns while the sum
stays within the budget. A window after the first repeats the conversation's
system turn, the first one if there are several, wherever it stood, and then the
last turns of the window before, up to a budget of their own. Only assistant turns that a window has for the first time
carry the loss: repeated ones are masked, so each is learnt once.

    system     <<SYS>>text<</SYS>>
    user       <s>[INST] text [/INST]
    assistant   text </s>
    any other  <|role:name|>text<|/role|>

Texts and names are escaped so that they hold no `<` and no `[`: `\l` stands for
`<`, `\b` for `[`, `\\` for `\`, and in names `\p` for `|`. No control string can occur in a text, and
reading a window back gives the turns as they were.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parts import slices

BUDGET, HISTORY = 1024, 256  # tokens of a window, and of the turns it repeats
TURN_TOKENS = 4  # of the marks around a turn
WINDOWS_PER_BATCH = 200
OWN_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
NO_ROLE = "<|norole|>"

# Texts hold no "<", so the next mark that closes a turn is its own.
_TURN = re.compile(
    r"<<SYS>>(?P<system>[^<]*)<</SYS>>|<s>\[INST\] (?P<user>[^<\[]*) \[/INST\]|<\|role:(?P<role>[^<]*?)\|>(?P<other>[^<]*)<\|/role\|>"
    r"|<\|norole\|>(?P<none>[^<]*)<\|/role\|>| (?P<assistant>[^<\[]*) </s>")
_ESCAPES = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\p": "|"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lbp]", lambda m: _ESCAPES[m[0]], text)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """(turn as written, start and end of the escaped text inside it)."""
    if role in OWN_MARKS:
        opening, closing = OWN_MARKS[role]
    else:
        # A name may not hold what ends it either.
        opening = NO_ROLE if role is None else "<|role:" + escape(role).replace("|", "\\p") + "|>"
        closing = "<|/role|>"
    inside = escape(text)
    return opening + inside + closing, len(opening), len(opening) + len(inside)


def parse(written: str) -> Iterator[tuple[str | None, str, int, int]]:
    """(role, text, start and end of the escaped text) of every turn of a window."""
    at = 0
    while at < len(written):
        match = _TURN.match(written, at)
        if match is None:
            raise ValueError(f"no turn at {at}")
        kind = match.lastgroup if match.lastgroup != "role" else "other"
        if kind == "other":
            role = unescape(match["role"])
        else:
            role = None if kind == "none" else kind
        yield role, unescape(match[kind]), match.start(kind), match.end(kind)
        at = match.end()


class _Conversation:
    """Windows of one conversation, turn by turn; holds one window at a time."""

    def __init__(self, key: int | None, budget: int, history: int):
        self.key, self.budget, self.history = key, budget, history
        self.number, self.system = 0, None
        self.open: list[tuple[str | None, str, int]] = []  # turns of the window that are new
        self.repeated: list[tuple[str | None, str, int]] = []
        self.used = 0

    def add(self, role: str | None, text: str, tokens: int) -> Iterator[tuple]:
        turn = (role, text, tokens)
        if self.open and self.used + tokens > self.budget:
            yield self.close()
            self._carry(tokens)
        if self.system is None and role == "system":
            self.system = turn
        self.open.append(turn)
        self.used += tokens

    def _carry(self, coming: int) -> None:
        """What the next window repeats: the system turn and the last turns that fit."""
        system = [self.system] if self.system else []
        room = min(self.history, self.budget - coming - sum(t[2] for t in system))
        turns, kept = [*self.repeated, *self.open], []
        for turn in reversed(turns):
            if turn is self.system:
                continue
            if turn[2] > room:
                break
            kept.append(turn)
            room -= turn[2]
        self.repeated, self.open = [*system, *reversed(kept)], []
        self.used = sum(t[2] for t in self.repeated)

    def close(self) -> tuple:
        parts, spans, at = [], [], 0
        for new, turns in ((False, self.repeated), (True, self.open)):
            if new:
                first = at
            for role, text, _ in turns:
                written, start, end = render(role, text)
                if new and role == "assistant":
                    spans.append((at + start, at + end))
                parts.append(written)
                at += len(written)
        row = (self.key, self.number, "".join(parts), first, [s for s, _ in spans], [e for _, e in spans],
               self.used, self.used > self.budget)
        self.number += 1
        return row


SCHEMA = ("conv_id long, window int, formatted string, new_from int, loss_starts array<int>, loss_ends array<int>, "
          "tokens long, over_budget boolean")
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.bool_()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def windows(
    turns: DataFrame, counter: Callable[[], Callable[[list[str]], list[int]]], budget: int = BUDGET, history: int = HISTORY, *,
    key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, window, formatted, new_from, loss_starts, loss_ends, tokens, over_budget).

    `counter()` is called in the task and gives a function from texts to token
    counts. Positions are in code points of `formatted`; what comes before
    `new_from` is repeated. A turn over the budget has a window of its own,
    marked; no text is cut. Null texts are empty; a null role has a mark of its
    own; null keys are one conversation; a null turn number comes first; rows with
    equal numbers are ordered by role, then text. Other columns are not looked at.

    Tokens are counted where the turns are. Then turns are dealt by conversation
    and streamed in order: a task holds one window, however long the conversation is.
    """

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter()
        for batch in batches:
            yield pa.array([n for texts in slices(batch) for n in count([t or "" for t in texts])], pa.int64())

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 2, 3, 4)]
            for k, r, t, n in zip(*columns):
                if current is None or current.key != k:
                    if current is not None:
                        held.append(current.close())
                    current = _Conversation(k, budget, history)
                held += current.add(r, t or "", n + TURN_TOKENS)
                if len(held) >= WINDOWS_PER_BATCH:
                    yield _batch(held, names, _KINDS)
                    held = []
        if current is not None:
            held.append(current.close())
        if held:
            yield _batch(held, names, _KINDS)

    rows = turns.select(F.col(key).cast("long").alias("k"), F.col(turn).alias("n"), F.col(role).alias("r"), F.col(text).alias("t"))
    rows = rows.withColumn("c", tokens(F.col("t")))
    return rows.repartition("k").sortWithinPartitions("k", "n", "r", "t").mapInArrow(form, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) from windows.

    `turns_sha256` is over role, newline, text, newline of each turn, once;
    `loss_sha256` over the unescaped text under the loss mask. Both are running
    digests over the windows in order, so a task holds one window.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def told(key, n_turns, turns, loss_chars, loss, chars, n_windows) -> tuple:
        return key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for key, _, written, new_from, starts, ends in zip(*columns):
                if state is None or state[0] != key:
                    if state is not None:
                        held.append(told(*state))
                    state = [key, 0, sha256(), 0, sha256(), 0, 0]
                for role, content, start, _ in parse(written):
                    if start >= new_from:
                        state[1] += 1
                        state[2].update(f"{role or ''}\n{content}\n".encode())
                for start, end in zip(starts, ends):
                    target = unescape(written[start:end])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(written)
                state[6] += 1
                if len(held) >= 10_000:
                    yield _batch(held, names, kinds)
                    held = []
        if state is not None:
            held.append(told(*state))
        if held:
            yield _batch(held, names, kinds)

    rows = formatted.select("conv_id", "window", "formatted", "new_from", "loss_starts", "loss_ends")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def loss_text(formatted: Column, starts: Column, ends: Column) -> Column:
    """The escaped texts under the loss mask of a window."""
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.substring(formatted, z["s"] + 1, z["e"] - z["s"]))
