"""Chat windows under a token budget.

A conversation's turns are laid out in windows that begin and end at turns: prefix sums of the turns' tokens choose the
longest span that fits beside the system turn and the repeated history. Every window starts with the system turn (if the
first turn is one), then up to ``history_turns`` turns before its span as far as ``history_tokens`` allow, then the span.
Loss falls on assistant texts of the span alone, so a repeated target is masked and each text is learnt once. A turn
that exceeds the budget alone gets a window of its own, whole.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts get a zero-width space after their first
character; where such spaces already stand, one more is put in, so undoing it is exact. Roles escape ``\\`` and line
breaks.

Turns arrive sorted and are formatted as a stream, so a task holds one window, however long the conversation is. Order:
turn, role, text; nulls first. Null texts and roles are empty, a null conv_id is a conversation of its own, repeated
rows are turns of their own, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.rows import record
from opslens.llm.tokens import worker_cache

# Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>")
START, END, SPACE = "<|im_start|>", "<|im_end|>", "​"
FOUND = re.compile("|".join(f"{re.escape(c[0])}{SPACE}*{re.escape(c[1:])}" for c in CONTROL))
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
WINDOWS = ("conv_id long, window long, text string, n_repeated int, n_tokens long, "
           "loss array<struct<start:long,end:long>>")
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int32()),
                   ("n_tokens", pa.int64()), ("loss", pa.list_(SPAN))])
DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "n_windows long")


def escape(text: str) -> str:
    return FOUND.sub(lambda m: m[0][0] + SPACE + m[0][1:], text)


def unescape(text: str) -> str:
    return FOUND.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == SPACE else m[0], text)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text lies in it."""
    head = START + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def role_text(head: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head))


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    return [(role_text(m[1]), unescape(m[2])) for m in TURN.finditer(text)]


class Layout:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv, budget: int, history_turns: int, history_tokens: int):
        self.conv, self.budget, self.most, self.history_tokens = conv, budget, history_turns, history_tokens
        self.system, self.past, self.span, self.seen, self.window = None, [], [], 0, 0

    def _held(self) -> int:
        """Tokens of the system turn and the history that the open window repeats."""
        return (self.system[3] if self.system else 0) + sum(t[3] for t in self.past)

    def add(self, role: str, text: str, tokens: int):
        """Takes a turn; gives back the window it closes, if any."""
        turn, done = (role, text, tokens, tokens), None
        self.seen += 1
        if self.seen == 1 and role == "system":
            self.system = turn
            return None
        if self.span and self._held() + sum(t[3] for t in self.span) + tokens > self.budget:
            done = self.close()
        if not self.span:  # the history gives way to the first turn of a span
            while self.past and self._held() + tokens > self.budget:
                self.past.pop(0)
        self.span.append(turn)
        return done

    def close(self):
        """The open window as a row; what it leaves as history follows."""
        if not self.span and (self.window or not self.system):
            return None
        first = self.window == 0
        repeated = ([self.system] if self.system and not first else []) + self.past
        fresh = ([self.system] if self.system and first else []) + self.span
        if first and self.system:
            repeated = []  # nothing is repeated in the first window: no history, and the system turn is new
        parts, loss, at = [], [], 0
        for k, (role, text, _, _) in enumerate([*repeated, *fresh]):
            body, lo, hi = turn_text(role, text)
            if role == "assistant" and k >= len(repeated):
                loss.append({"start": at + lo, "end": at + hi})
            parts.append(body)
            at += len(body)
        row = (self.conv, self.window, "".join(parts), len(repeated), sum(t[3] for t in [*repeated, *fresh]), loss)
        self.past, room = [], self.history_tokens
        for turn in reversed(self.span[-self.most:] if self.most else []):
            if turn[3] > room:
                break
            self.past.insert(0, turn)
            room -= turn[3]
        self.span, self.window = [], self.window + 1
        return row


def windows(conversations: DataFrame, *, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256,
            turn_overhead: int = 4, vocabulary: str | None = None) -> DataFrame:
    """One row per window; the rows of a conversation follow each other in one partition."""

    def run(batches):
        cache, layout, out, size = worker_cache(vocabulary), None, [], 0

        def rows():
            nonlocal out, size
            made = record({f.name: [r[i] for r in out] for i, f in enumerate(ARROW)}, ARROW)
            out, size = [], 0
            return made

        def keep(row):
            nonlocal size
            if row:
                out.append(row)
                size += len(row[2])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if layout is None or layout.conv != conv:
                    if layout:
                        keep(layout.close())
                    layout = Layout(conv, budget, history_turns, history_tokens)
                keep(layout.add(role, text, len(cache.ids(text)) // 4 + turn_overhead))
                if size > 1 << 20:
                    yield rows()
        if layout:
            keep(layout.close())
        if out:
            yield rows()

    empty = F.lit("")
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                 F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, WINDOWS)


def digest(formatted: DataFrame) -> DataFrame:
    """What each conversation's windows hold, read back from their text and loss spans. Keeps their order."""

    def run(batches):
        conv, state, out = object(), None, []

        def row():
            n, turns, chars, loss, size, wins = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, wins

        def rows():
            made = pa.RecordBatch.from_arrays([
                pa.array([r[i] for r in out], pa.string() if i in (2, 4) else pa.int64()) for i in range(7)
            ], names=[x.split()[0] for x in DIGEST.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for of, text, skip, loss in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 5))):
                if state is None or of != conv:
                    if state:
                        out.append(row())
                    conv, state = of, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, body in turns_of(text)[skip:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for s in loss:
                    target = unescape(text[s["start"]:s["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            if len(out) > 5000:
                yield rows()
        if state:
            out.append(row())
        if out:
            yield rows()

    return formatted.mapInArrow(run, DIGEST)
