"""Operator 5: chat formatting in budgeted, turn-aligned windows.

Each turn becomes ``<|role|>\\n text <|end|>\\n`` with control strings in its text
escaped reversibly. Running prefix sums of the turns' token counts choose spans of
whole turns: a window takes turns while the sum since its start, with the system
turn and the repeated history, stays within the budget. Every window opens with the
system turn; later ones repeat the end of the window before, masked, so each
assistant text is under the loss mask just once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter
from pathlib import Path
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidewater.llm.token_counts import counter

#: Control strings: this template's, and common ones of others.
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.S)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
WINDOWS = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", _SPAN), ("n_tokens", pa.int64()),
    ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("over_budget", pa.bool_()),
])
DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def escape(text: str) -> str:
    """Put a backslash into every control string (and one more where there are some)."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its escaped text starts and ends."""
    head, body = f"<|{quote(role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    return [(unquote(r), unescape(t)) for r, t in _TURN.findall(text)]


class Windows:
    """Builds the windows of one conversation from turns that arrive in order."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: list[tuple] = []  # turns are (formatted, start, end, loss, tokens, prefix sum)
        self.repeated: list[tuple] = []
        self.new: list[tuple] = []
        self.number, self.total, self.fixed, self.base = 0, 0, 0, 0

    def add(self, role: str, formatted: tuple[str, int, int], tokens: int) -> dict | None:
        """Take a turn; returns the window that it closes, if any."""
        self.total += tokens
        turn = (*formatted, role == "assistant", tokens, self.total)
        if role == "system" and not self.number and not self.new:
            self.system.append(turn)
            self.fixed += tokens
            self.base = self.total
            return None
        closed = None
        if self.new and self.fixed + self.total - self.base > self.budget:
            closed = self._close()
            self.repeated = []
            for old in reversed(self.last):
                if self.total - tokens - (old[5] - old[4]) > self.history:
                    break
                self.repeated.insert(0, old)
            self.base = self.total - tokens - sum(t[4] for t in self.repeated)
            while self.repeated and self.fixed + self.total - self.base > self.budget:
                self.base += self.repeated.pop(0)[4]
        self.new.append(turn)
        return closed

    def finish(self) -> dict | None:
        """The last window."""
        return self._close() if self.new or (self.system and not self.number) else None

    def _close(self) -> dict:
        shown = self.number == 0
        turns = [(t, shown) for t in self.system] + [(t, False) for t in self.repeated] + [(t, True) for t in self.new]
        parts, loss, at = [], [], 0
        for (text, start, end, assistant, *_), fresh in turns:
            if fresh and assistant and end > start:
                loss.append({"start": at + start, "end": at + end})
            parts.append(text)
            at += len(text)
        tokens = sum(t[4] for t, _ in turns)
        row = {
            "conv_id": self.conv_id, "window": self.number, "text": "".join(parts), "loss": loss, "n_tokens": tokens,
            "n_turns": len(turns), "n_repeated": sum(not f for _, f in turns), "over_budget": tokens > self.budget,
        }
        self.last, self.new, self.number = self.new, [], self.number + 1
        return row


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, list[dict]]]:
    """(conv_id, whether it begins here, rows), across batches sorted by conv_id.

    Ids stay whole numbers beside nulls, as Arrow has them.
    """
    last: object = _grouped  # equal to no id
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            for conv, rows in groupby(batch.slice(a, 1000).to_pylist(), key=itemgetter("conv_id")):
                yield conv, conv != last, list(rows)
                last = conv


def chat_windows(conversations: DataFrame, model_path: str, budget: int = 2048, history: int = 256) -> DataFrame:
    """Format conversations as windows of at most ``budget`` tokens.

    ``conversations`` has conv_id, turn, role and text. Turns are ordered by turn,
    ties by role and text; nulls come first; a null text or role counts as empty;
    a null conv_id is a conversation of its own; repeated rows are turns of their
    own; an empty table gives no windows; other columns are left alone. The
    leading system turns open every window. At most ``history`` tokens of whole
    turns are repeated. No turn is cut: one that alone exceeds the budget gets a
    window with over_budget set. ``loss`` has the code-point ranges of the
    window's own assistant texts.

    A conversation is read as a stream in order, so memory holds one window
    however long it is.
    """
    model = Path(model_path).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, state, out, held = counter(model), None, [], 0
        for conv, begins, rows in _grouped(batches):
            if begins and state is not None:
                out.append(state.finish())
            if begins:
                state = Windows(conv, budget, history)
            roles = [r["role"] or "" for r in rows]
            turns = [format_turn(role, r["text"] or "") for role, r in zip(roles, rows, strict=True)]
            for role, turn, tokens in zip(roles, turns, map(sum, cache.of([t[0] for t in turns])), strict=True):
                out.append(state.add(role, turn, tokens))
                held += len(turn[0])
            if len(out) > 500 or held > 4_000_000:
                yield pa.RecordBatch.from_pylist([w for w in out if w], WINDOWS)
                out, held = [], 0
        if state is not None:
            out.append(state.finish())
        yield pa.RecordBatch.from_pylist([w for w in out if w], WINDOWS)

    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(F.col("conv_id").cast("long"), *order[1:]).repartition("conv_id")
    return rows.sortWithinPartitions(*order).mapInArrow(run, from_arrow_schema(WINDOWS))


def window_digests(windows: DataFrame) -> DataFrame:
    """What windows hold, read back from their texts and masks, for each conversation.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end for each turn),
    loss_chars and loss_sha256 (of the unescaped text under the mask) and
    formatted_chars; turns that a window repeats count once.
    """
    new: Callable[[], list] = lambda: [0, sha256(), 0, sha256(), 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, d, out, open_ = None, new(), [], False
        result = lambda: (conv, d[0], d[1].hexdigest(), d[2], d[3].hexdigest(), d[4])
        flush = lambda: pa.RecordBatch.from_pylist([dict(zip(DIGESTS.names, r, strict=True)) for r in out], DIGESTS)
        for key, begins, rows in _grouped(batches):
            if begins:
                if open_:
                    out.append(result())
                conv, d, open_ = key, new(), True
            for r in rows:
                for role, said in parse_turns(r["text"])[r["n_repeated"] :]:
                    d[0] += 1
                    d[1].update(f"{role}\n{said}\n".encode())
                for span in r["loss"]:
                    said = unescape(r["text"][span["start"] : span["end"]])
                    d[2] += len(said)
                    d[3].update(said.encode())
                d[4] += len(r["text"])
            if len(out) > 5000:
                yield flush()
                out.clear()
        if open_:
            out.append(result())
        yield flush()

    columns = ["conv_id", "window", "text", "loss", "n_repeated"]
    rows = windows.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(run, from_arrow_schema(DIGESTS))
