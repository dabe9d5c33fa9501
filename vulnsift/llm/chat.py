"""Chat formatting from an event log.

A conversation is a log of events ``(conv_id, seq, kind, msg, role, text)``. The log is
partitioned by conversation and sorted by sequence inside each partition (one shuffle), then each
partition is read once as a stream of Arrow batches and folded; the state is the messages of
the one conversation at hand, never a group of rows, so streamed deltas cost no memory
beyond the text they make. The fold is a pure function of the sorted rows: a lost task is simply
run again.

Event kinds: ``message`` opens message ``msg`` with ``text`` (a null ``msg`` always opens a new one);
``delta`` appends ``text``, opening the message if need be; ``edit`` replaces its text;
``regenerate`` empties it and drops every later message; ``delete`` removes it. An unknown or null
kind counts as ``message``. Edits, regenerations and deletions of a message that is not there do nothing.

Template, per message: ``<|im_start|>ROLE \\n TEXT <|im_end|> \\n`` (without the blanks). A control
string inside a text is broken by one backslash between ``<`` and ``|``; a text that has
that very form gets one more, so the way back is exact. Roles also have backslash and newline escaped.
``loss`` lists the code-point spans of assistant texts in the formatted string.

Defined cases: null text is the empty text, null role is ``unknown``; rows with a null ``conv_id`` form one
conversation with a null id; events with equal ``seq`` are ordered by kind, msg, role and
text; repeated rows are repeated events; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_BREAK = re.compile(r"<(\\*)\|")
_JOIN = re.compile(r"<\\(\\*)\|")
FORMATTED = "conv_id bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"
DIGEST = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
          "formatted_chars bigint")


def escape(text: str) -> str:
    return _BREAK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _JOIN.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """Formatted string and the loss spans of its assistant texts."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string: the inverse of ``render``."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        turns.append((unescape_role(formatted[at + len(START):line]), unescape(formatted[line + 1:end])))
        at = end + len(END) + 1
    return turns


class _Fold:
    """Messages of one conversation, in order of opening."""

    def __init__(self):
        self.messages: dict = {}
        self.unnamed = 0

    def apply(self, kind, msg, role, text):
        m = self.messages
        if kind == "delta":
            if msg in m:
                m[msg][1].append(text)
            else:
                m[msg] = [role, [text]]
        elif kind == "edit":
            if msg in m:
                m[msg][1] = [text]
        elif kind == "regenerate":
            if msg in m:
                keys = list(m)
                for k in keys[keys.index(msg) + 1:]:
                    del m[k]
                m[msg][1] = []
        elif kind == "delete":
            m.pop(msg, None)
        else:
            if msg is None:
                msg, self.unnamed = ("", self.unnamed), self.unnamed + 1
            m[msg] = [role, [text]]

    def turns(self) -> list[tuple[str, str]]:
        return [("unknown" if r is None else r, "".join(parts)) for r, parts in self.messages.values()]


def _fold_batches(batches: Iterator[pa.RecordBatch], chars_per_batch: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    out, chars = [], 0
    fold, conv = None, None

    def done():
        turns = fold.turns()
        formatted, loss = render(turns)
        out.append({"conv_id": conv, "n_turns": len(turns), "formatted": formatted, "loss": loss})
        return len(formatted)

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        for c, kind, msg, role, text in zip(*cols):
            if fold is None or c != conv:
                if fold is not None:
                    chars += done()
                    if chars > chars_per_batch:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, chars = [], 0
                fold, conv = _Fold(), c
            fold.apply(kind, msg, role, text or "")
    if fold is not None:
        done()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def turn_events(turns: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as an event log: each opens a message of its own."""
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("seq"),
                        F.lit("message").alias("kind"), F.lit(None).cast("bigint").alias("msg"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def format_chats(events: DataFrame) -> DataFrame:
    """One row per conversation that has events: its folded, rendered string and loss spans."""
    log = events.select("conv_id", "seq", "kind", "msg", "role", "text").repartition("conv_id") \
        .sortWithinPartitions("conv_id", "seq", "kind", "msg", "role", "text")
    return log.select("conv_id", "kind", "msg", "role", "text").mapInArrow(_fold_batches, FORMATTED)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    for b in batches:
        rows = []
        for r in b.to_pylist():
            turns = parse(r["formatted"])
            loss = "".join(unescape(r["formatted"][s["start"]:s["end"]]) for s in r["loss"])
            rows.append({"conv_id": r["conv_id"], "n_turns": len(turns),
                         "turns_sha256": sha("".join(f"{a}\n{t}\n" for a, t in turns)),
                         "loss_chars": len(loss), "loss_sha256": sha(loss),
                         "formatted_chars": len(r["formatted"])})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([
            ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings and loss spans say when they are read back."""
    return formatted.mapInArrow(_digest_batches, DIGEST)
