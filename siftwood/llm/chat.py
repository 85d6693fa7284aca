"""Chat formatting with a grammar round trip.

Grammar of the rendered text (one turn after the other, nothing between):

    system     <<SYS>> text <</SYS>>      user  [INST] text [/INST]      assistant  <s> text </s>
    any other  [ROLE!] role [TEXT] text [/ROLE]                    (without the blanks shown here)

A turn is first rendered as it is and parsed back; if that does not give the same role and text and end at the
same place, it is rendered in the escaped form, whose opening mark has a ! (`[INST!]`) and in which \\ < [ are preceded by \\.
Parsing is deterministic from left to right, so a conversation's turns are recovered one by one.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import arrow_limits

# The template's marks: fixed values.
MARKS = {"system": ("<<SYS>>", "<<SYS!>>", "<</SYS>>"), "user": ("[INST]", "[INST!]", "[/INST]"), "assistant": ("<s>", "<s!>", "</s>")}
OTHER, OTHER_TEXT, OTHER_END = "[ROLE!]", "[TEXT]", "[/ROLE]"
_SPECIAL = re.compile(r"[\\<\[]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _find_unescaped(text: str, mark: str, at: int) -> int:
    """The first place of mark that no backslash takes away."""
    while (hit := text.find(mark, at)) >= 0:
        back = 0
        while text[hit - 1 - back] == "\\":
            back += 1
        if back % 2 == 0:
            return hit
        at = hit + 1
    raise ValueError("unclosed turn")


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int]:
    """(role, text, end) of the turn that starts at a place of rendered text."""
    if text.startswith(OTHER, at):
        mid = _find_unescaped(text, OTHER_TEXT, at + len(OTHER))
        end = _find_unescaped(text, OTHER_END, mid + len(OTHER_TEXT))
        return unescape(text[at + len(OTHER) : mid]), unescape(text[mid + len(OTHER_TEXT) : end]), end + len(OTHER_END)
    for role, (plain, escaped, close) in MARKS.items():
        if text.startswith(plain, at):
            end = text.index(close, at + len(plain))
            return role, text[at + len(plain) : end], end + len(close)
        if text.startswith(escaped, at):
            end = _find_unescaped(text, close, at + len(escaped))
            return role, unescape(text[at + len(escaped) : end]), end + len(close)
    raise ValueError("no turn starts here")


def parse(text: str) -> list[tuple[str, str]]:
    """All turns of a rendered conversation."""
    turns, at = [], 0
    while at < len(text):
        role, said, at = parse_turn(text, at)
        turns.append((role, said))
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of its text in it); plain where that reads back as it was, else escaped."""
    if role in MARKS:
        plain, escaped, close = MARKS[role]
        for mark, body in ((plain, text), (escaped, escape(text))):
            out = mark + body + close
            try:
                if parse_turn(out) == (role, text, len(out)):
                    return out, len(mark), len(mark) + len(body)
            except ValueError:
                pass
    else:
        head = OTHER + escape(role) + OTHER_TEXT
        body = escape(text)
        out = head + body + OTHER_END
        if parse_turn(out) == (role, text, len(out)):
            return out, len(head), len(head) + len(body)
    raise ValueError("a turn does not read back")


def _ordered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, role, text) with the turns of a conversation together and in order, streamed: never one group in memory."""
    arrow_limits(turns.sparkSession)
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")


def _stream(batches):
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)


def digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, read back from its rendered turns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Null roles and texts count as empty; equal turn numbers are ordered by role, then text; a null turn number comes
    first; a null conversation id is a conversation. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        out: list[tuple] = []
        state = None
        conv = object()

        def close():
            if state is not None:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for c, role, text in _stream(batches):
            if c != conv or state is None:
                close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            rendered, a, b = render_turn(role, text)
            role, text, end = parse_turn(rendered)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                masked = rendered[a:b]
                masked = unescape(masked) if rendered.startswith(MARKS[role][1]) else masked
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += end
            if len(out) >= 2000:
                yield _digest_batch(out)
                out = []
        close()
        if out:
            yield _digest_batch(out)

    return _ordered(turns, id_col, turn_col, role_col, text_col).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq, rendered, loss_start, loss_end) per turn in order; loss bounds are code points within the turn, null unless it is an assistant's."""

    def run(batches):
        conv, seq, out = object(), 0, []
        for c, role, text in _stream(batches):
            conv, seq = (c, 0) if c != conv else (c, seq + 1)
            rendered, a, b = render_turn(role, text)
            told = role == "assistant"
            out.append((c, seq, rendered, a if told else None, b if told else None))
            if len(out) >= 1000:
                yield _turn_batch(out)
                out = []
        if out:
            yield _turn_batch(out)

    return _ordered(turns, id_col, turn_col, role_col, text_col).mapInArrow(run, "conv_id long, seq long, rendered string, loss_start long, loss_end long")


def _turn_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "seq", "rendered", "loss_start", "loss_end"])
