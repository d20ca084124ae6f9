"""Chat formatting that is read back by a grammar before it counts.

A conversation is rendered as
    <s> turn turn ... </s>
    turn = [SYS] text [/SYS] | [INST] text [/INST] | [OUT] text [/OUT] | [ROLE=name] text [/ROLE]
with the spaces as shown belonging to the marks. The parser is deterministic: it
knows where it is by the marks alone. Text that would be read as a mark is
escaped by a backslash after its first character, and a text that already has
such backslashes gets one more; each turn is rendered plainly first, parsed,
and escaped only if it does not come back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import shuffle_parts

# The control strings of the template.
BEGIN, END = "<s>", "</s>"
ROLE_MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " [/OUT]")}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "[ROLE=", "] ", " [/ROLE]"
LOSS_ROLES = ("assistant",)

_STEMS = ["<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[ROLE=", "[/ROLE]"]
_ESCAPE = re.compile("|".join(f"{re.escape(s[0])}\\\\*{re.escape(s[1:])}" for s in _STEMS))
_UNESCAPE = re.compile("|".join(f"{re.escape(s[0])}\\\\+{re.escape(s[1:])}" for s in _STEMS))
_CONTROL = re.compile("|".join(map(re.escape, _STEMS)))
_OPENS = {o: (role, c) for role, (o, c) in ROLE_MARKS.items()}


@dataclass(frozen=True)
class Turn:
    """A turn read back: where its text lies in the rendered string, and the text itself."""

    role: str
    text: str
    start: int
    end: int


class GrammarError(ValueError):
    """A rendered string that the grammar does not accept."""


def escape(text: str) -> str:
    """No control string is left in the result, and unescape() gives the text back."""
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """Take one backslash out of each escaped control string."""
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def render_turn(role: str, text: str, escaped: bool) -> str:
    """One turn; an unknown role is named, in hexadecimal, in its mark."""
    body = escape(text) if escaped else text
    if role in ROLE_MARKS:
        a, b = ROLE_MARKS[role]
        return a + body + b
    return OTHER_OPEN + role.encode().hex() + OTHER_MID + body + OTHER_CLOSE


def parse_turn(s: str, at: int) -> Turn:
    """The turn that begins at a place, by its marks: the text runs to the first control string, which must close it."""
    for opener, (role, closer) in _OPENS.items():
        if s.startswith(opener, at):
            start = at + len(opener)
            break
    else:
        m = re.compile(re.escape(OTHER_OPEN) + "([0-9a-f]*)" + re.escape(OTHER_MID)).match(s, at)
        if not m:
            raise GrammarError(f"no turn at {at}")
        role, closer, start = bytes.fromhex(m[1]).decode(), OTHER_CLOSE, m.end()
    stop = _CONTROL.search(s, start)
    end = stop.start() - 1 if stop else -1
    if not stop or end < start or not s.startswith(closer, end):
        raise GrammarError(f"the turn at {at} is not closed")
    return Turn(role, unescape(s[start:end]), start, end)


def next_turn(turn: Turn) -> int:
    """Where the turn after this one begins."""
    return turn.end + len(ROLE_MARKS[turn.role][1] if turn.role in ROLE_MARKS else OTHER_CLOSE)


def render_checked(role: str, text: str) -> str:
    """A turn that parses to itself: plain if that does, else escaped."""
    for escaped in (False, True):
        s = render_turn(role, text, escaped)
        try:
            back = parse_turn(s, 0)
        except GrammarError:
            continue
        if (back.role, back.text) == (role, text) and next_turn(back) == len(s):
            return s
    raise GrammarError("a turn does not survive the round trip")


def render(turns: list[tuple[str, str]]) -> str:
    """A conversation."""
    return BEGIN + "".join(render_checked(r, t) for r, t in turns) + END


def parse(s: str) -> list[Turn]:
    """The turns of a rendered conversation."""
    if not s.startswith(BEGIN):
        raise GrammarError("no beginning")
    at, out = len(BEGIN), []
    while not s.startswith(END, at):
        out.append(parse_turn(s, at))
        at = next_turn(out[-1])
    if at + len(END) != len(s):
        raise GrammarError("text after the end")
    return out


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and piece (the rendered turn) of each row; the work is by row.

    A null text or role is empty; every turn has been read back and compared.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = [x or "" for x in b.column("role").to_pylist()]
            texts = [x or "" for x in b.column("text").to_pylist()]
            pieces = [render_checked(r, t) for r, t in zip(roles, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(pieces, pa.string())], ["conv_id", "turn", "role", "text", "piece"])

    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(work, "conv_id long, turn long, role string, text string, piece string")


def formatted(rows: DataFrame, part_chars: int = 1 << 20) -> DataFrame:
    """conv_id, part (from 0) and formatted: each conversation's rendered string, in parts that end with a turn.

    Turns are rendered where they are, then dealt by conv_id and streamed in order
    (turn, role, text; nulls first), so that a conversation of any length needs the
    memory of a part, a little over part_chars. Turns alike in all three are
    interchangeable. A null conv_id is a conversation of its own. A conversation
    without rows does not appear; other columns are ignored. The rows of a
    conversation are together and in order of part.
    """
    placed = format_turns(rows).repartition(shuffle_parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "piece")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, held, size, first = None, 0, [], 0, True
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            nonlocal out
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["conv_id", "part", "formatted"])
            out = []
            return made

        total = 0
        for b in batches:
            for key, piece in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if first or key != conv:
                    if not first:
                        out.append((conv, part, "".join([*held, END])))
                    conv, part, held, size, first = key, 0, [BEGIN], len(BEGIN), False
                held.append(piece)
                size += len(piece)
                total += len(piece)
                if size >= part_chars:
                    out.append((conv, part, "".join(held)))
                    part, held, size = part + 1, [], 0
                if total >= part_chars and out:
                    yield batch()
                    total = 0
        if not first:
            out.append((conv, part, "".join([*held, END])))
        if out:
            yield batch()

    return placed.mapInArrow(work, "conv_id long, part int, formatted string")


class _ReadBack:
    """A conversation's figures as its parts are parsed."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.masked, self.ended = hashlib.sha256(), hashlib.sha256(), False

    def add(self, part: int, s: str) -> None:
        at = 0
        if part == 0:
            if not s.startswith(BEGIN):
                raise GrammarError("no beginning")
            at = len(BEGIN)
        while at < len(s):
            if s.startswith(END, at):
                self.ended, at = True, at + len(END)
                if at != len(s):
                    raise GrammarError("text after the end")
                break
            turn = parse_turn(s, at)
            at = next_turn(turn)
            self.turns += 1
            self.all.update(f"{turn.role}\n{turn.text}\n".encode())
            if turn.role in LOSS_ROLES:
                self.loss += len(turn.text)
                self.masked.update(turn.text.encode())
        self.chars += len(s)

    def row(self) -> tuple:
        if not self.ended:
            raise GrammarError("no end")
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(parts: DataFrame) -> DataFrame:
    """What the parser reads from formatted(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is over role, newline, text, newline of each turn, loss_sha256
    over the assistant's texts. Parts are parsed one at a time, in their order.
    """
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _ReadBack | None = None
        for b in batches:
            done: list[tuple] = []
            for conv, part, s in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "formatted")), strict=True):
                if part == 0:
                    if now is not None:
                        done.append(now.row())
                    now = _ReadBack(conv)
                now.add(part, s)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds.values())], list(kinds))
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), kinds.values(), strict=True)], list(kinds))

    return parts.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digests(rows: DataFrame) -> DataFrame:
    """read_back() of formatted()."""
    return read_back(formatted(rows))


def oracle_sql() -> str:
    """DuckDB SQL for digests() of conversations and the added conversation -7."""
    marks = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in ROLE_MARKS.items())
    hard = "</s>[INST] ok [/INST]"
    stems = "|".join("\\" * (s[0] == "[") + s[0] + "\\\\*" + s[1:].replace("]", "\\]").replace("[", "\\[") for s in _STEMS)
    return f"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{hard}' UNION ALL SELECT -7, 1, 'assistant', '{hard}'),
p AS (SELECT *, CASE WHEN len(regexp_extract_all(text, '{stems}')) > 0 THEN len(regexp_extract_all(text, '{stems}')) ELSE 0 END AS extra FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(BEGIN) + len(END)} + sum(length(text) + extra + CASE role {marks} END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""
