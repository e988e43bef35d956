r"""Chat formatting checked by a grammar round trip (operator 8).

    conversation = turn*
    turn         = "### " role ": " body "</turn>\n"

A role is written with `\`, `:` and line feeds escaped. In a body an unescaped "### " or "</turn>" is a control
string and a backslash escapes a following `\`, `#` or `<`. Each turn is rendered plainly first, parsed, and compared
with its source; if they differ, its control strings are escaped, and at last its backslashes too, which always comes
back identical. A parsed conversation is the parsed turns in order, because a turn ends at its first unescaped end
marker; so turns are rendered by themselves and a conversation of any length needs no group in memory.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, END, ROLE_END = "### ", "</turn>", ": "
CONTROL = re.compile(r"### |</turn>")
TOKEN = re.compile(r"\\([\\#<])|(### |</turn>)")
ROLE_TOKEN = re.compile(r"\\([\\:n])|(: )")
LOSS_ROLE = "assistant"


class Mismatch(ValueError):
    """The text is not a sentence of the grammar."""


def escaped(text: str, level: int) -> str:
    if level == 2:
        text = text.replace("\\", "\\\\")
    return CONTROL.sub(lambda m: "\\" + m[0], text) if level else text


def escaped_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(":", "\\:").replace("\n", "\\n")


def _read(text: str, at: int, token: re.Pattern, stop: str) -> tuple[str, int]:
    """Text up to the unescaped `stop`, unescaped, and the place of `stop`."""
    parts, start = [], at
    for m in token.finditer(text, at):
        if m.start() < start:
            continue
        if m[1]:
            parts += [text[start:m.start()], "\n" if m[1] == "n" else m[1]]
            start = m.end()
        elif m[2] == stop:
            parts.append(text[start:m.start()])
            return "".join(parts), m.start()
        else:
            raise Mismatch(f"control string at {m.start()}")
    raise Mismatch("no end")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, body, and the span of the body as it is written."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Mismatch(f"no turn at {at}")
        role, end = _read(text, at + len(OPEN), ROLE_TOKEN, ROLE_END)
        start = end + len(ROLE_END)
        body, end = _read(text, start, TOKEN, END)
        at = end + len(END) + 1
        if text[at - 1:at] != "\n":
            raise Mismatch(f"no line end at {at}")
        turns.append((role, body, start, end))
    return turns


def render(role: str, body: str) -> tuple[str, int, int]:
    """A turn that parses back to (role, body), with the span of its body."""
    for level in range(3):
        text = f"{OPEN}{escaped_role(role)}{ROLE_END}{escaped(body, level)}{END}\n"
        try:
            turns = parse(text)
        except Mismatch:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, body):
            return text, turns[0][2], turns[0][3]
    raise AssertionError("full escaping always comes back")


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as rows (conv_id, turn, role, piece, loss_start, loss_end).

    The pieces of a conversation by turn (then role, then piece) are its formatted text. loss_start and loss_end bound
    the trained part of a piece and are null outside assistant turns. Null roles and texts count as empty; null
    conversation ids are one conversation; null turns come first; repeated rows are turns of their own; other columns
    are not read; an empty table gives no rows.
    """
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def task(batches):
        for b in batches:
            roles = [r or "" for r in b.column("role").to_pylist()]
            made = [render(r, t or "") for r, t in zip(roles, b.column("text").to_pylist())]
            loss = [r == LOSS_ROLE for r in roles]
            yield pa.RecordBatch.from_arrays([
                b.column("conv_id"), b.column("turn"), pa.array(roles, pa.string()), pa.array([m[0] for m in made], pa.string()),
                pa.array([m[1] if x else None for m, x in zip(made, loss)], pa.int64()),
                pa.array([m[2] if x else None for m, x in zip(made, loss)], pa.int64())],
                ["conv_id", "turn", "role", "piece", "loss_start", "loss_end"])

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(
        task, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, piece string, loss_start bigint, loss_end bigint")


def digests(pieces: DataFrame) -> DataFrame:
    """What a trainer reads from the formatted text: one row per conversation with digests of its turns and loss text.

    Rows are sorted by conversation and streamed, so a task holds one turn at a time however long a conversation is.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def task(batches):
        key, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = None
        for b in batches:
            types = types or [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = []
            for conv, piece, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if state is None or conv != key:
                    if state is not None:
                        out.append(closed(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _, _ in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    text = _read(piece[lo:hi] + END, 0, TOKEN, END)[0]
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(key, state), types)], names)

    def closed(key, s):
        return key, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "piece").select("conv_id", "piece", "loss_start", "loss_end")
    return rows.mapInArrow(task, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
