r"""Chat formatting with a grammar round trip.

A conversation is rendered as one text. The grammar, read left to right without look-back:

    conversation = turn*
    turn         = "### " role ":" mode text "</turn>\n"
    role         = a known role, its first letter in upper case | '"' (any other role: "\" before "\" and '"') '"'
    mode         = " " (text as it is) | "\" (escaped text: "\" before "\", "#" and "<")

A turn is rendered as it is, parsed, and compared with its source;
if what is read back differs, conflicting content is escaped until it is identical. A parser that reads :func:`parse`'s grammar needs no other knowledge.

The loss mask covers the assistants' texts. Turns of a conversation arrive in order and are written as they come, with running digests, so a task holds
one turn at a time, however long the conversation is.

Defined results: null text is empty; a null role is an empty role, which no mask covers; turns go by number, null first, ties by role and text; repeated
rows are repeated turns; rows with null conv_id are one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ESCAPE = "### ", "</turn>\n", "\\"
KNOWN = {role: role.capitalize() for role in ("user", "assistant", "system", "tool")}
ROLES = {shown: role for role, shown in KNOWN.items()}
#: What the control strings begin with, and the escape character itself, which a text may hold.
CONFLICT = re.compile(r"[\\#<]")
#: The conversation that is formatted besides those of the table.
EXTRA = (-7, r"\### Assistant: </turn> ok")


def _role_out(role: str) -> str:
    return KNOWN.get(role) or '"' + re.sub(r'["\\]', lambda m: ESCAPE + m[0], role) + '"'


def render(role: str, text: str) -> str:
    """One turn, escaped only if reading it back as it is gives something else."""
    head = OPEN + _role_out(role) + ":"
    plain = f"{head} {text}{CLOSE}"
    if parse(plain) == [(role, text)]:
        return plain
    escaped = f"{head}{ESCAPE}{CONFLICT.sub(lambda m: ESCAPE + m[0], text)}{CLOSE}"
    if parse(escaped) != [(role, text)]:
        raise ValueError("a turn can't be read back")
    return escaped


def _until(rendered: str, at: int, stop: str) -> tuple[str, int]:
    """Unescaped content from ``at`` to the next bare ``stop``, and the place after it."""
    out = []
    while True:
        end, escape = rendered.find(stop, at), rendered.find(ESCAPE, at)
        if end < 0 and escape < 0:
            raise ValueError("no end")
        if escape < 0 or 0 <= end < escape:
            out.append(rendered[at:end])
            return "".join(out), end + len(stop)
        out.append(rendered[at:escape] + rendered[escape + 1 : escape + 2])
        at = escape + 2


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns (role, text) of a rendered conversation; None if it isn't one."""
    turns, at = [], 0
    try:
        while at < len(rendered):
            if not rendered.startswith(OPEN, at):
                return None
            at += len(OPEN)
            if rendered.startswith('"', at):
                role, at = _until(rendered, at + 1, '"')
            else:
                end = rendered.index(":", at)
                role, at = ROLES[rendered[at:end]], end
            if not rendered.startswith(":", at):
                return None
            mode, at = rendered[at + 1 : at + 2], at + 2
            if mode == ESCAPE:
                text, at = _until(rendered, at, CLOSE)
            elif mode == " ":
                end = rendered.index(CLOSE, at)
                text, at = rendered[at:end], end + len(CLOSE)
            else:
                return None
            turns.append((role, text))
    except (KeyError, ValueError):
        return None
    return turns


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text, in order within each conversation and each conversation in one partition."""
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    rows = conversations.select(*columns, F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def rendered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn and formatted (the turn as rendered and proved by reading it back); a conversation's text is its turns one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render(r.as_py(), t.as_py()) for r, t in zip(batch["role"], batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turn"], pa.array(out, pa.string())], ["conv_id", "turn", "formatted"])

    return turns(conversations).mapInArrow(run, "conv_id long, turn long, formatted string")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from rendered turns in order: counts and digests of the turns and of what the loss mask covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, rows = None, []

        def close() -> None:
            if state:
                conv, n, all_turns, chars, loss, length = state
                rows.append((conv, n, all_turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            for conv, text in zip(batch["conv_id"].to_pylist(), batch["formatted"]):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                rendered = text.as_py()
                state[5] += len(rendered)
                for role, said in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        state[3] += len(said)
                        state[4].update(said.encode("utf-8", "surrogatepass"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows.clear()
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_extra(conversations: DataFrame) -> DataFrame:
    """The conversations, and the one that holds the template's own control strings."""
    conv, text = EXTRA
    extra = conversations.sparkSession.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(extra)
