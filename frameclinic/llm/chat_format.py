"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only the reply is
trainable. Turns are written as ``### role: text</turn>`` and a line break; a backslash marks the backslashes, runs of
three and more ``#`` and ``</turn>`` of the texts, so the written form can be read back without loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameclinic.llm.common import tidy

ASSISTANT, END = "assistant", "</turn>"
#: Characters of examples in one Arrow batch.
BATCH_CHARS = 4 << 20

_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_ROLE_CONTROL = re.compile(r"[\\:]")
_TURN = re.compile(r"### ((?:\\[\s\S]|[^\\:])*): ((?:\\[\s\S]|(?!</turn>)[^\\])*)</turn>\n")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "".join("\\" + c for c in m[0]) if m[0][0] == "#" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


def opening(role: str) -> str:
    return "### " + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + ": "


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a written conversation."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def examples(turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(text, start, stop) for each assistant turn: the reply is text[start:stop].

    What follows the last assistant turn comes as a last example with nothing to train on (start = stop = its end).
    """
    written, rest = "", False
    for role, text in turns:
        head = opening(role)
        start = len(written) + len(head)
        written += head + escape(text)
        stop = len(written)
        written += END + "\n"
        rest = role != ASSISTANT
        if not rest:
            yield written, start, stop
    if rest:
        yield written, len(written), len(written)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Conversations of rows sorted by number and turn."""
    number, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if turns and conv != number:
                yield number, turns
                turns = []
            number = conv
            turns.append((role or "", text or ""))
    if turns:
        yield number, turns


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def out():
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["conv_id", "example", "text", "loss_start", "loss_stop"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for number, turns in _conversations(batches):
        for i, (text, start, stop) in enumerate(examples(turns)):
            rows.append((number, i, text, start, stop))
            size += len(text)
            if size > BATCH_CHARS:
                yield out()
                rows, size = [], 0
    if rows:
        yield out()


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the examples: turns from each conversation's last example, replies from the loss spans."""
    out: list[tuple] = []
    state: dict = {}

    def close():
        turns, digest = parse(state["last"]), hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        out.append((state["conv"], len(turns), digest.hexdigest(), state["chars"], state["loss"].hexdigest(), state["written"]))

    for batch in _examples(batches):
        for conv, i, text, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
            if i == 0:
                if state:
                    close()
                state = {"conv": conv, "chars": 0, "loss": hashlib.sha256(), "written": 0}
            reply = unescape(text[start:stop])
            state["chars"] += len(reply)
            state["loss"].update(reply.encode())
            state["written"] += len(text)
            state["last"] = text
    if state:
        close()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    for a in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 10_000]), kinds)], names=names)


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_stop): one row for each assistant turn, numbered from 0.

    Turns are ordered by turn number (nulls first), then role and text, so repeated rows stay and have a defined
    order. Null texts and roles are empty; rows with a null conv_id are one conversation. Turns after the last
    assistant turn, and conversations without one, come as an example with an empty span. Examples are written one
    after the other while the rows stream by; a task holds one conversation.
    """
    return _sorted(conversations).mapInArrow(
        tidy(_examples), "conv_id long, example long, text string, loss_start long, loss_stop long"
    )


def chat_digests(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples as ``format_chats`` writes them.

    conv_id, n_turns, turns_sha256 (role, line break, text, line break for each turn), loss_chars and loss_sha256
    (the unescaped text of all loss spans in order) and formatted_chars (code points of all examples).
    """
    return _sorted(conversations).mapInArrow(
        tidy(_read_back),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
