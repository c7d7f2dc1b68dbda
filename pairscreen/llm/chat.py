"""Conversations as training text, checked by reading them back.

    conversation = "<s>" turn*
    turn         = "[INST]" role "\\n" text "[/INST]"  |  text "</s>"

The second form is a turn of the assistant, and its text carries the loss.  A
control string inside a text is escaped by a backslash behind its first character;
one that has backslashes there already gets one more, so the parser just takes one
away.  Roles have backslash and line feed escaped.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from pairscreen.llm.shared import numbered

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"

_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_ROLE_BACK = re.compile(r"\\(.)", re.S)


def escape(text):
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text):
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_out(role):
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def _role_in(role):
    return _ROLE_BACK.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def write(role, text):
    """One turn as it stands, without any escaping of its text."""
    if role == ASSISTANT:
        return text + END
    return f"{OPEN}{_role_out(role)}\n{text}{CLOSE}"


def parse(rendered):
    """Turns of a rendered text: (role, text, from, to), with the place of the
    still escaped text.  Raises ``ValueError`` where the grammar is broken."""
    at = len(BEGIN) if rendered.startswith(BEGIN) else 0
    while at < len(rendered):
        if rendered.startswith(OPEN, at):
            line = rendered.index("\n", at)
            role, start = _role_in(rendered[at + len(OPEN) : line]), line + 1
            stop, close = rendered.index(CLOSE, start), CLOSE
        else:
            role, start = ASSISTANT, at
            stop, close = rendered.index(END, start), END
        yield role, unescape(rendered[start:stop]), start, stop
        at = stop + len(close)


def render(role, text):
    """One turn, escaped only if it would not be read back as it is."""
    for written in (write(role, text), write(role, escape(text))):
        try:
            if [t[:2] for t in parse(written)] == [(role, text)] and not written.startswith(BEGIN):
                return written
        except ValueError:
            pass
    raise ValueError(f"cannot be written: {role!r}")


def _rows(batches, columns):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _in_batches(rows, names, kinds, size=4_096, characters=1 << 22):
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight > characters:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def format_turns(conversations, id_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """Formatted turns in order: ``id_col``, ``position`` (from 0), ``formatted``,
    ``loss_from`` and ``loss_to`` (the text under the loss mask, in code points of
    ``formatted``; empty for other roles).  A conversation's text is its ``formatted``
    in order; the first begins with ``BEGIN``.

    Turns are sorted by turn, role and text, null first; equal rows are turns of
    their own.  Rows of a conversation stay in one partition, in order, and pass as
    a stream: a task holds one turn at a time, however long the conversation.

    A null text or role is empty.  Null ids form one conversation.  An empty table
    gives no rows; other columns are ignored.
    """
    kind = dict(conversations.dtypes)[id_col]
    rows = conversations.select(
        conversations[id_col].alias("id"),
        conversations[turn_col].alias("turn"),
        F.coalesce(conversations[role_col], F.lit("")).alias("role"),
        F.coalesce(conversations[text_col], F.lit("")).alias("text"),
    )
    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    names = ["id", "position", "formatted", "loss_from", "loss_to"]

    def run(batches):
        def turns():
            now, position = (), 0
            for conv, role, text in _rows(batches, ("id", "role", "text")):
                position = position + 1 if now == (conv,) else 0
                now = (conv,)
                before = "" if position else BEGIN
                written = render(role, text)
                start = stop = 0
                if role == ASSISTANT:
                    start, stop = len(before), len(before) + len(written) - len(END)
                yield conv, position, before + written, start, stop

        yield from _in_batches(turns(), names, [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64()])

    id_type = _arrow(kind)
    schema = numbered([("id", kind), ("position", "long"), ("formatted", "string"), ("loss_from", "long"), ("loss_to", "long")])
    return ordered.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _arrow(kind):
    return {"string": pa.string(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.int64())


def read_back(formatted, id_col="conv_id"):
    """Digests of conversations from what ``format_turns`` gave, in its partitions
    and order: ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``,
    ``formatted_chars``.  Only the parser's turns and the mask go in."""
    kind = dict(formatted.dtypes)[id_col]
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [_arrow(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        def conversations():
            conv, turns = None, 0
            for this, position, text, start, stop in _rows(batches, ("id", "position", "formatted", "loss_from", "loss_to")):
                if position == 0:
                    if turns:
                        yield conv, turns, all_turns.hexdigest(), n_loss, loss.hexdigest(), n_chars
                    conv, turns, n_loss, n_chars = this, 0, 0, 0
                    all_turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, content, _, _ in parse(text):
                    all_turns.update(f"{role}\n{content}\n".encode())
                    turns += 1
                masked = unescape(text[start:stop])
                loss.update(masked.encode())
                n_loss += len(masked)
                n_chars += len(text)
            if turns:
                yield conv, turns, all_turns.hexdigest(), n_loss, loss.hexdigest(), n_chars

        yield from _in_batches(conversations(), names, kinds)

    schema = numbered(
        [("id", kind), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")]
    )
    return formatted.select(F.col(id_col).alias("id"), "position", "formatted", "loss_from", "loss_to").mapInArrow(run, schema).withColumnRenamed("id", id_col)
