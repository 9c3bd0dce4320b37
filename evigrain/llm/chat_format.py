r"""Chat formatting by columnar byte assembly.

A conversation becomes one string of turns ``<|im_start|>role\ntext<|im_end|>\n`` in turn
order. Control strings inside a role or text get a backslash after their first character
(one more where there are some), which reading takes away again; a role's backslashes and
line breaks are written ``\\`` and ``\n``. The loss mask lists the code-point ranges of
the assistant texts in the formatted string.

Spark sorts the turns of each conversation; a task then lays out a batch of turns in one
go: numpy computes all segment lengths, their running sum gives the offsets, scatter
indices copy headers and contents into one preallocated buffer, and Arrow takes that
buffer with the conversations' offsets as its string column. A conversation is one output
row, so its turns meet in one task; others share the task's partition in any number.

Defined cases: null text or role: empty. Turns of a null conv_id form a conversation of
their own. Equal turn numbers are ordered by role, then text; a null turn comes first.
Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as t

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: Strings that chat templates use for control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_rest = {first: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) for first in "<["}
ESCAPE = r"(?:(<)(\\*)(%s))|(?:(\[)(\\*)(%s))" % (_rest["<"], _rest["["])
UNESCAPE = re.compile(r"<\\(\\*)(%s)|\[\\(\\*)(%s)" % (_rest["<"], _rest["["]))
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
ROLE_ESCAPE = re.compile(r"\\(.)", re.S)
BATCH_BYTES = 8 << 20


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=ESCAPE, replacement=r"\1\4\\\2\5\3\6")


def unescape(x: str) -> str:
    return UNESCAPE.sub(lambda m: f"<{m[1]}{m[2]}" if m[2] is not None else f"[{m[3]}{m[4]}", x)


def read_role(x: str) -> str:
    return ROLE_ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(x))


def code_points(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code points in each text."""
    return np.diff(np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs])


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array, first: np.ndarray):
    """One record batch (conv, n_turns, formatted, mask) of the conversations that start at the turns ``first``."""
    role = pc.fill_null(role, "")
    assistant = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
    safe = pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n")
    names, name_offs = t.raw_bytes(escape(safe))
    body, body_offs = t.raw_bytes(escape(pc.fill_null(text, "")))
    n = len(role)
    fixed = np.frombuffer(START + MIDDLE + END, np.uint8)
    source = np.concatenate((fixed, names, body))
    at_name, at_body = len(fixed), len(fixed) + len(names)
    begin = np.stack((np.zeros(n, np.int64), name_offs[:-1] + at_name, np.full(n, len(START)), body_offs[:-1] + at_body, np.full(n, len(START) + len(MIDDLE))), axis=1).ravel()
    size = np.stack((np.full(n, len(START)), np.diff(name_offs), np.full(n, len(MIDDLE)), np.diff(body_offs), np.full(n, len(END))), axis=1).ravel()
    to = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[:] = source[np.arange(len(out)) + np.repeat(begin - to, size)]
    turn_end = np.append(to.reshape(n, 5)[1:, 0], len(out)) if n else np.zeros(0, np.int64)
    offsets = np.append(to.reshape(n, 5)[first, 0], len(out))
    # the mask, in code points from the start of the conversation
    chars = np.stack((np.full(n, len(START)), code_points(names, name_offs), np.full(n, len(MIDDLE)), code_points(body, body_offs), np.full(n, len(END))), axis=1)
    before = np.cumsum(chars.ravel()) - chars.ravel()
    turns = np.diff(np.append(first, n))
    lo = before.reshape(n, 5)[:, 3] - np.repeat(before.reshape(n, 5)[first, 0], turns)
    pairs = np.stack((lo, lo + chars[:, 3]), axis=1)[assistant]
    per = np.add.reduceat(assistant.astype(np.int64), first) if n else np.zeros(0, np.int64)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    mask = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.StructArray.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], fields=list(kind)))
    assert n == 0 or turn_end[-1] == len(out)
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), pa.array(turns), formatted, mask], names=["conv", "n_turns", "formatted", "mask"])


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, formatted, mask: array<struct<start, end>>), one row for each conversation."""
    rows = turns.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("body"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "body").select("conv", "role", "body")

    def run(batches):
        held, size = [], 0

        def done(whole: pa.Table, last: bool):
            """Format all conversations that surely ended; return the rest."""
            conv = whole["conv"].combine_chunks() if whole["conv"].num_chunks != 1 else whole["conv"].chunk(0)
            key = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)
            null = pc.is_null(conv).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1]))))
            cut = len(conv) if last else int(first[-1])
            first = first if last else first[:-1]
            own = whole.slice(0, cut).combine_chunks()
            made = assemble(*(t.column(own, c) for c in ("conv", "role", "body")), first) if cut else None
            return made, whole.slice(cut)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held.append(table)
            size += table.nbytes
            if size >= BATCH_BYTES:
                made, rest = done(pa.concat_tables(held), False)
                held, size = [rest], rest.nbytes
                if made is not None:
                    yield made
        if held and (whole := pa.concat_tables(held)).num_rows:
            yield done(whole, True)[0]

    got = rows.mapInArrow(run, "conv long, n_turns long, formatted string, mask array<struct<start:long,end:long>>")
    return got.withColumnRenamed("conv", conv_id)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(read_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]
