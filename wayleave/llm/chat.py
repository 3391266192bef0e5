"""Chat formatting: columnar byte assembly.

Turns are range-partitioned and sorted by conversation and turn, so that one very long conversation spreads over many
tasks. In each Arrow batch the segments (header, escaped text, footer of each turn) have known lengths; cumulative
offsets place them, scatter indices copy headers, texts and footers into one preallocated buffer, and that buffer is the
output column. A conversation comes out in one or more chunks of at most CHUNK turns, to be read in order of `chunk`.

Template: <|im_start|>role newline text <|im_end|> newline. Control strings inside roles and texts are escaped: a
backslash goes after the first character of each, and a backslash is doubled; in roles a newline is escaped too. Removing
one backslash before any character gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayleave.llm.shared import partitions, save

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of this template and of other common ones.
CONTROL = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>"]
CHUNK = 4096
#: Bytes of roles and texts that are assembled at once, if a turn is not longer by itself, and bytes that are copied at once: indices take some 40 bytes for each of these.
BYTES, COPIED = 2 << 20, 1 << 18
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, chunk long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def escaped(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(column, "\\", "\\\\")
    if role:
        out = pc.replace_substring(out, "\n", "\\\n")
    for c in CONTROL:
        out = pc.replace_substring(out, c, c[0] + "\\" + c[1:])
    return out


def unescaped(text: str, step: int = 1 << 16) -> str:
    """The text without its escapes, piece by piece; no piece ends between a backslash and what it escapes."""
    out, at = [], 0
    while at < len(text):
        end = at + step
        piece = text[at:end]
        if (len(piece) - len(piece.rstrip("\\"))) % 2:
            end += 1
            piece = text[at:end]
        out.append(re.sub(r"\\(.)", r"\1", piece, flags=re.DOTALL))
        at = end
    return "".join(out)


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, start and length of each string of a large_string array."""
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1 + a.offset)[a.offset :]
    buf = a.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copy data[start[i] : start[i] + size[i]] to out[to[i] :] for all i, COPIED bytes at a time; longer segments go in several pieces."""
    many = -(-size // COPIED)
    of = np.repeat(np.arange(size.size), many)
    skip = COPIED * (np.arange(of.size) - np.repeat(np.cumsum(many) - many, many))
    to, start, size = to[of] + skip, start[of] + skip, np.minimum(size[of] - skip, COPIED)
    ends, at = np.cumsum(size), 0
    while at < of.size:
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COPIED, side="right")))
        n = size[at:last]
        step = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[at:last], n) + step] = data[np.repeat(start[at:last], n) + step]
        at = last


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, list[list[tuple[int, int]]]]:
    """Formatted strings of runs of turns (first: index of each run's first turn) and their loss spans in code points."""
    large = pa.large_string()
    head = pc.binary_join_element_wise(pa.scalar(START, large), escaped(roles.cast(large), role=True), pa.scalar("\n", large), pa.scalar("", large))
    body = escaped(texts.cast(large))
    foot = np.frombuffer((END + "\n").encode(), np.uint8)
    hd, hs, hn = _bytes(head)
    bd, bs, bn = _bytes(body)
    size = hn + bn + foot.size
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    _scatter(out, at, hd, hs, hn)
    _scatter(out, at + hn, bd, bs, bn)
    _scatter(out, at + hn + bn, foot, np.zeros(len(size), np.int64), np.full(len(size), foot.size))
    ends = np.append(at, out.size)
    offsets = np.append(at[first], out.size) if len(first) else np.zeros(1, np.int64)
    formatted = pa.Array.from_buffers(large, len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    # Loss spans count code points: heads and bodies have as many as they have characters.
    hc, bc = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (head, body))
    chars = hc + bc + foot.size
    begin = np.cumsum(chars) - chars
    loss = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
    spans = []
    for i, j in zip(first, np.append(first[1:], len(ends) - 1), strict=True):
        own = np.flatnonzero(loss[i:j]) + i
        spans.append([{"start": int(begin[t] + hc[t] - begin[i]), "end": int(begin[t] + hc[t] + bc[t] - begin[i])} for t in own])
    return formatted, spans


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (1, 2))
        ends, to = np.cumsum(size), 0
        while to < batch.num_rows:
            at, base = to, ends[to - 1] if to else 0
            to = min(at + CHUNK, max(at + 1, int(np.searchsorted(ends, base + BYTES, side="right"))))
            b = batch.slice(at, to - at)
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
            formatted, spans = assemble(b.column(1).fill_null(""), b.column(2).fill_null(""), first)
            turns = np.diff(np.append(first, len(ids)))
            chunk = number + np.arange(len(first))
            number += len(first)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(first)), pa.array(chunk), pa.array(turns), formatted.cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["conv_id", "chunk", "n_turns", "formatted", "loss"],
            )


#: Stands for a null conversation inside a task.
NO_ID = np.iinfo(np.int64).min


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, chunk, n_turns, formatted, loss): each conversation in chunks, in order of chunk.

    Turns stand by `turn` (null last), then by role and text; rows that repeat each count. Null roles and texts count as empty. loss has
    the spans of formatted, in code points, that assistant texts take. Turns without a conversation are one of their own.
    Texts may have any length: a turn is assembled in some ten times its bytes. An empty table gives an empty result; other columns are not looked at.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(role).alias("role"), F.col(text).alias("text"), F.col(turn).alias("turn"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    # Ranges by conversation and turn; equal ones stay together, so that ties are settled by the sort in one task.
    ranged = rows.repartitionByRange(partitions(turns.sparkSession), "conv_id", F.col("turn").asc_nulls_last()).sortWithinPartitions(*order)
    return ranged.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


# Nothing is ever taken back, so that a long text needs no memory of where it could be.
TURN = re.compile(re.escape(START) + r"((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!\|im_end\|>))*+)" + re.escape(END) + "\n", re.DOTALL)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted chunk."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        yield unescaped(found[1]), unescaped(found[2])
        at = found.end()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose chunks come in order; only hash states are held from chunk to chunk."""
    state, out = None, []

    def put() -> None:
        out.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]))

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_chunks"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    for batch in batches:
        for conv, text, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    put()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said in parsed(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescaped(text[span["start"] : span["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
            state[6] += 1
        if out:
            yield pack()
            out = []
    if state is not None:
        put()
    if out:
        yield pack()


def chat_digests(turns: DataFrame, **columns) -> DataFrame:
    """One row for each conversation, read back from the formatted chunks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_chunks.

    A digest runs over a whole conversation in order, so its chunks meet in one task, one after another; that task holds a chunk and the
    hash states, whatever the conversation's length. A turn of any length is held some five times over; what format_chats() says of nulls, ties, repeated rows and empty tables holds here.
    """
    chunks = save(format_chats(turns, **columns), "chats")
    by = chunks.select("conv_id", "formatted", "loss", "chunk").repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk")
    return by.select("conv_id", "formatted", "loss").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_chunks long")
