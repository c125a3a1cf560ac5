"""Chat formatting by columnar byte assembly.

Template: ``<|im_start|>role \\n text <|im_end|> \\n`` per turn. Inside roles and texts a control opening ``<|`` is
written with a backslash more (``<|`` -> ``<\\|``, ``<\\|`` -> ``<\\\\|``), so no text can end or begin a turn and
the original comes back by taking one backslash away. Roles also write backslash and line feed as ``\\\\`` and ``\\n``.

Rows are dealt by conversation and sorted by (turn, role, text), nulls first; each batch is assembled in numpy into one
buffer. A conversation that goes beyond a batch continues in a further part, so no conversation is gathered in memory.
Null roles and texts are empty strings; a null conv_id is a conversation of its own; repeated rows are repeated turns;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xpanel.llm.common import text_slices

START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "conv_id long, part int, formatted string, loss_starts array<long>, loss_ends array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(roles: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(escape(roles), "\\", "\\\\"), "\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets, data = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1], column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.empty(0, np.uint8)), lengths


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: bytes, end of each turn in bytes, and code points of (head, content, tail) per turn."""
    roles, texts = escape_role(roles), escape(texts)
    (role_bytes, role_n), (text_bytes, text_n) = _bytes_of(roles), _bytes_of(texts)
    head, tail = np.frombuffer(START.encode(), np.uint8), np.frombuffer(END.encode(), np.uint8)
    n = len(texts)
    lengths = np.column_stack([np.full(n, len(head)), role_n, np.ones(n, np.int64), text_n, np.full(n, len(tail))])
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    out = np.empty(ends[-1, -1] if n else 0, np.uint8)
    out[starts[:, 0, None] + np.arange(len(head))] = head
    out[starts[:, 2]] = ord("\n")
    out[starts[:, 4, None] + np.arange(len(tail))] = tail
    for k, data, size in ((1, role_bytes, role_n), (3, text_bytes, text_n)):
        out[np.arange(len(data)) + np.repeat(starts[:, k] - (np.cumsum(size) - size), size)] = data
    points = np.column_stack([pc.utf8_length(roles).to_numpy(zero_copy_only=False) + len(head) + 1, pc.utf8_length(texts).to_numpy(zero_copy_only=False), np.full(n, len(tail))]).astype(np.int64)
    return out, ends[:, 4], points


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in batches:
        for b in text_slices(batch):
            ids, roles, texts = b.column("conv_id").to_pylist(), b.column("role"), b.column("text")
            data, ends, points = assemble(roles, texts)
            firsts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            lasts = [*firsts[1:], len(ids)]
            offsets = np.concatenate([[0], ends[np.array(lasts) - 1]]).astype(np.int32)
            formatted = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(offsets), pa.py_buffer(data))
            spoken = np.array(pc.equal(roles, "assistant").to_pylist(), bool)
            before = np.cumsum(points.sum(1)) - points.sum(1)
            parts, starts, stops = [], [], []
            for i, j in zip(firsts, lasts):
                part = part + 1 if ids[i] == last else 0
                last = ids[i]
                at = (before[i:j] - before[i] + points[i:j, 0])[spoken[i:j]]
                parts.append(part)
                starts.append(at)
                stops.append(at + points[i:j, 1][spoken[i:j]])
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in firsts], pa.int64()), pa.array(parts, pa.int32()), formatted, pa.array(starts, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))],
                ["conv_id", "part", "formatted", "loss_starts", "loss_ends"],
            )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Formatted parts with their loss spans (code points within the part, assistant texts only), in order within a partition."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text)
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format, PARTS)


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Read a formatted part back: (role, text) per turn, unescaped."""
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn[len(START) :].partition("\n")
        yield unescape_role(role), unescape(text)


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        for role, text in turns(formatted):
            self.n += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for s, e in zip(starts, ends):
            text = unescape(formatted[s:e])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, done = None, []
    for batch in batches:
        for conv_id, part, formatted, starts, ends in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if part == 0:
                if now:
                    done.append(now.row())
                now = _Digest(conv_id)
            now.add(formatted, starts, ends)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), schema.types)], schema=schema)
            done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), schema.types)], schema=schema)


def digest(parts: DataFrame) -> DataFrame:
    """What the formatted parts say when read back, one row per conversation."""
    return parts.mapInArrow(_read_back, DIGEST)
