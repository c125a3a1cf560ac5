"""Hashed words of texts: lower-cased runs of ASCII letters and digits and of non-ASCII characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from xpanel.llm.common import mix64

_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_BREAK = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_AT = 64  #: places in a word that have a table of their own
_TABLE = mix64(np.arange(1, _AT * 256 + 1, dtype=np.uint64)).reshape(_AT, 256)
PIECE_BYTES = 1_000_000
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  #: a word of a lower-cased text


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts and the n + 1 offsets between texts."""
    encoded = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    inside = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the last byte is a line feed
    first = np.concatenate([[0], edges[1::2]]) if len(data) and inside[0] else edges[::2]
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.flatnonzero(inside)
    lengths = (edges[::2] if inside[0] else edges[1::2]) - first
    starts = np.cumsum(lengths) - lengths
    place = at - np.repeat(first, lengths)
    values = _TABLE[place % _AT, data[at]]
    if lengths.max() > _AT:
        far = np.flatnonzero(place >= _AT)
        values[far] = mix64(values[far] + place[far].astype(np.uint64))
    ends = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    return mix64(np.add.reduceat(values, starts) + lengths.astype(np.uint64)), np.searchsorted(first, ends)


def word_pieces(texts: list[str | None], size: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Text numbers and pieces of about `size` characters in all; a longer text is cut between words and goes on in further ones."""
    owners, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = at + size
            if end < len(text):
                cut = _BREAK.search(text, end)
                end = cut.start() if cut else len(text)
            owners.append(i)
            pieces.append(text[at:end])
            held += len(pieces[-1])
            at = end
            if held >= size:
                yield owners, pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield owners, pieces


def word_hashes(texts: list[str | None], size: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts and the n + 1 offsets between texts."""
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    for owners, pieces in word_pieces(texts, size):
        words, offsets = _hashes(pieces)
        hashes.append(words)
        np.add.at(counts, owners, np.diff(offsets))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)])


def word_chunks(texts: list[str | None], before: int, size: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Word hashes, their text numbers, and how many words at the beginning repeat the last `before` words of the chunk before,
    where a text goes on."""
    words, docs = np.empty(0, np.uint64), np.empty(0, np.int64)
    for owners, pieces in word_pieces(texts, size):
        tail = np.flatnonzero(docs[-before:] == owners[0]) if before else []
        kept = (words[-before:][tail], docs[-before:][tail]) if len(tail) else (words[:0], docs[:0])
        hashes, offsets = _hashes(pieces)
        words, docs = np.concatenate([kept[0], hashes]), np.concatenate([kept[1], np.repeat(owners, np.diff(offsets))])
        yield words, docs, len(kept[0])
