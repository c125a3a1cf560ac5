"""Best-fit decreasing packing of tokenised documents into sequences.

Tokenising happens once, in Arrow batches, and its short row per piece is written to the shared folder. Pieces that fill a
sequence are one, and are not shuffled. The others are dealt evenly into shards of about SHARD_PIECES by their place in the scan
(so no key can be hot), and each shard is packed by best-fit decreasing: a segment tree over remaining capacities finds the
tightest open sequence in logarithmic time. A shard loses less than one sequence against packing all at once.

Null and empty texts are the end id alone. Repeated rows are documents of their own. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xpanel.llm.common import frugal, materialise, text_slices, vocabulary_path, worker_cache

CAPACITY, SHARD_PIECES, CACHE_WORDS, CACHE_LETTERS, CACHE_BYTES = 2048, 20_000, 600_000, 400_000, 16_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: Letters that normalisation only lower-cases, then marks that are one piece.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-;=?@\[-`{}~]*)")


class WordTokenizer:
    """Token ids of texts as little-endian uint32 bytes, encoding each distinct blank-separated word once.

    The tokenizer drops white space and neither its normaliser nor its merges reach across a blank, so words can be
    encoded apart; letters with punctuation after them are two pieces to it, and it lower-cases, so `Word,` is `word` and
    `,`. Unknown runs of letters are encoded many in a string: each ends with the one id that carries the word end; where they
    are lower-case ASCII nothing but the merges applies, so these run alone. The memory of words is emptied when it holds
    CACHE_WORDS words or CACHE_BYTES of their characters, that of letters and marks at CACHE_LETTERS or CACHE_BYTES.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.known, self.letters = Tokenizer.from_file(vocabulary_path(path)), {}, {}
        self.held = self.held_letters = 0  # characters
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[ends] = True
        self.merges = Tokenizer.from_file(vocabulary_path(path))
        self.merges.normalizer, self.merges.pre_tokenizer = None, WhitespaceSplit()

    def _encode(self, texts: list[str], by=None) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in (by or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_letters(self, words: list[str], by) -> None:
        for i in range(0, len(words), 512):
            some = words[i : i + 512]
            ids = self._encode([" ".join(some)], by)[0]
            ends = [0, *(4 * np.flatnonzero(self.is_end[np.frombuffer(ids, "<u4")]) + 4).tolist()]
            if len(ends) == len(some) + 1:
                self.letters.update(zip(some, [ids[a:b] for a, b in zip(ends, ends[1:])]))
            else:
                self.letters.update(zip(some, self._encode(some)))

    def _learn(self, words: list[str]) -> None:
        plain, letters_of, marks_of, whole = [], [], [], []  # strings alone: the garbage collector doesn't follow them
        for w in words:
            if m := PLAIN.fullmatch(w):
                plain.append(w)
                letters_of.append(m[1].lower())
                marks_of.append(m[2])
            else:
                whole.append(w)
        if len(self.letters) > CACHE_LETTERS or self.held_letters > CACHE_BYTES:  # only new words look here
            self.letters.clear()
            self.held_letters = 0
        self.known.update(zip(whole, self._encode(whole)))
        letters = [a for a in dict.fromkeys(letters_of) if a not in self.letters]
        marks = [b for b in dict.fromkeys(marks_of) if b and b not in self.letters]
        self.held_letters += sum(map(len, letters)) + sum(map(len, marks))
        self.letters.update(zip(marks, self._encode(marks)))
        self._learn_letters([a for a in letters if a.isascii()], self.merges)
        self._learn_letters([a for a in letters if not a.isascii()], self.tokenizer)
        of = self.letters
        self.known.update(zip(plain, [of[a] + of[b] if b else of[a] for a, b in zip(letters_of, marks_of)]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words = dict.fromkeys(chain.from_iterable(split))
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known.clear()
            self.held, new = 0, list(words)
        self.held += sum(map(len, new))
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, so its words are known across batches and tasks."""
    return worker_cache(f"packing {path}", lambda: WordTokenizer(path))


def _cut(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = tokenizer(path), TaskContext.get().partitionId() << 33
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in text_slices(batch, limit=1_000_000):
                out = [array("q") for _ in range(6)]
                docs = part.column("doc_id").to_pylist()
                ids_of = []
                for doc, ids in zip(docs, encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        ids_of.append(doc)
                        for column, value in zip(out[1:], (k, at // 4, len(piece) // 4, zlib.crc32(piece), place)):
                            column.append(value)
                        place += 1
                columns = [pa.array(ids_of, pa.int64()), pa.array(np.array(out[1], np.int32)), *[pa.array(np.array(c, np.int64)) for c in out[2:]]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    return frugal("packing", cut)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer_path, end_id, capacity), PIECES)


class CapacityTree:
    """A segment tree over remaining capacities: how many open sequences have each; finds the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= least that an open sequence has."""
        node = least + self.size
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ties in length in the given order."""
    order = np.argsort(-lengths, kind="stable")
    tree, open_at = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in order:
        need = int(lengths[i])
        left = tree.tightest(need)
        if left is None:
            s, left = n, capacity
            n += 1
        else:
            s = open_at[left].pop()
            tree.add(left, -1)
        sequence[i], offset[i] = s, capacity - left
        if left > need:
            open_at[left - need].append(s)
            tree.add(left - need, 1)
    return sequence, offset


def _pack(capacity: int):
    def pack(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("place", kind="stable")
        sequence, offset = best_fit_decreasing(pieces["length"].to_numpy(np.int64), capacity)
        return pieces.assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)[[c.split()[0] for c in PACKED.split(", ")]]

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents with their sequence and their place in it. tokenizer_path: a file, or the name of a public one."""
    pieces = materialise(tokenised_pieces(docs, tokenizer_path, end_id, capacity))
    full, rest = pieces.filter(F.col("length") == capacity), pieces.filter(F.col("length") < capacity)
    shards = max(1, round(rest.count() / SHARD_PIECES))
    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")
    packed = rest.groupBy(shard.alias("shard")).applyInPandas(_pack(capacity), PACKED)
    alone = full.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
