"""Stupid-backoff scores of all documents by trigrams, computed relationally.

A document does not vote for itself: documents are dealt into two halves by a hash of their id, and each half is scored by
the counts of the other. A word scores c(trigram) / c(its first two words); where the other half has not seen the trigram ALPHA *
c(pair) / c(first); where it has not seen the pair ALPHA^2 * u(word), u being c(word) / N or, of an unseen word, ALPHA / N. A
text's first word scores u(word), its second begins with pairs. A document's score is the mean log10 of its words' scores.

Nothing is pruned or capped. Texts are read once: documents of one half become chunks of about CHUNK characters, a row of arrays
each. A chunk asks for its n-grams: its distinct ones travel with their occurrences as one sorted array for each range of hashes,
of about PART_BYTES in all. The task of a range adds up each half and answers every chunk with the other half's counts, in the
order asked. A chunk then has every count that the scores of its documents need. No key is hot: a chunk asks once for an n-gram.

A pair or trigram that the other half has consists of words that both halves have. Chunks therefore leave out the others as long as
the words of both halves are few (BROADCAST_WORDS, 8 bytes each, broadcast). Pairs and trigrams can be asked for in passes by hash, so
what stands on disk is a pass's share.

Words are as in `words`, lower-cased; they and n-grams are 64-bit hashes. Null texts and texts without words have n_words 0 and
a null score. Rows that repeat a doc_id (null too) are texts of one document; further columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xpanel.llm.common import delete, frugal, intermediates, materialise, mix64, shuffles_released, text_slices
from xpanel.llm.words import WORD_SQL, word_chunks

ALPHA, PASSES = 0.4, 1
CHUNK, PART_BYTES, BROADCAST_WORDS = 2_000_000, 16_000_000, 2_000_000
CHUNKS = pa.schema([("chunk", pa.int64()), ("half", pa.int32()), ("before", pa.int32()), ("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()), ("ids", pa.binary()), ("n_words", pa.int64())])
ASKED = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("half", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
ANSWERS = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("width", pa.int32()), ("counts", pa.binary())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def half(doc_id: Column) -> Column:
    """0 or 1 by an MD5 of the id (null: empty)."""
    return (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("long") % 2).cast("int")


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _A + b)


def trigram_keys(ab: np.ndarray, bc: np.ndarray) -> np.ndarray:
    return mix64(ab * _B + bc)


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _unsigned(most: int) -> str:
    """The narrowest type that holds numbers up to `most`."""
    return next(f"<u{k}" for k in (1, 2, 4, 8) if most < 256**k)


def placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them."""
    codes, distinct = pd.factorize(keys)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[codes]


def _looked_up(keys: np.ndarray, of: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, `of` being keys with values, in order; 0 where it is none of them."""
    if not len(of):
        return np.zeros(len(keys), values.dtype)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return np.where(of[at] == keys, values[at], values.dtype.type(0))


# --- chunks -----------------------------------------------------------------------------------------------------------


def _cut(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, nothing = TaskContext.get().partitionId() << 33, (np.empty(0, np.uint64), np.empty(0, np.int64), 0)
        for batch in batches:
            for g in (0, 1):
                for b in text_slices(batch.filter(pc.equal(batch.column("half"), g)), limit=size):
                    docs, found = b.column("doc_id").to_pylist(), word_chunks(b.column("text").to_pylist(), 2, size)
                    for words, owners, before in itertools.chain([next(found, nothing)], found):  # texts without words are a chunk too
                        distinct, ids = placed(words)
                        sizes = np.bincount(owners, minlength=len(docs))
                        yield _row(CHUNKS, number, g, before, docs, sizes.astype("<u4").tobytes(), distinct.tobytes(), ids.astype(_unsigned(len(distinct))).tobytes(), len(words) - before)
                        number += 1

    return frugal("lm", cut)


class Chunk:
    """Words of documents of one half; the first `before` of them repeat the end of the chunk before, where a text goes on."""

    def __init__(self, row: dict, known: np.ndarray | None):
        self.chunk, self.half, self.before, self.docs = row["chunk"], row["half"], row["before"], row["docs"]
        self.distinct, self.ids = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["ids"], _unsigned(len(row["words"]) // 8))
        self.owners = np.repeat(np.arange(len(self.docs)), np.frombuffer(row["sizes"], "<u4"))
        self.words, self.known = self.distinct[self.ids], known

    def grams(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of `level` words end that the other half may have, and their keys."""
        if level == 1:
            return np.arange(len(self.ids)), self.words
        inside = self.owners[level - 1 :] == self.owners[: 1 - level]
        if self.known is not None:
            known = _looked_up(self.distinct, self.known, np.ones(len(self.known), bool))[self.ids]
            for k in range(level):
                inside = inside & known[k : len(known) - level + 1 + k]
        at = np.flatnonzero(inside) + level - 1
        if level == 2:
            return at, pair_keys(self.words[at - 1], self.words[at])
        pairs = pair_keys(self.words[:-1], self.words[1:])
        return at, trigram_keys(pairs[at - 2], pairs[at - 1])


# --- counts -----------------------------------------------------------------------------------------------------------


def _ask(level: int, parts: int, passes: int, turn: int, known):
    """The chunks' distinct n-grams of `level` words by range of hashes, with their occurrences (none in the words that are repeated)."""
    edges = np.array([(p << 32) // parts << 32 for p in range(1, parts)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.slice(i, 1).to_pylist()[0], known and known.value)
                if not len(c.ids):
                    continue
                at, keys = c.grams(level)
                if passes > 1:
                    mine = keys % np.uint64(passes) == turn
                    at, keys = at[mine], keys[mine]
                if c.before:
                    keys, place = placed(keys)
                    n = np.bincount(place, at >= c.before, len(keys))
                else:
                    keys = np.sort(keys)
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
                    keys, n = keys[first], np.diff(np.append(first, len(keys)))
                cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
                mine = np.flatnonzero(np.diff(cuts))
                spans, n = [(cuts[p], cuts[p + 1]) for p in mine], n.astype("<u4")
                columns = mine, np.full(len(mine), c.chunk), np.full(len(mine), c.half), [keys[a:b].tobytes() for a, b in spans], [n[a:b].tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, ASKED)], schema=ASKED)

    return frugal("lm", ask)


def _summed(held: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(r["keys"], "<u8") for r in held)])
    n = np.concatenate([np.empty(0, "<u4"), *(np.frombuffer(r["n"], "<u4") for r in held)]).astype(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    keys, n = keys[first], np.add.reduceat(n, first) if len(first) else n
    return keys[n > 0], n[n > 0]


def _answer(level: int):
    """The other half's count of each n-gram a chunk asked for. The rows of a range come one after the other. Of words, a row without
    a chunk holds those of the range that both halves have."""

    def answered(held: list[dict]) -> Iterator[pa.RecordBatch]:
        tables = [_summed([r for r in held if r["half"] == g]) for g in (0, 1)]
        for r in held:
            counts = _looked_up(np.frombuffer(r["keys"], "<u8"), *tables[1 - r["half"]])
            counts = counts.astype(_unsigned(counts.max(initial=0)))
            yield _row(ANSWERS, r["part"], r["chunk"], counts.itemsize, counts.tobytes())
        if level == 1:
            yield _row(ANSWERS, held[0]["part"], None, 8, np.intersect1d(tables[0][0], tables[1][0], assume_unique=True).tobytes())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["part"] != held[0]["part"]:
                    yield from answered(held)
                    held = []
                held.append(r)
        if held:
            yield from answered(held)

    return frugal("lm", answer)


def counts(chunks: DataFrame, level: int, parts: int, passes: int = 1, turn: int = 0, known=None) -> DataFrame:
    """ANSWERS to what the chunks ask for at a level; known: a broadcast of the words that both halves have."""
    asked = chunks.mapInArrow(_ask(level, parts, passes, turn, known), ddl(ASKED))
    answers = asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_answer(level), ddl(ANSWERS))
    return answers.select(F.lit(level).alias("level"), F.lit(turn).alias("turn"), "part", "chunk", "width", "counts")


def partitions(n_words: float) -> int:
    """Hash ranges of the n-grams of so many words: a key and its occurrences a word, PART_BYTES in each."""
    return max(8, math.ceil(n_words * 12 / PART_BYTES))


# --- scores -----------------------------------------------------------------------------------------------------------


def _score(totals: list[float], passes: int, known):
    """A chunk's words with the counts of the other half: n_words and summed log10 scores of its documents."""

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(chunk.to_pylist()[0], known and known.value)
        n, told = len(c.ids), {}
        for r in sorted(answers.to_pylist(), key=lambda r: r["part"]):
            told.setdefault((r["level"], r["turn"]), []).append(np.frombuffer(r["counts"], f"<u{r['width']}"))
        seen = np.zeros((4, n))
        for level in (1, 2, 3):
            at, keys = c.grams(level) if n else (np.empty(0, np.int64), np.empty(0, np.uint64))
            keys, place = placed(keys)
            values, turns = np.zeros(len(keys)), keys % np.uint64(passes if level > 1 else 1)
            for (of, turn), arrays in told.items():
                if of == level:
                    values[turns == turn] = np.concatenate(arrays)
            seen[level, at] = values[place]
        words, pairs, trigrams = seen[1:]
        a, last = math.log10(ALPHA), np.append(1, words)[:n]
        same = np.append(False, c.owners[1:] == c.owners[:-1])[:n]
        two = same & np.append(False, same)[:n]
        log = lambda x: np.log10(np.maximum(x, 1))  # noqa: E731  zeros are not looked at
        value = np.log10(np.where(words > 0, words, ALPHA) / totals[1 - c.half]) + same * a
        value = np.where(pairs > 0, log(pairs) - log(last), value) + two * a
        value = np.where(trigrams > 0, log(trigrams) - log(np.append(1, pairs)[:n]), value)[c.before :]
        owners, size = c.owners[c.before :], len(c.docs)
        columns = c.docs, np.bincount(owners, minlength=size), np.bincount(owners, value, size)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SCORES)], schema=SCORES)

    return score


def score_corpus(docs: DataFrame, filter_keys: int | None = None, passes: int = PASSES) -> DataFrame:
    """doc_id, n_words, score: the mean log10 stupid-backoff score of a document's words under the other half's counts. filter_keys: up to
    how many words of both halves are broadcast (BROADCAST_WORDS); passes: in how many parts pairs and trigrams are asked for."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", half(F.col("doc_id")).alias("half"))
    with shuffles_released(spark), intermediates() as made:
        chunks = materialise(docs.mapInArrow(_cut(CHUNK), ddl(CHUNKS)))
        by_half = {r["half"]: r["n"] for r in chunks.groupBy("half").agg(F.sum("n_words").alias("n")).collect()}
        totals = [float(max(by_half.get(g, 0), 1)) for g in (0, 1)]
        parts, known = partitions(sum(totals)), None
        answers = materialise(counts(chunks, 1, partitions(sum(totals) / 5)))  # fewer distinct words than words
        both = answers.filter("chunk IS NULL")
        if (both.agg(F.sum(F.length("counts"))).first()[0] or 0) <= 8 * (BROADCAST_WORDS if filter_keys is None else filter_keys):
            held = sorted(both.select("part", "counts").collect())
            known = spark.sparkContext.broadcast(np.concatenate([np.empty(0, "<u8"), *(np.frombuffer(r["counts"], "<u8") for r in held)]))
        for level in (2, 3):
            for turn in range(passes):
                answers = answers.unionByName(materialise(counts(chunks, level, max(8, math.ceil(parts / passes)), passes, turn, known)))
        scored = chunks.groupBy("chunk").cogroup(answers.filter("chunk IS NOT NULL").groupBy("chunk")).applyInArrow(_score(totals, passes, known), ddl(SCORES))
        sums = materialise(scored.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("score").alias("score")))
    delete(spark, made[:-1])
    return sums.select("doc_id", "n_words", F.round(F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")), 6).alias("score"))


def oracle() -> str:
    """score_corpus in SQL: every word with its counts in the other half."""
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS rid, doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT % 2 AS INTEGER) AS half,
             regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}') AS ws FROM documents),
    t AS (SELECT rid, doc_id, half, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)),
    n AS (SELECT h.half, greatest(count(t.w), 1)::DOUBLE AS n FROM (VALUES (0), (1)) h(half) LEFT JOIN t ON t.half = 1 - h.half GROUP BY h.half),
    c1 AS (SELECT 1 - half AS half, w, count(*) AS c FROM t GROUP BY ALL),
    c2 AS (SELECT 1 - half AS half, v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY ALL),
    c3 AS (SELECT 1 - half AS half, u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY ALL),
    s AS (
      SELECT t.doc_id, log10(CASE
        WHEN c3.c IS NOT NULL THEN c3.c / ctx.c
        WHEN t.u IS NOT NULL THEN CASE WHEN c2.c IS NOT NULL THEN {ALPHA} * c2.c / mid.c ELSE {ALPHA} * {ALPHA} * coalesce(c1.c, {ALPHA}) / n.n END
        WHEN t.v IS NOT NULL THEN CASE WHEN c2.c IS NOT NULL THEN c2.c / mid.c ELSE {ALPHA} * coalesce(c1.c, {ALPHA}) / n.n END
        ELSE coalesce(c1.c, {ALPHA}) / n.n END) AS score
      FROM t JOIN n USING (half) LEFT JOIN c1 ON c1.half = t.half AND c1.w = t.w LEFT JOIN c1 mid ON mid.half = t.half AND mid.w = t.v
      LEFT JOIN c2 ON c2.half = t.half AND c2.v = t.v AND c2.w = t.w LEFT JOIN c2 ctx ON ctx.half = t.half AND ctx.v = t.u AND ctx.w = t.v
      LEFT JOIN c3 ON c3.half = t.half AND c3.u = t.u AND c3.v = t.v AND c3.w = t.w),
    g AS (SELECT doc_id, sum(score) AS total FROM s GROUP BY doc_id), sizes AS (SELECT doc_id, CAST(sum(len(ws)) AS BIGINT) AS n_words FROM d GROUP BY doc_id)
    SELECT sizes.doc_id, n_words, round(total / nullif(n_words, 0), 6) AS score FROM sizes LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM sizes.doc_id"""
