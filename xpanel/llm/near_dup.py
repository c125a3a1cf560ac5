"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification, connected classes.

A document is the set of its 5-word shingles (words: runs of ASCII letters and digits and of non-ASCII characters,
lower-cased; a text of one to four words is one shingle). Two documents are linked if the Jaccard similarity of their sets is
THRESHOLD or more, and a class is what links connect. Documents with equal sets are one node, so copies are never paired.

DartMinHash throws darts into the plane of weight and rank over each element: every unit cell of an element holds a
Poisson(1) number of darts that depend on the element alone; a dart counts if it is below the element's weight, and
each of the K coordinates keeps its dart of lowest rank. About K ln K + 2K darts per document are looked at, not K
hashes per element. Sets weigh each shingle 1. With weighted=True a shingle weighs its count, and similarity is that of multisets
(the sum of least counts over the sum of greatest): a shingle's copies are compared as elements of their own.

Nodes that agree on one of BANDS bands of ROWS coordinates (a similarity of 0.8 is missed once in 40,000) meet in a
bucket; of buckets with the same members one is kept. A bucket is cut into chunks of about BLOCK nodes by a hash (fewer, if they
have more than BLOCK_SHINGLES), and each pair of chunks is a group of its own: a task holds two chunks, compares them all exactly by one matrix
product over the shingles they share, and returns what connects them, not the pairs. So a hot bucket of n nodes is
n / BLOCK times its rows and n * n comparisons dealt over many tasks, and no link between two of its nodes is lost.

Null texts and texts without words have no shingles and are classes of their own. A class is named by its smallest
doc_id (null only if it has no other). Repeated rows each get a row; further columns are ignored.

A null doc_id names nothing and a doc_id may stand with several texts, so the document that a class keeps is chosen by row:
by id and a hash of the text. A text without shingles and without an id is a row of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xpanel.llm.common import frugal, materialise, mix64, nested, text_slices
from xpanel.llm.words import word_hashes

SHINGLE, THRESHOLD, BANDS, ROWS, BLOCK, BLOCK_SHINGLES = 5, 0.8, 20, 4, 256, 2_000_000
K = BANDS * ROWS
SKETCH = "doc_id long, text_key long, set_key long, n_shingles int, bands array<long>, shingles binary"
_CDF = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the sorted distinct shingle hashes, their counts, and the n + 1 offsets between texts."""
    words, offsets = word_hashes(texts)
    n_words = np.diff(offsets)
    n = np.where(n_words > 0, np.maximum(n_words - SHINGLE + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    stop, padded = np.repeat(offsets[1:], n), np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    h = np.full(len(doc), _C)
    for j in range(SHINGLE):
        h = h * _A + np.where(at + j < stop, padded[at + j], _B)
    h = mix64(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(h)]]))
    return h[first], counts, np.searchsorted(doc[first], np.arange(len(texts) + 1))


def dart_minhash(elements: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int = K) -> np.ndarray:
    """[text, coordinate] -> the dart kept there; 0 for texts without elements. Weights are positive numbers."""
    n = len(offsets) - 1
    out = np.zeros((n, k), np.uint64)
    sums = np.concatenate([[0], np.cumsum(weights, dtype=np.float64)])
    total = sums[offsets[1:]] - sums[offsets[:-1]]
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[todo] = (k * math.log(k) + 2 * k) / total[todo]  # ranks below it hold about so many darts
    while len(todo):
        sizes = offsets[todo + 1] - offsets[todo]
        doc = np.repeat(np.arange(len(todo)), sizes)
        el = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[todo], sizes)
        # a row per unit cell of weight and rank
        high, wide = np.ceil(weights[el]).astype(np.int64), np.ceil(reach[todo][doc]).astype(np.int64)
        cells = high * wide
        row = np.repeat(np.arange(len(el)), cells)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(cells) - cells, cells)
        rank_cell, weight_cell = cell % wide[row], cell // wide[row]
        seed = mix64(elements[el[row]] + mix64(rank_cell.astype(np.uint64) * _A + weight_cell.astype(np.uint64) * _B))
        darts = np.searchsorted(_CDF, (seed >> np.uint64(11)) * 2.0**-53, "right")
        keys, ranks, ids = [], [], []
        for j in range(int(darts.max(initial=0))):
            has = np.flatnonzero(darts > j)
            dart = mix64(seed[has] + np.array(j + 1, np.uint64)[None] * _C)
            place = mix64(dart ^ _A)
            rank = rank_cell[has] + (place >> np.uint64(32)) * 2.0**-32
            weight = weight_cell[has] + (place & np.uint64(0xFFFFFFFF)) * 2.0**-32
            ok = (weight < weights[el[row[has]]]) & (rank < reach[todo][doc[row[has]]])
            keys.append((doc[row[has]] * k + (mix64(dart ^ _B) % np.uint64(k)).astype(np.int64))[ok])
            ranks.append(rank[ok])
            ids.append(dart[ok])
        key, rank, dart = (np.concatenate(x) if x else np.empty(0) for x in (keys, ranks, ids))
        order = np.lexsort((rank, key))
        key, dart = key[order].astype(np.int64), dart[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        kept = np.zeros(len(todo) * k, np.uint64)
        kept[key[first]] = dart[first]
        kept = kept.reshape(-1, k)
        full = (kept != 0).all(1)
        out[todo[full]] = kept[full]
        todo = todo[~full]
        reach[todo] *= 2
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signatures), BANDS)).copy()
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    for r in range(ROWS):
        h = mix64(h * _A + parts[:, :, r])
    return h.view(np.int64)


def _sketch(weighted: bool):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, limit=1_000_000):
                sets, counts, offsets = shingle_sets(b.column("text").to_pylist())
                sizes, n = np.diff(offsets), b.num_rows
                weights = counts if weighted else np.ones(len(sets), np.int64)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix64(sets * _B + weights.astype(np.uint64)))])
                set_key = mix64(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(np.uint64)).view(np.int64)
                bands = band_keys(dart_minhash(sets, weights, offsets)).ravel()
                short, spans = (sets >> np.uint64(32)).astype("<u4"), offsets
                if weighted:  # the copies of a shingle are elements of their own
                    ends = np.cumsum(counts)
                    copy = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
                    short = (mix64(np.repeat(sets, counts) + copy.astype(np.uint64)) >> np.uint64(32)).astype("<u4")
                    spans = np.concatenate([[0], ends])[offsets]
                columns = [
                    b.column("doc_id"), b.column("text_key"), pa.array(set_key, mask=sizes == 0), pa.array(sizes.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands)),
                    pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((spans * 4).astype(np.int32)), pa.py_buffer(short)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "set_key", "n_shingles", "bands", "shingles"])

    return frugal("near-dup", sketch)


def sketches(docs: DataFrame, weighted: bool = False) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(_sketch(weighted), SKETCH)


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """The exact Jaccard similarities of sorted distinct arrays, all with all."""
    sizes = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = np.zeros((2, 2))
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, shared = np.repeat(np.arange(len(sets)), sizes), times > 1  # what one set alone has meets nothing
        column, keep = np.cumsum(shared) - 1, shared[at]
        owner, column, both = owner[keep], column[at[keep]], np.zeros((len(sets), len(sets)))
        for lo in range(0, int(shared.sum()), 8192):
            part = (column >= lo) & (column < lo + 8192)
            has = np.zeros((len(sets), 8192), np.float32)
            has[owner[part], column[part] - lo] = 1
            both += has @ has.T
    return both / (sizes[:, None] + sizes[None, :] - both)


def connect(linked: np.ndarray) -> np.ndarray:
    """For each node the smallest node that the symmetric matrix connects it with."""
    n = len(linked)
    linked = linked | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        nearer = np.where(linked, label[None, :], n).min(1)
        nearer = nearer[nearer]
        if (nearer == label).all():
            return label
        label = nearer


def _compare(threshold: float):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The rows of each (band, lo, hi), which come sorted."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            keys = np.column_stack([table.column(c).to_numpy() for c in ("band", "lo", "hi")])
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            starts = np.concatenate([[0], cuts])
            for a, b in zip(starts[:-1], starts[1:]):
                yield table.slice(a, b - a)
            held = table.slice(starts[-1]) if len(table) else None
        if held is not None and len(held):
            yield held

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [], []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

        for g in groups(batches):
            if len(g) < 2:
                continue
            keys = g.column("set_key").to_numpy()
            label = connect(similarities([np.frombuffer(x.as_buffer(), "<u4") for x in g.column("shingles")]) >= threshold)
            for i in np.flatnonzero(label != np.arange(len(label))):
                low.append(min(keys[i], keys[label[i]]))
                high.append(max(keys[i], keys[label[i]]))
            if len(low) > 10_000:
                yield out()
                low, high = [], []
        yield out()

    return frugal("near-dup", compare)


def links(sketched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b (a < b): pairs of sets that connect all sets whose similarity is the threshold or more, as far as they meet in a band.

    sketched: set_key, bands, shingles; its rows may repeat sets.
    """
    sketched = sketched.filter(F.col("set_key").isNotNull())
    nodes = sketched.groupBy("set_key").agg(F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    rows = nodes.select("set_key", "n", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("set_key")).alias("members")).filter("size > 1")
    chunks = F.ceil(F.greatest(F.col("size") / BLOCK, F.least(F.col("n") / BLOCK_SHINGLES, F.col("size")))).cast("int")
    buckets = buckets.groupBy("size", "members").agg(F.min("band").alias("band"), F.first("n").alias("n")).select("band", chunks.alias("chunks"))
    rows = rows.drop("n")
    live = rows.join(buckets, "band").withColumn("chunk", F.pmod(F.xxhash64("set_key", "band"), F.col("chunks")).cast("int"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    live = materialise(live.select("band", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "set_key"))
    sets = sketched.groupBy("set_key").agg(F.first("shingles").alias("shingles"))
    dealt = live.join(sets, "set_key").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    return materialise(dealt.mapInArrow(_compare(threshold), "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that the edges (a, b) connect a node with. Minimum labels with pointer jumping."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")))
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("next"))
        jumped = nearer.join(labels.select(F.col("node").alias("next"), F.col("label").alias("far")), "next", "left")
        after = materialise(jumped.select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("moved")))
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels


def classify(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """doc_id, text_key, set_key, label, class_id, n_shingles: a row per row of docs; label tells classes apart, null if without shingles."""
    sketched = materialise(sketches(docs, weighted))
    edges = links(sketched, threshold)
    labels = components(edges)
    sets = sketched.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("first_id"))
    sets = sets.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").select("set_key", "first_id", F.coalesce("label", "set_key").alias("label"))
    named = sets.groupBy("label").agg(F.min("first_id").alias("class_id"))
    sets = sets.join(named, "label").select("set_key", "label", "class_id")
    rows, named = sketched.select("doc_id", "text_key", "set_key", "n_shingles"), ["set_key", "doc_id", "text_key", "n_shingles", "label", "class_id"]
    without = rows.filter(F.col("set_key").isNull()).withColumn("label", F.lit(None).cast("long")).withColumn("class_id", F.col("doc_id"))  # not shuffled to one task
    return rows.filter(F.col("set_key").isNotNull()).join(sets, "set_key").select(named).unionByName(without.select(named))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = False) -> DataFrame:
    """doc_id, class_id, n_shingles: a row per row of docs."""
    return classify(docs, threshold, weighted).select("doc_id", "class_id", "n_shingles")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, columns as given: the row with the smallest (doc_id, set_key, text hash), ids before nulls (one row of equal ones)."""
    rows = classify(docs, threshold)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_key", "text_key")
    chosen = rows.filter("label is not null").groupBy("label").agg(F.min(place).alias("p")).select("p.doc_id", "p.text_key", F.lit(False).alias("alone"))
    single = rows.filter("label is null").select("doc_id", "text_key", F.col("doc_id").isNull().alias("alone")).distinct()
    keep = materialise(chosen.unionByName(single)).toDF("_keep_id", "_keep_text", "_alone")
    held = docs.select(nested(docs).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    held = held.join(keep, F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_text") == F.col("_keep_text")))
    held = held.withColumn("_row", F.when(F.col("_alone"), F.monotonically_increasing_id()))
    return held.dropDuplicates(["_keep_id", "_keep_text", "_row"]).select("row.*")
