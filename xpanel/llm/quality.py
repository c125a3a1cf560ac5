"""Quality rules: word and line counts, and n-gram perplexity under a modified Kneser-Ney model of the corpus.

The model is over characters as they stand (case, marks, digits and every script), ORDER of them to an n-gram, and over all
languages together, so a text in two languages is no surprise to it. Spark counts the n-grams of all documents (a task adds
up its own first) and smooths them: continuation counts, discounts and interpolation are groupings and joins by context and
by suffix. Nothing is pruned: the model grows with the corpus as its alphabet and spelling do. What is kept is a table of n-gram
hashes with log probabilities. Up to BROADCAST_ROWS of them (12 bytes each) go to the tasks as two sorted arrays; a larger model goes
there in up to MAX_PARTS parts, one scan each; one still larger is joined to the n-grams of each text. All give the same sums.

A document's cross entropy (log perplexity, nats a character) must lie within its language's band: LOW distances from the
median to the 16th percentile below, HIGH distances from the median to the 84th above, percentiles being exact over the
documents that pass the base rule, at a resolution of 1e-4. The language is the `lang` column as it stands (null is a language);
one of fewer than MIN_BAND such documents takes the band of all documents.

A null, empty or too short text has no words, fails the base rule and has no perplexity. Repeated rows are judged alike.
Columns of any other name stay as they are, whatever they are called. An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from xpanel.llm.common import frugal, materialise, mix64, nested, small, text_pieces, text_slices

ORDER, PIECE_CHARS = 5, 1_000_000
LOW, HIGH, LEAST, MIN_BAND = 6.0, 4.5, 0.01, 100  #: the band's ends, the least distance that counts, documents for a band
BROADCAST_ROWS, MAX_PARTS = 4_000_000, 16
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def word_keys(text: str, step: int = 1_000_000) -> np.ndarray:
    """A 64-bit hash of each word; the words themselves are held for about `step` characters at a time."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + step)
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        parts.append(np.fromiter(map(hash, text[at:end].encode().split()), np.int64))  # bytes.split() splits at exactly BLANKS
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def repeated_words(words: np.ndarray) -> int:
    """Words in 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    w = words.view(np.uint64)
    windows = mix64(mix64(mix64(w[:-2]) + w[1:-1]) + w[2:])
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, twice)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= hit
    return int(covered.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = word_keys(text)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = np.fromiter((hash(x.removesuffix("\n")) for x in io.StringIO(text, newline="\n") if x.strip(BLANKS)), np.int64)
    return len(words), word_chars, symbols, len(lines) - len(np.unique(lines)), repeated_words(words)


# --- n-grams ----------------------------------------------------------------------------------------------------------


def gram_keys(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A 64-bit hash of the n-gram that ends at each code point from the (order - 1)-th on."""
    n = len(points) - order + 1
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        key = mix64(key + points[k : k + n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return key


def text_grams(texts: list[str | None], order: int = ORDER, size: int = PIECE_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys and text numbers of n-grams, all code points, and each n-gram's place among them, for about `size` characters at a time.

    A text begins after order - 1 line feeds, so it has an n-gram a character; a long text goes on in further pieces.
    """
    for owners, pieces in text_pieces(texts, size, order - 1, "\n"):
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "replace"), np.uint32)
        lengths = np.array([len(p) for p in pieces])
        starts = np.cumsum(lengths) - lengths
        inside = np.ones(len(points) - order + 1, bool)
        for k in range(1, order):  # n-grams that would begin in one piece and end in the next
            cut = starts[1:] - k
            inside[cut[cut < len(inside)]] = False
        yield gram_keys(points, order)[inside], np.repeat(owners, lengths - order + 1), points, np.flatnonzero(inside)


def _strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    order = points.shape[1]
    joined = points.astype("<u4").tobytes().decode("utf-32-le")
    return pa.array([joined[i : i + order] for i in range(0, len(joined), order)], pa.string())


def _count(order: int, limit: int = 1_000_000):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, points = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, order), np.uint32)

        def out() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([_strings(points[i : i + 50_000]), pa.array(n[i : i + 50_000])], ["gram", "n"])

        for batch in batches:
            for b in text_slices(batch):
                for new_keys, _, all_points, places in text_grams(b.column("text").to_pylist(), order):
                    some, first, times = np.unique(new_keys, return_index=True, return_counts=True)
                    new_points = all_points[places[first][:, None] + np.arange(order)]
                    both = np.concatenate([keys, some])
                    keys, at, inverse = np.unique(both, return_index=True, return_inverse=True)
                    n = np.bincount(inverse, np.concatenate([n, times]), len(keys)).astype(np.int64)
                    points = np.concatenate([points, new_points])[at]
                    if len(keys) > limit:
                        yield from out()
                        keys, n, points = keys[:0], n[:0], points[:0]
        yield from out()

    return frugal("quality", count)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n: the n-grams of all documents, nothing left out."""
    partial = docs.select("text").filter("text <> ''").mapInArrow(_count(order), "gram string, n long")
    return partial.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: list[int]) -> list[float]:
    """The discounts of counts 0, 1, 2 and 3 or more from how many n-grams have a count of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(c, 1) for c in counts)
    y = n1 / (n1 + 2 * n2)
    raw = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.0), float(i)) for i, d in enumerate(raw)]


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, p: the interpolated modified Kneser-Ney probability of each n-gram's last character after the others."""
    levels = [counts]
    for _ in range(order - 1):  # continuation counts: how many different characters stand before
        levels.insert(0, materialise(levels[0].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))))
    below = None
    for m, level in enumerate(levels, 1):
        seen = level.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)], F.count("*")).first()
        d = F.element_at(F.array(*map(F.lit, discounts(list(seen[:4])))), F.least(F.col("n"), F.lit(3)).cast("int") + 1)
        rows = level.withColumn("d", d)
        if m == 1:  # one context: the empty one
            sums = rows.agg(F.sum("n"), F.sum("d")).first()
            below = rows.select("gram", ((F.col("n") - F.col("d")) / F.lit(sums[0] or 1) + F.lit((sums[1] or 0) / (sums[0] or 1) / max(seen[4], 1))).alias("p"))
            continue
        context = F.expr(f"left(gram, {m - 1})")
        totals = rows.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum("d").alias("back"))
        joined = rows.join(totals, context == totals["context"]).join(below.withColumnsRenamed({"gram": "suffix", "p": "q"}), F.expr("substring(gram, 2)") == F.col("suffix"))
        below = joined.select("gram", ((F.col("n") - F.col("d") + F.col("back") * F.col("q")) / F.col("total")).alias("p"))
    return below


def _hashed(order: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = np.frombuffer("".join(b.column("gram").to_pylist()).encode("utf-32-le"), np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(gram_keys(points, order)[::order].view(np.int64)), b.column("log_p")], ["key", "log_p"])

    return frugal("quality", hashed)


def fit_model(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """key, log_p: the model over all documents, written to the shared folder."""
    counts = materialise(count_grams(docs, order))
    rows = kneser_ney(counts, order).select("gram", F.log("p").cast("float").alias("log_p"))
    return materialise(rows.mapInArrow(_hashed(order), "key long, log_p float"))


def sorted_arrays(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model as hashes in order and the log probabilities beside them."""
    rows = model.toArrow()
    keys, log_p = rows.column("key").to_numpy().view(np.uint64), rows.column("log_p").to_numpy()
    order = np.argsort(keys)
    return keys[order], log_p[order]


# --- measures and verdicts --------------------------------------------------------------------------------------------


def _entropies(texts: list[str | None], keys: np.ndarray, log_p: np.ndarray, order: int) -> np.ndarray:
    """The cross entropy of each text (NaN without n-grams); n-grams that the model lacks count as its least likely."""
    sums, n = np.zeros(len(texts)), np.zeros(len(texts))
    for grams, owners, _, _ in text_grams(texts, order):
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        found = np.where(keys[at] == grams, log_p[at], log_p.min()).astype(np.float64)
        sums += np.bincount(owners, found, len(texts))
        n += np.bincount(owners, minlength=len(texts))
    with np.errstate(invalid="ignore", divide="ignore"):
        return -sums / n


def _measure(model, order: int, keep_text: bool):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch):
                texts = b.column("text").to_pylist()
                counts = np.array([base_counts(t) for t in texts], np.int64).reshape(len(texts), 5)
                entropy = _entropies(texts, *model.value, order) if model is not None and len(model.value[0]) else np.full(len(texts), np.nan)
                columns = [b.column("row"), *([b.column("text")] if keep_text else []), b.column("lang"), *(pa.array(counts[:, i]) for i in range(5)), pa.array(np.round(entropy, 6), mask=np.isnan(entropy))]
                yield pa.RecordBatch.from_arrays(columns, ["row", *(["text"] if keep_text else []), "lang", *COUNTS, "entropy"])

    return frugal("quality", measure)


def _text_grams(order: int):
    """text_key, key, n: the n-grams of each text."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_slices(batch, limit=PIECE_CHARS):
                names = b.column("text_key").to_numpy()
                for keys, owners, _, _ in text_grams(b.column("text").to_pylist(), order):
                    by = np.lexsort((keys, owners))
                    keys, owners = keys[by], owners[by]
                    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])[: len(keys)]
                    first = np.flatnonzero(new)
                    n = np.diff(np.concatenate([first, [len(keys)]]))
                    yield pa.RecordBatch.from_arrays([pa.array(names[owners[first]]), pa.array(keys[first].view(np.int64)), pa.array(n.astype(np.int64))], ["text_key", "key", "n"])

    return frugal("quality", grams)


def _sums(model, order: int):
    """text_key, log_p, n: what a part of the model says of each text."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, log_p = model.value
        for batch in batches:
            for b in text_slices(batch):
                total, n = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
                for grams, owners, _, _ in text_grams(b.column("text").to_pylist(), order):
                    at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
                    found = keys[at] == grams
                    total += np.bincount(owners[found], log_p[at[found]], len(total))
                    n += np.bincount(owners[found], minlength=len(n))
                yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(total), pa.array(n)], ["text_key", "log_p", "n"])

    return frugal("quality", sums)


def _text_entropies(docs: DataFrame, model: DataFrame, order: int, broadcast_rows: int, max_parts: int) -> DataFrame:
    """text_key, entropy of a model too large to be broadcast whole. A text that stands twice counts twice above and below the line."""
    texts = docs.filter("text <> ''").select(F.xxhash64("text").alias("text_key"), "text")
    parts = -(-model.count() // broadcast_rows)
    if parts > max_parts:
        sums = texts.mapInArrow(_text_grams(order), "text_key long, key long, n long").join(model, "key").select("text_key", (F.col("n") * F.col("log_p")).alias("log_p"), "n")
    else:
        sums = None
        for i in range(parts):
            shared = docs.sparkSession.sparkContext.broadcast(sorted_arrays(model.filter(F.pmod("key", F.lit(parts)) == i)))
            part = materialise(texts.mapInArrow(_sums(shared, order), "text_key long, log_p double, n long"))
            shared.unpersist()
            sums = part if sums is None else sums.unionByName(part)
    return sums.groupBy("text_key").agg(F.round(-F.sum("log_p") / F.sum("n"), 6).alias("entropy"))


def measure(docs: DataFrame, row: Column, model: DataFrame, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS, max_parts: int = MAX_PARTS) -> DataFrame:
    """row, lang, the base counts and entropy of each document."""
    rows = docs.select(row.alias("row"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))
    fits = small(model, broadcast_rows)
    shared = docs.sparkSession.sparkContext.broadcast(sorted_arrays(model)) if fits else None
    keep_text = not fits
    fields = [rows.schema["row"], *([StructField("text", StringType())] if keep_text else []), StructField("lang", StringType()), *(StructField(c, LongType()) for c in COUNTS), StructField("entropy", DoubleType())]
    out = rows.mapInArrow(_measure(shared, order, keep_text), StructType(fields))
    if fits:
        return out
    keyed = out.select("row", "lang", *COUNTS, F.xxhash64("text").alias("own_key"))
    joined = keyed.join(_text_entropies(docs, model, order, broadcast_rows, max_parts), F.col("own_key") == F.col("text_key"), "left")
    return joined.select("row", "lang", *COUNTS, "entropy")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """lang, n, low, high of each language, and of all documents in a row marked `every`.

    Percentiles are exact by a histogram of cross entropies in steps of 1e-4: some ten thousand bins, however many documents.
    """
    bins = measured.filter(~base_failed() & F.col("entropy").isNotNull()).groupBy("lang", F.round(F.col("entropy") * 10000).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = bins.withColumn("every", F.explode(F.array(F.lit(False), F.lit(True)))).groupBy(F.when(~F.col("every"), F.col("lang")).alias("lang"), "every", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang", "every")
    ranked = bins.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * F.lit(p)), F.col("bin"))) / 10000
    ends = ranked.groupBy("lang", "every").agg(F.first("all").alias("n"), at(0.16).alias("a"), at(0.5).alias("b"), at(0.84).alias("c"))
    low, high = F.col("b") - LOW * F.greatest(F.col("b") - F.col("a"), F.lit(LEAST)), F.col("b") + HIGH * F.greatest(F.col("c") - F.col("b"), F.lit(LEAST))
    return ends.select("lang", "every", "n", low.alias("low"), high.alias("high"))


def verdicts(measured: DataFrame) -> DataFrame:
    """measured with base_failed, kept and perplexity."""
    limits = materialise(bands(measured))
    every = limits.filter("every").select("low", "high").first()
    own = limits.filter(f"NOT every AND n >= {MIN_BAND}").select(F.col("lang").alias("_lang"), "low", "high")
    own = F.broadcast(own) if small(own, 10_000) else own
    joined = measured.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    low, high = (F.coalesce(c, F.lit(every[c] if every else None).cast("double")) for c in ("low", "high"))
    inside = F.coalesce(F.col("entropy").between(low, high), F.lit(False))
    return joined.withColumn("kept", ~base_failed() & inside).drop("_lang", "low", "high").withColumn("base_failed", base_failed()).withColumn("perplexity", F.round(F.exp("entropy"), 6))


def quality_report(docs: DataFrame, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS, max_parts: int = MAX_PARTS) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, kept, perplexity."""
    measured = materialise(measure(docs, F.struct("doc_id"), fit_model(docs, order), order, broadcast_rows, max_parts))
    return verdicts(measured).select("row.doc_id", *COUNTS, "base_failed", "kept", "perplexity")


def keep_quality(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The documents that the rules keep, columns as given; the measured documents are stored once, for the bands."""
    measured = materialise(measure(docs, nested(docs), fit_model(docs, order), order))
    return verdicts(measured).filter("kept").select("row.*")
