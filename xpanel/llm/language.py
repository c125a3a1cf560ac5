"""Language identification with segmentation-marginalised unigrams.

A word's probability in a language is the sum over all its segmentations into pieces of a fixed public vocabulary of
the product of the pieces' probabilities; a forward algorithm adds them up for many words and all languages at once. The
piece probabilities come from expectation maximisation (forward-backward) over labelled documents: each task adds up the
expected counts of its words, and Spark adds up the tasks (vocabulary x languages numbers, whatever the corpus).

Words are runs of letters, lower-cased, however long; all letter pieces of the vocabulary take part, whatever their length; a
character outside the vocabulary is a piece of probability UNKNOWN in every language. Sums of long words are scaled on the
way, so none is lost. A text's language is the one with the highest total, its score that language's posterior at a tempering
of one word in TEMPER. Null texts and texts without letters are ``und`` with score 0, as are all texts where there is nothing to
learn from. Repeated rows get equal results; further columns stay, whatever they are called.

Training is on a bounded sample: about SAMPLE_PER_LANGUAGE labelled documents a language, chosen by a hash of their id, in
EM_ROUNDS rounds, where words count in parts of TRAINING_LETTERS letters. A model is a number per piece and language, so the number
of its languages is bounded too, for it is broadcast: the MAX_LANGUAGES most frequent labels are learnt (24,000 pieces: 192 MB
at most), and further labels are never predicted. A Python worker keeps the scores of CACHE_WORDS words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from xpanel.llm.common import frugal, nested, text_slices, vocabulary_path, worker_cache

UND = "und"
UNKNOWN, TEMPER = 1e-9, 4.0
SAMPLE_PER_LANGUAGE, EM_ROUNDS, TRAINING_LETTERS, MAX_LANGUAGES, CACHE_WORDS = 3000, 2, 23, 1000, 250_000
#: Numbers of a lattice or of its sums that a task holds at a time (one word may need more).
CELLS = 4_000_000
WORDS = regex.compile(r"\p{L}+")
MARK = "▁"  # the vocabulary's sign for the beginning of a word


def vocabulary(path: str) -> list[str]:
    """The letter pieces of a sentencepiece vocabulary, in sorted order. path: a file, or the name of a public one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(path))
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p.strip(MARK).isalpha() and MARK not in p[1:])


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """A polynomial hash of each row's codes, zeros at the end ignored."""
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = np.where(column > 0, (h + column.astype(np.uint64)) * _BASE, h)
    return h


class Pieces:
    """The vocabulary as sorted hashes; the row beyond the last is the unknown piece."""

    def __init__(self, pieces: list[str]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        h = _hashes(word_codes(pieces, self.longest, ""))
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def word_codes(words: list[str], width: int, mark: str = MARK) -> np.ndarray:
    """Code points of the marked words, a row each, zeros at the end."""
    if not words:
        return np.zeros((0, width), np.uint32)
    return np.array([mark + w for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width)


def lattice(codes: np.ndarray, pieces: Pieces) -> np.ndarray:
    """[word, start, length - 1] -> piece number; -1 where none, the unknown piece for single characters without one."""
    n, width = codes.shape
    longest = min(pieces.longest, width)
    found = np.full((n, width, longest), -1, np.int32)
    for start in range(width):
        live = np.flatnonzero(codes[:, start])
        h = np.zeros(len(live), np.uint64)
        for k in range(min(longest, width - start)):
            c = codes[live, start + k]
            if not (inside := c > 0).all():
                live, h, c = live[inside], h[inside], c[inside]
            if not len(live):
                break
            h = (h + c.astype(np.uint64)) * _BASE
            got = pieces.lookup(h)
            found[live, start, k] = np.where((got < 0) & (k == 0), pieces.size, got)
    return found


def forward(codes: np.ndarray, found: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[word, position, language], the summed probability of all segmentations up to a position, and the log factor [word, language]
    that a word's last one is to be taken with: where sums get small, those that still count are scaled up. probs: pieces + 1 rows."""
    n, width = codes.shape
    longest = found.shape[2]
    alpha, factor = np.zeros((n, width + 1, probs.shape[1])), np.zeros((n, probs.shape[1]))
    alpha[:, 0] = 1
    for start in range(width):
        for k in range(min(longest, width - start)):
            use = np.flatnonzero(found[:, start, k] >= 0)
            if len(use):
                alpha[use, start + k + 1] += alpha[use, start] * probs[found[use, start, k]]
        if start % 8 == 7:
            ahead = alpha[:, start + 1 : start + 1 + longest]
            most = ahead.max(1)
            low = (most > 0) & (most < 1e-60)
            if low.any():
                scale = np.where(low, most, 1)
                ahead /= scale[:, None]
                factor += np.log(scale)
    return alpha, factor


def chunks(lengths: np.ndarray, wide: int) -> Iterator[slice]:
    """Slices of ascending lengths, `wide` numbers a letter, of at most CELLS numbers (a longer word is alone)."""
    start = 0
    while start < len(lengths):
        stop = int(min(len(lengths), start + 20_000))
        while stop > start + 1 and (stop - start) * (int(lengths[stop - 1]) + 2) * wide > CELLS:
            stop = start + (stop - start) // 2
        yield slice(start, stop)
        start = stop


def log_scores(words: list[str], pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), probs.shape[1]))
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for part in chunks(lengths[order], max(pieces.longest, probs.shape[1])):
        at = order[part]
        codes = word_codes([words[i] for i in at], int(lengths[at[-1]]) + 1)
        alpha, factor = forward(codes, lattice(codes, pieces), probs)
        out[at] = np.log(alpha[np.arange(len(at)), lengths[at] + 1] + 1e-300) + factor
    return out


def expected_counts(words: list[str], weights: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language] of words with weights [word, language], by forward-backward."""
    total = np.zeros(probs.shape)
    for at in chunks(np.full(len(words), max(map(len, words), default=0)), max(pieces.longest, probs.shape[1])):
        part, w = words[at], weights[at]
        codes = word_codes(part, max(map(len, part)) + 1)
        found, lengths = lattice(codes, pieces), np.array([len(x) + 1 for x in part])
        alpha, _ = forward(codes, found, probs)  # words of training are short: nothing is scaled
        beta = np.zeros_like(alpha)
        beta[np.arange(len(part)), lengths] = 1
        z = np.maximum(alpha[np.arange(len(part)), lengths], 1e-300)
        for start in reversed(range(codes.shape[1])):
            for k in range(min(found.shape[2], codes.shape[1] - start)):
                use = np.flatnonzero(found[:, start, k] >= 0)
                if len(use):
                    p = probs[found[use, start, k]]
                    beta[use, start] += p * beta[use, start + k + 1]
                    share = alpha[use, start] * p * beta[use, start + k + 1] / z[use] * w[use]
                    for lang in range(probs.shape[1]):
                        total[:, lang] += np.bincount(found[use, start, k], share[:, lang], len(total))
    return total


def text_words(text: str, letters: int | None = None) -> list[str]:
    """The text's words; in parts of so many letters, if given."""
    words = WORDS.findall(text.lower())
    if letters and max(map(len, words), default=0) > letters:
        words = [w[i : i + letters] for w in words for i in range(0, len(w), letters)]
    return words


def distinct_words(texts: list[str], letters: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of all texts, and for each word in order its number and its text's."""
    index: dict[str, int] = {}
    ids, owners = [], []
    for i, t in enumerate(texts):
        got = [index.setdefault(w, len(index)) for w in text_words(t, letters)]
        ids.append(np.array(got, np.int64))
        owners.append(np.full(len(got), i))
    return list(index), np.concatenate([np.empty(0, np.int64), *ids]), np.concatenate([np.empty(0, np.int64), *owners])


def _expect(path: str, languages: list[str], probs):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, index = Pieces(vocabulary(path)), {x: i for i, x in enumerate(languages)}
        total = np.zeros((pieces.size + 1, len(languages)))
        p = probs.value if probs else np.full(total.shape, 1 / pieces.size)
        for batch in batches:
            for b in text_slices(batch):
                words, ids, owners = distinct_words(b.column("text").to_pylist(), TRAINING_LETTERS)
                if words:
                    lang = np.array([index[x] for x in b.column("lang").to_pylist()])
                    weights = np.bincount(ids * len(languages) + lang[owners], minlength=len(words) * len(languages)).reshape(len(words), -1)
                    total += expected_counts(words, weights, pieces, p)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    return frugal("training", expect)


def training_rows(docs: DataFrame, counts: dict[str, int], per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """About per_language labelled rows a language: those whose hash is in the language's share. A scan, no shuffle."""
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).filter(unit < share[F.col("lang")]).select("lang", "text")


def learn(docs: DataFrame, pieces_path: str, per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray | None]:
    """Languages in order and the piece probabilities [pieces + 1, languages]."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return [], None
    languages, rows = sorted(counts), training_rows(docs, counts, per_language)
    context, size, probs = docs.sparkSession.sparkContext, len(vocabulary(pieces_path)), None
    for _ in range(rounds):
        shared = context.broadcast(probs) if probs is not None else None
        expected = rows.mapInArrow(_expect(pieces_path, languages, shared), "piece long, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        table = np.full((size + 1, len(languages)), 0.1)
        table[expected["piece"], expected["lang"]] += expected["n"]
        probs = table / table[:size].sum(0)
        probs[size] = UNKNOWN
    return languages, probs


class WordScores:
    """log_scores of words, those of up to CACHE_WORDS kept."""

    def __init__(self, pieces: Pieces, probs: np.ndarray):
        self.pieces, self.probs = pieces, probs
        self._empty()

    def _empty(self) -> None:
        self.index: dict[str, int] = {}
        self.rows = np.empty((0, self.probs.shape[1]))

    def __call__(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > CACHE_WORDS:
            self._empty()
            new = words
        self.index.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
        self.rows = np.concatenate([self.rows, log_scores(new, self.pieces, self.probs)])
        return self.rows[[self.index[w] for w in words]]


def _predict(path: str, languages: list[str], probs, model: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*languages, UND], object)
        scores = worker_cache(f"language {model}", lambda: WordScores(Pieces(vocabulary(path)), probs.value))
        for batch in batches:
            for b in text_slices(batch, limit=2_000_000):
                words, ids, owners = distinct_words([t or "" for t in b.column("row").field("text").to_pylist()])
                n, best, score = b.num_rows, np.full(b.num_rows, len(languages)), np.zeros(b.num_rows)
                if words and languages:
                    each = scores(words)
                    total = np.column_stack([np.bincount(owners, each[ids, k], n) for k in range(len(languages))])
                    lettered = np.bincount(owners, minlength=n) > 0
                    best = np.where(lettered, total.argmax(1), best)
                    rest = np.exp(np.maximum((total - total.max(1, keepdims=True)) / TEMPER, -700)).sum(1)
                    score = np.where(lettered, 1 / rest, 0)
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["row", "lang_pred", "lang_score"])

    return frugal("language", predict)


def identify(docs: DataFrame, pieces_path: str, model: tuple[list[str], np.ndarray | None]) -> DataFrame:
    """row (the columns of docs), lang_pred and lang_score."""
    languages, probs = model
    shared = docs.sparkSession.sparkContext.broadcast(np.empty((0, 0)) if probs is None else probs)
    rows = docs.select(nested(docs).alias("row"))
    schema = StructType([*rows.schema, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return rows.mapInArrow(_predict(pieces_path, languages, shared, uuid.uuid4().hex), schema)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def language_report(docs: DataFrame, pieces_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from what is not held out."""
    model = learn(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), pieces_path)
    out = identify(docs.select("doc_id", "text"), pieces_path, model)
    return out.select("row.doc_id", F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, pieces_path: str, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised with a score of at least `least`, columns as given; all, if nothing can be learnt."""
    model = learn(docs, pieces_path)
    if model[1] is None:
        return docs
    return identify(docs, pieces_path, model).filter((F.col("lang_pred") != UND) & (F.col("lang_score") >= least)).select("row.*")
