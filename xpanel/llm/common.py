"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised operators take at a time inside a task.
CHUNK_BYTES = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one in fewer splits than there are cores (a small one in one file) is dealt to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset a local one, if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base}/{uuid.uuid4().hex}"


_SCOPES: list[list[str]] = []


@contextlib.contextmanager
def intermediates() -> Iterator[list[str]]:
    """Inside, the folders that materialise() writes are listed."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared file system."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    for made in _SCOPES:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about `limit` bytes of text (a longer text stands alone). The text may be a field of `row`."""
    n = batch.num_rows
    if not n:
        return
    texts = batch.column(column) if column in batch.schema.names else batch.column("row").field(column)
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_pieces(texts: list[str | None], size: int, overlap: int = 0, pad: str = "") -> Iterator[tuple[np.ndarray, list[str]]]:
    """Lists of about `size` characters in all: text numbers and pieces. A longer text is cut, each piece beginning with the
    last `overlap` characters of the piece before; the first begins with as many pads. Null and empty texts have none."""
    owners, pieces, held = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), size):
            before = text[max(0, at - overlap) : at]
            piece = pad * (overlap - len(before)) + before + text[at : at + size]
            owners.append(i)
            pieces.append(piece)
            held += len(piece)
            if held >= size:
                yield np.array(owners), pieces
                owners, pieces, held = [], [], 0
    if pieces:
        yield np.array(owners), pieces


def nested(df: DataFrame) -> Column:
    """All columns of df in one struct: an operator's own columns beside it cannot clash with them."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; looks at one row more."""
    return df.limit(rows + 1).count() <= rows


_CACHE: dict = {}


def worker_cache(name: str, make):
    """What make() gives, kept in this Python worker until another operator asks for its own: a worker holds one operator's cache."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


def drop_caches(but: str) -> None:
    """Let this Python worker keep no caches but those of one operator, named by their first word."""
    if not all(name.split()[0] == but for name in _CACHE):
        _CACHE.clear()


def give_back() -> None:
    """Freed memory goes back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def frugal(name: str, f: Callable) -> Callable:
    """f, a function of mapInArrow, in a worker without the caches of other operators; its memory is given back at the end."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches(name)
        yield from f(batches)
        give_back()

    return run


def vocabulary_path(name: str) -> str:
    """An absolute path as it is; else the place of a public tokenizer's file, on the machine that asks."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, each query's shuffle files go when it has ended, not when the driver collects their handles."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
