"""The corpus pipeline: quality rules, language, near-duplicates, mixing, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from xpanel.llm import language, mixing, near_dup, packing, quality
from xpanel.llm.catalog import PIECE_BPE, WORD_BPE
from xpanel.llm.common import delete, intermediates, read, shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []
BATCH_ROWS, BATCH_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(f: Stage) -> Stage:
    """f, which first deletes the intermediate tables of the stage before: its result has been written by then, unless docs still reads them.
    Rows go to Python workers and back BATCH_ROWS at a time at most, for the session: whoever writes the result sends them."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if _left else []
        gone = [p for p in _left if not any(p in file for file in read)]
        delete(spark, gone)
        _left[:] = [p for p in _left if p not in gone]
        if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
            spark.conf.set(BATCH_KEY, BATCH_ROWS)
        with intermediates() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, PIECE_BPE)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_first(docs)


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select("row.*")


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("quality rules", quality_rules), ("language", language_id), ("near-dedup", near_dedup), ("mixing", source_mixing), ("packing", best_fit_packing)]
ORACLE_SQL = None  # perplexity, segmentation sums, MinHash and tokenizing are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes when the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, apply in STAGES:
        out, path = apply(spark, docs, sf_dir), shared_dir(spark)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        delete(spark, [before] if before else [])
        before = path
    return docs
