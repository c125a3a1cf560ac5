import corpus_pipeline
import duckdb
import pytest
from conftest import DATA

from xpanel.llm import common, language, lm_score, near_dup, packing, quality


def test_stages_keep_columns_and_every_decision_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(out := near_dup.materialise(stage(spark, seen[-1], DATA)))
        if name != "packing":
            assert out.columns == docs.columns
    first, good, known, single, mixed, packed = seen
    kept = {r["doc_id"] for r in quality.quality_report(first).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept
    classes = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(known).collect()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(classes.values()))
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in single.collect()}
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}
    by = {}
    for r in packed.collect():
        by[r["sequence_id"]] = by.get(r["sequence_id"], 0) + r["length"]
    assert max(by.values()) <= packing.CAPACITY


def test_clean_labelled_documents_pass_the_quality_stage(spark):
    good = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).collect()}
    clean = duckdb.sql(f"SELECT doc_id FROM '{DATA}/labels.parquet' JOIN '{DATA}/documents.parquet' USING (doc_id) WHERE quality = 1 AND n_chars > 600").fetchall()
    assert sum(i in good for (i,) in clean) >= 0.95 * len(clean)


@pytest.mark.parametrize("task", [
    lambda: quality._count(5), lambda: quality._measure(None, 5, False), lambda: language._expect(language_pieces(), ["en"], None), lambda: near_dup._sketch(False), lambda: near_dup._compare(0.8),
    lambda: lm_score._ask(1, 8, 1, 0, None), lambda: lm_score._answer(1),
])
def test_a_stage_keeps_no_cache_of_another(monkeypatch, task):
    monkeypatch.setattr(common, "_CACHE", {"packing x": object()})
    list(task()(iter([])))
    assert "packing x" not in common._CACHE


def language_pieces():
    return corpus_pipeline.PIECE_BPE


def test_a_stage_keeps_its_own_cache(monkeypatch):
    monkeypatch.setattr(common, "_CACHE", {f"packing {corpus_pipeline.WORD_BPE}": None})
    common.frugal("packing", lambda batches: batches)(iter([])).close()
    list(common.frugal("packing", iter)([]))
    assert list(common._CACHE) == [f"packing {corpus_pipeline.WORD_BPE}"]


def test_stages_send_small_batches_to_python(spark):
    key = corpus_pipeline.BATCH_KEY
    for given, then in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (500, 500)):  # 0: no limit
        spark.conf.set(key, given)
        corpus_pipeline.stage(lambda spark, docs, sf_dir: docs)(spark, spark.range(1), DATA)
        assert int(spark.conf.get(key)) == then
    spark.conf.unset(key)
