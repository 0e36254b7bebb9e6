"""Batches for Python: small in the pipeline's stages, and without influence on results."""

import pyarrow as pa

import corpus_pipeline
from voxelspark.llm import bpe

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_stages_give_python_small_batches(spark, sf):
    before = spark.conf.get(ARROW_ROWS)
    try:
        for name, stage in corpus_pipeline.STAGES:
            spark.conf.set(ARROW_ROWS, "10000")
            stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
            docs = spark.range(0, 6000, 1, 1)
            sizes = docs.mapInArrow(lambda bs: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()
            assert sum(r["n"] for r in sizes) == 6000
            assert max(r["n"] for r in sizes) <= 2000, name
    finally:
        spark.conf.set(ARROW_ROWS, before)


def test_a_smaller_setting_stays(spark, sf):
    before = spark.conf.get(ARROW_ROWS)
    try:
        spark.conf.set(ARROW_ROWS, "100")
        corpus_pipeline.identified(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        assert spark.conf.get(ARROW_ROWS) == "100"
    finally:
        spark.conf.set(ARROW_ROWS, before)


def test_blocks_do_not_depend_on_batches():
    texts = ["one two two", None, "three " * 50, "", "four five", "six"] * 40
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    blocks = lambda rows: [r for b in bpe._blocks(bpe.vocabulary(), 8, 1000)(table.to_batches(max_chunksize=rows)) for r in b.to_pylist()]
    assert blocks(1) == blocks(7) == blocks(1000)
    assert len({r["block"] for r in blocks(1)}) > 5


def test_no_rows_make_no_block():
    empty = pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    assert not list(bpe._blocks(bpe.vocabulary(), 8, 1000)(empty.to_batches()))
