"""The pipeline's Arrow batches."""

from __future__ import annotations

import pyarrow as pa

import corpus_pipeline


def test_batches_of_texts_are_small(spark):
    before = spark.conf.get(corpus_pipeline._BATCH)
    try:
        spark.conf.set(corpus_pipeline._BATCH, 10000)
        good = " ".join(f"word{k}" for k in range(60))
        docs = spark.range(5000, numPartitions=1).selectExpr("id AS doc_id", f"if(id % 2 = 0, '{good}', 'short') AS text")
        kept = corpus_pipeline.quality_rules(spark, docs, "")
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 5000, 2))

        def rows(batches):
            yield from (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)

        assert max(r["n"] for r in docs.mapInArrow(rows, "n long").collect()) <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(corpus_pipeline._BATCH, 7)
        corpus_pipeline.sentencepiece(spark, docs.limit(3), "")
        assert spark.conf.get(corpus_pipeline._BATCH) == "7"
    finally:
        spark.conf.set(corpus_pipeline._BATCH, before)
