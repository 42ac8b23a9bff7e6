"""The pipeline's stages and run() against each other and brute force."""

import corpus_pipeline
import tiktoken  # noqa: F401


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "tokens"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left, sf)
        assert out.columns == docs.columns, name
        before, after = {r[0] for r in left.select("doc_id").collect()}, {r[0] for r in out.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before), name
        left = spark.createDataFrame(out.collect(), docs.schema)
    tokens = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, left, sf).collect()}
    assert tokens == {r["doc_id"] for r in left.collect()}
    assert tokens == {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [r for r in left.collect() if any(b in r["text"] for b in bench)]
