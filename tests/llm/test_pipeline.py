"""The pipeline: each stage on what the stage before kept, against brute force where it can be."""

import corpus_pipeline
from sluice.llm.decontaminate import Decontaminator, normalised


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        results[name] = docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = {d for d, q in labels.items() if q == 1}
    kept = {r.doc_id for r in results["quality"]}
    assert len(good - kept) <= 0.1 * len(good)

    def shingle_set(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    left = [shingle_set(r.text) for r in results["near_duplicates"]]
    assert not any(a and 10 * len(a & b) >= 8 * len(a | b) for i, a in enumerate(left) for b in left[:i])
    items = [normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    least = Decontaminator().min_chars
    dirty = {r.doc_id for r in results["near_duplicates"] if any(len(i) >= least and i in normalised(r.text) for i in items)}
    clean = {r.doc_id for r in results["decontaminate"]}
    assert not dirty & clean and len(clean) >= len(results["near_duplicates"]) - len(dirty) - 2
    assert {r.doc_id for r in results["mix"]} <= clean
    shards = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in shards) == sorted(r.doc_id for r in results["mix"])


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
