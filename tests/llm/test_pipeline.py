"""The pipeline's stages in order, each held against its operator's brute force or definition."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from struklake.llm import simhash
from struklake.llm.common import materialise


def test_stages(spark, sf_dir):
    folder = sf_dir.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, folder))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "sharding":
            assert docs.columns == columns
        if name == "quality":
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept[name] for i in good) >= 0.99 * len(good)
            bad = [i for i, q in labels.items() if q == 0]
            assert sum(i in kept[name] for i in bad) <= 0.05 * len(bad)
        if name == "near_dedup":
            left = {i: before[i] for i in kept[name]}
            assert len({" ".join(t.lower().split()) for t in left.values()}) == len(left)
    order = [n for n, _ in corpus_pipeline.STAGES]
    assert order == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all(kept[b] <= kept[a] for a, b in zip(order, order[1:], strict=False))
    slots = docs.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m"))
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in slots.collect())


def test_awkward_rows_pass_all_stages(spark, awkward, no_docs, tmp_path):
    bench = spark.createDataFrame([(1, "nothing like this stands in any of the texts")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for source, n in ((awkward, "awkward"), (no_docs, "empty")):
        folder = str(tmp_path / n)
        source.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == (n == "awkward")
    assert simhash.one_of_each(awkward).filter("doc_id is null").count() == 2
