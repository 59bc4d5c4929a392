"""The corpus pipeline, stage by stage."""

import random

import corpus_pipeline


def test_stages(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    clean, passage, leaked = text(120), text(80), text(40)
    near = clean.split()
    near[60] = "changed"
    rows = [(1, clean), (2, clean), (3, " ".join(near)), (4, "too short"), (5, text(100) + " " + passage), (6, text(100) + " " + passage), (7, text(60) + " " + leaked), (8, None), (9, text(300))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = corpus_pipeline.stored(docs, "docs")  # written as the driver's tables are
    benchmark = spark.createDataFrame([(1, leaked)], "item_id long, text string")
    base = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test"
    benchmark.write.mode("overwrite").parquet(f"{base}/benchmark.parquet")
    left = {"quality rules": {1, 2, 3, 5, 6, 7, 9}, "minhash near-dedup": {1, 5, 6, 7, 9}, "substring dedup": {1, 5, 6, 7, 9}, "benchmark decontamination": {1, 5, 6, 9}, "bpe": {1, 5, 6, 9}}
    out = folder
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, out, base), "stage")
        assert {r.doc_id for r in out.select("doc_id").collect()} == left[name], name
        if name != "bpe":
            assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
