def test_stages(spark):
    import corpus_pipeline

    from ravelin.llm import decontam, store

    folder = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{folder}/documents.parquet")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, folder), name)
        left.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == first.columns
        if name == "benchmark_decontamination":
            again = decontam.report(decontam.scan(docs, spark.read.parquet(f"{folder}/benchmark.parquet")))
            assert again.where("contaminated").count() == 0
            assert left[-1] > 0.6 * left[0]
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_a_runs_folder_is_cleared(spark):
    import os

    from ravelin.llm import hostrules, store

    docs = spark.createDataFrame([(k, f"some words of text number {k} which are enough to stay", "h") for k in range(20)], "doc_id long, text string, source string")
    with store.cleared(spark) as folder:
        assert len(hostrules.judged(docs).collect()) == 20
        inside = os.listdir(folder.removeprefix("file://"))
    assert inside and not os.path.exists(folder.removeprefix("file://"))
    assert not store.shared_dir(spark).startswith(folder)
