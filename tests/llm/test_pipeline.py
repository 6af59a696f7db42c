"""The stages of the pipeline, each on all that the one before it kept."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    clean = [words(rng.randrange(60, 200)) for _ in range(30)]
    passage = words(60)
    texts = [*clean, "few", "### $$$ " * 40, clean[0], clean[1] + " end", f"{words(150)} {passage}", f"{words(150)} {passage}"]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, ids = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns[:5] == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert set(range(30)) <= ids["quality_rules"] and not {30, 31} & ids["quality_rules"]
    assert ids["minhash_dedup"] == ids["quality_rules"] - {32, 33}
    assert ids["bpe"] == ids["mixing"] == ids["substring_dedup"] == ids["minhash_dedup"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "substring_dedup")).collect()}
    assert passage in texts[34] and passage not in texts[35]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids["bpe"])


def test_nulls_repeats_and_no_rows(spark, tmp_path):
    rng = random.Random(5)
    text = " ".join(f"w{rng.randrange(4000)}" for _ in range(80))
    rows = [(None, text, None, None, None), (1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, "en", None, 0), (3, "", None, "b", 0), (4, " \n", "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {name: sorted(r.doc_id or 0 for r in stage(spark, docs, str(tmp_path)).collect()) for name, stage in corpus_pipeline.STAGES}
    assert left["quality_rules"] == [0, 1, 1] and left["substring_dedup"] == left["mixing"] == left["bpe"] == [0, 1, 1, 2, 3, 4]
    assert set(left["minhash_dedup"]) == {0, 1, 2, 3, 4}
    for name, rows_ in (("some", docs), ("none", docs.limit(0))):
        rows_.write.parquet(str(tmp_path / name / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()} == {None, 1}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
