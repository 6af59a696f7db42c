"""The stored index against the search without one."""

import random

import pytest

from groundwork.operators import search_index
from groundwork.operators.retrieval import bm25_topk


@pytest.mark.parametrize("block, folders", [(3, 2), (64, None)])
def test_equals_the_search_without_an_index(spark, tmp_path, block, folders):
    rng = random.Random(8)
    # a hot term in every passage, few rare ones
    words = lambda n: " ".join(["hot"] + [f"w{min(int(rng.expovariate(0.03)), 400)}" for _ in range(n)])
    texts = [words(rng.randrange(1, 60)) for _ in range(500)] + [None, "", "the of", "İK 2x", "w399 " * 20_000]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    queries = spark.createDataFrame([(i, words(rng.randrange(1, 5))) for i in range(30)] + [(90, None), (91, "nowhere"), (92, "w3 w3 w3 w5")], "query_id long, query_text string")
    path = search_index.write_index(chunks, str(tmp_path / "index"), block=block, folders=folders)
    for k in (1, 5):
        rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 9)) for r in df.collect())
        assert rows(search_index.search(queries, path, k)) == rows(bm25_topk(queries, chunks, k))
    share = search_index.search_share(queries, path, 1).collect()
    assert all(r.n_scored <= r.n_blocks for r in share)
    if block == 3:
        assert sum(r.n_scored for r in share) < 0.5 * sum(r.n_blocks for r in share)


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"word{i}") for i in range(50)], "chunk_id long, text string")
    path = search_index.write_index(chunks, str(tmp_path / "index"), folders=16)
    terms = spark.createDataFrame([("word7",)], "term string")
    plan = search_index._blocks(spark, path, terms, 16, "bigint")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan
    assert [r.block for r in search_index._blocks(spark, path, terms, 16, "bigint").collect()] == [0]


def test_empty_tables(spark, tmp_path):
    chunks = spark.createDataFrame([], "chunk_id long, text string")
    path = search_index.write_index(chunks, str(tmp_path / "index"))
    assert search_index.search(spark.createDataFrame([(1, "x y")], "query_id long, query_text string"), path).collect() == []
