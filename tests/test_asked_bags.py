"""Queries of equal terms are searched once; each has the ranking of its own search."""

import pytest
from pyspark.sql import functions as F

from groundwork.operators import retrieval
from groundwork.operators.retrieval import asked_bags, bm25_topk, suggested_citations

TEXTS = ["ash and clay in the pit", "clay clay pit", "ash ash ash of clay", "stone", None, "", "pit of ash", "The Ash, the CLAY"]


def _chunks(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")


def _queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, query_text string")


def test_equal_terms_make_one_bag(spark):
    rows = [(i, "The ash, clay") for i in range(50)] + [(50, "clay ASH"), (51, "clay clay ash"), (52, None), (53, "the of"), (54, "ash"), (54, "clay")]
    asked, bags = asked_bags(_queries(spark, rows))
    assert sorted(r.bag for r in bags.collect()) == ["ash clay", "ash clay clay"]
    assert {r.query_id for r in asked.collect()} == {*range(52), 54}


def test_rankings_are_those_of_single_searches(spark):
    rows = [(1, "ash clay"), (2, "Clay, the ash!"), (3, "clay clay ash"), (4, "pit"), (5, "nowhere"), (6, "pit"), (None, "stone")]
    found = lambda qs: sorted((str(r.query_id), r.rank, r.chunk_id, round(r.score, 9)) for r in bm25_topk(_queries(spark, qs), _chunks(spark), 3).collect())
    alone = [hit for row in rows[:4] for hit in found([row])]
    assert [h for h in found(rows) if h[0] in "1234"] == sorted(alone)
    assert [h[2] for h in found(rows) if h[0] == "None"] == [3]


@pytest.mark.parametrize("few", [0, 50_000])
def test_citations_of_many_equal_claims(spark, monkeypatch, few):
    monkeypatch.setattr(retrieval, "FEW", few)
    claims = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, "ash").otherwise("clay pit").alias("claim_text"))
    found = suggested_citations(claims, _chunks(spark), 2, 8).collect()
    assert len(found) == 600
    assert {(r.claim_id % 2, r["rank"], r.chunk_id, r.excerpt) for r in found} == {(0, 1, 2, "ash ash "), (0, 2, 6, "pit of a"), (1, 1, 1, "clay cla"), (1, 2, 0, "ash and ")}


def test_without_queries_or_passages(spark):
    assert bm25_topk(_queries(spark, []), _chunks(spark)).count() == 0
    assert bm25_topk(_queries(spark, [(1, "nowhere")]), _chunks(spark)).count() == 0
    assert bm25_topk(_queries(spark, [(1, "ash")]), _chunks(spark, [])).count() == 0
