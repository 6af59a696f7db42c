"""Searches for names take any number of them."""

from pyspark.sql import functions as F

from groundwork.operators import chronology, conflicts


def test_proposals_take_many_names(spark):
    sites = spark.range(100_002).select("id", F.concat(F.lit("Site#"), "id").alias("site_name"))
    evidence = spark.createDataFrame([(1, [], "at Site#100001, é"), (2, [], "Site#7"), (3, [5], None), (4, [], "")], "id long, source_ids array<long>, evidence_text string")
    got = {tuple(r) for r in chronology.proposals(sites, evidence).select("site_id", "evidence_id").collect()}
    assert got == {(int("100001"[:k]), 1) for k in range(1, 7)} | {(7, 2), (5, 3)}


def test_mentions_of_names(spark):
    flags = spark.createDataFrame([("1", "at ALPHA and beta"), ("2", "gamma"), ("3", None)], "chapter string, claim_text string")
    names = spark.createDataFrame([("Alpha",), ("Beta",), ("",), (None,)], "name string")
    assert {tuple(r) for r in conflicts.entity_mentions(flags, names).collect()} == {("1", "Alpha"), ("1", "Beta")}
