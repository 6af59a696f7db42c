"""Repeats and late rows of a stream, over a restart."""

import os
from datetime import datetime, timedelta

from groundwork.operators.gating import routed
from groundwork.streaming.jobs import file_stream, unique_route_stream

SCHEMA = "fact_id long, source_id long, degradation_class string, value_engine_a string, value_engine_b string, true_value string, seen_at timestamp"


def test_repeats_and_late_rows(spark, tmp_path):
    given, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    at = lambda hours: datetime(2024, 1, 1) + timedelta(hours=hours)
    fact = lambda i, hours: (i, 1, "CLASS_A", "12", "12", "12", at(hours))

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(given)
        stream = file_stream(spark, given, spark.read.parquet(given).schema)
        unique_route_stream(stream, out, checkpoint, ["fact_id"], "seen_at", "1 hour").awaitTermination()
        return sorted(r.fact_id for r in spark.read.parquet(out).collect())

    assert run([fact(1, 10), fact(2, 10), fact(1, 10.2), fact(1, 10.9)]) == [1, 2]
    # a new query on the same checkpoint knows 2; 3 is new; 4 is three hours behind
    assert run([fact(2, 10.5), fact(3, 11.5), fact(3, 11.6)]) == [1, 2, 3]
    assert run([fact(4, 8), fact(5, 11.7), fact(3, 11.9)]) == [1, 2, 3, 5]
    # long after its key has expired a fact counts as new
    assert run([fact(6, 30)]) == [1, 2, 3, 5, 6]
    assert run([fact(1, 30)]) == [1, 1, 2, 3, 5, 6]


def test_keys_are_kept_in_files_until_they_expire(spark, tmp_path):
    given, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    key = ["fact_id", "value_engine_a", "value_engine_b"]
    fact = lambda i, a, b, hours: (i, 1, "CLASS_A", a, b, "12", datetime(2024, 1, 1) + timedelta(hours=hours))

    def run(*files):
        for rows in files:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(given)
        stream = file_stream(spark, given, spark.read.parquet(given).schema, 1)
        unique_route_stream(stream, out, checkpoint, key, "seen_at", "1 hour").awaitTermination()
        return sorted((r.fact_id, r.value_engine_a or "", r.value_engine_b or "", r.seen_at.hour) for r in spark.read.parquet(out).collect())

    # a null and a value in another place are another key; the earliest of a batch stays
    first = [(1, "", "12", 10), (1, "12", "", 10), (1, "12", "12", 10)]
    assert run([fact(1, "12", None, 10), fact(1, None, "12", 10), fact(1, "12", "12", 10.2), fact(1, "12", "12", 10)]) == first
    assert run([fact(1, "12", None, 10.4), fact(2, "", "", 10.4)], [fact(2, "", "", 10.8), fact(1, "12", "12", 10.9)]) == sorted([*first, (2, "", "", 10)])
    assert not os.path.exists(f"{checkpoint}/state")  # no task holds the keys in its memory
    # a batch that was not finished is made again, with the same rows
    os.remove(f"{checkpoint}/commits/2")
    if os.path.exists(f"{checkpoint}/commits/.2.crc"):
        os.remove(f"{checkpoint}/commits/.2.crc")
    assert run() == sorted([*first, (2, "", "", 10)])
    # all keys have expired: their files go
    assert len(run([fact(9, "1", "1", 20)], [fact(1, "12", "12", 20)])) == 6
    assert sorted(os.listdir(f"{checkpoint}/seen/keys")) == ["batch=3", "batch=4"]


def test_normal_forms_are_made_once_for_a_row(spark):
    facts = spark.createDataFrame([(1, 1, "CLASS_A", " 1,200", "1200", "", None), (2, 1, None, "5\u20136", "5-6", "", None), (3, 1, "CLASS_A", None, "1", "", None), (4, 1, "CLASS_B", "1", "1", "", None)], SCHEMA)
    done = routed(facts)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
    assert [(r.status[:4], r.confidence, r.resolved_value) for r in done.orderBy("fact_id").collect()] == [("AUTO", 0.985, "1200"), ("AUTO", 0.985, "5-6"), ("FLAG", 0.4, ""), ("GATE", 0.0, "")]
    assert done.columns == [*facts.columns, "status", "confidence", "resolved_value"]
