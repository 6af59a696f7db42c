"""Updates and deletions of a stored table touch no other bucket."""

import os

from groundwork.operators import keyed_table


def _files(path):
    return {os.path.relpath(os.path.join(f, n), path) for f, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def _rows(spark, path):
    return sorted(map(tuple, keyed_table.read(spark, path).select("id", "project_id", "title").collect()), key=repr)


def test_untouched_files_keep_their_names(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id long, project_id string, title string"
    rows = [(i, "p", f"title {i}") for i in range(200)]
    keyed_table.create(spark.createDataFrame(rows, schema), path, buckets=16)
    first = _files(path)
    assert _rows(spark, path) == sorted(rows, key=repr) and len(first) == 16

    newer = spark.createDataFrame([(3, "p", "old", 1), (3, "p", "new", 2), (900, "p", "added", 1), (3, "q", "of q", 1)], schema + ", seq long")
    n = keyed_table.upsert(spark, path, newer, "seq", buckets=16)
    second = _files(path)
    assert 1 <= n <= 2 and len(first & second) == 16 - n
    want = {(r[1], r[0]): r for r in rows} | {("p", 3): (3, "p", "new"), ("p", 900): (900, "p", "added"), ("q", 3): (3, "q", "of q")}
    assert _rows(spark, path) == sorted(want.values(), key=repr)

    # all rows of one bucket go, and later one comes back
    one = {r.id for r in spark.read.parquet(path).where("bucket = 5").select("id").collect()}
    gone = spark.createDataFrame([(i,) for i in one] * 2 + [(None,)], "id long")
    assert keyed_table.delete(spark, path, gone, buckets=16) == 1
    third = _files(path)
    assert {f for f in second if "bucket=5/" not in f} <= third
    left = sorted((r for r in want.values() if r[0] not in one), key=repr)
    assert _rows(spark, path) == left
    back = (min(one), "p", "back")
    keyed_table.upsert(spark, path, spark.createDataFrame([(*back, 1)], schema + ", seq long"), "seq", buckets=16)
    assert _rows(spark, path) == sorted([*left, back], key=repr)
    assert [tuple(r) for r in keyed_table.lookup(spark, path, [back[0], 12345], buckets=16).select("id", "project_id", "title").collect()] == [back]


def test_nothing_to_do_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id long, project_id string, title string"
    keyed_table.create(spark.createDataFrame([(None, "p", "a"), (1, "p", "b")], schema), path, buckets=4)
    files = _files(path)
    assert keyed_table.upsert(spark, path, spark.createDataFrame([], schema + ", seq long"), "seq", buckets=4) == 0
    assert keyed_table.delete(spark, path, spark.createDataFrame([(None,)], "id long"), buckets=4) == 0 and _files(path) == files
    keyed_table.upsert(spark, path, spark.createDataFrame([(None, "p", "c", 1)], schema + ", seq long"), "seq", buckets=4)
    assert _rows(spark, path) == [(1, "p", "b"), (None, "p", "c")]
