"""A stored table in buckets by key, whose updates and deletions rewrite only the buckets that they touch.

A bucket is a folder; readers of one key read one folder.  An update reads the
touched buckets, writes their new rows to the shared folder and then overwrites
those partitions dynamically: a job that fails before its commit leaves the table
as it was, and files of other buckets stay.  The commit moves folder after
folder, so readers at that moment may see some buckets before and some after it;
updates of one table must not run at the same time.

A bucket without rows keeps one row of nulls that is not live, since an overwrite
replaces only partitions that it has rows for.  The number of buckets is a
property of the table and is given with each call; lists of touched buckets are
at most as long.  A null id is a key like others for updates; deletions match none."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.tables import upserted, without_keys
from groundwork.plans.scratch import shared_folder, stored
from groundwork.registry import operator
from groundwork.views import load, with_views

#: Buckets of a table; some hundred MB each are a good size.
BUCKETS = 64


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int").alias("bucket")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Rows with their bucket and __live; a bucket is written by one task."""
    rows.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create(df: DataFrame, path: str, key: str = "id", buckets: int = BUCKETS) -> None:
    """Writes df as a new table; buckets without rows have no folder yet."""
    _write(df.withColumns({"bucket": _bucket(key, buckets), "__live": F.lit(True)}), path, "errorifexists")


def _stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table."""
    return _stored_rows(spark, path).where("__live").drop("__live", "bucket")


def lookup(spark: SparkSession, path: str, ids: list, key: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """Rows of a few keys, from their folders alone."""
    wanted = {r[0] for r in spark.createDataFrame([(str(i),) for i in ids], f"`{key}` string").select(_bucket(key, buckets)).collect()}
    return _stored_rows(spark, path).where(F.col("bucket").isin(sorted(wanted)) & F.col("__live") & F.col(key).isin(ids)).drop("__live", "bucket")


def _replace(spark: SparkSession, path: str, change: DataFrame, key: str, buckets: int, edit) -> int:
    """Overwrites the buckets that change touches by edit(their rows, change); returns how many they are."""
    change = stored(change.withColumn("bucket", _bucket(key, buckets)))
    touched = sorted(r.bucket for r in change.select("bucket").distinct().collect())
    if not touched:
        return 0
    old = _stored_rows(spark, path).where(F.col("bucket").isin(touched) & F.col("__live")).drop("__live")
    new = stored(edit(old, change).withColumn("__live", F.lit(True)))
    full = new.select("bucket").distinct()
    rest = spark.createDataFrame([(b,) for b in touched], "bucket int").join(full, "bucket", "left_anti").withColumn("__live", F.lit(False))
    _write(new.unionByName(rest, allowMissingColumns=True), path, "overwrite")
    return len(touched)


def upsert(spark: SparkSession, path: str, delta: DataFrame, order: str, keys: tuple[str, ...] = ("project_id", "id"), key: str = "id", buckets: int = BUCKETS) -> int:
    """Puts the rows of delta in by keys, of which key chooses the bucket; the row of highest `order` wins.  Returns the number of buckets rewritten."""
    if key not in keys:
        raise ValueError(f"{key} is not one of the keys")
    return _replace(spark, path, delta, key, buckets, lambda old, change: upserted(old, change, order, keys))


def delete(spark: SparkSession, path: str, gone: DataFrame, key: str = "id", buckets: int = BUCKETS) -> int:
    """Removes the rows whose key is in gone.  Returns the number of buckets rewritten."""
    return _replace(spark, path, gone.select(key).where(F.col(key).isNotNull()).distinct(), key, buckets, lambda old, change: without_keys(old, change, (key,)))


# queries ---------------------------------------------------------------------
@operator("s6_s7_stored_table", with_views("""SELECT id, project_id, CASE WHEN id % 5 = 0 THEN 'checked ' || CAST(id AS STRING) ELSE claim_text END AS claim_text FROM {claims}
  WHERE id % 5 = 0 OR id NOT IN (SELECT claim_id FROM {evidence} WHERE evidence_type = 'contradicting')"""))
def _s6_s7(spark, d):
    path = f"{shared_folder(spark)}/groundwork/{uuid.uuid4().hex}"
    claims = load(spark, d, "claims").select("id", "project_id", "claim_text")
    create(claims, path)
    delete(spark, path, load(spark, d, "evidence").where("evidence_type = 'contradicting'").select(F.col("claim_id").alias("id")))
    upsert(spark, path, claims.where("id % 5 = 0").withColumns({"claim_text": F.expr("'checked ' || CAST(id AS STRING)"), "seq": F.lit(1)}), "seq")
    return read(spark, path)
