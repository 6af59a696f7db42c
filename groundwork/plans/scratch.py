"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows that may be broadcast; the count is checked first.
MOST_BROADCAST_ROWS = 1_000_000

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of this machine only where that is unset and all tasks run here, as in tests."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        key = spark.sparkContext.applicationId
        folder = _OWN.setdefault(key, "") or f"file://{tempfile.mkdtemp(prefix='spark-')}"
        _OWN[key] = folder
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a table and read again: it is computed once, its lineage is cut and it survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/groundwork/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast only if it has at most so many rows; beyond that a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df for work that is dear for each row: an input of fewer than two splits a core, such as a table in one file, is dealt over all cores; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df
