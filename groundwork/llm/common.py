"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.plans.scratch import shared_folder, stored  # noqa: F401

#: Rows of at most 16 bytes that may be broadcast; the count is checked first.
MOST_BROADCAST_ROWS = 1_000_000


@dataclass
class Entry:
    """A registered query."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    entries: list[Entry] = field(default_factory=list)

    def query(self, name: str):
        def add(run):
            def small_batches(spark, sf_dir):
                bound_batches(spark)
                return run(spark, sf_dir)

            self.entries.append(Entry(name, small_batches))
            return run

        return add


QUERIES = Registry()


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bounds what a Python worker is handed at once: whole texts are large."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast only if it has at most so many rows; beyond that a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def own_columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]
