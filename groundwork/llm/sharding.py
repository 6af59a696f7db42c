"""Shards of near equal bytes by longest-processing-time scheduling.

Rows that must stay together are one group (by default, equal texts).  Groups are taken
from the largest to the smallest, and each goes to the shard of least bytes, of
several the one of smallest number.

1. One aggregation with map-side combine gives the rows and bytes of every group.  The
   groups, 40 bytes each, are dealt into ranges by (bytes, name), largest first.
2. The driver walks over the sizes that occur, with the number of groups of each, largest
   first, an iterator's batch at a time: many groups of one size are placed in one step, since
   what a run of equal groups does to the loads is known without the heap.  It notes the loads at
   the start of each range, `shards` numbers a range; no group reaches the driver.
3. Each range is a task that goes on from those loads with a heap over its own
   groups.  The outcome is that of one heap over all of them.
4. The place of a row in its shard is the number of rows in groups before its own,
   from running counts per range and shard, plus its place in the group.  A group of more
   than a quarter of a task's share of rows is cut into chunks first, so a group of
   a third of all rows is no task's burden; it still is in one shard.

Defined cases: a null text is an empty one, of size `overhead`, and all of them are one
group; null sizes count 0; null ids come first in their group and repeated rows are
rows of their own; a group larger than a shard's share stays whole and its shard is larger
than the others; an empty table gives no rows; columns of the input named shard or slot
are replaced, all others are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import QUERIES, small, stored, table

#: Bytes that a row takes beside its text.
OVERHEAD = 16
#: From so many groups of one size for each shard on, they are placed in one step.
MANY = 4


def text_group(text: Column) -> Column:
    """A name of 16 bytes that equal texts share."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_size(text: Column, overhead: int = OVERHEAD) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead


def put_equal(loads: list[int], size: int, count: int) -> list[int]:
    """The loads after `count` groups of one size went to the least loaded shard one by one.

    The groups take the `count` smallest of the steps (load + j * size, shard); the level below which all steps are taken is found by bisection."""
    if size <= 0:
        return list(loads)
    steps = lambda level: sum(max(0, -(-(level - x) // size)) for x in loads)  # noqa: E731  steps below level
    low, high = min(loads), max(loads) + count * size + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if steps(middle) <= count else (low, middle)
    taken = [max(0, -(-(low - x) // size)) for x in loads]
    left = count - sum(taken)
    for i, x in enumerate(loads):
        if left and x + taken[i] * size == low:
            taken[i], left = taken[i] + 1, left - 1
    return [x + t * size for x, t in zip(loads, taken, strict=True)]


def loads_at_starts(sizes: Iterable[tuple[int, int, int]], shards: int) -> dict[int, list[int]]:
    """Rows (part, size, number of groups), in order of part and falling size -> the loads when each part starts."""
    starts, heap = {}, [(0, i) for i in range(shards)]
    for part, size, count in sizes:
        if part not in starts:
            starts[part] = [x for x, _ in sorted(heap, key=lambda h: h[1])]
        if count >= MANY * shards:
            loads = [x for x, _ in sorted(heap, key=lambda h: h[1])]
            heap = [(x, i) for i, x in enumerate(put_equal(loads, size, count))]
            heapq.heapify(heap)
        else:
            for _ in range(count):
                x, i = heap[0]
                heapq.heapreplace(heap, (x + size, i))
    return starts


def _scheduled(starts: dict[int, list[int]], shards: int):
    """(part, group, n, bytes) in order -> with the shard of the group and the rows that the part put there before."""
    schema = pa.schema([("part", pa.int32()), ("group", pa.binary()), ("n", pa.int64()), ("shard", pa.int32()), ("before", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heap, rows = None, [], [0] * shards
        for batch in batches:
            shard, before = [], []
            for part, n, size in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                if part != at:
                    at, heap, rows = part, [(x, i) for i, x in enumerate(starts[part])], [0] * shards
                    heapq.heapify(heap)
                x, i = heap[0]
                heapq.heapreplace(heap, (x + size, i))
                shard.append(i)
                before.append(rows[i])
                rows[i] += n
            yield pa.RecordBatch.from_arrays([batch["part"].cast(pa.int32()), batch["group"].cast(pa.binary()), batch["n"], pa.array(shard, pa.int32()), pa.array(before, pa.int64())], schema=schema)

    return of


def scheduled_groups(groups: DataFrame, shards: int, ranges: int | None = None) -> DataFrame:
    """Stored groups(group binary, n, bytes) -> (group, n, shard, base): base is the number of rows that come before the group in its shard."""
    spark = groups.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // 1_000_000))
    dealt = stored(groups.repartitionByRange(ranges, F.desc("bytes"), "group").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part", "bytes").count().orderBy("part", F.desc("bytes"))
    starts = loads_at_starts(((r[0], r[1], r[2]) for r in sizes.toLocalIterator(prefetchPartitions=True)), shards)
    ordered = dealt.select("part", "group", "n", "bytes").repartitionByRange(ranges, "part").sortWithinPartitions("part", F.desc("bytes"), "group")
    placed = stored(ordered.mapInArrow(_scheduled(starts, shards), "part int, group binary, n bigint, shard int, before bigint"))
    totals = placed.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(totals.select("shard", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset")))
    return placed.join(small(offsets), ["shard", "part"]).select("group", "n", "shard", (F.col("before") + F.col("offset")).alias("base"))


def placed(rows: DataFrame, group: Column, size: Column, order: str, shards: int = 40, ranges: int | None = None) -> DataFrame:
    """rows with shard int and slot long: rows of one group share a shard, slots of a shard run from 0 without gaps.

    The rows are written to the shared folder once: give those columns only that are wanted."""
    if shards < 1:
        raise ValueError("at least one shard")
    own = [c for c in rows.columns if c not in ("shard", "slot")]
    kept = stored(rows.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(own)], F.col(f"`{order}`").alias("order"), group.alias("group"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
    groups = stored(kept.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    most = max(1, -(-total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    # at most total / most groups, 4 a shuffle partition, are larger than that
    large = stored(groups.where(F.col("n") > most).select("group", F.ceil(F.col("n") / most).cast("int").alias("chunks")))
    chunk = F.coalesce(F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"), F.lit(0))
    cut = kept.join(F.broadcast(large), "group", "left").withColumn("chunk", chunk).drop("chunks")
    sizes = cut.join(F.broadcast(large), "group", "left_semi").groupBy("group", "chunk").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("group", "chunk", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("ahead"))
    where = scheduled_groups(groups, shards, ranges).select("group", "shard", "base")
    whole = where.join(F.broadcast(large), "group", "left_anti").select("group", F.lit(0).alias("chunk"), "shard", "base")
    parts = before.join(where.join(F.broadcast(large), "group", "left_semi"), "group").select("group", "chunk", "shard", (F.col("base") + F.col("ahead")).alias("base"))
    found = cut.join(whole.unionByName(parts), ["group", "chunk"])
    turn = F.row_number().over(Window.partitionBy("group", "chunk").orderBy("order", "row"))
    return found.withColumn("turn", turn).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(own)], F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("turn") - 1).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = 40, text: str = "text", order: str = "doc_id", overhead: int = OVERHEAD) -> DataFrame:
    """docs with shard and slot, equal texts together."""
    return placed(docs, text_group(F.col(f"`{text}`")), text_size(F.col(f"`{text}`"), overhead), order, shards)


def write_shards(placed_rows: DataFrame, path: str, files: int | None = None) -> None:
    """Rows with shard and slot as Parquet, a folder for each shard, its files and rows in order of slot."""
    files = files or int(placed_rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed_rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@QUERIES.query("op11_lpt_sharding")
def op11_lpt_sharding(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    rows = docs.select("doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), text_group(text).alias("name"))
    made = placed(rows, F.col("name"), F.col("size"), "doc_id", 40)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
