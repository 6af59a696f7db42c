"""Shards by longest processing time against one heap over all groups."""

import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from groundwork.llm import registry, sharding


def lpt(groups, shards):
    """groups: name -> bytes.  The plain heap over all of them, largest first, equal ones by name."""
    heap, found = [(0, i) for i in range(shards)], {}
    for name, size in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        x, i = heapq.heappop(heap)
        found[name] = i
        heapq.heappush(heap, (x + size, i))
    return found


@pytest.mark.parametrize("seed", range(30))
def test_equal_groups_in_one_step(seed):
    rng = random.Random(seed)
    loads, size, count = [rng.randrange(50) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 12), rng.randrange(60)
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        x, i = heap[0]
        heapq.heapreplace(heap, (x + size, i))
    assert sharding.put_equal(loads, size, count) == [x for x, _ in sorted(heap, key=lambda h: h[1])]


def test_equals_one_heap(spark):
    """Groups of many sizes, one of a third of all rows, and many of one size."""
    rng = random.Random(3)
    texts = [None, "", None, "é", "é 中文", "x" * 5_000_000] + ["hot text"] * 400 + [f"{i:05d}" for i in range(300)] + ["y" * rng.randrange(400) for _ in range(400)]
    ids = [None, 7, 7, 7] + list(range(4, len(texts)))
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, shard string, slot string, `group` string, size string")
    for shards in (1, 7, 40):
        out = sharding.sharded(docs, shards)
        assert out.columns == ["doc_id", "text", "group", "size", "shard", "slot"]
        rows = out.select("doc_id", "text", "shard", "slot", sharding.text_group(F.col("text")).alias("name")).collect()
        assert sorted((repr(r.doc_id), r.text or "") for r in rows) == sorted((repr(i), t or "") for i, t in zip(ids, texts, strict=True))
        size, where, slots = defaultdict(int), {}, defaultdict(list)
        for r in rows:
            size[bytes(r.name)] += len((r.text or "").encode()) + 16
            assert where.setdefault(bytes(r.name), r.shard) == r.shard
            slots[r.shard].append(r.slot)
        assert where == lpt(size, shards)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_query_and_files(spark, data, tmp_path):
    got = registry.queries()["op11_lpt_sharding"](spark, data)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    rows = got.collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    loads, where, slots = defaultdict(int), {}, defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert where.setdefault(raw, r.shard) == r.shard
    assert set(loads) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    group = defaultdict(int)
    for r in rows:
        group[docs[r.doc_id]] += r.size
    assert max(loads.values()) <= sum(loads.values()) / 40 + max(group.values())
    table = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    sharding.write_shards(sharding.sharded(table, 5), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.doc_id: r.text for r in back.collect()} == docs and {r.shard for r in back.collect()} == set(range(5))
