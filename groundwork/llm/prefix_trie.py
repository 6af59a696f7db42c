"""Prefix trie of conversations as balanced parentheses.

A node is a sequence of first turns that some conversation starts with.  The trie says what a
cache of shared prefixes would save.

1. A turn is named by 16 bytes that equal turns share; a conversation is the list of its turns'
   names and sizes.  Equal conversations are one class with a count, found by an
   aggregation with map-side combine, so copies cost one.
2. The classes are dealt into ranges in order of their names.  Each range is a shard: a task writes the
   trie of its classes as balanced parentheses, an opening and a closing one per node, with
   blocks of least and greatest excess over them, as leaves of a tree.  find_close() delimits
   the subtrees; leaves are the pairs "()" whose rank is counted up to both ends of a
   subtree; members and savings are differences of cumulative arrays.
3. Only nodes on the path to the first or to the last class of a shard may also be in another one. These
   spines (two paths a shard) are added up by the names of their paths and merged into one small tree, in one task; every other
   node is final where it is.

The ids that end at a node are joined in runs of ids first, and a task reads the runs of a
node in order, one at a time, for the digest.

Rows and bytes moved are in proportion to the turns, at 16 bytes and some of overhead each; texts are
read once and not moved.  What is held in one place: the turn names of a conversation (one row), the
nodes of a shard and the spines of all shards.

Defined cases: a null role or text is empty; null turns come first; turns of equal number go by role,
then by name; a null conv_id takes no part; a conversation without turns ends at the
root; an empty table has no nodes, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import QUERIES, small, stored, table

#: Parentheses of a block of excess.
BLOCK = 128
#: Ids joined at once for a digest: those with equal higher bits.
RUN_BITS = 12
#: Turns of a shard, about.
SHARD_TURNS = 500_000
_NONE = hashlib.sha256(b"").hexdigest()
_ROOT = b"root"


class Parentheses:
    """A balanced sequence, True opening, with the least and the greatest excess of blocks and of pairs of blocks."""

    def __init__(self, opens: np.ndarray, block: int = BLOCK):
        self.opens, self.block = opens, block
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int64)
        blocks = max(1, -(-len(opens) // block))
        self.leaves = 1 << (blocks - 1).bit_length()
        padded = np.full(self.leaves * block, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        self.least = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.least[self.leaves :] = padded.reshape(self.leaves, block).min(1)
        padded[len(opens) :] = np.iinfo(np.int64).min
        self.greatest = np.full(2 * self.leaves, np.iinfo(np.int64).min)
        self.greatest[self.leaves :] = padded.reshape(self.leaves, block).max(1)
        level = self.leaves
        while level > 1:
            self.least[level // 2 : level] = self.least[level : 2 * level].reshape(-1, 2).min(1)
            self.greatest[level // 2 : level] = self.greatest[level : 2 * level].reshape(-1, 2).max(1)
            level //= 2
        self.rank = np.append(0, np.cumsum(opens))
        self.pairs = np.append(0, np.cumsum(opens & ~np.append(opens[1:], True)))

    def _holds(self, node: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.least[node] <= target) & (target <= self.greatest[node])

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """Where each opening parenthesis is closed: the first place after it with an excess less by one."""
        target, found = self.excess[at] - 1, np.full(len(at), -1)
        self._in_block(at + 1, target, found, np.arange(len(at)))
        far = np.flatnonzero(found < 0)
        node, up = at[far] // self.block + self.leaves, np.ones(len(far), bool)
        while up.any():  # to the first block on the right that holds the target, by way of common parents
            beside = up & (node % 2 == 0) & self._holds(node | 1, target[far])
            node = np.where(beside, node | 1, np.where(up, node // 2, node))
            up &= ~beside
        while (node < self.leaves).any():  # down to it
            inner = node < self.leaves
            left = 2 * np.where(inner, node, 0)
            node = np.where(inner, np.where(self._holds(left, target[far]), left, left + 1), node)
        self._in_block((node - self.leaves) * self.block, target[far], found, far)
        return found

    def _in_block(self, start: np.ndarray, target: np.ndarray, found: np.ndarray, which: np.ndarray) -> None:
        """Looks from start to the end of its block."""
        last = np.minimum((start // self.block + 1) * self.block, len(self.opens))
        on = np.arange(len(start))
        for o in range(self.block):
            on = on[start[on] + o < last[on]]
            if not len(on):
                return
            hit = self.excess[start[on] + o] == target[on]
            found[which[on[hit]]] = start[on[hit]] + o
            on = on[~hit]


class Shard:
    """The trie of classes that come in order of their names."""

    def __init__(self):
        self.opens, self.depth, self.size, self.parent = [True], [0], [0], [-1]
        self.members, self.first, self.ends = [0], [np.iinfo(np.int64).max], [None]
        self.names: list[bytes] = []
        self.path, self.left = [0], None
        self.keys = {0: _ROOT}

    def add(self, names: list[bytes], sizes: list[int], members: int, first: int, ends: str) -> None:
        same = 0
        for a, b in zip(names, self.names):  # noqa: B905
            if a != b:
                break
            same += 1
        self.opens += [False] * (len(self.names) - same)
        del self.path[same + 1 :]
        for d in range(same, len(names)):
            self.parent.append(self.path[-1])
            self.path.append(len(self.depth))
            self.depth.append(d + 1)
            self.size.append(sizes[d])
            self.members.append(0)
            self.first.append(np.iinfo(np.int64).max)
            self.ends.append(None)
            self.opens.append(True)
        self.names = names
        at = self.path[-1]
        self.members[at], self.first[at], self.ends[at] = members, first, ends
        if self.left is None:
            self.left = list(self.path)
            self._name(self.left, names)

    def _name(self, path: list[int], names: list[bytes]) -> None:
        for node, parent, name in zip(path[1:], path, names, strict=False):
            self.keys[node] = hashlib.md5(self.keys[parent] + name).digest()

    def nodes(self) -> pa.RecordBatch:
        """One row per node; nodes of the spines have the name of their path, and what hangs on them outside the spines."""
        self._name(self.path, self.names)
        tree = Parentheses(np.array(self.opens + [False] * (len(self.names) + 1)))
        at = np.flatnonzero(tree.opens)
        close = tree.find_close(at)
        begin, end = np.arange(len(at)), tree.rank[close + 1]
        depth, size, parent = np.array(self.depth), np.array(self.size, np.int64), np.array(self.parent)
        within = lambda x: (lambda c: c[end] - c[begin])(np.append(0, np.cumsum(x)))
        members = within(np.array(self.members, np.int64))
        saved = within((members - 1) * size)
        leaves = tree.pairs[close + 1] - tree.pairs[at]
        children = np.bincount(parent[1:], minlength=len(at))
        first = np.array(self.first, np.int64)
        order = np.argsort(depth, kind="stable")
        level = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        for d in range(int(depth.max()), 0, -1):
            some = order[level[d] : level[d + 1]]
            np.minimum.at(first, parent[some], first[some])
        spine = np.zeros(len(at), bool)
        spine[list(self.keys)] = True
        hung = np.flatnonzero(~spine & spine[np.maximum(parent, 0)])
        for values in (saved, leaves):
            values[spine] = 0
            np.add.at(values, parent[hung], values[hung])
        children[spine] = 0
        np.add.at(children, parent[hung], 1)
        above = first[np.maximum(parent, 0)]
        keyed = lambda i: self.keys.get(int(i)) if i >= 0 else None
        by_key = spine | spine[np.maximum(parent, 0)]
        columns = [
            pa.array([self.keys.get(i) for i in range(len(at))], pa.binary()), pa.array([keyed(p) if k else None for p, k in zip(parent.tolist(), by_key.tolist(), strict=True)], pa.binary()),
            pa.array(depth, pa.int64()), pa.array(first), pa.array(above, mask=by_key), pa.array(members), pa.array(children.astype(np.int64)), pa.array(leaves.astype(np.int64)), pa.array(saved), pa.array(size), pa.array(self.ends, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)


_NAMES = ["key", "parent_key", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "ends"]
_NODES = "key binary, parent_key binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = None
    for batch in batches:
        shard = shard or Shard()
        for row in zip(*(batch[c].to_pylist() for c in ("names", "sizes", "members", "first", "ends")), strict=True):
            shard.add(*row)
    if shard and shard.left is not None:
        made = shard.nodes()
        for k in range(0, made.num_rows, 50_000):
            yield made.slice(k, 50_000)


def _merged_spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all spines, once each -> the same with what hangs on the spine nodes below them added."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    by_key = {r["key"]: r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["size"]
        up = by_key.get(r["parent_key"])
        if up:
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
            r["parent_conv_id"] = up["conv_id"]
    schema = batch_schema()
    for k in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_pylist(rows[k : k + 50_000], schema=schema)


def batch_schema() -> pa.Schema:
    kinds = [pa.binary()] * 2 + [pa.int64()] * 8 + [pa.string()]
    return pa.schema(list(zip(_NAMES, kinds, strict=True)))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, ids) in order of seq and ids -> the digest of each seq's ids."""
    at, done, names, out = None, None, [], []
    for batch in batches:
        for seq, ids in zip(batch["seq"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if seq == at:
                done.update(f",{ids}".encode())
            else:
                if done:
                    names.append(at)
                    out.append(done.hexdigest())
                at, done = seq, hashlib.sha256(ids.encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.string())], ["seq", "ends"])
            names, out = [], []
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([*names, at], pa.binary()), pa.array([*out, done.hexdigest()], pa.string())], ["seq", "ends"])


def named_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, name, size) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), name.alias("name"), F.octet_length(text).cast("long").alias("size"))


def sequences(named: DataFrame, *by: str) -> DataFrame:
    """(by..., conv_id, turns): the turns of each conversation in order, each a struct of turn, role, name and size."""
    return named.groupBy(*by, "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "name", "size"))).alias("turns"))


def crossed(turns: DataFrame, apart: int = 5, most: int = 9) -> DataFrame:
    """Conversations (conv_id, turns) rebuilt: the first h turns of conversation c - c % apart, then c's own after its first h, h being crc32(c) % most.

    Dealt by that conversation, so grouping and rebuilding take one shuffle."""
    base = (F.col("conv_id") - F.col("conv_id") % apart).alias("base")
    own = sequences(named_turns(turns).select("*", base).repartition("base"), "base")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    made = own.withColumn("head", head).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    return made.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _name_of(turns: Column) -> Column:
    return F.unhex(F.md5(F.array_join(F.transform(turns, lambda t: F.hex(t["name"])), "")))


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of conversations (conv_id, turns as of sequences()); a conv_id is there once."""
    spark = conversations.sparkSession
    kept = stored(conversations.select("conv_id", _name_of(F.col("turns")).alias("seq"), F.transform("turns", lambda t: t["name"]).alias("names"), F.transform("turns", lambda t: t["size"]).alias("sizes")))
    runs = kept.select("seq", "conv_id", F.shiftright("conv_id", RUN_BITS).alias("run")).groupBy("seq", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = runs.repartition("seq").sortWithinPartitions("seq", "run").select("seq", "ids").mapInArrow(_digest, "seq binary, ends string")
    classes = kept.groupBy("seq").agg(F.count("*").alias("members"), F.min("conv_id").alias("first"), F.first("names").alias("names"), F.first("sizes").alias("sizes"))
    classes = stored(classes.join(ends, "seq").select("names", "sizes", "members", "first", "ends"))
    turns = classes.agg(F.sum(F.size("names"))).first()[0] or 0
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    nodes = stored(classes.repartitionByRange(shards, "names").sortWithinPartitions("names").mapInArrow(_shard_nodes, _NODES))
    total = lambda c: F.sum(c).alias(c)
    spine = nodes.where("key IS NOT NULL").groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"), F.first("size").alias("size"), F.max("ends").alias("ends"))
    spine = stored(spine.select(*_NAMES).repartition(1).mapInArrow(_merged_spine, _NODES))
    above = small(spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("spine_conv_id")))
    inner = nodes.where("key IS NULL").join(above, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "spine_conv_id"))
    last = F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256")
    return inner.select(*OUT, last).unionByName(spine.select(*OUT, last))


@QUERIES.query("op13_prefix_trie")
def op13_prefix_trie(spark, sf_dir) -> DataFrame:
    return trie(crossed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
