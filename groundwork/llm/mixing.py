"""Mixing sources to target weights by Pfair scheduling.

The texts of each source, in a hashed order, are laid end to end and cut into
blocks of equal size; a document belongs to the block in which it starts.  Block j
of a source of weight w is released at slot floor((j - 1) / w) and due by slot
ceil(j / w).  One block goes to each slot: of those released, the one due first.
So after every slot each source has had its weighted share to within less than
one block.  When a source runs out, the weights of the others are scaled up and
the next phase begins: every document is placed exactly once.

Weights are exact fractions, so the bound holds against the target weights however
many slots there are.  The schedule has no period: the driver walks over the slots,
with two heaps of one entry per source, and keeps only the state at every
`range_slots` slots (ten times the sources at least); tasks go over the ranges again and make a row per block.
Spark does the rest: a count per source and hash bucket, running sums of the
counts, and a running sum inside each bucket, so a source with a third of all
rows is spread over as many tasks as its size asks for.

Defined cases: documents without a source are a source of their own; sources of
weight 0 come after all others, in equal shares; a null or
empty text has size 0 and shares the slot of what follows it; repeated rows are
each placed; ties of the hashed order go by id; an empty table gives no rows;
other columns are kept, and ones with the names of the results are replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import QUERIES, own_columns, small, stored, table

#: Rows of the plan that may be broadcast; with more it is a shuffled join.
MOST_BROADCAST_BLOCKS = 500_000
MOST_LONG = 2**63 - 1
NO_SOURCE = "\0"


def whole_weights(weights: Sequence[float]) -> list[int]:
    """Weights as whole numbers in exactly their proportions."""
    exact = [max(Fraction(0), Fraction(w)) for w in weights]
    common = math.lcm(*[x.denominator for x in exact])
    return [x.numerator * (common // x.denominator) for x in exact]


class Schedule:
    """Earliest deadline first among released blocks; iteration gives (slot, phase, source, block, release, deadline), sources by number.

    state() between two steps is enough to go on from there."""

    def __init__(self, blocks: Sequence[int], weights: Sequence[int], slot: int = 0, phase: int = 0, slot0: int = 0, done: Sequence[int] | None = None, had: Sequence[int] | None = None):
        self.blocks, self.weights, self.slot, self.phase, self.slot0 = blocks, weights, slot, phase, slot0
        self.done, self.had = list(done or [0] * len(blocks)), list(had or [0] * len(blocks))  # before this phase, and in it

    def state(self) -> tuple:
        return self.slot, self.phase, self.slot0, list(self.done), list(self.had)

    def shares(self) -> dict[int, int]:
        """Weights of the sources of this phase."""
        left = [s for s, n in enumerate(self.blocks) if self.done[s] + self.had[s] < n]
        return {s: self.weights[s] for s in left if self.weights[s]} or dict.fromkeys(left, 1)

    def __iter__(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        while share := self.shares():
            total = sum(share.values())
            window = lambda s: (self.had[s] * total // share[s], -(-(self.had[s] + 1) * total // share[s]), s)  # noqa: E731, B023
            later, due = [window(s) for s in share], []
            heapq.heapify(later)
            while True:
                while later and later[0][0] <= self.slot - self.slot0:
                    release, deadline, s = heapq.heappop(later)
                    heapq.heappush(due, (deadline, s, release))
                deadline, s, release = heapq.heappop(due)
                row = self.slot, self.phase, s, self.done[s] + self.had[s], release, deadline
                self.had[s] += 1
                self.slot += 1
                over = self.done[s] + self.had[s] == self.blocks[s]
                if over:
                    for x in share:
                        self.done[x], self.had[x] = self.done[x] + self.had[x], 0
                    self.phase, self.slot0 = self.phase + 1, self.slot
                else:
                    heapq.heappush(later, window(s))
                yield row
                if over:
                    break


def phases(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[dict]:
    """The whole schedule in memory: a row per phase and source with its first block, its slots after slot0 and its share of the ticks.  For looking at; mix_sources makes a table."""
    names = sorted(blocks)
    # more ticks than blocks, so that slots repeat nowhere
    whole = [w * (1 + sum(blocks.values())) for w in whole_weights([weights[s] for s in names])]
    made, rows, share, at = Schedule([blocks[s] for s in names], whole), {}, {}, -1
    for slot, phase, s, block, _, _ in made:
        if phase != at:
            done = {r["source"]: r["first"] + r["n"] for r in rows.values()}
            share = {x: whole[x] for x in range(len(names)) if done.get(names[x], 0) < blocks[names[x]] and whole[x]} or {x: 1 + sum(blocks.values()) for x in range(len(names)) if done.get(names[x], 0) < blocks[names[x]]}
            at, slot0 = phase, slot
        row = rows.setdefault((phase, s), {"source": names[s], "phase": phase, "first": block, "n": 0, "slot0": slot0, "ticks": sum(share.values()), "share": share[s], "slots": []})
        row["n"] += 1
        row["slots"].append(slot - slot0)
    return list(rows.values())


def planned(spark, blocks: Mapping[str, int], weights: Mapping[str, float], range_slots: int = 100_000) -> DataFrame:
    """(__s, mix_block, mix_phase, mix_slot, mix_release, mix_deadline): a row per block."""
    names, states = sorted(blocks), []
    counts, whole, step = [blocks[s] for s in names], whole_weights([weights[s] for s in names]), max(range_slots, 10 * len(names))
    made = Schedule(counts, whole)
    if names:
        states.append(made.state())
    for row in made:
        if (row[0] + 1) % step == 0:
            states.append(made.state())
    kinds = [("__s", pa.string()), ("mix_block", pa.int64()), ("mix_phase", pa.int32()), ("mix_slot", pa.int64()), ("mix_release", pa.int64()), ("mix_deadline", pa.int64())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                rows = []
                for slot, phase, s, block, release, deadline in Schedule(counts, whole, *state):
                    if slot >= state[0] + step:
                        break
                    rows.append((names[s], block, phase, slot, min(release, MOST_LONG), min(deadline, MOST_LONG)))
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    frame = spark.createDataFrame(states, "slot long, phase int, slot0 long, done array<long>, had array<long>")
    return frame.repartition(max(1, len(states))).mapInArrow(of, "__s string, mix_block long, mix_phase int, mix_slot long, mix_release long, mix_deadline long")


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, id: str = "doc_id", source: str = "source", text: str = "text", block_chars: int = 100_000, power: float = 0.5, bucket_rows: int = 5_000, seed: int = 7) -> DataFrame:
    """docs with mix_block, mix_phase, mix_slot, mix_release and mix_deadline (the last two within the phase).

    weights: of sources; one that isn't named gets the smallest of them.  Without weights: size to the power `power`.
    Columns of these names are replaced; a null source is a source of its own; a null text has no characters; repeated or null ids are rows as any other."""
    docs = docs.drop("mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline")
    made = docs.withColumns({"__s": F.coalesce(F.col(f"`{source}`"), F.lit(NO_SOURCE)), "__n": F.coalesce(F.length(f"`{text}`"), F.lit(0)).cast("long"), "__h": F.xxhash64(F.col(f"`{id}`"), F.lit(seed))})
    rows = {r["__s"]: (r["rows"], r["size"]) for r in made.groupBy("__s").agg(F.count("*").alias("rows"), F.sum("__n").alias("size")).collect()}
    spread = max([1, *(-(-n // bucket_rows) for n, _ in rows.values())])
    made = made.withColumn("__b", F.pmod("__h", F.lit(spread)))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(made.groupBy("__s", "__b").agg(F.sum("__n").alias("size")).select("__s", "__b", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__base"), F.sum("size").over(Window.partitionBy("__s")).alias("__size")))
    inside = Window.partitionBy("__s", "__b").orderBy("__h", F.col(f"`{id}`"), "__n").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(bases, ["__s", "__b"])
    blocks = {s: max(1, -(-size // block_chars)) for s, (_, size) in rows.items()}
    block = F.floor((F.col("__base") + F.col("__in")) / block_chars).cast("long")
    made = made.withColumn("mix_block", F.least(block, F.greatest(F.lit(1), F.ceil(F.col("__size") / block_chars)).cast("long") - 1))
    least = min(weights.values()) if weights else 1.0
    goal = {s: (weights.get(s, least) if weights else max(1, size) ** power) for s, (_, size) in rows.items()}
    plan = small(stored(planned(docs.sparkSession, blocks, goal)), MOST_BROADCAST_BLOCKS)
    joined = made.join(plan, ["__s", "mix_block"])
    return joined.select(*own_columns(docs), "mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline")


def mixed_order(docs: DataFrame, **how) -> DataFrame:
    """docs in the order of the mix, as range partitions sorted by slot; mix_slot is the one column added."""
    id = how.get("id", "doc_id")
    return mix_sources(docs, **how).select(*own_columns(docs.drop("mix_slot")), "mix_slot").repartitionByRange("mix_slot", f"`{id}`").sortWithinPartitions("mix_slot", f"`{id}`")


@QUERIES.query("op1_mixing")
def op1_mixing(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs.select("doc_id", "source", F.col("text"))).drop("text")
