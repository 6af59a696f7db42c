"""Hard negatives by a vertical scan with bounds (BOND).

A score is the integer inner product of two quantised vectors.  Rows are dealt into
blocks; a block is held column by column, with the least and the greatest value of each
dimension.  For an anchor the columns are read in falling order of the anchor's
magnitude.  After each stride of columns the partial score of a row together with the least and the greatest
that the columns not yet read can add bounds its score, and rows that cannot be
wanted leave the candidate bitmap; the rest are read on until scores are exact.

1. The first pass wants an anchor's `positives` best rows of its own label: a row leaves
   when that many others are certainly better.
2. Each positive opens a window of scores, `least` to `most` per cent of its own.  The second
   pass wants the `negatives` best rows of other labels in each window: a row leaves
   when it can be in no window, or is certainly behind that many rows which certainly are.

A unit of work is a block of rows with a group of anchors, both bounded; every row meets every
anchor once a pass, in blocks, and at most the wanted rows of each block leave a unit.  The best over
all blocks are taken by Spark.

Defined cases: rows with a null id, label or vector, and those whose vector holds null or
non-finite components, take no part; components beyond 65,536 count as that; repeated
rows (equal in id, label and vector) count once, and rows of one id that differ are rows of their own;
vectors of different lengths don't meet; empty vectors score 0; a positive of negative score has an empty window;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import QUERIES, stored, table

#: Rows of a block, anchors of a group.
MOST_ROWS, LEAST_ROWS, MOST_ANCHORS = 65_536, 256, 4096
#: Columns read between two looks at the bounds.
STRIDE = 8
#: Magnitude of a quantised component; scores of up to 2**14 dimensions stay within 64 bits.
MOST = 1 << 24


class Block:
    """Rows of one length, column by column, in order of id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, top: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        exact = np.float64 if float(np.abs(vectors).max(initial=0)) * top * vectors.shape[1] < 2**53 else np.int64  # products of doubles are exact below 2**53
        self.columns = np.ascontiguousarray(vectors[order].T.astype(exact))
        none = np.zeros(len(self.columns), exact)
        self.low, self.high = (self.columns.min(1), self.columns.max(1)) if len(ids) else (none, none)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, exact scores, components read) of the rows of the bitmap that wanted(lower, upper) never turned down."""
        anchor = anchor.astype(self.columns.dtype)
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.sort(np.stack([anchor * self.low, anchor * self.high]), axis=0)[:, order]
        below, above = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in ends)  # what the columns from t on add at least, at most
        rows, read = np.flatnonzero(bitmap), 0
        score, alive = np.zeros(len(rows), self.columns.dtype), np.ones(len(rows), bool)
        for t in range(0, len(order), STRIDE):
            if not len(rows):
                break
            some = order[t : t + STRIDE]
            columns = self.columns[some] if len(rows) == len(self.ids) else self.columns[np.ix_(some, rows)]
            score += anchor[some] @ columns
            read += columns.size
            after = min(t + STRIDE, len(order))
            alive &= wanted(score + below[after], score + above[after], alive)
            if 2 * alive.sum() < len(alive) or after == len(order):
                rows, score, alive = rows[alive], score[alive], np.ones(int(alive.sum()), bool)
        return rows, score.astype(np.int64), read


def _best(values: np.ndarray, k: int):
    """The k-th largest value, or none."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def among_best(k: int):
    def wanted(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray) -> np.ndarray:
        least = _best(lower[alive], k)
        return alive if least is None else upper >= least

    return wanted


def best_in_windows(windows: list[tuple[int, int]], k: int):
    """windows: closed ranges of scores."""

    def wanted(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray) -> np.ndarray:
        any_ = np.zeros(len(lower), bool)
        for lo, hi in windows:
            least = _best(lower[alive & (lower >= lo) & (upper <= hi)], k)
            any_ |= (upper >= (lo if least is None else max(lo, least))) & (lower <= hi)
        return any_

    return wanted


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [np.asarray(c.flatten()) for c in vectors.chunks]
    return np.concatenate([np.zeros(0, np.int32), *flat]).astype(np.int64).reshape(len(vectors), dim)


def _unit(rows: pa.Table, anchors: pa.Table) -> tuple[Block, list[tuple[int, object, int, np.ndarray]]]:
    dim = rows["dim"][0].as_py()
    asked = _matrix(anchors["q"], dim)
    block = Block(rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["q"], dim), int(np.abs(asked).max(initial=0)))
    return block, list(zip(anchors["anchor"].to_pylist(), anchors["label"].to_pylist(), anchors["id"].to_pylist(), asked, strict=True))


def _positives(k: int):
    schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def of(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 3]
        if rows.num_rows and anchors.num_rows:
            block, asked = _unit(rows, anchors)
            for name, label, id, vector in asked:
                bitmap = block.labels == label
                for i in range(*np.searchsorted(block.ids, [id, id + 1])):
                    bitmap[i] &= not (block.columns[:, i] == vector).all()
                at, score, _ = block.scan(vector, bitmap, among_best(k))
                first = np.lexsort((block.ids[at], -score))[:k]
                out.append([np.full(len(first), name, np.int64), block.ids[at[first]], score[first]])
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return of


def _negatives(k: int, least: int, most: int):
    schema = pa.schema([("anchor", pa.int64()), ("w", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def of(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)] * 4]
        if rows.num_rows and anchors.num_rows:
            block, asked = _unit(rows, anchors)
            for (name, label, _, vector), scores in zip(asked, anchors["scores"].to_pylist(), strict=True):
                windows = [(-(-least * s // 100), most * s // 100) for s in scores]
                at, score, _ = block.scan(vector, block.labels != label, best_in_windows(sorted({w for w in windows if w[0] <= w[1]}), k))
                for w, (lo, hi) in enumerate(windows):
                    fits = np.flatnonzero((score >= lo) & (score <= hi))
                    first = fits[np.lexsort((block.ids[at[fits]], -score[fits]))[:k]]
                    out.append([np.full(len(first), name, np.int64), np.full(len(first), w), block.ids[at[first]], score[first]])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return of


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, computed in double precision."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int"))


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, block_rows: int | None = None, group_anchors: int = MOST_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchor says which rows are anchors, label is the label that counts."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), label.alias("label"), v.alias("v"), anchor.alias("anchored"), bad.alias("bad"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT coalesce(bad, true)")
    base = stored(rows.select("id", "label", quantised(F.col("v")).alias("q"), F.coalesce("anchored", F.lit(False)).alias("anchored")).dropDuplicates(["id", "label", "q"]).withColumn("dim", F.size("q")))
    n, m = base.agg(F.count("*"), F.count_if("anchored")).first()
    blocks = -(-n // block_rows) if block_rows else max(-(-n // MOST_ROWS), min(32, -(-n // LEAST_ROWS)))
    blocks, groups = max(1, blocks), max(1, -(-m // group_anchors))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    key = ["dim", "block", "part"]
    left = base.select("id", "label", "q", "dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("part")).groupBy(*key)
    asked = stored(base.where("anchored").select("id", "label", "q", "dim", F.xxhash64("id", "label", "q").alias("anchor")))

    def met(some: DataFrame, of, schema: str) -> DataFrame:
        right = some.withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
        return left.cogroup(right.groupBy(*key)).applyInArrow(of, schema)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    near = first(met(asked, _positives(positives), "anchor bigint, id bigint, score bigint"), ["anchor"], positives)
    near = stored(near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near")))  # `positives` entries at most
    windows = near.select("anchor", F.posexplode("near").alias("w", "p")).select("anchor", "w", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    sought = asked.join(near.select("anchor", F.col("near.score").alias("scores")), "anchor")
    far = first(met(sought, _negatives(negatives, least, most), "anchor bigint, w int, id bigint, score bigint"), ["anchor", "w"], negatives)
    named = far.join(windows, ["anchor", "w"]).join(asked.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


@QUERIES.query("op12_bond_negatives")
def op12_bond_negatives(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)
