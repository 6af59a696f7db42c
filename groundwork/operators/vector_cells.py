"""Exact nearest vectors by cells around pivots.

A bounded number of vectors, chosen by hash, are pivots; every vector is in the cell of its
nearest one, with its distance to it.  By the triangle inequality no vector of a cell
is nearer to a query than the query's distance to the pivot allows for the cell's least and greatest
radius, which bounds the score of the whole cell.

1. Each query scans its nearest cells that hold k vectors; the k-th best score is its floor.
2. It then scans only cells whose bound reaches the floor.

A unit of work is a block of a cell with a group of queries, both bounded, and at most k
rows of a query leave it.  Where vectors have no structure few cells can be ruled out; the
result is exact all the same, and scanned_share() tells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from groundwork.plans.scratch import stored

#: Pivots, vectors of a block and queries of a group at most.
MOST_PIVOTS, BLOCK, GROUP = 1024, 8192, 4096
#: Numbers of a table of scores, distances, bounds or coordinates that a task holds at once.
TABLE = 1_000_000
#: Bounds and scores may differ by rounding.
SLACK = 1e-7


def matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows of dim numbers, the length of the longest; shorter ones end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    flat = np.nan_to_num(np.asarray(vectors.flatten(), dtype=np.float64))
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    ends = np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        out[i, :size] = flat[end - size : end]
    return out


def units(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows scaled to length 1, unless nearly zero or already that long."""
    x = matrix(vectors, dim)
    square = (x * x).sum(1, keepdims=True)
    scaled = (square > 1e-12) & (np.abs(square - 1) > 1e-6)
    return np.where(scaled, x / np.sqrt(np.where(scaled, square, 1)), x)


def _slices(rows: int, columns: int) -> Iterator[slice]:
    """Ranges of rows whose table with so many columns has TABLE numbers at most, or a row."""
    step = max(1, TABLE // max(columns, 1))
    return (slice(s, s + step) for s in range(0, rows, step))


def _sliced(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in _slices(batch.num_rows, columns):
            yield batch.slice(some.start, some.stop - some.start)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _in_cells(pivots: np.ndarray, kind: pa.DataType):
    """(id, v) -> (id, v, cell, radius, square)."""
    names = ["id", "v", "cell", "radius", "square"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, max(pivots.shape)):
            x = units(batch.column(1), pivots.shape[1])
            d = _distances(x, pivots)
            cell = d.argmin(1)
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array((x * x).sum(1))], names)

    return of


def _bounds(x: np.ndarray, pivots: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance to each cell's pivot, largest inner product that a vector of the cell can have); cells: number, least and greatest radius, greatest square, size."""
    d = _distances(x, pivots[cells[:, 0].astype(int)])
    nearest = np.maximum(np.maximum(d - cells[:, 2], cells[:, 1] - d), 0)
    return d, ((x * x).sum(1)[:, None] + cells[:, 3] - nearest**2) / 2


def _asking(pivots: np.ndarray, cells: np.ndarray, k: int, kind: pa.DataType, again: bool):
    """(id, v[, floor]) -> (cell, id, v): the nearest cells that hold k vectors, or, again, all others that may reach the floor."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, max(len(cells), pivots.shape[1])):
            if not len(cells):
                return
            d, bound = _bounds(units(batch.column(1), pivots.shape[1]), pivots, cells)
            order = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(cells[:, 4][order], axis=1)
            first = np.zeros(d.shape, bool)
            np.put_along_axis(first, order, np.append(np.zeros((len(d), 1)), held[:, :-1], axis=1) < k, axis=1)
            if again:
                floor = batch.column(2).to_numpy(zero_copy_only=False)
                first = ~first & (np.isnan(floor)[:, None] | (bound >= floor[:, None] - SLACK))
            row, at = np.nonzero(first)
            for s in range(0, len(row), 5000):
                some = pa.array(row[s : s + 5000])
                yield pa.RecordBatch.from_arrays([pa.array(cells[at[s : s + 5000], 0].astype(np.int32)), batch.column(0).take(some).cast(kind), batch.column(1).take(some).cast(pa.list_(pa.float64()))], ["cell", "query", "v"])

    return of


def _best(k: int, dim: int, schema: pa.Schema):
    def of(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids = np.array(vectors["id"].to_pylist())
        order = np.argsort(ids, kind="stable")
        asked, held = units(queries["v"], dim), matrix(vectors["v"], dim)[order].T
        rows, flat, kept = [], [], []
        for some in _slices(len(asked), len(order)):
            scores = asked[some] @ held
            best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
            rows.append(np.repeat(np.arange(some.start, some.start + len(best)), best.shape[1]))
            flat.append(order[best].ravel())
            kept.append(np.take_along_axis(scores, best, axis=1).ravel())
        row, at = np.concatenate(rows), np.concatenate(flat)
        return pa.Table.from_arrays([queries["query"].take(pa.array(row)).combine_chunks(), vectors["id"].take(pa.array(at)).combine_chunks(), pa.array(np.concatenate(kept))], schema=schema)

    return of


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, pivots: int | None = None, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, chunk_id, score): inner products of vectors scaled to length 1, among them the k best of each query (query_id, embedding) over vectors (chunk_id, embedding).

    Null vectors are not found; shorter vectors count as ending in zeros."""
    return _nearest(queries, vectors, k, pivots, block, group)[0]


def scanned_share(queries: DataFrame, vectors: DataFrame, k: int, pivots: int | None = None) -> float:
    """The share of all pairs of queries and vectors whose score was computed."""
    _, pairs, total = _nearest(queries, vectors, k, pivots, BLOCK, GROUP)
    return (pairs.first()[0] or 0) / max(total, 1)


def _nearest(queries: DataFrame, vectors: DataFrame, k: int, pivots: int | None, block: int, group: int) -> tuple[DataFrame, DataFrame, int]:
    base = vectors.where("embedding IS NOT NULL").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))
    asked = stored(queries.where("embedding IS NOT NULL").select(F.col("query_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")))
    n, dim = base.agg(F.count("*"), F.max(F.size("v"))).first()
    m, other = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(dim or 0, other or 0, 1)
    block, group = (max(1, min(x, TABLE // dim)) for x in (block, group))  # long vectors come in smaller units
    count = pivots or max(1, min(MOST_PIVOTS, round(n**0.5 / 4)))
    id_kind, query_kind = base.schema["id"].dataType, asked.schema["id"].dataType
    chosen = units(base.orderBy(F.xxhash64("id"), "id").select("v").limit(count).toArrow()["v"], dim) if n else np.zeros((1, dim))
    cell_type = T.StructType([T.StructField("id", id_kind), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("radius", T.DoubleType()), T.StructField("square", T.DoubleType())])
    held = stored(base.mapInArrow(_in_cells(chosen, to_arrow_type(id_kind)), cell_type))
    about = held.groupBy("cell").agg(F.min("radius"), F.max("radius"), F.max("square"), F.count("*"))  # a row per pivot at most
    cells = np.array([tuple(r) for r in about.collect()], float).reshape(-1, 5)
    cells = cells[np.argsort(cells[:, 0])]
    sizes = queries.sparkSession.createDataFrame([(int(c[0]), -(-int(c[4]) // block), int(c[4])) for c in cells], "cell int, blocks int, size long")
    groups = max(1, -(-m // group))
    every = lambda c: F.explode(F.sequence(F.lit(0), c - 1))
    key = ["cell", "block", "part"]
    left = held.join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), every(F.lit(groups)).alias("part"), "id", "v")
    ask_type = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("query", query_kind), T.StructField("v", T.ArrayType(T.DoubleType()))])
    out_type = T.StructType([T.StructField("query_id", query_kind), T.StructField("chunk_id", id_kind), T.StructField("score", T.DoubleType())])
    arrow = pa.schema([("query_id", to_arrow_type(query_kind)), ("chunk_id", to_arrow_type(id_kind)), ("score", pa.float64())])

    def asking(rows: DataFrame, again: bool) -> DataFrame:
        return stored(rows.mapInArrow(_asking(chosen, cells, k, to_arrow_type(query_kind), again), ask_type))

    def scored(some: DataFrame) -> DataFrame:
        right = some.join(F.broadcast(sizes), "cell").select("cell", every(F.col("blocks")).alias("block"), F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("part"), "query", "v")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k, dim, arrow), out_type)

    first = asking(asked, False)
    start = stored(scored(first))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floor = start.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    rest = asking(asked.join(floor, "id", "left").select("id", "v", F.coalesce("floor", F.lit(float("nan"))).alias("floor")), True)
    pairs = first.unionByName(rest).join(F.broadcast(sizes), "cell").agg(F.sum("size"))
    return start.unionByName(scored(rest)), pairs, n * m
