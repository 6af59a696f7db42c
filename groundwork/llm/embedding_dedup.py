"""Near-duplicate vectors by spherical-cap filters.

Structured random product codes give the filter directions: one of `words` random
directions for each half of the coordinates, so `words ** 2` filters from few
vectors; `codes` of them, since a vector may have few filters in one.  Each code
halves the coordinates after a random rotation of its own, so what a pair's chance
depends on is its cosine and the number of dimensions, not where the energy of
the vectors lies.  A vector is list-decoded to all filters whose score exceeds the
threshold: codewords of the first block are taken in order of their score, and for
each one those of the next block that still exceed.  Vectors of one label join on
filters, and pairs in a list are verified by their cosine in double precision.
A vector with fewer than `fewest` filters per code on the average is compared with
all of its label and length, block by block.

Equal vectors are one class with a count, so many copies cost one.  Lists of one
member are dropped before vectors are sent; long lists are dealt into blocks
of `block` vectors and each pair of blocks is a task's unit, so no list is held
whole.  Only verified links leave a unit.

Defined cases: a vector with a null id or label, and one that is null, zero, empty or has
null or non-finite components, links with nothing and stays; repeated rows are
copies of each other; vectors of different lengths don't link; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from groundwork.operators.components import connected_components

from .common import QUERIES, stored, table

#: Directions of each half of a code: filters are their square.  The tables of a task hold 16 * words * dimensions numbers.
LEAST_WORDS, MOST_WORDS = 768, 8192


@lru_cache(maxsize=64)
def _code(dim: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions in the first and in the second half of the coordinates, after a random rotation."""
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    head = dim - dim // 2
    return rng.standard_normal((words, head)) @ turn[:head], rng.standard_normal((words, dim - head)) @ turn[head:]


def filters(vector: Column, codes: int, words: int, per_code: float, seed: int) -> Column:
    """The filters of each vector, about per_code of each code on the average."""
    least = NormalDist().inv_cdf(1 - min(0.5, per_code / words**2))

    def of(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors:
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
            x = x / np.linalg.norm(x)
            found = [np.zeros(0, np.int64)]
            for c in range(codes):
                first, second = _code(len(x), words, seed + c)
                s1, s2 = first @ x, second @ x
                some = np.flatnonzero(s2 >= least - s1.max())
                order = some[np.argsort(s2[some])[::-1]]
                fits = np.searchsorted(-s2[order], s1 - least, "right")  # codewords of the second half that still exceed
                found += [c * words**2 + k * words + order[: fits[k]] for k in np.flatnonzero(fits)]
            out.append(np.concatenate(found))
        ends = np.concatenate([[0], np.cumsum([len(o) for o in out])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int32)))

    return arrow_udf(of, "array<int>")(vector)


def _linked(least: float):
    """Rows (unit, id, side, vector, label) in order of unit -> verified links (a, b) of one label and length."""

    def links(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        alike: dict[tuple, list[tuple]] = {}
        for r in rows:
            alike.setdefault((r[3], len(r[2])), []).append(r)
        for some in alike.values():
            ids, side = np.array([r[0] for r in some]), np.array([r[1] for r in some])
            x = np.array([r[2] for r in some], float)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            i, j = np.nonzero(x[left] @ x[right].T >= least)
            a, b = ids[left[i]], ids[right[j]]
            a, b = a[a != b], b[a != b]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            vectors = batch.column(3)
            for k, (u, id, side, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
                if u != unit:
                    yield from links(rows)
                    unit, rows = u, []
                rows.append((id, side, vectors[k].values.to_numpy(zero_copy_only=False), label))
        yield from links(rows)

    return of


def _against_all(named: DataFrame, fewest: float, block: int) -> DataFrame:
    """(unit, rep, side): each vector of named(rep, label, dim, fs) with fewer than `fewest` filters meets all of its label and length."""
    key = ["label", "dim"]
    weak = F.size("fs") < fewest
    of = lambda n: F.ceil(n / block).cast("int")
    sizes = named.groupBy(*key).agg(of(F.count("*")).alias("blocks"), of(F.count_if(weak)).alias("weak_blocks")).where("weak_blocks > 0")
    rows = named.select("rep", *key, weak.alias("weak")).join(sizes, key)
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("weak").withColumn("i", own("weak_blocks")).withColumn("j", each("blocks")).withColumn("side", F.lit(0))
    right = rows.withColumn("j", own("blocks")).withColumn("i", each("weak_blocks")).withColumn("side", F.lit(1))
    both = left.select("rep", *key, "i", "j", "side").unionByName(right.select("rep", *key, "i", "j", "side"))
    return both.select(F.xxhash64(F.lit("all"), *key, "i", "j").alias("unit"), "rep", "side")


def similar_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, codes: int = 8, words: int | None = None, per_code: float = 20, fewest: float = 2, block: int = 1000, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept) per row of vectors.

    words: by default so many that a filter is expected to hold two random vectors of the largest label, within LEAST_WORDS and MOST_WORDS."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (norm > 0) & (norm < float("inf"))
    tagged = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = tagged.where("fine")
    classes = stored(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    if words is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        words = min(MOST_WORDS, max(LEAST_WORDS, math.isqrt(int(most * per_code / 2))))
    named = stored(classes.select("rep", "label", F.size("v").alias("dim"), filters(F.col("v"), codes, words, per_code, seed).alias("fs")))
    listed = named.select("rep", "label", F.explode("fs").alias("f"))
    sizes = listed.groupBy("label", "f").count().where("count > 1")
    live = listed.join(sizes, ["label", "f"]).withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
    live = live.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
    unit = F.xxhash64("label", "f", F.least("own", "other"), F.greatest("own", "other"))
    met = live.select(unit.alias("unit"), "rep", side.alias("side")).unionByName(_against_all(named, fewest * codes, block))
    units = met.join(classes.select("rep", "v", F.col("label").cast("string").alias("label")), "rep")
    ordered = units.select("unit", "rep", "side", "v", "label").repartition("unit").sortWithinPartitions("unit")
    links = stored(ordered.mapInArrow(_linked(least), "a bigint, b bigint").distinct())
    part = connected_components(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    known = classes.join(degree, "rep", "left").join(part.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"), F.lit(True).alias("fine"))
    out = tagged.join(known, ["label", "v", "fine"], "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


@QUERIES.query("op7_embedding_dedup")
def op7_embedding_dedup(spark, sf_dir) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
