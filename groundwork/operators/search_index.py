"""A stored lexical index whose blocks of postings know their largest weight.

Passages are dealt by hash into blocks of about `block` passages.  The index has a row per term and
block: the passages with their counts and lengths, and the largest weight (before the
term's rarity) that one of them reaches.  It is written once, in folders by hash of the
term, and a search reads the folders of its terms only.

A search is exact and skips blocks:

1. The largest weights of a query's terms in a block add up to a bound for every passage of
   the block; only terms, blocks and these numbers are read for that.
2. The k blocks of largest bound are scored.  They hold k passages with a term at least, so
   the k-th best score is a floor for the result.
3. Only blocks whose bound reaches the floor are scored too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwork.functions.scalars import bm25_rarity, bm25_saturation
from groundwork.operators.retrieval import RANKED, asked_terms, indexed, ranked
from groundwork.plans.scratch import shared_folder, small, stored
from groundwork.registry import operator
from groundwork.views import load

#: Bounds and scores may differ by rounding.
SLACK = 1e-7
#: Postings that a task gathers into blocks at once.
GATHERED = 50_000
_KEPT: dict[tuple[str, str], str] = {}


def _folder(term: str, folders: int):
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (folder, term, block, w, chunk_id, tf, length) in order of term and block -> a row for each term and block, which is never cut."""
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        other = np.diff(t["block"].to_numpy()) != 0
        other |= pc.not_equal(t["term"].slice(1), t["term"].slice(0, len(t) - 1)).to_numpy()
        return np.flatnonzero(np.append(True, other))

    def made(t: pa.Table, at: np.ndarray) -> pa.RecordBatch:
        one = t.combine_chunks().to_batches()[0]
        ends = np.append(at, len(t))
        postings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([one[c] for c in ("chunk_id", "tf", "length")], ["chunk_id", "tf", "length"]))
        heads = [one[c].take(pa.array(at)) for c in ("folder", "term", "block")]
        most = np.maximum.reduceat(one["w"].to_numpy(), at)
        return pa.RecordBatch.from_arrays([*heads, pa.array(np.diff(ends), pa.int64()), pa.array(most), postings], ["folder", "term", "block", "n", "most", "postings"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            t = pa.Table.from_batches(held)
            at = starts(t)
            if len(at) > 1:
                yield made(t.slice(0, int(at[-1])), at[:-1])
                held = t.slice(int(at[-1])).to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield made(t, starts(t))


def write_index(chunks: DataFrame, path: str, k1: float = 1.2, b: float = 0.75, block: int = 64, folders: int | None = None, spread: int = 8) -> str:
    """Writes the index of chunks (chunk_id, text) to path; a frequent term's postings are dealt over `spread` files of its folder."""
    found = stored(indexed(chunks))
    n = chunks.count()
    size = found.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    mean = max(1.0, size / max(n, 1))
    folders, blocks = folders or max(4, min(2048, -(-n // 20_000))), max(1, -(-n // block))
    rows = found.select("*", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).alias("block"), _folder("term", folders).alias("folder")).withColumn("part", F.col("block") % spread)
    weight = bm25_saturation(F.col("tf"), F.col("length"), F.lit(mean), k1, b)
    dealt = rows.repartition("folder", "part").select("folder", "term", "block", weight.alias("w"), "chunk_id", "tf", "length").sortWithinPartitions("folder", "term", "block")
    made = dealt.mapInArrow(_gathered, f"folder int, term string, block bigint, n bigint, most double, postings array<struct<chunk_id:{dict(chunks.dtypes)['chunk_id']},tf:bigint,length:bigint>>")
    made.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/blocks")
    chunks.sparkSession.createDataFrame([(n, mean, k1, b, folders, dict(chunks.dtypes)["chunk_id"])], "n long, mean_length double, k1 double, b double, folders int, id_type string").write.parquet(f"{path}/about")
    return path


def _blocks(spark: SparkSession, path: str, terms: DataFrame, folders: int, id_type: str) -> DataFrame:
    """Posting blocks of some terms; other folders are not read.  The numbers of folders are at most `folders`."""
    some = [r[0] for r in terms.select(_folder("term", folders)).distinct().collect()]
    schema = f"term string, block bigint, n bigint, most double, postings array<struct<chunk_id:{id_type},tf:bigint,length:bigint>>, folder int"
    return spark.read.schema(schema).parquet(f"{path}/blocks").where(F.col("folder").isin(some)).join(terms, "term", "left_semi")


def search(queries: DataFrame, path: str, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, score, rank), as bm25_topk() over the indexed passages."""
    return _searched(queries, path, k)[0]


def search_share(queries: DataFrame, path: str, k: int = 5) -> DataFrame:
    """(query_id, n_blocks, n_scored): the blocks with a term of the query, and those whose postings were read."""
    return _searched(queries, path, k)[1]


def _searched(queries: DataFrame, path: str, k: int) -> tuple[DataFrame, DataFrame]:
    spark = queries.sparkSession
    n, mean, k1, b, *how = spark.read.parquet(f"{path}/about").first()
    asked = stored(asked_terms(queries))
    terms = small(stored(asked.select("term").distinct()))
    heads = stored(_blocks(spark, path, terms, *how).select("term", "block", "n", "most"))
    rarity = heads.groupBy("term").agg(F.sum("n").alias("df")).select("term", bm25_rarity(F.col("df"), F.lit(n)).alias("rarity"))
    weighed = stored(asked.join(rarity, "term").select("query_id", "term", (F.col("times") * F.col("rarity")).alias("w")))
    bounds = stored(heads.join(weighed, "term").groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    first = stored(bounds.withColumn("place", place).where(F.col("place") <= k).select("query_id", "block", "bound"))

    def scores(some: DataFrame) -> DataFrame:
        wanted = some.join(weighed, "query_id").select("query_id", "block", "term", "w")
        posting = _blocks(spark, path, terms, *how).select("term", "block", "postings").join(wanted, ["term", "block"]).select("query_id", "w", F.inline("postings"))
        weight = F.col("w") * bm25_saturation(F.col("tf"), F.col("length"), F.lit(mean), k1, b)
        return posting.groupBy("query_id", "chunk_id").agg(F.sum(weight).alias("score"))

    start = stored(ranked(scores(first), "score", "rank").where(F.col("rank") <= k))
    floor = start.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))
    rest = stored(rest.select("query_id", "block", "bound"))
    every = start.drop("rank").unionByName(scores(rest))
    share = bounds.groupBy("query_id").agg(F.count("*").alias("n_blocks")).join(first.unionByName(rest).groupBy("query_id").agg(F.count("*").alias("n_scored")), "query_id")
    return ranked(every, "score", "rank").where(F.col("rank") <= k), share


def index_of(spark: SparkSession, sf_dir: str) -> str:
    """The index of the passages of a data folder, written by the first search of an application and kept for the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        import uuid

        _KEPT[key] = write_index(load(spark, sf_dir, "chunks"), f"{shared_folder(spark)}/groundwork/index-{uuid.uuid4().hex}")
    return _KEPT[key]


@operator("r1_block_max_topk", RANKED)
def _r1c(spark, d):
    found = search(load(spark, d, "queries"), index_of(spark, d))
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
