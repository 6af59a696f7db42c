"""Lexical, vector and fused search over passages, for many queries at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from groundwork.functions.scalars import RRF_K, rrf_weight, shown_score, trust_badge
from groundwork.operators import term_sums
from groundwork.operators.matching import contained_terms
from groundwork.operators.tables import of_project
from groundwork.operators.vector_cells import nearest_vectors
from groundwork.plans.scratch import small, spread, stored
from groundwork.registry import operator
from groundwork.views import load, with_views

#: Words too common to search for; fixed values.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "be",
    "been", "being", "that", "this", "it", "as", "into", "their",
    "its", "within", "which", "over", "these", "those",
)
#: Rows with a text that may be broadcast.
FEW = 50_000
#: Pairs of a bag and a term that are sent to the tasks at once.
RANGE_PAIRS = 1_000_000


# text ------------------------------------------------------------------------
def tokens(text: Column) -> Column:
    """ASCII letter and digit runs in small letters, two characters or more, without stop words."""
    plain = F.replace(F.replace(text, F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" "))  # the two other characters whose small letters are ASCII
    return F.filter(F.split(F.lower(plain), "[^a-z0-9]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf)."""
    return spread(chunks.select("chunk_id", "text")).select("chunk_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


def indexed(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, length): postings with the number of terms of their passage; texts are read once."""
    t = spread(chunks.select("chunk_id", "text")).select("chunk_id", tokens(F.col("text")).alias("t")).select("chunk_id", F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
    return t.groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: passages, mean length (at least 1), different terms; texts are cut into tokens once."""
    terms = spread(chunks.select("text")).select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    a = terms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("size"), F.count("*").alias("vocabulary"))
    mean = F.greatest(F.col("size") / F.greatest("n", F.lit(1)), F.lit(1.0))
    return chunks.agg(F.count("*").alias("n")).join(F.broadcast(a)).select("n", mean.alias("mean_length"), "vocabulary")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def reindexed(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """index with the postings of the given passages replaced."""
    return index.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(postings(chunks))


def paragraphs(pages: DataFrame, most: int = 200) -> DataFrame:
    """pages (source_id, page, text) cut at an empty line once more than `most` characters are gathered; the tail is kept."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, line: Column) -> Column:
        cut = (F.trim(line) == "") & (F.length(s["now"]) > most)
        now = F.when(cut, F.lit("")).otherwise(F.concat(s["now"], line, F.lit("\n")))
        return F.struct(F.when(cut, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"), now.alias("now"))

    end = lambda s: F.when(F.trim(s["now"]) != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
    cut = F.aggregate(F.split("text", "\n"), start, add, end)
    rows = pages.select("source_id", "page", F.posexplode(cut).alias("i", "text"))
    return rows.select(F.concat_ws("_", F.col("source_id").cast("string"), F.concat(F.lit("p"), F.col("page")), F.concat(F.lit("c"), F.col("i"))).alias("chunk_id"), "source_id", "page", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


# ranking ---------------------------------------------------------------------
def ranked(scores: DataFrame, score: str, rank: str) -> DataFrame:
    """1-based rank within each query, ties by passage; nine places count, so the order of a sum cannot break a tie."""
    return scores.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), "chunk_id")))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of queries (query_id, query_text)."""
    return queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def asked_bags(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, bag) of queries (query_id, query_text), the bag being its terms in order with repeats, and (bag_id, bag) of the different bags; both stored.

    Queries of equal bags have equal rankings, so a search asks each bag once."""
    own = queries.select("query_id", tokens(F.col("query_text")).alias("t")).where("size(t) > 0").groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))
    asked = stored(own.select("query_id", F.concat_ws(" ", "t").alias("bag")))
    return asked, stored(asked.select("bag").distinct().withColumn("bag_id", F.monotonically_increasing_id()))


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, k1: float = 1.2, b: float = 0.75, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, query_text).  A repeated term counts as often.

    For one search over passages without an index: only postings of query terms leave the pass over the texts, a row for each passage, so sums are made where they are
    and at most k rows of a query leave a task.  search_index.py keeps an index for many searches.
    The terms of one range of bags are sent to the tasks; bags of more ranges cost a pass over the texts for each."""
    asked, bags = asked_bags(queries)
    terms = stored(bags.select("bag_id", F.xxhash64("bag").alias("h"), F.explode(F.split("bag", " ")).alias("term")).groupBy("h", "bag_id", "term").agg(F.count("*").alias("times")))
    ranges = max(-(-terms.count() // range_pairs), -(-bags.count() * k // (4 * range_pairs)))
    passes = [_range_topk(terms.where(F.pmod("h", F.lit(ranges)) == i), chunks, k, k1, b) for i in range(ranges)]
    if not passes:
        return asked.join(chunks.select("chunk_id").limit(0)).select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    best = F.row_number().over(Window.partitionBy("bag_id").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    top = stored(reduce(DataFrame.unionAll, passes).withColumn("rank", best).where(F.col("rank") <= k).join(bags, "bag_id").drop("bag_id"))
    return asked.join(small(top, FEW), "bag").select("query_id", "chunk_id", "score", "rank")


def _range_topk(pairs: DataFrame, chunks: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """(bag_id, chunk_id, score): at least the best k passages of each bag of pairs (bag_id, term, times)."""
    send, kind = chunks.sparkSession.sparkContext.broadcast, chunks.schema["chunk_id"].dataType
    asked = pairs.select("bag_id", "term", "times").toArrow().combine_chunks()
    ids, terms = (asked[c].combine_chunks().dictionary_encode() for c in ("bag_id", "term"))
    bag, term, times = (x.to_numpy(zero_copy_only=False) for x in (ids.indices, terms.indices, asked["times"].combine_chunks()))
    words, n_terms = terms.dictionary.to_pylist(), len(terms.dictionary)
    each = T.StructType([T.StructField("chunk_id", kind), *T.StructType.fromDDL("length bigint, terms array<int>, counts array<int>").fields])
    cut = spread(chunks.select("chunk_id", "text")).mapInArrow(term_sums.counted(send(words), STOP_WORDS, to_arrow_type(kind)), each)
    found = stored(cut.groupBy("chunk_id").agg(F.collect_list(F.struct("length", "terms", "counts")).alias("parts")))
    counts = found.select("parts").mapInArrow(term_sums.frequencies(n_terms), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    number, n = (counts[c].to_numpy() for c in ("term", "n"))
    known = np.zeros(n_terms, np.int64)
    known[number[number >= 0]] = n[number >= 0]
    texts, size = int(n[number == -1].sum()), int(n[number == -2].sum())
    order = np.argsort(term, kind="stable")
    weight = np.log(1 + (texts - known + 0.5) / (known + 0.5))
    sent = send((np.searchsorted(term[order], np.arange(n_terms + 1)), bag[order].astype(np.int64), times[order], weight))
    schema = T.StructType([T.StructField("bag", T.LongType()), T.StructField("chunk_id", kind), T.StructField("score", T.DoubleType())])
    sums = found.mapInArrow(term_sums.summed(sent, max(1.0, size / max(texts, 1)), k1, b, k, to_arrow_type(kind)), schema)
    of = chunks.sparkSession.createDataFrame(pa.table({"bag": pa.array(range(len(ids.dictionary)), pa.int64()), "bag_id": ids.dictionary}))
    return sums.join(small(stored(of)), "bag").select("bag_id", "chunk_id", "score")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cosine, exact, for queries (query_id, embedding) and vectors (chunk_id, embedding)."""
    return ranked(nearest_vectors(queries, vectors, k), "score", "rank").where(F.col("rank") <= k)


def allowed(hits: DataFrame, chunks: DataFrame, doc: int | None = None, min_page: int = -1, max_page: int = -1, docs: DataFrame | None = None) -> DataFrame:
    """Ranked hits within a document, a range of pages or a set of documents (doc_id).  Ranks keep their gaps."""
    out = hits.join(chunks.select("chunk_id", "doc_id", "page_ref"), "chunk_id")
    if doc is not None:
        out = out.where(F.col("doc_id") == doc)
    if min_page >= 0:
        out = out.where(F.col("page_ref") >= min_page)
    if max_page >= 0:
        out = out.where(F.col("page_ref") <= max_page)
    if docs is not None:
        out = out.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return out.select(*hits.columns)


def fused_topk(lexical: DataFrame, dense: DataFrame, k: int = 5, lexical_weight: float = 1.0, dense_weight: float = 1.0, rrf_k: int = RRF_K) -> DataFrame:
    """Both rankings by reciprocal rank; absent sides have rank 0 and score 0."""
    a = lexical.select("query_id", "chunk_id", F.col("score").alias("lexical_score"), F.col("rank").alias("lexical_rank"))
    b = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer").na.fill(0)
    fused = both.withColumn("score", rrf_weight(dense_weight, F.col("dense_rank"), rrf_k) + rrf_weight(lexical_weight, F.col("lexical_rank"), rrf_k))
    return ranked(fused, "score", "rank").where(F.col("rank") <= k)


def hybrid_topk(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, weights: tuple[float, float] = (1.0, 1.0), **only) -> DataFrame:
    """queries (query_id, query_text, embedding): pools of max(4k, 20) from both sides are ranked, filtered, fused."""
    pool = max(4 * k, 20)
    lexical, dense = bm25_topk(queries, chunks, pool), dense_topk(queries, vectors, pool)
    if only:
        lexical, dense = allowed(lexical, chunks, **only), allowed(dense, chunks, **only)
    return fused_topk(lexical, dense, k, *weights)


def project_documents(sources: DataFrame, project: str) -> DataFrame:
    """Every name under which a project's documents may appear: id, file path and archive path."""
    s = sources.where(F.col("project_id") == project)
    return s.select(F.explode(F.array(F.col("id").cast("string"), F.col("file_path"), F.col("archive_path"))).alias("name")).where("name <> ''").distinct()


def enriched(hits: DataFrame, chunks: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    """Hits with the class and status of their source, verified facts on the page, badge and excerpt."""
    s = sources.select(F.col("id").alias("doc_id"), F.nullif("degradation_class", F.lit("")).alias("cls"), F.col("ingestion_status").alias("status"))
    facts = claims.where("verification_status = 'VERIFIED'").groupBy(F.col("source_id").alias("doc_id"), "page_ref").agg(F.count("*").alias("n_facts"))
    base = hits.join(chunks, "chunk_id").join(s, "doc_id", "left").withColumn("page", F.concat(F.lit("p."), F.col("page_ref")))
    full = base.join(facts.withColumnRenamed("page_ref", "page"), ["doc_id", "page"], "left")
    cls, status, n = F.coalesce("cls", F.lit("CLASS_B")), F.coalesce("status", F.lit("UNVERIFIED_ROUGH_SCAN")), F.coalesce("n_facts", F.lit(0))
    badge = trust_badge(cls, status, n)
    return full.select("query_id", "chunk_id", "doc_id", "rank", cls.alias("degradation_class"), status.alias("ingestion_status"), n.cast("long").alias("n_facts"), badge.alias("badge"), (badge == "UNVERIFIED_ROUGH_SCAN").alias("is_rough"), shown_score(F.coalesce("dense_score", F.lit(0.0)), F.col("score")).alias("shown_score"))


def project_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, sources: DataFrame, claims: DataFrame, project: str, k: int = 5) -> DataFrame:
    names = project_documents(sources, project)
    mine = chunks.join(names, chunks["doc_id"].cast("string") == names["name"], "left_semi").select("doc_id")
    return enriched(hybrid_topk(queries, chunks, vectors, k, docs=mine), chunks, sources, claims)


def compound_query(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, sources: DataFrame, claims: DataFrame, project: str, site: int | None = None, stratum: int | None = None, k: int = 5) -> DataFrame:
    """(kind, query_id, id, rank, score): for each query the best passages of the project, and once (query_id null) its claims on the site and the stratum."""
    names = project_documents(sources, project)
    mine = chunks.join(names, chunks["doc_id"].cast("string") == names["name"], "left_semi").select("doc_id")
    passages = hybrid_topk(queries, chunks, vectors, k, docs=mine).select(F.lit("passage").alias("kind"), "query_id", F.col("chunk_id").alias("id"), F.col("rank").cast("long").alias("rank"), "score")
    found = of_project(claims, project)
    for lists, wanted in (("site_ids", site), ("strata_ids", stratum)):
        if wanted is not None:
            found = found.where(F.array_contains(lists, F.lit(wanted).cast("long")))
    none = F.lit(None)
    return passages.unionByName(found.select(F.lit("claim").alias("kind"), none.cast("long").alias("query_id"), "id", none.cast("long").alias("rank"), none.cast("double").alias("score")))


def suggested_citations(claims: DataFrame, chunks: DataFrame, k: int = 2, excerpt: int = 180, vectors: DataFrame | None = None) -> DataFrame:
    """The best k passages for each claim, by its text, and with vectors by its embedding too."""
    asked = claims.select(F.col("id").alias("query_id"), F.col("claim_text").alias("query_text"), *(["embedding"] if vectors is not None else []))
    hits = stored(bm25_topk(asked, chunks, k) if vectors is None else hybrid_topk(asked, chunks, vectors, k))
    # few passages are cited by many claims, so theirs is the smaller side
    cited = stored(chunks.select("chunk_id", F.substring("text", 1, excerpt).alias("excerpt")).join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    return hits.join(small(cited, FEW), "chunk_id").select(F.col("query_id").alias("claim_id"), "rank", "chunk_id", "excerpt")


def byte_histogram(texts: DataFrame, id: str, text: str = "text", dim: int = 128) -> DataFrame:
    """(id, bin, n, share): the different values modulo dim of a text's bytes, how often each comes, and its coordinate in the vector of counts scaled to length 1.

    A vector that needs no model, as one row per bin in use.  Bytes are counted once."""
    rows = texts.select(F.col(id), F.hex(F.encode(F.col(text), "UTF-8")).alias("h")).where("length(h) > 0")
    pairs = F.transform(F.sequence(F.lit(0), (F.length("h") / 2).cast("int") - 1), lambda i: F.conv(F.substring("h", i * 2 + 1, F.lit(2)), 16, 10).cast("int") % dim)
    counts = rows.select(id, F.explode(pairs).alias("bin")).groupBy(id, "bin").agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(id)).cast("double"))  # at most dim rows a text
    return counts.withColumn("share", F.col("n") / norm)


def histogram_vectors(texts: DataFrame, id: str, text: str = "text", dim: int = 128) -> DataFrame:
    """(id, embedding): the histograms as vectors; zeros for no text."""
    held = byte_histogram(texts, id, text, dim).groupBy(id).agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return texts.select(id).join(held, id, "left").select(id, F.coalesce(filled, F.array_repeat(F.lit(0.0), dim)).alias("embedding"))


def source_passages(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id): the first passage that holds the text of a query."""
    hits = contained_terms(chunks, queries, "chunk_id", "text", "query_text").join(queries.select("query_id", F.col("query_text").alias("term")), "term")
    return hits.groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id"))


def retrieval_quality(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Recall at 1, 3, 5 and 10 and mean reciprocal rank over targets (query_id, chunk_id); misses count 0."""
    found = targets.join(hits.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")
    at = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in (1, 3, 5, 10)]
    return found.agg(*at, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def exact_percentiles(values: DataFrame, column: str, shares: dict[str, float], few: int = 10_000, accuracy: int = 10_000) -> DataFrame:
    """One row of exact percentiles, interpolated between neighbours; no values: nulls.  Nulls and NaN don't count.

    Selection: a mergeable sketch brackets each wanted rank between two values, one exact count tells which of the two or the values between it is, and what is
    between, a few of `accuracy` parts, is bracketed again until at most `few` values are left to sort.  No task and not the driver holds more than a sketch or these."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = v.count()
    schema = ", ".join(f"`{name}` double" for name in shares)
    if not n:
        return values.sparkSession.createDataFrame([tuple(None for _ in shares)], schema)
    wanted = sorted({min(n - 1, int(share * (n - 1)) + step) for share in shares.values() for step in (0, 1)})
    found: dict[int, float] = {}
    open_ = {r: (F.lit(True), 0, n) for r in wanted}  # rank: which values may have it, how many are below them, how many they are
    while any(m > few for _, _, m in open_.values()):
        large = {r: x for r, x in open_.items() if x[2] > few}
        near = lambda r, below, m: [min(1.0, max(0.0, (r - below + side) / m + margin)) for side, margin in ((0, -2 / accuracy), (1, 2 / accuracy))]
        ends = v.agg(*[F.percentile_approx(F.when(where, F.col("v")), near(r, below, m), accuracy).alias(str(r)) for r, (where, below, m) in large.items()]).first()
        case = lambda where, test: F.count_if(where & test)
        asked = [case(x[0], test) for r, x in large.items() for a, b in [ends[str(r)]] for test in (F.col("v") < a, F.col("v") == a, (F.col("v") > a) & (F.col("v") < b), F.col("v") == b)]
        counts = iter(v.agg(*asked).first())
        for r, (where, below, _) in large.items():
            a, b = ends[str(r)]
            under, at_a, between, at_b = (next(counts) for _ in range(4))
            k = r - below - under
            if 0 <= k < at_a:
                found[r] = a
                del open_[r]
            elif at_a <= k < at_a + between:
                open_[r] = (where & (F.col("v") > a) & (F.col("v") < b), below + under + at_a, between)
            elif at_a + between <= k < at_a + between + at_b:
                found[r] = b
                del open_[r]
            else:  # the sketch was off: look on the side of the bracket that has the rank
                side = F.col("v") < a if k < 0 else F.col("v") > b
                before = 0 if k < 0 else under + at_a + between + (at_b if b > a else 0)
                open_[r] = (where & side, below + before, under if k < 0 else open_[r][2] - before)
    if open_:
        number = {r: i for i, r in enumerate(open_)}
        marked = F.array_compact(F.array(*[F.when(where, F.lit(number[r])) for r, (where, _, _) in open_.items()]))
        rows: dict[int, list[float]] = {}
        for i, x, m in v.select(F.explode(marked).alias("i"), "v").groupBy("i", "v").count().collect():  # at most `few` rows a rank
            rows.setdefault(i, []).append((x, m))
        for r, (_, below, _) in open_.items():
            for x, m in sorted(rows[number[r]]):
                below += m
                if r < below:
                    found[r] = x
                    break
    at = lambda p: found[int(p)] + (found[min(n - 1, int(p) + 1)] - found[int(p)]) * (p - int(p))
    return values.sparkSession.createDataFrame([tuple(float(at(s * (n - 1))) for s in shares.values())], schema)


def latency(timings: DataFrame, ms: str = "ms") -> DataFrame:
    """One row: mean, median, 90th and 95th percentile, least and greatest; the percentiles are exact."""
    p = exact_percentiles(timings, ms, {"median": 0.5, "p90": 0.9, "p95": 0.95})
    return timings.agg(F.avg(ms).alias("mean"), F.min(ms).alias("min"), F.max(ms).alias("max")).join(F.broadcast(p)).select("mean", "median", "p90", "p95", "min", "max")


# queries ---------------------------------------------------------------------
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = f"""tok AS (SELECT chunk_id, term FROM (SELECT chunk_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM {{chunks}}) t WHERE length(term) >= 2 AND term NOT IN ({_STOPS})),
  post AS (SELECT term, chunk_id, count(*) AS tf FROM tok GROUP BY 1, 2), len AS (SELECT c.chunk_id, count(t.term) AS length FROM {{chunks}} c LEFT JOIN tok t ON c.chunk_id = t.chunk_id GROUP BY 1),
  st AS (SELECT count(*) AS n, greatest(avg(length), CAST(1 AS DOUBLE)) AS m FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""
_BM25 = f"""{_TOKENS}, qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(string_split(trim(regexp_replace(lower(query_text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM q) t WHERE length(term) >= 2 AND term NOT IN ({_STOPS}) GROUP BY 1, 2),
  w AS (SELECT query_id, p.chunk_id, sum(times * ln(1 + (st.n - df.df + CAST(0.5 AS DOUBLE)) / (df.df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len.length / st.m))) AS score
    FROM qt JOIN post p ON qt.term = p.term JOIN df ON df.term = p.term JOIN len ON len.chunk_id = p.chunk_id, st GROUP BY 1, 2),
  lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM w)"""


def _q(name: str, sql: str):
    return operator(name, with_views(sql))


@_q("t1_t2_inverted_index", f"WITH {_TOKENS} SELECT term, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(tf) AS BIGINT) AS n_occurrences FROM post GROUP BY 1")
def _t2(spark, d):
    return postings(load(spark, d, "chunks")).groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("n_occurrences"))


@_q("t3_reindex", f"WITH {_TOKENS}, up AS (SELECT 'renewed' AS term, chunk_id, CAST(1 AS BIGINT) AS tf FROM {{chunks}} WHERE chunk_id % 10 = 0), x AS (SELECT term, chunk_id, tf FROM post WHERE chunk_id % 10 <> 0 UNION ALL SELECT * FROM up) SELECT chunk_id, CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(tf) AS BIGINT) AS n FROM x GROUP BY 1")
def _t3(spark, d):
    chunks = load(spark, d, "chunks")
    changed = chunks.where("chunk_id % 10 = 0").withColumn("text", F.lit("Renewed"))
    return reindexed(postings(chunks), changed).groupBy("chunk_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n"))


@_q("a17_corpus_statistics", f"WITH {_TOKENS} SELECT CAST(n AS BIGINT) AS n, round(m, 6) AS mean_length, CAST((SELECT count(*) FROM df) AS BIGINT) AS vocabulary FROM st")
def _a17(spark, d):
    return corpus_statistics(load(spark, d, "chunks")).withColumn("mean_length", F.round("mean_length", 6))


RANKED = with_views(f"WITH q AS (SELECT * FROM {{queries}}), {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM lex WHERE rank <= 5")


@operator("r1_bm25_topk", RANKED)
def _r1(spark, d):
    return bm25_topk(load(spark, d, "queries"), load(spark, d, "chunks")).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@_q("p6_page_limits", f"WITH q AS (SELECT * FROM {{queries}}), {_BM25} SELECT query_id, l.chunk_id, CAST(rank AS BIGINT) AS rank FROM lex l JOIN {{chunks}} c ON l.chunk_id = c.chunk_id WHERE rank <= 20 AND page_ref BETWEEN 10 AND 30")
def _p6(spark, d):
    chunks = load(spark, d, "chunks")
    hits = allowed(bm25_topk(load(spark, d, "queries"), chunks, 20), chunks, min_page=10, max_page=30)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def _vectors(spark, d) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark, d) -> DataFrame:
    return load(spark, d, "queries").join(_vectors(spark, d).select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id")


_COS = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"
_DENSE = f"dsc AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS score FROM {{embeddings}} a JOIN {{queries}} k ON a.vec_id = k.query_id, {{embeddings}} b), den AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dsc)"


@_q("r2_dense_topk", f"WITH {_DENSE} SELECT query_id, chunk_id, round(score, 4) AS score FROM den WHERE rank <= 5")
def _r2(spark, d):
    return dense_topk(_vector_queries(spark, d), _vectors(spark, d)).select("query_id", "chunk_id", F.round("score", 4).alias("score"))


_HYBRID = f"""WITH q AS (SELECT k.* FROM {{queries}} k WHERE query_id IN (SELECT vec_id FROM {{embeddings}})), {_BM25}, {_DENSE},
  j AS (SELECT coalesce(l.query_id, e.query_id) AS query_id, coalesce(l.chunk_id, e.chunk_id) AS chunk_id, coalesce(e.rank, 0) AS dr, coalesce(l.rank, 0) AS lr, coalesce(e.score, 0) AS ds,
    CASE WHEN e.rank > 0 THEN CAST(1 AS DOUBLE) / (60 + e.rank) ELSE 0 END + CASE WHEN l.rank > 0 THEN CAST(1 AS DOUBLE) / (60 + l.rank) ELSE 0 END AS score
    FROM (SELECT * FROM lex WHERE rank <= 20) l FULL OUTER JOIN (SELECT * FROM den WHERE rank <= 20) e ON l.query_id = e.query_id AND l.chunk_id = e.chunk_id),
  hyb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM j)"""


@_q("r3_hybrid_topk", _HYBRID + " SELECT query_id, chunk_id, round(score, 6) AS score, CAST(dr AS BIGINT) AS dense_rank, CAST(lr AS BIGINT) AS lexical_rank, CAST(rank AS BIGINT) AS rank FROM hyb WHERE rank <= 5")
def _r3(spark, d):
    hits = hybrid_topk(_vector_queries(spark, d), load(spark, d, "chunks"), _vectors(spark, d))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), *[F.col(c).cast("long").alias(c) for c in ("dense_rank", "lexical_rank", "rank")])


@_q("r4_project_search", _HYBRID.replace("SELECT * FROM lex WHERE rank <= 20", "SELECT x.* FROM lex x JOIN {chunks} c ON x.chunk_id = c.chunk_id WHERE rank <= 20 AND c.doc_id IN (SELECT id FROM {sources} WHERE project_id = 'p1')").replace("SELECT * FROM den WHERE rank <= 20", "SELECT x.* FROM den x JOIN {chunks} c ON x.chunk_id = c.chunk_id WHERE rank <= 20 AND c.doc_id IN (SELECT id FROM {sources} WHERE project_id = 'p1')") + """,
  f AS (SELECT source_id, page_ref, count(*) AS n FROM {claims} WHERE verification_status = 'VERIFIED' GROUP BY 1, 2)
  SELECT h.query_id, h.chunk_id, c.doc_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_facts, CASE WHEN s.ingestion_status = 'VERIFIED_MANUAL' THEN 'VERIFIED_MANUAL' WHEN s.degradation_class = 'CLASS_A' AND s.ingestion_status = 'VERIFIED_CONSENSUS' THEN 'VERIFIED_CONSENSUS'
    WHEN coalesce(f.n, 0) > 0 THEN 'PARTIALLY_VERIFIED' ELSE 'UNVERIFIED_ROUGH_SCAN' END AS badge, round(CASE WHEN h.ds > 0 THEN h.ds ELSE h.score * 30 END, 4) AS shown_score
  FROM hyb h JOIN {chunks} c ON h.chunk_id = c.chunk_id LEFT JOIN {sources} s ON s.id = c.doc_id LEFT JOIN f ON f.source_id = c.doc_id AND f.page_ref = 'p.' || CAST(c.page_ref AS STRING) WHERE h.rank <= 5""")
def _r4(spark, d):
    hits = project_search(_vector_queries(spark, d), load(spark, d, "chunks"), _vectors(spark, d), load(spark, d, "sources"), load(spark, d, "claims"), "p1")
    return hits.select("query_id", "chunk_id", "doc_id", "n_facts", "badge", F.round("shown_score", 4).alias("shown_score"))


@_q("r6_suggested_citations", f"WITH q AS (SELECT id AS query_id, claim_text AS query_text FROM {{claims}} WHERE id NOT IN (SELECT claim_id FROM {{evidence}}) ), {_BM25} SELECT query_id AS claim_id, l.chunk_id, CAST(rank AS BIGINT) AS rank, substr(c.text, 1, 180) AS excerpt FROM lex l JOIN {{chunks}} c ON l.chunk_id = c.chunk_id WHERE rank <= 2")
def _r6(spark, d):
    bare = load(spark, d, "claims").join(load(spark, d, "evidence").select(F.col("claim_id").alias("id")), "id", "left_anti")
    return suggested_citations(bare, load(spark, d, "chunks")).withColumn("rank", F.col("rank").cast("long"))


@_q("r7_a26_retrieval_quality", f"""WITH q AS (SELECT * FROM {{queries}}), {_BM25}, tg AS (SELECT query_id, min(chunk_id) AS chunk_id FROM q JOIN {{chunks}} c ON contains(c.text, query_text) GROUP BY 1), f AS (SELECT rank FROM tg LEFT JOIN (SELECT * FROM lex WHERE rank <= 10) l ON l.query_id = tg.query_id AND l.chunk_id = tg.chunk_id)
  SELECT """ + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(CAST(1 AS DOUBLE) / rank, 0)), 6) AS mrr FROM f")
def _r7(spark, d):
    q, chunks = load(spark, d, "queries"), load(spark, d, "chunks")
    targets = source_passages(q, chunks)
    quality = retrieval_quality(bm25_topk(q, chunks, 10), targets)
    return quality.select(*[F.round(c, 6).alias(c) for c in quality.columns])


_MINE = "JOIN {chunks} c ON x.chunk_id = c.chunk_id WHERE rank <= 20 AND c.doc_id IN (SELECT id FROM {sources} WHERE project_id = 'p1')"
_OF_PROJECT = _HYBRID.replace("SELECT * FROM lex WHERE rank <= 20", f"SELECT x.* FROM lex x {_MINE}").replace("SELECT * FROM den WHERE rank <= 20", f"SELECT x.* FROM den x {_MINE}")


@_q("r5_compound", _OF_PROJECT + """ SELECT 'passage' AS kind, CAST(query_id AS BIGINT) AS query_id, CAST(chunk_id AS BIGINT) AS id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM hyb WHERE rank <= 5
  UNION ALL SELECT 'claim', NULL, id, NULL, NULL FROM {claims} WHERE project_id = 'p1' AND list_contains(string_split(site_ids, ','), '7')""")
def _r5(spark, d):
    found = compound_query(_vector_queries(spark, d), load(spark, d, "chunks"), _vectors(spark, d), load(spark, d, "sources"), load(spark, d, "claims"), "p1", site=7)
    return found.select("kind", F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("id"), "rank", F.round("score", 6).alias("score"))


@_q("r6_hybrid_citations", "WITH bq AS (SELECT id AS query_id, claim_text AS query_text FROM {claims} WHERE id NOT IN (SELECT claim_id FROM {evidence})), " + _HYBRID[5:].replace("{queries}", "bq").replace("<= 20", "<= 20") + " SELECT query_id AS claim_id, h.chunk_id, CAST(rank AS BIGINT) AS rank, substr(c.text, 1, 180) AS excerpt FROM hyb h JOIN {chunks} c ON h.chunk_id = c.chunk_id WHERE rank <= 2")
def _r6b(spark, d):
    vectors = _vectors(spark, d)
    bare = load(spark, d, "claims").join(load(spark, d, "evidence").select(F.col("claim_id").alias("id")), "id", "left_anti").join(vectors.select(F.col("chunk_id").alias("id"), "embedding"), "id")
    return suggested_citations(bare, load(spark, d, "chunks"), vectors=vectors).withColumn("rank", F.col("rank").cast("long"))


@_q("r7_methods_quality", _HYBRID.replace("<= 20", "<= 40") + """, tg AS (SELECT query_id, min(chunk_id) AS chunk_id FROM q JOIN {chunks} c ON contains(c.text, query_text) GROUP BY 1),
  h AS (SELECT 'dense' AS method, query_id, chunk_id, rank FROM den WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hyb WHERE rank <= 10),
  f AS (SELECT m.method, h.rank FROM tg CROSS JOIN (SELECT unnest(['dense', 'hybrid']) AS method) m LEFT JOIN h ON h.method = m.method AND h.query_id = tg.query_id AND h.chunk_id = tg.chunk_id) SELECT method, """ + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS recall_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(CAST(1 AS DOUBLE) / rank, 0)), 6) AS mrr FROM f GROUP BY 1")
def _r7b(spark, d):
    q, chunks, vectors = _vector_queries(spark, d), load(spark, d, "chunks"), _vectors(spark, d)
    targets = stored(source_passages(q, chunks))  # both methods are measured with them
    rows = [retrieval_quality(hits, targets).withColumn("method", F.lit(name)) for name, hits in (("dense", dense_topk(q, vectors, 10)), ("hybrid", hybrid_topk(q, chunks, vectors, 10)))]
    both = rows[0].unionByName(rows[1])
    return both.select("method", *[F.round(c, 6).alias(c) for c in both.columns if c != "method"])


@_q("f21_byte_histogram", "WITH b AS (SELECT item_id, unnest(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g'), ' ')) AS x FROM {benchmark}), n AS (SELECT item_id, CAST('0x' || x AS INT) % 128 AS bin, count(*) AS n FROM b WHERE x <> '' GROUP BY 1, 2) SELECT item_id, bin, n, round(n / sqrt(CAST(sum(n * n) OVER (PARTITION BY item_id) AS DOUBLE)), 6) AS share FROM n")
def _f21(spark, d):
    return byte_histogram(load(spark, d, "benchmark"), "item_id").withColumn("share", F.round("share", 6))


@_q("a27_latency", "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM {events}")
def _a27(spark, d):
    t = latency(load(spark, d, "events"), "value")
    return t.select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "p95")], "min", "max")


#: Pages pg(source_id, page, t) cut into ck(source_id, page, i, text), as paragraphs() does: what is gathered last follows the last chr(1).
CUT = """cu AS (SELECT source_id, page, string_split(list_reduce(list_prepend('', string_split(t, chr(10))), lambda s, l: CASE WHEN trim(l) = '' AND length(string_split(s, chr(1))[-1]) > 200 THEN s || chr(1) ELSE s || l || chr(10) END), chr(1)) AS c FROM pg),
  ck AS (SELECT source_id, page, i - 1 AS i, regexp_replace(c[i], '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT source_id, page, c, unnest(range(1, len(c) + 1)) AS i FROM cu) x WHERE i < len(c) OR trim(c[i]) <> '')"""


@operator("t9_w12_paragraphs", f"WITH pg AS (SELECT doc_id AS source_id, doc_id % 50 AS page, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents), {CUT} SELECT CAST(source_id AS STRING) || '_p' || CAST(page AS STRING) || '_c' || CAST(i AS STRING) AS chunk_id, source_id, page, CAST(length(text) AS BIGINT) AS n_chars FROM ck")
def _t9(spark, d):
    pages = load(spark, d, "documents").select(F.col("doc_id").alias("source_id"), (F.col("doc_id") % 50).alias("page"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return paragraphs(pages).select("chunk_id", "source_id", "page", F.length("text").cast("long").alias("n_chars"))
