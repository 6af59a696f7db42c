"""Streaming twins of batch jobs.

Each gives the rows of its batch twin on the same input; with availableNow a job
ends when its input does.  All state is in the checkpoint and the sink tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from groundwork.operators.gating import claim_gate, routed
from groundwork.operators.retrieval import CUT, STOP_WORDS, paragraphs, postings
from groundwork.plans.scratch import shared_folder
from groundwork.registry import operator
from groundwork.views import load, with_views


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def gate_stream(claims: DataFrame, sources: DataFrame, out: str, checkpoint: str, **how) -> list[StreamingQuery]:
    """Claims as they come, joined to the table of sources, into accepted and rejected ones."""
    judged = claim_gate(claims, sources, **how)
    return [_append(judged.where("accepted"), f"{out}/accepted", f"{checkpoint}/accepted"), _append(judged.where("not accepted"), f"{out}/rejected", f"{checkpoint}/rejected")]


def index_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Pages (source_id, page, text) are cut into passages, and their postings are kept per batch.

    A batch writes its own folder and writes it over when it is tried again, so a failure leaves no half batch and no repeats."""

    def put(batch: DataFrame, number: int) -> None:
        postings(paragraphs(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_postings(spark: SparkSession, out: str) -> DataFrame:
    """The postings of each passage from the last batch that had it."""
    every = spark.read.parquet(out)
    last = every.groupBy("chunk_id").agg(F.max("batch").alias("batch"))
    return every.join(last, ["chunk_id", "batch"]).drop("batch")


def route_stream(facts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Facts routed as they come."""
    return _append(routed(facts), out, checkpoint)


def routing_count_stream(facts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running counts per source and status: each batch writes the counts that it changed, under its number, so a batch that is run again replaces its own."""
    counts = routed(facts).groupBy("source_id", "status").count()
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def unique_route_stream(facts: DataFrame, out: str, checkpoint: str, key: list[str], time: str, delay: str = "1 hour") -> StreamingQuery:
    """Facts routed once each: a row whose key came within `delay` of event time before it is dropped, and so is one that is later than that behind the latest of the batches before.

    Of the rows of a batch with one key the earliest stays.  A batch writes its own folders and writes them over when it is tried again: its facts under `out`, their keys as 128 bits
    with the end of their `delay` in the checkpoint, and a row for each batch whose keys still count.  A batch is joined to these keys only; older ones are deleted.  So
    keys are read where they lie and no task has to hold them, and a restarted stream still knows them."""
    seen, end = f"{checkpoint}/seen", lambda t: F.unix_micros(t.cast("timestamp"))
    until, bound = (end(F.col(time) + F.expr(f"INTERVAL '{delay}'")), end(F.col(time) - F.expr(f"INTERVAL '{delay}'")))
    h = [F.xxhash64(F.lit(i), *[F.col(c).isNull() for c in key], *key).alias(f"__h{i}") for i in (0, 1)]  # a hash passes over nulls, so they are named

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        live = spark.read.schema("number bigint, bound bigint, until bigint").parquet(f"{seen}/live/batch={number - 1}").collect() if number else []
        mark = max((r.bound for r in live), default=None)
        old = [r.number for r in live if r.until < mark]
        live = [tuple(r) for r in live if r.number not in old]
        rows = batch if mark is None else batch.where(F.coalesce(end(F.col(time)) > mark, F.lit(True)))
        earliest = F.min_by(F.struct(*batch.columns), F.coalesce(end(F.col(time)), F.lit(2**63 - 1)))
        first = rows.select(*h, "*").groupBy("__h0", "__h1").agg(earliest.alias("r"))  # before the join, so that repeats of a batch are not moved
        if live:
            known = spark.read.schema("__h0 bigint, __h1 bigint, until bigint").parquet(*[f"{seen}/keys/batch={n}" for n, _, _ in live])
            known = known.where(F.col("until") > mark).select("__h0", "__h1", F.lit(True).alias("__known"))
            first = first.join(known, ["__h0", "__h1"], "left").where("__known IS NULL")  # Spark would put an anti join before the grouping
        fresh = routed(first.select("r.*"))
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")
        spark.read.schema(fresh.schema).parquet(f"{out}/batch={number}").select(*h, until.alias("until")).write.mode("overwrite").parquet(f"{seen}/keys/batch={number}")
        latest = batch.agg(F.max(bound), F.max(until)).first()
        live += [(number, *latest)] if latest[0] is not None else []
        spark.createDataFrame(live, "number bigint, bound bigint, until bigint").coalesce(1).write.mode("overwrite").parquet(f"{seen}/live/batch={number}")
        for path in [f"{seen}/keys/batch={n}" for n in old] + [f"{seen}/live/batch={number - 2}"]:
            _delete(spark, path)

    return facts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def current_counts(spark: SparkSession, out: str) -> DataFrame:
    """The last counts of each source and status."""
    every = spark.read.parquet(out)
    last = every.groupBy("source_id", "status").agg(F.max("batch").alias("batch"))
    return every.join(last, ["source_id", "status", "batch"]).drop("batch")


# queries: the stream over a whole table, read back -------------------------------
def _folders(spark: SparkSession, name: str) -> tuple[str, str, str]:
    import uuid

    base = f"{shared_folder(spark)}/groundwork/stream-{name}-{uuid.uuid4().hex}"
    return f"{base}/in", f"{base}/out", f"{base}/checkpoint"


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


@operator("z1_gate_stream", with_views("""SELECT id, NOT (origin_type = 'dual_engine_consensus' AND verification_status <> 'VERIFIED' OR coalesce(degradation_class = 'CLASS_B' AND origin_type <> 'manual_transcription', false)) AS accepted
  FROM (SELECT c.*, s.degradation_class FROM {claims} c LEFT JOIN {sources} s ON c.source_id = s.id) x"""))
def _z1(spark, d):
    given, out, checkpoint = _folders(spark, "gate")
    claims = load(spark, d, "claims")
    claims.write.parquet(given)
    for q in gate_stream(file_stream(spark, given, claims.schema, 2), load(spark, d, "sources"), out, checkpoint, dual="dual_engine_consensus"):
        q.awaitTermination()
    schema = "id bigint, accepted boolean"
    return _read(spark, f"{out}/accepted", schema).unionByName(_read(spark, f"{out}/rejected", schema))


@operator("z2_index_stream", f"""WITH pg AS (SELECT doc_id AS source_id, 0 AS page, text AS t FROM documents), {CUT},
  tk AS (SELECT source_id, i, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS term FROM ck), ps AS (SELECT source_id, i, term, count(*) AS tf FROM tk WHERE length(term) >= 2 AND term NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY 1, 2, 3)
  SELECT term, CAST(count(*) AS BIGINT) AS n_chunks, CAST(sum(tf) AS BIGINT) AS n FROM ps GROUP BY 1""")
def _z2(spark, d):
    given, out, checkpoint = _folders(spark, "index")
    pages = load(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.lit(0).alias("page"), "text")
    pages.write.parquet(given)
    index_stream(file_stream(spark, given, pages.schema, 2), out, checkpoint).awaitTermination()
    return current_postings(spark, out).groupBy("term").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("n"))


@operator("z3_route_stream", with_views("WITH r AS (SELECT source_id, CASE WHEN degradation_class = 'CLASS_B' THEN 'GATED_MANUAL_REVIEW_REQUIRED' WHEN regexp_replace(trim(value_engine_a), '([0-9]),([0-9])', '\\1\\2', 'g') = trim(value_engine_b) AND trim(value_engine_b) <> '' THEN 'AUTO_ACCEPTED_CONSENSUS' ELSE 'FLAGGED_DISAGREEMENT' END AS status FROM {ocr_facts}) SELECT source_id, status, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2"))
def _z3(spark, d):
    given, out, checkpoint = _folders(spark, "route")
    facts = load(spark, d, "ocr_facts")
    facts.write.parquet(given)
    route_stream(file_stream(spark, given, facts.schema, 2), out, checkpoint).awaitTermination()
    return _read(spark, out, "source_id bigint, status string").groupBy("source_id", "status").agg(F.count("*").alias("n"))


@operator("z3_count_stream", with_views("WITH r AS (SELECT source_id, CASE WHEN degradation_class = 'CLASS_B' THEN 'GATED_MANUAL_REVIEW_REQUIRED' WHEN regexp_replace(trim(value_engine_a), '([0-9]),([0-9])', '\\1\\2', 'g') = trim(value_engine_b) AND trim(value_engine_b) <> '' THEN 'AUTO_ACCEPTED_CONSENSUS' ELSE 'FLAGGED_DISAGREEMENT' END AS status FROM {ocr_facts}) SELECT source_id, status, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2"))
def _z3b(spark, d):
    given, out, checkpoint = _folders(spark, "count")
    facts = load(spark, d, "ocr_facts")
    facts.write.parquet(given)
    routing_count_stream(file_stream(spark, given, facts.schema, 2), out, checkpoint).awaitTermination()
    return current_counts(spark, out).select("source_id", "status", F.col("count").alias("n"))


@operator("z3_unique_route_stream", with_views("WITH o AS (SELECT DISTINCT * FROM {ocr_facts}), r AS (SELECT source_id, CASE WHEN degradation_class = 'CLASS_B' THEN 'GATED_MANUAL_REVIEW_REQUIRED' WHEN regexp_replace(trim(value_engine_a), '([0-9]),([0-9])', '\\1\\2', 'g') = trim(value_engine_b) AND trim(value_engine_b) <> '' THEN 'AUTO_ACCEPTED_CONSENSUS' ELSE 'FLAGGED_DISAGREEMENT' END AS status FROM o) SELECT source_id, status, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2"))
def _z3c(spark, d):
    """Every fact is sent twice, half an hour apart; each counts once."""
    given, out, checkpoint = _folders(spark, "unique")
    facts = load(spark, d, "ocr_facts")
    seen = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("fact_id"), F.lit(1200)) + F.col("turn") * 1800).alias("seen_at")
    files = spark.sparkContext.defaultParallelism  # a larger table comes in larger batches, not in more
    facts.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))).select(*facts.columns, seen).coalesce(files).write.option("parquet.block.size", 8 << 20).parquet(given)  # files of many row groups, read by many tasks
    stream = file_stream(spark, given, spark.read.parquet(given).schema, 2)
    unique_route_stream(stream, out, checkpoint, facts.columns, "seen_at", "2 hours").awaitTermination()
    return _read(spark, out, "source_id bigint, status string").groupBy("source_id", "status").agg(F.count("*").alias("n"))
