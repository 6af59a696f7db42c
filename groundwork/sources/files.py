"""Readers and writers: project states, catalogs, documents, page texts, bibliographies, archives, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions.scalars import bibtex_escaped, citation_key
from groundwork.operators.conflicts import dashboard
from groundwork.plans.scratch import stored
from groundwork.registry import operator
from groundwork.views import load, with_views

_S, _I, _D, _B, _L = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.ArrayType(T.StringType())


def _table(text: str) -> T.StructType:
    kinds = {"i": _I, "d": _D, "b": _B, "l": _L, "n": T.LongType()}
    return T.StructType([T.StructField(n.partition(":")[0], kinds.get(n.partition(":")[2], _S)) for n in ("id project_id " + text + " created_date").split()])


#: The nine tables of a project state.  A field without a kind is text; i int, n long, d double, b boolean, l list of text.
STATE = {
    "sites": _table("site_name country region latitude:d longitude:d elevation:d period site_type excavation_history aliases:l"),
    "strata": _table("site_id stratum_name phase locus_numbers:l sediment_type chronological_bounds date_start_bce:i date_end_bce:i date_start_ce:i date_end_ce:i harris_above:l harris_below:l harris_cut_by:l"),
    "artifacts": _table("artifact_name category material period date_range site_ids:l stratum_id locus_findspot typology"),
    "samples": _table("site_id stratum_id lab_code material method cal_range_2sigma date_cal_start_bce:i date_cal_end_bce:i date_cal_start_ce:i date_cal_end_ce:i"),
    "claims": _table("claim_text scholar_name source_id publication_year page_ref chapter status topic site_ids:l strata_ids:l origin_type verification_status is_quantitative:b anomaly_flag:b anomaly_reason optical_crop_path ocr_confidence:d"),
    "evidence": _table("claim_id evidence_text evidence_type physical_entity_type physical_entity_id source_ids:l date_info"),
    "sources": _table("title author year publication journal pages source_type file_path degradation_class confirmed_clean_offset:b ingestion_status archive_path file_sha256 file_size_bytes:n compressed_size_bytes:n page_count:i"),
    "verification_items": _table("source_id page_number:i field_type context_text crop_image_path candidate_a candidate_b resolved_value status audit_note"),
    "notes": _table("title content tags:l updated_date"),
}
CATALOG = "Artifact_ID string, Site_Sector string, Trench_ID string, Stratigraphic_Layer string, Period_Phase string, Material string, Typology_Description string, Depth_cm int, Estimated_Date_Year int, Preservation_Score int, Conservation_Status string"


def _or_default(field: T.StructField) -> Column:
    c = F.col(field.name)
    if field.name == "project_id":
        return F.coalesce(c, F.lit("default")).alias(field.name)
    kind = field.dataType
    empty = F.array().cast(kind) if isinstance(kind, T.ArrayType) else F.lit("" if kind == _S else False if kind == _B else 0).cast(kind)
    return F.coalesce(c, empty).alias(field.name)


def read_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of project state files (JSON objects with an array per table); what is missing gets its default."""
    schema = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in STATE.items()])
    state = spark.read.schema(schema).option("multiLine", True).json(path)
    return {n: state.select(F.inline(n)).select(*[_or_default(f) for f in s.fields]) for n, s in STATE.items()}


def write_state(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One Parquet table each, partitioned by project."""
    for name, df in tables.items():
        df.write.mode(mode).partitionBy("project_id").parquet(f"{path}/{name}")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG).option("header", True).csv(path)


def ingested(files: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """binaryFile rows as sources: always CLASS_B and unverified; the id comes from the content; titles(path, title, author, year) fill in."""
    rows = files if titles is None else files.join(titles, "path", "left")
    given = lambda c, default: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(default)) if titles is not None else F.lit(default)
    sha = F.sha2("content", 256)
    return rows.select(F.concat(F.lit("src_"), F.substring(sha, 1, 16)).alias("id"), given("title", "Untitled Source").alias("title"), given("author", "Unknown Author").alias("author"), given("year", "n.d.").alias("year"), F.col("path").alias("file_path"), sha.alias("file_sha256"), F.length("content").cast("long").alias("file_size_bytes"), F.lit("CLASS_B").alias("degradation_class"), F.lit("UNVERIFIED_ROUGH_SCAN").alias("ingestion_status"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def text_runs(df: DataFrame, content: str = "content", opening: str = "BT", closing: str = "ET", literal: str = r"\(((?:[^()\\]|\\.)*)\)\s*T[jJ]") -> DataFrame:
    """df with `text`: between each opening and closing mark every shown literal, joined by spaces."""
    blocks = F.regexp_extract_all(F.col(content).cast("string"), F.lit(rf"(?s){opening}(.*?){closing}"), F.lit(1))
    runs = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(literal), F.lit(1))))
    return df.withColumn("text", F.array_join(runs, " "))


def write_passages(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_passages(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The passages of ids(chunk_id)."""
    return spark.read.parquet(path).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def read_page_texts(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """One text file per page: (page_id from the file's name, text, engine); empty files are left out."""
    rows = spark.read.text(path, wholetext=True).withColumn("f", F.input_file_name())
    return rows.select(F.regexp_extract("f", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("page_id"), F.col("value").alias("text"), F.lit(engine).alias("engine")).where("trim(text) <> ''")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page_id string, type string, description string, true_value string").option("multiLine", True).json(path)


# sinks -----------------------------------------------------------------------
def bibliography(sources: DataFrame) -> DataFrame:
    """(id, entry): one BibTeX entry per source; an article if it is of a journal, else a book; empty fields are left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind = F.when((text("source_type") == "Journal") | (text("journal") != ""), "article").otherwise("book")
    line = lambda name, c: F.when(text(c) != "", F.concat(F.lit(f"  {name} = {{"), bibtex_escaped(text(c)), F.lit("},")))
    head = F.concat(F.lit("@"), kind, F.lit("{"), citation_key(F.col("author"), F.col("year"), F.col("title")), F.lit(","))
    return sources.select("id", F.concat_ws("\n", head, line("title", "title"), line("author", "author"), line("year", "year"), line("journal", "journal"), line("pages", "pages"), F.lit("}")).alias("entry"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows, checksum): the checksum is of the sorted set of row hashes by exclusive or and sum, so order does not count."""
    def one(name: str, df: DataFrame) -> DataFrame:
        h = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))
        a = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(1_000_003))), F.lit(0)).alias("s"))
        return a.select(F.lit(name).alias("name"), F.col("n").alias("n_rows"), F.sha2(F.concat_ws(":", "n", "x", "s"), 256).alias("checksum"))

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def write_archive(tables: dict[str, DataFrame], path: str, version: str = "1.0") -> DataFrame:
    """Each table as JSON lines, and the manifest with the schema version and the numbers of sources and claims; returns the manifest."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    rows = stored(manifest(tables))  # a row for each table
    of = lambda name: F.coalesce(F.max(F.when(F.col("name") == name, F.col("n_rows"))), F.lit(0))
    counts = rows.agg(of("sources").alias("source_count"), of("claims").alias("claim_count"))
    made = stored(rows.join(F.broadcast(counts)).withColumn("schema_version", F.lit(version)))
    made.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return made


def report_lines(t: dict[str, DataFrame]) -> DataFrame:
    """(section, ord, line): the report as Markdown rows: inventory, readiness, chapters, sites, strata, claims and conflicts."""
    s = dashboard(t)
    row = lambda *cs: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs]), F.lit(" |"))
    part = lambda i, title, df, key, *cs: [df.sparkSession.createDataFrame([(i, "", f"## {title}")], "section int, ord string, line string"), df.select(F.lit(i).alias("section"), F.concat(F.lit(" "), F.lpad(F.col(key).cast("string"), 20, "0")).alias("ord"), row(*cs).alias("line"))]
    frames = [
        *part(1, "Inventory", s["summary"], "measure", "project_id", "measure", "n"), *part(2, "Readiness", s["readiness"], "score", "score", "verdict", "n_claims", "n_conflicts"),
        *part(3, "Chapters", s["chapters"], "chapter", "chapter", "n_claims", "n_verified", "n_unsupported", "score", "readiness"), *part(4, "Sites", t["sites"], "id", "id", "site_name", "period"),
        *part(5, "Strata", t["strata"], "id", "id", "stratum_name", "site_id"), *part(6, "Claims", t["claims"], "id", "id", "claim_text", "status"), *part(7, "Conflicts", s["conflicts"], "entity", "kind", "severity", "entity"),
    ]
    return reduce(DataFrame.unionByName, frames)


def export_all(t: dict[str, DataFrame], path: str) -> DataFrame:
    """Bibliography, report and archive under one folder; returns the manifest."""
    bibliography(t["sources"]).orderBy("id").select("entry").write.mode("overwrite").text(f"{path}/bibliography")
    report_lines(t).orderBy("section", "ord", "line").select("line").write.mode("overwrite").text(f"{path}/report")
    return write_archive(t, f"{path}/archive")


# queries ---------------------------------------------------------------------
_NAMES = ("sites", "strata", "artifacts", "samples", "claims", "evidence", "sources")


@operator("s15_f17_f18_bibliography", with_views("""SELECT id, CASE WHEN source_type = 'Journal' OR journal <> '' THEN 'article' ELSE 'book' END AS kind, coalesce(nullif(regexp_replace(lower((CASE WHEN contains(author, ',') THEN split_part(author, ',', 1) ELSE list_last(string_split(author, ' ')) END) || regexp_replace(year, '[^0-9]', '', 'g') || split_part(title, ' ', 1)), '[^a-z0-9]', '', 'g'), ''), 'ref_archaeo') AS key,
  regexp_replace(title, '([&%$#_])', '\\\\\\1', 'g') AS title FROM {sources}"""))
def _s15(spark, d):
    b = bibliography(load(spark, d, "sources"))
    return b.select("id", F.regexp_extract("entry", r"^@(\w+)\{", 1).alias("kind"), F.regexp_extract("entry", r"^@\w+\{([^,]*),", 1).alias("key"), F.regexp_extract("entry", r"title = \{(.*)\},", 1).alias("title"))


@operator("s16_manifest", "\nUNION ALL ".join(with_views(f"SELECT * FROM (SELECT '{n}' AS name, CAST(count(*) AS BIGINT) AS n_rows FROM {{{n}}}) q").replace("WITH", "SELECT * FROM (WITH", 1) + ") w" for n in _NAMES))
def _s16(spark, d):
    return manifest({n: load(spark, d, n) for n in _NAMES}).select("name", "n_rows")


@operator("s17_s18_report_lines")
def _s18(spark, d):
    return report_lines({n: load(spark, d, n) for n in _NAMES}).groupBy("section").agg(F.count("*").alias("n_lines"))


@operator("s11_text_runs", "SELECT page_id, array_to_string(regexp_extract_all(html, '<p>([^<]*)</p>', 1), ' ') AS text FROM pages")
def _s11(spark, d):
    return text_runs(load(spark, d, "pages"), "html", r"\A", r"\z", r"<p>([^<]*)</p>").select("page_id", "text")


@operator("s10_checksum", "SELECT page_id, sha256(html) AS checksum FROM pages")
def _s10(spark, d):
    return load(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("checksum"))


@operator("s9_ingest", "SELECT 'src_' || substr(sha256(html), 1, 16) AS id, CAST(octet_length(encode(html)) AS BIGINT) AS file_size_bytes, 'CLASS_B' AS degradation_class, 'Untitled Source' AS title FROM pages")
def _s9(spark, d):
    files = load(spark, d, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return ingested(files).select("id", "file_size_bytes", "degradation_class", "title")
