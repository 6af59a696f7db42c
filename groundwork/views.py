"""Field-research tables over the general tables of a data folder.

Each view is one SQL text that Spark and other engines read alike: {name} stands
for a table or for another view.  Lists are comma-separated strings in the views;
`load` turns the columns of LISTS into arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "sites": """
        SELECT c_custkey AS id, c_mktsegment AS project_id, c_name AS site_name, n_name AS country, r_name AS region,
          CASE WHEN c_custkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE (c_custkey * 7919 % 14000) / CAST(100 AS DOUBLE) - 70 END AS latitude,
          CASE WHEN c_custkey % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE (c_custkey * 104729 % 36000) / CAST(100 AS DOUBLE) - 180 END AS longitude,
          c_acctbal AS elevation,
          CASE c_custkey % 16 WHEN 0 THEN 'Late Bronze Age' WHEN 1 THEN 'Iron Age I' WHEN 2 THEN 'Natufian' WHEN 3 THEN 'Roman' WHEN 4 THEN 'unknown'
            WHEN 5 THEN '' WHEN 6 THEN 'ca. 1400 BCE' WHEN 7 THEN 'Middle Bronze Age' WHEN 8 THEN 'AD 320'
            ELSE CAST(200 + c_custkey * 37 % 3000 AS STRING) || ' - ' || CAST(100 + c_custkey * 53 % 3000 AS STRING) || ' BCE' END AS period
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "strata": """
        SELECT p_partkey AS id, p_partkey * 2 % (SELECT count(*) FROM {customer}) AS site_id, 'p' || CAST(p_partkey % 3 AS STRING) AS project_id,
          p_name AS stratum_name, p_brand AS phase,
          CASE WHEN p_partkey = 0 THEN '' WHEN p_partkey % 3 = 0 AND p_partkey >= 7
            THEN CAST(CAST(floor(p_partkey / CAST(2 AS DOUBLE)) AS BIGINT) AS STRING) || ',' || CAST(p_partkey - 7 AS STRING)
            ELSE CAST(CAST(floor(p_partkey / CAST(2 AS DOUBLE)) AS BIGINT) AS STRING) END AS harris_below,
          CASE WHEN p_partkey > 0 AND p_partkey % 41 = 0 THEN CAST(CAST(floor(p_partkey / CAST(2 AS DOUBLE)) AS BIGINT) AS STRING) ELSE '' END AS harris_above,
          CASE WHEN p_partkey % 11 = 5 THEN CAST(p_partkey + 3 AS STRING) ELSE '' END AS harris_cut_by,
          CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE CAST(100 + p_size * 40 AS INT) END AS date_start_bce,
          CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE CAST(60 + p_size * 40 - p_partkey % 60 AS INT) END AS date_end_bce,
          CASE WHEN p_partkey % 10 = 0 THEN CAST(p_size * 10 AS INT) ELSE 0 END AS date_start_ce, 0 AS date_end_ce
        FROM {part}""",
    "artifacts": """
        SELECT p_partkey AS id, 'p' || CAST(p_partkey % 3 AS STRING) AS project_id, p_name AS artifact_name, p_type AS category, p_brand AS material,
          CASE WHEN p_partkey % 3 = 0 THEN 'Roman' ELSE '' END AS period,
          CASE WHEN p_partkey % 2 = 0 THEN CAST(300 + p_size AS STRING) || ' BCE' ELSE '' END AS date_range,
          p_partkey * 7 % (SELECT count(*) FROM {part}) AS stratum_id, CAST(p_partkey % (SELECT count(*) FROM {customer}) AS STRING) AS site_ids
        FROM {part}""",
    "samples": """
        SELECT o_orderkey AS id, 'p' || CAST(o_orderkey % 3 AS STRING) AS project_id, o_orderkey % (SELECT count(*) FROM {part}) AS stratum_id,
          'LAB-' || CAST(o_orderkey AS STRING) AS lab_code, CAST(200 + o_custkey * 37 % 12500 AS DOUBLE) AS age, CAST(20 + o_orderkey % 80 AS DOUBLE) AS sigma,
          CAST(100 + o_custkey * 37 % 3000 AS INT) AS date_start_bce, CAST(100 + o_custkey * 37 % 3000 - o_orderkey % 90 AS INT) AS date_end_bce, 0 AS date_start_ce, 0 AS date_end_ce
        FROM {orders}""",
    "sources": """
        SELECT s_suppkey AS id, CASE WHEN s_suppkey = 0 THEN 'p0' WHEN s_suppkey % 2 = 0 THEN 'p1' ELSE 'p2' END AS project_id, s_name AS title,
          CASE WHEN s_suppkey % 6 = 0 THEN '' WHEN s_suppkey % 2 = 0 THEN 'Smith, ' || n_name ELSE n_name || ' Jones' END AS author,
          CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE CAST(1950 + s_suppkey % 70 AS STRING) END AS year,
          CASE WHEN s_suppkey % 4 = 0 THEN 'Journal of ' || n_name ELSE '' END AS journal, 'pp. ' || CAST(s_suppkey % 90 AS STRING) AS pages,
          CASE s_suppkey % 5 WHEN 0 THEN 'Journal' WHEN 1 THEN 'Book' WHEN 2 THEN 'Report' ELSE '' END AS source_type,
          'file-' || CAST(s_suppkey AS STRING) AS file_path, 'archive-' || CAST(s_suppkey AS STRING) AS archive_path,
          CASE s_suppkey % 3 WHEN 0 THEN 'CLASS_A' WHEN 1 THEN 'CLASS_B' ELSE '' END AS degradation_class, s_suppkey % 6 = 0 AS confirmed_clean_offset,
          CASE s_suppkey % 3 WHEN 0 THEN 'VERIFIED_CONSENSUS' WHEN 1 THEN 'VERIFIED_MANUAL' ELSE 'UNVERIFIED_ROUGH_SCAN' END AS ingestion_status
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "claims": """
        SELECT o_orderkey AS id, 'p' || CAST(o_orderkey % 3 AS STRING) AS project_id,
          CASE WHEN o_orderkey % 5 = 0 THEN 'The layer dates to 1200 BCE in phase ' ELSE 'The layer was ' END || CAST(o_orderkey % 40 AS STRING)
            || CASE o_orderkey % 7 WHEN 0 THEN ' cm thick' WHEN 1 THEN ' of simultaneous destruction' WHEN 2 THEN ' with a collapse' ELSE ' of ash at ' || substr(o_orderpriority, 3, 40) END AS claim_text,
          CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Scholar ' || CAST(o_custkey % 50 AS STRING) END AS scholar_name, o_custkey % (SELECT count(*) FROM {supplier}) AS source_id,
          CAST(1950 + o_orderkey % 70 AS BIGINT) AS publication_year, 'p.' || CAST(o_orderkey % 50 AS STRING) AS page_ref,
          CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE o_orderpriority END AS chapter, CASE WHEN o_orderstatus = 'F' THEN 'Verified' ELSE 'Contested' END AS status,
          CASE o_orderkey % 6 WHEN 0 THEN 'Chronology' WHEN 1 THEN 'Stratigraphy' WHEN 2 THEN 'Measurement' WHEN 3 THEN '' ELSE 'Architecture ' || CAST(o_orderkey % 400 AS STRING) END AS topic,
          CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN ',' || CAST((o_custkey + 1) % (SELECT count(*) FROM {customer}) AS STRING) ELSE '' END AS site_ids,
          CAST(o_orderkey % (SELECT count(*) FROM {part}) AS STRING) AS strata_ids,
          CASE o_orderkey % 4 WHEN 0 THEN 'manual_transcription' WHEN 1 THEN 'dual_engine_consensus' ELSE 'machine' END AS origin_type,
          CASE o_orderkey % 5 WHEN 0 THEN 'PENDING_VERIFICATION' WHEN 1 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verification_status,
          o_orderkey % 9 = 0 AS is_quantitative, o_orderkey % 17 = 0 AS anomaly_flag
        FROM {orders}""",
    "evidence": """
        SELECT l_orderkey * 10 + l_linenumber AS id, 'p' || CAST(l_orderkey % 3 AS STRING) AS project_id, l_orderkey AS claim_id,
          CASE l_returnflag WHEN 'A' THEN 'supporting' WHEN 'R' THEN 'contradicting' ELSE 'neutral' END AS evidence_type,
          'artifact' AS physical_entity_type, l_partkey AS physical_entity_id, CAST(l_suppkey AS STRING) AS source_ids,
          'Found near item ' || CAST(l_partkey AS STRING) AS evidence_text, CAST(CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS STRING) AS date_info
        FROM {lineitem} WHERE l_orderkey % 4 <> 1""",
    "catalog": """
        SELECT p_partkey AS artifact_id, p_name AS typology, p_brand AS material, p_type AS period_phase, CAST(p_size * 10 AS BIGINT) AS depth_cm,
          CAST(-(p_size * 37 % 900) - p_partkey % 50 AS BIGINT) AS estimated_year, CAST(CAST(floor(p_retailprice) AS BIGINT) % 100 AS BIGINT) AS preservation_score,
          CASE p_partkey % 9 WHEN 0 THEN 'Needs Conservation' ELSE 'Stable' END AS conservation_status
        FROM {part}""",
    "chunks": "SELECT doc_id AS chunk_id, doc_id % (SELECT count(*) FROM {supplier}) AS doc_id, doc_id % 50 AS page_ref, text FROM {documents}",
    "queries": "SELECT item_id AS query_id, text AS query_text FROM {benchmark}",
    "ocr_facts": """
        SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_suppkey AS source_id, CAST(floor(l_orderkey / CAST(50 AS DOUBLE)) AS BIGINT) AS page_id,
          CASE l_suppkey % 3 WHEN 0 THEN 'CLASS_A' ELSE 'CLASS_B' END AS degradation_class,
          CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || ',000 ' END AS value_engine_a,
          CASE WHEN l_orderkey % 9 = 0 THEN CAST(CAST(l_quantity AS BIGINT) + 1 AS STRING) || '000' WHEN l_orderkey % 17 = 0 THEN '' ELSE ' ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) || '000' END AS value_engine_b,
          CAST(CAST(l_quantity AS BIGINT) AS STRING) || '000' AS true_value
        FROM {lineitem}""",
    "verification_items": """
        SELECT l_orderkey * 10 + l_linenumber AS id, 'p' || CAST(l_orderkey % 3 AS STRING) AS project_id, l_suppkey AS source_id,
          CAST(CAST(l_quantity AS BIGINT) AS STRING) AS candidate_a, CAST(CAST(l_quantity AS BIGINT) + l_orderkey % 2 AS STRING) AS candidate_b,
          CASE WHEN l_orderkey % 5 = 0 THEN 'VERIFIED' ELSE 'PENDING' END AS status, CASE WHEN l_orderkey % 6 = 0 THEN '' ELSE 'crop-' || CAST(l_orderkey AS STRING) END AS crop
        FROM {lineitem}""",
}

#: Columns that hold lists, with the type of their elements.
LISTS = {"strata": {"harris_below": "bigint", "harris_above": "bigint", "harris_cut_by": "bigint"}, "artifacts": {"site_ids": "bigint"}, "claims": {"site_ids": "bigint", "strata_ids": "bigint"}, "evidence": {"source_ids": "bigint"}}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, or a view with its lists as arrays."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    df = spark.sql(text, **{n: load(spark, sf_dir, n) for n in _names(text)})
    for column, kind in LISTS.get(name, {}).items():
        df = df.withColumn(column, F.when(F.col(column) == "", F.array().cast(f"array<{kind}>")).otherwise(F.split(column, ",").cast(f"array<{kind}>")))
    return df


def with_views(text: str) -> str:
    """The SQL text with the views that it names by {name} put before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in _names(VIEWS[name]):
                visit(n)
            order.append(name)

    for name in _names(text):
        visit(name)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    views = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    text = plain(text).strip()
    if not views:
        return text
    if re.match(r"(?i)with\s+recursive\b", text):
        return f"WITH RECURSIVE {views}, {re.sub(r'(?i)^with\s+recursive', '', text)}"
    if re.match(r"(?i)with\b", text):
        return f"WITH {views}, {text[4:]}"
    return f"WITH {views} {text}"
