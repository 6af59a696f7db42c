"""What may enter the curated tables: claim gates, source classes, two-engine reconciliation, the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.scalars import normal_number
from groundwork.registry import operator
from groundwork.views import load, with_views

DUAL, MANUAL = "scanned_ocr_dual_consensus", "manual_transcription"


def _with_class(claims: DataFrame, sources: DataFrame) -> DataFrame:
    cls = sources.select(F.col("id").alias("source_id"), F.col("degradation_class").alias("__class"))
    return claims.join(cls, "source_id", "left")


def claim_gate(claims: DataFrame, sources: DataFrame, human: Column | None = None, dual: str = DUAL) -> DataFrame:
    """claims with `accepted` and `reason`.

    Without `human`: a two-engine consensus must be verified, and a CLASS_B source takes manual transcriptions only.  With the column `human`: nothing of
    two engines and nothing that a human has not verified."""
    machine_only = (F.col("__class") == "CLASS_B") & (F.col("origin_type") != MANUAL)
    first = (F.col("origin_type") == dual) & (F.col("verification_status") != "VERIFIED") if human is None else (F.col("origin_type") == dual) | ~F.coalesce(human, F.lit(False))
    reason = F.when(first, "not_verified").when(F.coalesce(machine_only, F.lit(False)), "class_b_manual_only")
    return _with_class(claims, sources).withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("__class")


def classified(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """sources after requests (id, class, confirmed): unknown classes are CLASS_B, and CLASS_A takes an explicit confirmation."""
    r = requests.select(F.col("id").alias("__id"), F.col("class").alias("__class"), F.col("confirmed").alias("__ok"))
    wanted = F.when((F.col("__class") == "CLASS_A") & F.coalesce("__ok", F.lit(False)), "CLASS_A").otherwise("CLASS_B")
    asked = F.col("__id").isNotNull()
    out = sources.join(r, sources["id"] == r["__id"], "left")
    return out.withColumns({"degradation_class": F.when(asked, wanted).otherwise(F.col("degradation_class")), "confirmed_clean_offset": F.when(asked, wanted == "CLASS_A").otherwise(F.col("confirmed_clean_offset"))}).drop("__id", "__class", "__ok")


def reclassified(sources: DataFrame, claims: DataFrame, items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, claims, items) after the sources of ids(id) fell to CLASS_B: their machine claims go, their open items are rejected."""
    key = ids.select(F.col("id").alias("__id")).distinct()
    hit = F.col("__id").isNotNull()
    s = sources.join(key, sources["id"] == key["__id"], "left").withColumns({"degradation_class": F.when(hit, "CLASS_B").otherwise(F.col("degradation_class")), "ingestion_status": F.when(hit, "MANUAL_TRANSCRIPTION_PENDING").otherwise(F.col("ingestion_status"))}).drop("__id")
    c = claims.join(key, (claims["source_id"] == key["__id"]) & (claims["origin_type"] != MANUAL), "left_anti")
    i = items.join(key, items["source_id"] == key["__id"], "left").withColumn("status", F.when(hit & (F.col("status") == "PENDING"), "REJECTED_DUE_TO_RECLASSIFICATION").otherwise(F.col("status"))).drop("__id")
    return s, c, i


def routed(facts: DataFrame) -> DataFrame:
    """facts with status, confidence and resolved_value: degraded scans are gated; equal normal forms agree; the rest disagrees."""
    gated = F.col("degradation_class") == "CLASS_B"
    normal = lambda c: F.when(~F.coalesce(gated, F.lit(False)), normal_number(F.col(c)))
    both = facts.withColumns({"__a": normal("value_engine_a"), "__b": normal("value_engine_b")})  # once for a row, however often they are asked for
    agree = (F.col("__a") == F.col("__b")) & (F.col("__a") != "")
    pick = lambda x, y, z: F.when(gated, x).when(agree, y).otherwise(z)
    out = both.withColumns({"status": pick("GATED_MANUAL_REVIEW_REQUIRED", "AUTO_ACCEPTED_CONSENSUS", "FLAGGED_DISAGREEMENT"), "confidence": pick(0.0, 0.985, 0.40), "resolved_value": pick("", F.col("__a"), "")})
    return out.drop("__a", "__b")


def routing_counts(facts: DataFrame, by: str = "source_id") -> DataFrame:
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return routed(facts).groupBy(by).agg(F.count("*").alias("n_facts"), n("AUTO_ACCEPTED_CONSENSUS", "n_consensus"), n("FLAGGED_DISAGREEMENT", "n_queued"), n("GATED_MANUAL_REVIEW_REQUIRED", "n_gated"))


def queue(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Items for review: facts of confirmed CLASS_A sources, whether the engines agree or not."""
    clean = sources.where((F.col("degradation_class") == "CLASS_A") & F.col("confirmed_clean_offset")).select(F.col("id").alias("source_id"))
    rows = routed(facts.join(clean, "source_id", "left_semi")).where("status <> 'GATED_MANUAL_REVIEW_REQUIRED'")
    return rows.select(F.col("fact_id").alias("id"), "source_id", F.col("value_engine_a").alias("candidate_a"), F.col("value_engine_b").alias("candidate_b"), F.lit("PENDING").alias("status"), "confidence")


def resolved(items: DataFrame, decisions: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """items after decisions (id, kind, value), with `applied`; kinds that are not known change nothing.

    With crops(crop): an item is resolved only if its crop is there, unless it is rejected."""
    d = decisions.select(F.col("id").alias("__id"), F.col("kind").alias("__k"), F.col("value").alias("__v"))
    rows = items.join(d, items["id"] == d["__id"], "left")
    known = F.col("__k").isin("CANDIDATE_A", "CANDIDATE_B", "MANUAL_OVERRIDE", "REJECT")
    if crops is not None:
        rows = rows.join(crops.select("crop").distinct().withColumn("__c", F.lit(True)), "crop", "left")
        known = known & (F.coalesce("__c", F.lit(False)) & (F.col("crop") != "") | (F.col("__k") == "REJECT"))
    known = F.coalesce(known, F.lit(False))
    kind = lambda k: known & (F.col("__k") == k)
    value = F.when(kind("CANDIDATE_A"), F.col("candidate_a")).when(kind("CANDIDATE_B"), F.col("candidate_b")).when(kind("MANUAL_OVERRIDE"), F.col("__v"))
    status = F.when(kind("CANDIDATE_A"), "RESOLVED_A").when(kind("CANDIDATE_B"), "RESOLVED_B").when(kind("MANUAL_OVERRIDE"), "RESOLVED_MANUAL_OVERRIDE").when(kind("REJECT"), "REJECTED").otherwise(F.col("status"))
    return rows.withColumns({"resolved_value": value, "status": status, "applied": known}).select(*items.columns, "resolved_value", "applied")


def transcribed(rows: DataFrame) -> DataFrame:
    """Manual transcriptions (source_id, page, entity, value) as verified quantitative claims; blank values are skipped."""
    some = rows.where(F.trim(F.coalesce("value", F.lit(""))) != "")
    return some.select("source_id", F.concat(F.lit("p."), F.col("page").cast("string")).alias("page_ref"), F.concat_ws(": ", "entity", F.trim("value")).alias("claim_text"), F.lit(MANUAL).alias("origin_type"), F.lit("VERIFIED").alias("verification_status"), F.lit(True).alias("is_quantitative"))


def verified(claims: DataFrame, corrections: DataFrame) -> DataFrame:
    """claims after corrections (id, text): verified and without anomaly; a changed text makes them manual and Verified."""
    c = corrections.select(F.col("id").alias("__id"), F.col("text").alias("__t"))
    rows = claims.join(c, claims["id"] == c["__id"], "left")
    hit = F.col("__id").isNotNull()
    new = F.coalesce(hit & (F.coalesce("__t", F.lit("")) != "") & (F.col("__t") != F.col("claim_text")), F.lit(False))
    return rows.withColumns({
        "verification_status": F.when(hit, "VERIFIED").otherwise(F.col("verification_status")), "anomaly_flag": F.when(hit, False).otherwise(F.col("anomaly_flag")),
        "claim_text": F.when(new, F.col("__t")).otherwise(F.col("claim_text")), "origin_type": F.when(new, MANUAL).otherwise(F.col("origin_type")), "status": F.when(new, "Verified").otherwise(F.col("status")),
    }).drop("__id", "__t")


# reconciliation --------------------------------------------------------------
def found_in(text: Column, value: Column) -> Column:
    """How a true value occurs in a text: direct, range, comma, unit, integer or phrase; null if it doesn't."""
    literal = lambda c: F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    seen = lambda p: F.coalesce(F.regexp_like(text, p), F.lit(False))
    dash = F.instr(value, "-") > 0
    left, right = F.substring_index(value, "-", 1), F.regexp_replace(value, r"^[^-]*-", "")
    ranges = F.concat(F.lit(r"(?i)\b"), literal(left), F.lit(r"\s*[-–—]\s*"), literal(right))
    comma = F.concat(F.lit(r"\b"), F.replace(literal(value), F.lit(","), F.lit("[,.]?")), F.lit(r"\b"))
    unit = value.rlike(r"(?i)^\d+\s*(m\.|mtrs|metres|cm|pieces)$")
    units = F.concat(F.lit(r"(?i)\b"), F.regexp_extract(value, r"^(\d+)", 1), F.lit(r"\s*(m\.|mtrs|metres|m|cm|pieces)\b"))
    phrase = F.concat(F.lit("(?i)"), F.replace(F.replace(literal(value), F.lit(" "), F.lit(r"\s+")), F.lit("\\."), F.lit(r"\.?")))
    return (
        F.when((text == "") | (value == "") | text.isNull() | value.isNull(), None)
        .when(F.contains(text, value), "direct")
        .when(dash & seen(ranges), "range")
        .when(F.contains(value, F.lit(",")) & (F.contains(text, F.replace(value, F.lit(","), F.lit(""))) | seen(comma)), "comma")
        .when(unit & seen(units), "unit")
        .when(value.rlike(r"^\d+$") & seen(F.concat(F.lit(r"\b"), value, F.lit(r"\b"))), "integer")
        .when(F.contains(value, F.lit(" ")) & seen(phrase), "phrase")
    )


def reconciled(facts: DataFrame, pages_a: DataFrame, pages_b: DataFrame) -> DataFrame:
    """facts (fact_id, page_id, true_value) with hit_a and hit_b: whether each engine's page (page_id, text) holds the value."""
    a, b = pages_a.select("page_id", F.col("text").alias("ta")), pages_b.select("page_id", F.col("text").alias("tb"))
    # each value of a page is looked for once, and a page's texts move once, not with every fact
    values = facts.groupBy("page_id").agg(F.collect_set("true_value").alias("values")).join(a, "page_id", "left").join(b, "page_id", "left")
    seen = values.select("page_id", "ta", "tb", F.explode("values").alias("true_value"))
    seen = seen.select("page_id", "true_value", found_in(F.col("ta"), F.col("true_value")).isNotNull().alias("__a"), found_in(F.col("tb"), F.col("true_value")).isNotNull().alias("__b"))
    no = F.lit(False)
    return facts.join(seen, ["page_id", "true_value"], "left").withColumns({"hit_a": F.coalesce("__a", no), "hit_b": F.coalesce("__b", no)}).drop("__a", "__b")


def engine_table(hits: DataFrame, by: str = "degradation_class") -> DataFrame:
    """Hits per engine, both, one only and neither, per class and over all."""
    n = lambda c, name: F.count_if(c).alias(name)
    a, b = F.col("hit_a"), F.col("hit_b")
    sets = hits.groupingSets([[by], []], by).agg(F.count("*").alias("n_facts"), n(a, "n_a"), n(b, "n_b"), n(a & b, "n_both"), n(a & ~b, "n_a_only"), n(b & ~a, "n_b_only"), n(~a & ~b, "n_neither"))
    return sets.withColumn(by, F.coalesce(by, F.lit("all")))


# queries ---------------------------------------------------------------------
def _q(name: str, sql: str):
    return operator(name, with_views(sql))


@_q("v1_claim_gate", """SELECT id, CASE WHEN origin_type = 'dual_engine_consensus' AND verification_status <> 'VERIFIED' THEN 'not_verified' WHEN degradation_class = 'CLASS_B' AND origin_type <> 'manual_transcription' THEN 'class_b_manual_only' END AS reason
  FROM (SELECT c.*, s.degradation_class FROM {claims} c LEFT JOIN {sources} s ON c.source_id = s.id) x""")
def _v1(spark, d):
    return claim_gate(load(spark, d, "claims"), load(spark, d, "sources"), dual="dual_engine_consensus").select("id", "reason")


@_q("v2_strict_gate", """SELECT id, NOT (origin_type = 'dual_engine_consensus' OR verification_status <> 'VERIFIED' OR coalesce(degradation_class = 'CLASS_B' AND origin_type <> 'manual_transcription', false)) AS accepted
  FROM (SELECT c.*, s.degradation_class FROM {claims} c LEFT JOIN {sources} s ON c.source_id = s.id) x""")
def _v2(spark, d):
    return claim_gate(load(spark, d, "claims"), load(spark, d, "sources"), F.col("verification_status") == "VERIFIED", "dual_engine_consensus").select("id", "accepted")


@_q("v3_classification", "SELECT id, CASE WHEN source_type = '' THEN degradation_class WHEN source_type = 'Book' AND confirmed_clean_offset THEN 'CLASS_A' ELSE 'CLASS_B' END AS degradation_class FROM {sources}")
def _v3(spark, d):
    s = load(spark, d, "sources")
    asked = s.where("source_type <> ''").select("id", F.when(F.col("source_type") == "Book", "CLASS_A").otherwise("CLASS_X").alias("class"), F.col("confirmed_clean_offset").alias("confirmed"))
    return classified(s, asked).select("id", "degradation_class")


_DOWN = "(SELECT id FROM {sources} WHERE ingestion_status = 'VERIFIED_CONSENSUS')"


@_q("v4_downgrade_claims", f"SELECT id, source_id FROM {{claims}} WHERE NOT (source_id IN {_DOWN} AND origin_type <> 'manual_transcription')")
def _v4(spark, d):
    s = load(spark, d, "sources")
    return reclassified(s, load(spark, d, "claims"), load(spark, d, "verification_items"), s.where("ingestion_status = 'VERIFIED_CONSENSUS'"))[1].select("id", "source_id")


@_q("v4_downgrade_items", f"SELECT id, CASE WHEN status = 'PENDING' AND source_id IN {_DOWN} THEN 'REJECTED_DUE_TO_RECLASSIFICATION' ELSE status END AS status FROM {{verification_items}}")
def _v4b(spark, d):
    s = load(spark, d, "sources")
    return reclassified(s, load(spark, d, "claims"), load(spark, d, "verification_items"), s.where("ingestion_status = 'VERIFIED_CONSENSUS'"))[2].select("id", "status")


_NORM = lambda c: f"regexp_replace(trim({c}), '([0-9]),([0-9])', '\\1\\2', 'g')"
_ROUTED = f"ro AS (SELECT *, CASE WHEN degradation_class = 'CLASS_B' THEN 'GATED_MANUAL_REVIEW_REQUIRED' WHEN {_NORM('value_engine_a')} = {_NORM('value_engine_b')} AND {_NORM('value_engine_a')} <> '' THEN 'AUTO_ACCEPTED_CONSENSUS' ELSE 'FLAGGED_DISAGREEMENT' END AS st FROM {{ocr_facts}})"


@_q("v5_f16_routing", f"WITH {_ROUTED} SELECT fact_id, st AS status, CASE WHEN st = 'AUTO_ACCEPTED_CONSENSUS' THEN {_NORM('value_engine_a')} ELSE '' END AS resolved_value FROM ro")
def _v5(spark, d):
    return routed(load(spark, d, "ocr_facts")).select("fact_id", "status", "resolved_value")


@_q("a21_routing_counts", f"WITH {_ROUTED} SELECT source_id, CAST(count(*) AS BIGINT) AS n_facts, CAST(count(*) FILTER (WHERE st = 'AUTO_ACCEPTED_CONSENSUS') AS BIGINT) AS n_consensus, CAST(count(*) FILTER (WHERE st = 'FLAGGED_DISAGREEMENT') AS BIGINT) AS n_queued, CAST(count(*) FILTER (WHERE st = 'GATED_MANUAL_REVIEW_REQUIRED') AS BIGINT) AS n_gated FROM ro GROUP BY 1")
def _a21(spark, d):
    return routing_counts(load(spark, d, "ocr_facts"))


@_q("v6_queue", f"WITH {_ROUTED} SELECT fact_id AS id, source_id, value_engine_a AS candidate_a FROM ro WHERE source_id IN (SELECT id FROM {{sources}} WHERE degradation_class = 'CLASS_A' AND confirmed_clean_offset) AND st <> 'GATED_MANUAL_REVIEW_REQUIRED'")
def _v6(spark, d):
    return queue(load(spark, d, "ocr_facts"), load(spark, d, "sources")).select("id", "source_id", "candidate_a")


_DECIDE = "CASE id % 7 WHEN 0 THEN 'CANDIDATE_A' WHEN 1 THEN 'CANDIDATE_B' WHEN 2 THEN 'MANUAL_OVERRIDE' WHEN 3 THEN 'REJECT' WHEN 4 THEN 'NO_SUCH_KIND' END"


@_q("v7_v8_resolution", f"""SELECT id, CASE WHEN NOT ok THEN status WHEN k = 'CANDIDATE_A' THEN 'RESOLVED_A' WHEN k = 'CANDIDATE_B' THEN 'RESOLVED_B' WHEN k = 'MANUAL_OVERRIDE' THEN 'RESOLVED_MANUAL_OVERRIDE' ELSE 'REJECTED' END AS status,
  CASE WHEN ok THEN CASE k WHEN 'CANDIDATE_A' THEN candidate_a WHEN 'CANDIDATE_B' THEN candidate_b WHEN 'MANUAL_OVERRIDE' THEN 'manual' END END AS resolved_value, ok AS applied FROM (SELECT *, coalesce(k IN ('CANDIDATE_A', 'CANDIDATE_B', 'MANUAL_OVERRIDE') AND crop <> '' OR k = 'REJECT', false) AS ok FROM (SELECT *, {_DECIDE} AS k FROM {{verification_items}}) x) y""")
def _v7(spark, d):
    items = load(spark, d, "verification_items")
    decisions = items.select("id", F.expr(_DECIDE).alias("kind"), F.lit("manual").alias("value")).where("kind is not null").distinct()
    return resolved(items, decisions, items.where("crop <> ''").select("crop")).select("id", "status", "resolved_value", "applied")


@_q("v9_transcription", "SELECT source_id, 'p.' || CAST(page_id AS STRING) AS page_ref, 'fact ' || CAST(fact_id AS STRING) || ': ' || trim(value_engine_b) AS claim_text FROM {ocr_facts} WHERE trim(value_engine_b) <> ''")
def _v9(spark, d):
    f = load(spark, d, "ocr_facts").select("source_id", F.col("page_id").alias("page"), F.concat(F.lit("fact "), F.col("fact_id").cast("string")).alias("entity"), F.col("value_engine_b").alias("value"))
    return transcribed(f).select("source_id", "page_ref", "claim_text")


@_q("v10_verification", "SELECT id, CASE WHEN topic = 'Chronology' THEN 'VERIFIED' ELSE verification_status END AS verification_status, CASE WHEN topic = 'Chronology' THEN false ELSE anomaly_flag END AS anomaly_flag, CASE WHEN topic = 'Chronology' AND is_quantitative THEN 'manual_transcription' ELSE origin_type END AS origin_type FROM {claims}")
def _v10(spark, d):
    c = load(spark, d, "claims")
    fixes = c.where("topic = 'Chronology'").select("id", F.when(F.col("is_quantitative"), F.concat("claim_text", F.lit("!"))).alias("text"))
    return verified(c, fixes).select("id", "verification_status", "anomaly_flag", "origin_type")


@_q("j24_t11_a20_engines", """WITH pa AS (SELECT page_id, string_agg(value_engine_a, ' ' ORDER BY fact_id) AS t FROM {ocr_facts} GROUP BY 1), pb AS (SELECT page_id, string_agg(value_engine_b, ' ' ORDER BY fact_id) AS t FROM {ocr_facts} GROUP BY 1),
  h AS (SELECT f.degradation_class AS c, contains(pa.t, true_value) AS a, contains(pb.t, true_value) AS b FROM {ocr_facts} f LEFT JOIN pa ON f.page_id = pa.page_id LEFT JOIN pb ON f.page_id = pb.page_id), g AS (SELECT c, a, b FROM h UNION ALL SELECT 'all', a, b FROM h)
  SELECT c AS degradation_class, CAST(count(*) AS BIGINT) AS n_facts, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS n_a, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS n_b, CAST(count(*) FILTER (WHERE a AND b) AS BIGINT) AS n_both FROM g GROUP BY 1""")
def _j24(spark, d):
    f = load(spark, d, "ocr_facts")
    page = lambda c: f.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", F.col(c).alias("v")))), lambda x: x["v"]), " ").alias("text"))
    return engine_table(reconciled(f, page("value_engine_a"), page("value_engine_b"))).select("degradation_class", "n_facts", "n_a", "n_b", "n_both")
