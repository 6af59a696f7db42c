"""Conflicting claims, readiness audit, alerts and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.scalars import first_named, or_label, shortened
from groundwork.operators.matching import contained_terms
from groundwork.operators.stratigraphy import cycles, precedence
from groundwork.operators.tables import bears_date, claim_flags, claims_breakdown, claims_simultaneity, coverage, date_disagreement, is_measurement, is_pending, members, research_gaps, source_counts, summary_counts
from groundwork.plans.scratch import stored
from groundwork.registry import operator
from groundwork.views import load, with_views


def _two_authorities(claims: DataFrame, entity: str, kind: str) -> DataFrame:
    """Entities with two claims or more: the first two by id, and the first flagged one, which lowers HIGH to MEDIUM.

    Aggregates only: the two smallest ids come from a bounded window, counts and the flagged claim from partial sums."""
    first = Window.partitionBy(entity).orderBy("id")
    top = claims.withColumn("r", F.row_number().over(first)).where("r <= 2").select(entity, "r", F.struct("id", "scholar_name", "source_id").alias("c"))
    pair = top.groupBy(entity).agg(F.max(F.when(F.col("r") == 1, F.col("c"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("c"))).alias("b")).where("b is not null")
    flagged = F.min(F.when(F.col("anomaly_flag") & (F.col("verification_status") != "VERIFIED"), F.col("id")))
    n = claims.groupBy(entity).agg(F.count("*").alias("n_claims"), flagged.alias("flagged_claim"))
    who = lambda s, label: first_named(F.col(f"{s}.scholar_name"), F.col(f"{s}.source_id").cast("string"), F.lit(f"Authority {label}"))
    return pair.join(n, entity).select(
        F.lit(kind).alias("kind"), F.when(F.col("flagged_claim").isNull(), "HIGH").otherwise("MEDIUM").alias("severity"), F.col(entity).cast("string").alias("entity"),
        who("a", "A").alias("authority_a"), F.col("a.id").alias("claim_a"), who("b", "B").alias("authority_b"), F.col("b.id").alias("claim_b"), "n_claims", "flagged_claim", F.lit(True).alias("confirmed"),
    )


def chronological(claims: DataFrame) -> DataFrame:
    """Sites with two date-bearing claims or more."""
    return _two_authorities(members(claims.where(bears_date()), "site_ids", "site_id"), "site_id", "chronological")


def measurements(claims: DataFrame) -> DataFrame:
    """Strata with two measurement claims or more."""
    return _two_authorities(members(claims.where(is_measurement()), "strata_ids", "stratum_id"), "stratum_id", "measurement")


def _row(df: DataFrame, kind: str, severity: str, entity: Column, claim_a: Column, claim_b: Column, n: Column, confirmed: bool) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), entity.cast("string").alias("entity"), nothing.alias("authority_a"), claim_a.cast("bigint").alias("claim_a"), nothing.alias("authority_b"), claim_b.cast("bigint").alias("claim_b"), n.cast("bigint").alias("n_claims"), F.lit(None).cast("bigint").alias("flagged_claim"), F.lit(confirmed).alias("confirmed"))


def stratigraphic(strata: DataFrame) -> DataFrame:
    """One CRITICAL row per cycle of strata."""
    per = cycles(strata, stored(precedence(strata))).groupBy("component").agg(F.count("*").alias("n"))
    return _row(per, "stratigraphic", "CRITICAL", F.col("component"), F.lit(None), F.lit(None), F.col("n"), True)


def interpretive(evidence: DataFrame) -> DataFrame:
    """Physical entities with both supporting and contradicting evidence, with the first claim of each side."""
    first = lambda kind: F.min(F.when(F.col("evidence_type") == kind, F.struct("id", "claim_id")))["claim_id"]
    per = evidence.groupBy("physical_entity_type", "physical_entity_id").agg(first("supporting").alias("s"), first("contradicting").alias("c"), F.count("*").alias("n")).where("s is not null and c is not null")
    return _row(per, "interpretive", "MEDIUM", F.concat_ws(":", "physical_entity_type", "physical_entity_id"), F.col("s"), F.col("c"), F.col("n"), False)


def simultaneity(claims: DataFrame) -> DataFrame:
    return _row(claims.where(claims_simultaneity()), "cross_site", "MEDIUM", F.col("id"), F.col("id"), F.lit(None), F.lit(1), False)


def candidate_pairs(claims: DataFrame) -> DataFrame:
    """(a, b, entity), once per pair: claims that share a site or stratum, with the smallest entity that they share.

    Every pair is a row, so an entity with very many claims makes very many; Spark splits its partition.  A claim brings all its entities to each of them,
    so a pair is made at its smallest one only, and pairs are not moved."""
    at = lambda c, kind: members(claims, c, "e").select("id", F.concat(F.lit(f"{kind}:"), F.col("e")).alias("entity"))
    own = at("site_ids", "site").unionByName(at("strata_ids", "stratum")).groupBy("id").agg(F.collect_set("entity").alias("own"))
    rows = own.select("id", "own", F.explode("own").alias("entity"))
    a, b = rows.alias("a"), rows.alias("b")
    first = F.array_min(F.array_intersect("a.own", "b.own")) == F.col("a.entity")
    pairs = a.join(b, (F.col("a.entity") == F.col("b.entity")) & (F.col("a.id") < F.col("b.id")) & first)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.entity").alias("entity"))


def labelled_conflicts(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose given relation contains CONTRADICT."""
    found = pairs.join(labels, ["a", "b"]).where(F.upper("relation").contains("CONTRADICT"))
    return _row(found, "semantic", "MEDIUM", F.col("entity"), F.col("a"), F.col("b"), F.lit(2), False)


def conflicts(claims: DataFrame, evidence: DataFrame, strata: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """All families in fixed order (family 1 to 6)."""
    parts = [chronological(claims), measurements(claims), stratigraphic(strata), interpretive(evidence), simultaneity(claims)]
    if labels is not None:
        parts.append(labelled_conflicts(candidate_pairs(claims), labels))
    return reduce(DataFrame.unionByName, [p.withColumn("family", F.lit(i)) for i, p in enumerate(parts, 1)])


# audit -----------------------------------------------------------------------
def audit_flags(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    s, c = F.col("n_supporting") > 0, F.col("n_contradicting") > 0
    return claim_flags(claims, evidence).withColumns({
        "chapter": or_label(F.col("chapter"), "Unassigned Chapter"), "verified": F.col("status") == "Verified", "unsupported": ~s & ~c & ~F.col("anomaly_flag"),
        "contradicted": c, "anomaly": F.col("anomaly_flag") & (F.col("verification_status") != "VERIFIED"),
    })


def _counts() -> list[Column]:
    n = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    return [F.count("*").alias("n_claims"), n("verified"), F.count_if(~F.col("verified")).alias("n_contested"), n("unsupported"), n("contradicted"), n("anomaly")]


def chapter_audit(flags: DataFrame) -> DataFrame:
    score = F.greatest(F.lit(20), 100 - 15 * F.col("n_unsupported") - 20 * F.col("n_contradicted") - 10 * F.col("n_anomaly"))
    a = flags.groupBy("chapter").agg(*_counts()).withColumn("score", score)
    return a.withColumn("readiness", F.when(F.col("score") < 60, "HIGH_RISK").when(F.col("score") < 85, "NEEDS_REVISION").otherwise("DEFENSE_READY"))


def readiness(flags: DataFrame, n_conflicts: DataFrame) -> DataFrame:
    """One row; n_conflicts holds one number n."""
    a = flags.agg(*_counts()).join(F.broadcast(n_conflicts.select(F.col("n").alias("n_conflicts"))))
    score = F.greatest(F.lit(15), 100 - 10 * F.col("n_unsupported") - 15 * F.col("n_conflicts") - 8 * F.col("n_anomaly") - 12 * F.col("n_contradicted"))
    a = a.withColumn("score", F.when(F.col("n_claims") == 0, 100).otherwise(score).cast("long"))
    return a.withColumn("verdict", F.when(F.col("score") < 50, "CRITICAL_DEFENSE_RISK").when(F.col("score") < 75, "VULNERABLE_TO_EXAMINATION").when(F.col("score") < 90, "SATISFACTORY_WITH_MINOR_REVISIONS").otherwise("DEFENSE_READY"))


def findings(flags: DataFrame) -> DataFrame:
    """(priority, kind, chapter, claim_id, excerpt), most urgent first."""
    make = lambda df, priority, kind: df.select(priority.alias("priority"), F.lit(kind).alias("kind"), "chapter", F.col("id").alias("claim_id"), shortened(F.col("claim_text"), 60).alias("excerpt"))
    rows = [make(flags.where("anomaly"), F.lit("HIGH"), "ocr_anomaly"), make(flags.where("unsupported"), F.lit("MEDIUM"), "unsupported"), make(flags.where("contradicted"), F.when(F.col("n_contradicting") >= 2, "CRITICAL").otherwise("HIGH"), "contradicted")]
    rank = F.when(F.col("priority") == "CRITICAL", 0).when(F.col("priority") == "HIGH", 1).otherwise(2)
    return reduce(DataFrame.unionByName, rows).orderBy(rank, "chapter", "claim_id")


def affected_chapters(flags: DataFrame, found: DataFrame) -> DataFrame:
    """Chapters of claims that are flagged in any way or named by a conflict, as its flagged claim or as either side."""
    named = reduce(DataFrame.union, [found.select(F.col(c).alias("id")) for c in ("flagged_claim", "claim_a", "claim_b")]).where("id is not null").distinct()
    own = flags.where("anomaly or unsupported or contradicted").select("chapter")
    return own.union(flags.join(named, "id", "left_semi").select("chapter")).distinct()


def entity_mentions(flags: DataFrame, names: DataFrame) -> DataFrame:
    """(chapter, name): conflict names that occur in a claim's text, case not counted; any number of names."""
    folded = names.select("name", F.lower("name").alias("term"))
    hits = contained_terms(flags.select("chapter", F.lower("claim_text").alias("text")), folded, "chapter", "text").select("chapter", "term").distinct()
    return hits.join(folded, "term").select("chapter", "name").distinct()


def alerts(found: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(severity, kind, subject): conflicts, claims that wait for review, sources whose dates disagree."""
    a = found.select("severity", F.concat(F.lit("conflict_"), F.col("kind")).alias("kind"), F.col("entity").alias("subject"))
    b = claims.where(is_pending()).select(F.lit("HIGH"), F.lit("unverified_scan"), F.col("id").cast("string"))
    c = date_disagreement(evidence).select(F.lit("MEDIUM"), F.lit("date_disagreement"), F.col("source_id").cast("string"))
    return a.union(b).union(c)


def dashboard(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every section of the report; conflicts are found once."""
    found = stored(conflicts(t["claims"], t["evidence"], t["strata"]))
    flags = audit_flags(t["claims"], t["evidence"])
    total = found.agg(F.count("*").alias("n"))
    return {
        "summary": summary_counts({k: t[k] for k in ("sites", "strata", "artifacts", "samples", "claims", "evidence", "sources")}),
        "claims": claims_breakdown(t["claims"], t["evidence"]), "coverage": coverage(t["sites"], t["artifacts"]), "sources": source_counts(t["sources"]),
        "gaps": research_gaps(t["claims"], t["evidence"], t["sources"], t["sites"], t["strata"]), "alerts": alerts(found, t["claims"], t["evidence"]),
        "conflicts": found, "chapters": chapter_audit(flags), "readiness": readiness(flags, total), "findings": findings(flags), "affected": affected_chapters(flags, found),
    }


# queries ---------------------------------------------------------------------
def _pair_sql(kind: str, lists: str, where: str) -> str:
    return f"""SELECT '{kind}' AS kind, CASE WHEN f IS NULL THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CAST(e AS STRING) AS entity, wa AS authority_a, a AS claim_a, wb AS authority_b, b AS claim_b, CAST(n AS BIGINT) AS n_claims, f AS flagged_claim FROM (
      SELECT e, count(*) AS n, min(id) FILTER (WHERE anomaly_flag AND verification_status <> 'VERIFIED') AS f, min(id) FILTER (WHERE r = 1) AS a, min(id) FILTER (WHERE r = 2) AS b, min(w) FILTER (WHERE r = 1) AS wa, min(w) FILTER (WHERE r = 2) AS wb FROM (
        SELECT *, coalesce(nullif(scholar_name, ''), CAST(source_id AS STRING)) AS w, row_number() OVER (PARTITION BY e ORDER BY id) AS r FROM (SELECT DISTINCT c.id, scholar_name, source_id, anomaly_flag, verification_status, CAST(e AS BIGINT) AS e FROM (SELECT *, unnest(string_split({lists}, ',')) AS e FROM {{claims}} WHERE {where}) c) x) y GROUP BY e) z WHERE b IS NOT NULL"""


_K1 = _pair_sql("chronological", "site_ids", "topic = 'Chronology' OR contains(claim_text, 'BCE') OR contains(claim_text, 'CE') OR is_quantitative")
_K2 = _pair_sql("measurement", "strata_ids", "topic IN ('Stratigraphy', 'Measurement') OR contains(claim_text, ' cm') OR contains(claim_text, ' m.') OR contains(claim_text, 'thick')")
_PAIR = ("kind", "severity", "entity", "authority_a", "claim_a", "authority_b", "claim_b", "n_claims", "flagged_claim")


@operator("k1_w1_w2_chronological", with_views(_K1))
def _k1(spark, d):
    return chronological(load(spark, d, "claims")).select(*_PAIR)


@operator("k2_measurements", with_views(_K2))
def _k2(spark, d):
    return measurements(load(spark, d, "claims")).select(*_PAIR)


_K4 = "SELECT entity, arg_min(claim_id, id) FILTER (WHERE evidence_type = 'supporting') AS claim_a, arg_min(claim_id, id) FILTER (WHERE evidence_type = 'contradicting') AS claim_b, CAST(count(*) AS BIGINT) AS n_claims FROM (SELECT *, physical_entity_type || ':' || CAST(physical_entity_id AS STRING) AS entity FROM {evidence}) e GROUP BY 1 HAVING count(*) FILTER (WHERE evidence_type = 'supporting') > 0 AND count(*) FILTER (WHERE evidence_type = 'contradicting') > 0"


@operator("k4_w3_interpretive", with_views(_K4))
def _k4(spark, d):
    return interpretive(load(spark, d, "evidence")).select("entity", "claim_a", "claim_b", "n_claims")


@operator("k5_simultaneity", with_views("SELECT id AS claim_a, CAST(id AS STRING) AS entity FROM {claims} WHERE contains(lower(claim_text), 'simultaneous') AND (contains(lower(claim_text), 'collapse') OR contains(lower(claim_text), 'destruction'))"))
def _k5(spark, d):
    return simultaneity(load(spark, d, "claims")).select("claim_a", "entity")


_K6 = "WITH r AS (SELECT DISTINCT id, 'site:' || u AS e FROM (SELECT id, unnest(string_split(site_ids, ',')) AS u FROM {claims}) a UNION ALL SELECT id, 'stratum:' || strata_ids FROM {claims}) SELECT x.id AS a, y.id AS b, min(x.e) AS entity FROM r x JOIN r y ON x.e = y.e AND x.id < y.id GROUP BY 1, 2"


@operator("k6_j23_candidate_pairs", with_views(_K6))
def _k6(spark, d):
    return candidate_pairs(load(spark, d, "claims"))


@operator("k6_labelled_conflicts", with_views("SELECT 'semantic' AS kind, 'MEDIUM' AS severity, entity, a AS claim_a, b AS claim_b FROM (" + _K6 + ") p WHERE (a + b) % 3 = 0"))
def _k6b(spark, d):
    pairs = stored(candidate_pairs(load(spark, d, "claims")))
    given = pairs.select("a", "b", F.when((F.col("a") + F.col("b")) % 3 == 0, "Contradicts").otherwise("Agrees").alias("relation"))
    return labelled_conflicts(pairs, given).select("kind", "severity", "entity", "claim_a", "claim_b")


_AF = """af AS (SELECT c.id, claim_text, CASE WHEN trim(chapter) = '' THEN 'Unassigned Chapter' ELSE chapter END AS chapter, status = 'Verified' AS verified, coalesce(s, 0) = 0 AND coalesce(k, 0) = 0 AND NOT anomaly_flag AS unsupported, coalesce(k, 0) > 0 AS contradicted, anomaly_flag AND verification_status <> 'VERIFIED' AS anomaly, coalesce(k, 0) AS k
  FROM {claims} c LEFT JOIN (SELECT claim_id, count(*) FILTER (WHERE evidence_type = 'supporting') AS s, count(*) FILTER (WHERE evidence_type = 'contradicting') AS k FROM {evidence} GROUP BY 1) e ON c.id = e.claim_id)"""
_CNT = "CAST(count(*) AS BIGINT) AS n_claims, CAST(count(*) FILTER (WHERE verified) AS BIGINT) AS n_verified, CAST(count(*) FILTER (WHERE NOT verified) AS BIGINT) AS n_contested, CAST(count(*) FILTER (WHERE unsupported) AS BIGINT) AS n_unsupported, CAST(count(*) FILTER (WHERE contradicted) AS BIGINT) AS n_contradicted, CAST(count(*) FILTER (WHERE anomaly) AS BIGINT) AS n_anomaly"


@operator("a10_claim_evidence_counts", with_views("SELECT c.id, CAST(coalesce(s, 0) AS BIGINT) AS n_supporting, CAST(coalesce(k, 0) AS BIGINT) AS n_contradicting FROM {claims} c LEFT JOIN (SELECT claim_id, count(*) FILTER (WHERE evidence_type = 'supporting') AS s, count(*) FILTER (WHERE evidence_type = 'contradicting') AS k FROM {evidence} GROUP BY 1) e ON c.id = e.claim_id"))
def _a10(spark, d):
    return claim_flags(load(spark, d, "claims"), load(spark, d, "evidence")).select("id", "n_supporting", "n_contradicting")


@operator("a11_chapter_audit", with_views(f"WITH {_AF}, c AS (SELECT chapter, {_CNT} FROM af GROUP BY 1), s AS (SELECT *, greatest(20, 100 - 15 * n_unsupported - 20 * n_contradicted - 10 * n_anomaly) AS score FROM c) SELECT *, CASE WHEN score < 60 THEN 'HIGH_RISK' WHEN score < 85 THEN 'NEEDS_REVISION' ELSE 'DEFENSE_READY' END AS readiness FROM s"))
def _a11(spark, d):
    return chapter_audit(audit_flags(load(spark, d, "claims"), load(spark, d, "evidence")))


@operator("a12_readiness", with_views(f"WITH {_AF}, n AS (SELECT count(*) AS n FROM ({_K1}) k), c AS (SELECT {_CNT} FROM af), z AS (SELECT c.*, CAST(n AS BIGINT) AS n_conflicts, CAST(CASE WHEN n_claims = 0 THEN 100 ELSE greatest(15, 100 - 10 * n_unsupported - 15 * n - 8 * n_anomaly - 12 * n_contradicted) END AS BIGINT) AS score FROM c, n) SELECT *, CASE WHEN score < 50 THEN 'CRITICAL_DEFENSE_RISK' WHEN score < 75 THEN 'VULNERABLE_TO_EXAMINATION' WHEN score < 90 THEN 'SATISFACTORY_WITH_MINOR_REVISIONS' ELSE 'DEFENSE_READY' END AS verdict FROM z"))
def _a12(spark, d):
    claims = load(spark, d, "claims")
    return readiness(audit_flags(claims, load(spark, d, "evidence")), chronological(claims).agg(F.count("*").alias("n")))


@operator("k8_w11_findings", with_views(f"WITH {_AF}, f AS (SELECT 'HIGH' AS priority, 'ocr_anomaly' AS kind, * FROM af WHERE anomaly UNION ALL SELECT 'MEDIUM', 'unsupported', * FROM af WHERE unsupported UNION ALL SELECT CASE WHEN k >= 2 THEN 'CRITICAL' ELSE 'HIGH' END, 'contradicted', * FROM af WHERE contradicted) SELECT priority, kind, chapter, id AS claim_id, CASE WHEN length(claim_text) > 60 THEN substr(claim_text, 1, 57) || '...' ELSE claim_text END AS excerpt FROM f"))
def _k8(spark, d):
    return findings(audit_flags(load(spark, d, "claims"), load(spark, d, "evidence")))


@operator("u7_j21_affected_chapters", with_views(f"WITH {_AF}, k AS ({_K1}), nm AS (SELECT flagged_claim AS id FROM k UNION SELECT claim_a FROM k UNION SELECT claim_b FROM k) SELECT DISTINCT chapter FROM af WHERE anomaly OR unsupported OR contradicted OR id IN (SELECT id FROM nm WHERE id IS NOT NULL)"))
def _u7(spark, d):
    claims = load(spark, d, "claims")
    return affected_chapters(audit_flags(claims, load(spark, d, "evidence")), chronological(claims))


@operator("j20_entity_mentions", with_views(f"WITH {_AF} SELECT DISTINCT chapter, r_name AS name FROM af JOIN (SELECT 'ash at ' || substr(o_orderpriority, 3, 40) AS r_name FROM orders GROUP BY 1) n ON contains(lower(claim_text), lower(r_name))"))
def _j20(spark, d):
    names = load(spark, d, "orders").select(F.concat(F.lit("ash at "), F.substring("o_orderpriority", 3, 40)).alias("name")).distinct()
    return entity_mentions(audit_flags(load(spark, d, "claims"), load(spark, d, "evidence")), names)


@operator("k10_u2_alerts", with_views(f"SELECT severity, 'conflict_' || kind AS kind, entity AS subject FROM ({_K1}) a UNION ALL SELECT severity, 'conflict_' || kind, entity FROM ({_K2}) b UNION ALL SELECT 'MEDIUM', 'conflict_interpretive', entity FROM ({_K4}) c UNION ALL SELECT 'HIGH', 'unverified_scan', CAST(id AS STRING) FROM {{claims}} WHERE verification_status = 'PENDING_VERIFICATION' OR anomaly_flag UNION ALL SELECT 'MEDIUM', 'date_disagreement', source_ids FROM {{evidence}} WHERE date_info <> '' GROUP BY 3 HAVING count(DISTINCT date_info) > 1"))
def _k10(spark, d):
    claims, evidence = load(spark, d, "claims"), load(spark, d, "evidence")
    found = chronological(claims).unionByName(measurements(claims)).unionByName(interpretive(evidence))
    return alerts(found, claims, evidence)


@operator("k7_u1_conflicts")
def _k7(spark, d):
    return conflicts(load(spark, d, "claims"), load(spark, d, "evidence"), load(spark, d, "strata"))


@operator("k11_dashboard")
def _k11(spark, d):
    sections = dashboard({n: load(spark, d, n) for n in ("sites", "strata", "artifacts", "samples", "claims", "evidence", "sources")})
    rows = [df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row")) for name, df in sections.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("section").agg(F.count("*").alias("n_rows"))
