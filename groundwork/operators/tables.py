"""Lookups, filters, joins and coverage reports over the field-research tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.scalars import density_label, first_named, or_label, shortened
from groundwork.registry import operator
from groundwork.views import load, with_views


# scans -----------------------------------------------------------------------
def of_project(df: DataFrame, project: str = "") -> DataFrame:
    """The rows of a project; all rows for the empty name.  On a table partitioned by project_id only its folder is read."""
    return df.where(F.col("project_id") == project) if project else df


def review_queue(items: DataFrame, project: str = "", source: int | None = None) -> DataFrame:
    items = of_project(items, project)
    return items if source is None else items.where(F.col("source_id") == source)


def by_id(df: DataFrame, id) -> DataFrame:
    """One row by its key; pushed to the scan."""
    return df.where(F.col("id") == id)


def upserted(base: DataFrame, delta: DataFrame, order: str, keys: tuple[str, ...] = ("project_id", "id")) -> DataFrame:
    """base with the rows of delta put in by key; the row of highest `order` wins, and delta wins over base."""
    both = base.withColumns({"__o": F.lit(None).cast("long"), "__d": F.lit(0)}).unionByName(delta.withColumn("__o", F.col(order).cast("long")).withColumn("__d", F.lit(1)).drop(*[order] if order not in base.columns else []))
    last = Window.partitionBy(*keys).orderBy(F.desc("__d"), F.desc("__o"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__o", "__d")


def without_keys(base: DataFrame, gone: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


# predicates ------------------------------------------------------------------
def bears_date(c: DataFrame | None = None) -> Column:
    return (F.col("topic") == "Chronology") | F.col("claim_text").contains("BCE") | F.col("claim_text").contains("CE") | F.col("is_quantitative")


def is_measurement() -> Column:
    text = F.col("claim_text")
    return F.col("topic").isin("Stratigraphy", "Measurement") | text.contains(" cm") | text.contains(" m.") | text.contains("thick")


def claims_simultaneity() -> Column:
    text = F.lower("claim_text")
    return text.contains("simultaneous") & (text.contains("collapse") | text.contains("destruction"))


def is_pending() -> Column:
    return (F.col("verification_status") == "PENDING_VERIFICATION") | F.col("anomaly_flag")


def of_places(claims: DataFrame, site: int | None = None, stratum: int | None = None) -> DataFrame:
    if site is not None:
        claims = claims.where(F.array_contains("site_ids", F.lit(site)))
    return claims if stratum is None else claims.where(F.array_contains("strata_ids", F.lit(stratum)))


def between_depths(catalog: DataFrame, low: int = 290, high: int = 450, score: int = 85) -> DataFrame:
    return catalog.where(F.col("depth_cm").between(low, high) & (F.col("preservation_score") > score))


def needs_care(catalog: DataFrame, score: int = 80) -> DataFrame:
    return catalog.where((F.col("preservation_score") < score) | (F.col("conservation_status") == "Needs Conservation"))


# joins -----------------------------------------------------------------------
def members(df: DataFrame, lists: str, to: str) -> DataFrame:
    """df with a row per different element of a list column."""
    return df.withColumn(to, F.explode(F.array_distinct(lists)))


def claims_by_site(sites: DataFrame, claims: DataFrame) -> DataFrame:
    return members(claims, "site_ids", "site_id").join(sites.select(F.col("id").alias("site_id")), "site_id").select("site_id", F.col("id").alias("claim_id"))


def claims_by_stratum(strata: DataFrame, claims: DataFrame) -> DataFrame:
    return members(claims, "strata_ids", "stratum_id").join(strata.select(F.col("id").alias("stratum_id")), "stratum_id").select("stratum_id", F.col("id").alias("claim_id"))


def children(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, id): rows under the parent that they name: strata of a site, artifacts or samples of a stratum, evidence of a claim, claims of a source."""
    return rows.select(key, "id").join(parents.select(F.col("id").alias(key)), key)


def star(sites: DataFrame, strata: DataFrame, artifacts: DataFrame, samples: DataFrame, claims: DataFrame) -> DataFrame:
    """Around each site: its strata, what lies in them and its claims, as sorted lists."""
    s = strata.select(F.col("id").alias("stratum_id"), "site_id")
    branch = lambda df, name: df.groupBy("site_id").agg(F.array_sort(F.collect_list("id")).alias(name))
    parts = [
        branch(s.withColumnRenamed("stratum_id", "id"), "strata"),
        branch(artifacts.select("id", "stratum_id").join(s, "stratum_id"), "artifacts"),
        branch(samples.select("id", "stratum_id").join(s, "stratum_id"), "samples"),
        branch(members(claims, "site_ids", "site_id"), "claims"),
    ]
    out = sites.select(F.col("id").alias("site_id"))
    for p in parts:
        out = out.join(p, "site_id", "left")
    return out.select("site_id", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("strata", "artifacts", "samples", "claims")])


def grounded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with supporting evidence."""
    return claims.join(evidence.where("evidence_type = 'supporting'").select(F.col("claim_id").alias("id")), "id", "left_semi")


def ungrounded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    return claims.join(evidence.where("evidence_type = 'supporting'").select(F.col("claim_id").alias("id")), "id", "left_anti")


def unsupported(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with no evidence row of any type."""
    return claims.join(evidence.select(F.col("claim_id").alias("id")), "id", "left_anti")


def unstratified(sites: DataFrame, strata: DataFrame) -> DataFrame:
    return sites.join(strata.select(F.col("site_id").alias("id")), "id", "left_anti")


# aggregates ------------------------------------------------------------------
def claim_flags(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims with n_supporting and n_contradicting."""
    n = evidence.groupBy("claim_id").agg(F.count_if(F.col("evidence_type") == "supporting").alias("n_supporting"), F.count_if(F.col("evidence_type") == "contradicting").alias("n_contradicting"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return claims.join(n, claims["id"] == n["claim_id"], "left").select(claims["*"], zero("n_supporting"), zero("n_contradicting"))


def summary_counts(tables: dict[str, DataFrame], contradictions: DataFrame | None = None) -> DataFrame:
    """(project_id, measure, n): how many rows each table has, and the claims that wait or lack ground."""
    claims = tables["claims"]
    frames = [df.groupBy("project_id").count().select("project_id", F.lit(name).alias("measure"), F.col("count").alias("n")) for name, df in tables.items()]
    count = lambda df, name: df.groupBy("project_id").count().select("project_id", F.lit(name).alias("measure"), F.col("count").alias("n"))
    frames += [count(claims.where(is_pending()), "pending"), count(ungrounded(claims, tables["evidence"]), "ungrounded")]
    if contradictions is not None:
        frames.append(count(contradictions, "contradictions"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def claims_breakdown(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per project: supported, contradicted (may overlap), neither, and percent supported (0 without claims)."""
    s, c = F.col("n_supporting") > 0, F.col("n_contradicting") > 0
    a = claim_flags(claims, evidence).groupBy("project_id").agg(F.count("*").alias("n_claims"), F.count_if(s).alias("n_supported"), F.count_if(c).alias("n_contradicted"), F.count_if(~s & ~c).alias("n_unsupported"))
    return a.withColumn("grounding_percent", F.when(F.col("n_claims") > 0, F.col("n_supported") * 100.0 / F.col("n_claims")).otherwise(0.0))


def coverage(sites: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Sites and artifacts per period, lined up, with a density label."""
    a = sites.groupBy(or_label(F.col("period"), "Unassigned Period").alias("period")).agg(F.count("*").alias("n_sites"))
    b = artifacts.groupBy(or_label(F.col("period"), "Unassigned Period").alias("period")).agg(F.count("*").alias("n_artifacts"))
    both = a.join(b, "period", "full_outer").select("period", F.coalesce("n_sites", F.lit(0)).alias("n_sites"), F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"))
    return both.withColumn("density", density_label(F.col("n_sites") + F.col("n_artifacts")))


def source_counts(sources: DataFrame) -> DataFrame:
    """(kind, label, n): sources by year, by type and by class, in one pass."""
    named = sources.select(or_label(F.col("year"), "Undated").alias("year"), or_label(F.col("source_type"), "Other").alias("type"), or_label(F.col("degradation_class"), "CLASS_B").alias("class"))
    sets = named.groupingSets([["year"], ["type"], ["class"]], "year", "type", "class").agg(F.count("*").alias("n"), F.grouping("year").alias("gy"), F.grouping("type").alias("gt"))
    kind = F.when(F.col("gy") == 0, "year").when(F.col("gt") == 0, "type").otherwise("class")
    return sets.select(kind.alias("kind"), F.coalesce("year", "type", "class").alias("label"), "n")


def sparse_topics(claims: DataFrame, sources: DataFrame, least_claims: int = 2, least_sources: int = 2) -> DataFrame:
    """Topics with enough claims in projects with too few sources."""
    per = claims.groupBy("project_id", or_label(F.col("topic"), "General").alias("topic")).agg(F.count("*").alias("n_claims")).where(F.col("n_claims") >= least_claims)
    n = sources.groupBy("project_id").agg(F.count("*").alias("n_sources"))
    return per.join(n, "project_id", "left").where(F.coalesce("n_sources", F.lit(0)) < least_sources).select("project_id", "topic", "n_claims")


def date_disagreement(evidence: DataFrame) -> DataFrame:
    """Sources whose evidence gives more than one date."""
    dates = members(evidence, "source_ids", "source_id").where("date_info <> ''").groupBy("source_id").agg(F.array_sort(F.collect_set("date_info")).alias("d"))
    return dates.where(F.size("d") > 1).select("source_id", F.size("d").cast("long").alias("n_dates"), F.array_join("d", ", ").alias("dates"))


def research_gaps(claims: DataFrame, evidence: DataFrame, sources: DataFrame, sites: DataFrame, strata: DataFrame) -> DataFrame:
    """(severity, kind, subject): claims without evidence, topics with few sources, sites without strata."""
    one = unsupported(claims, evidence).select(F.lit("HIGH").alias("severity"), F.lit("unsupported_claim").alias("kind"), shortened(F.col("claim_text"), 60).alias("subject"))
    two = sparse_topics(claims, sources).select(F.lit("MEDIUM"), F.lit("sparse_topic"), F.concat_ws(":", "project_id", "topic"))
    three = unstratified(sites, strata).select(F.lit("LOW"), F.lit("unstratified_site"), "site_name")
    return one.union(two).union(three)


def diversity(catalog: DataFrame) -> DataFrame:
    """Shannon-Wiener index over materials, in nats."""
    n = catalog.groupBy("material").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return n.join(F.broadcast(total)).agg(F.sum(-p * F.log(p)).alias("shannon"))


def accumulation(catalog: DataFrame) -> DataFrame:
    """Depth over years, in mm per year."""
    span = F.max("estimated_year") - F.min("estimated_year")
    return catalog.agg(F.when(span != 0, (F.max("depth_cm") - F.min("depth_cm")) * 10.0 / span).alias("mm_per_year"))


def authority_label(n: str) -> Column:
    return first_named(F.col("scholar_name"), F.col("source_id").cast("string"), F.lit(f"Authority {n}"))


# queries ---------------------------------------------------------------------
def _q(name: str, sql: str):
    return operator(name, with_views(sql))


@_q("s3_project_scan", "SELECT id, site_name, period FROM {sites} WHERE project_id = 'BUILDING'")
def _s3(spark, d):
    return of_project(load(spark, d, "sites"), "BUILDING").select("id", "site_name", "period")


@_q("s4_review_queue", "SELECT id, status FROM {verification_items} WHERE project_id = 'p1' AND source_id = 7")
def _s4(spark, d):
    return review_queue(load(spark, d, "verification_items"), "p1", 7).select("id", "status")


@_q("s5_point_lookup", "SELECT id, site_name, latitude FROM {sites} WHERE id = 42")
def _s5(spark, d):
    return by_id(load(spark, d, "sites"), 42).select("id", "site_name", "latitude")


@_q("s6_upsert", """SELECT id, CASE WHEN id % 5 = 0 THEN 'new-' || CAST(id * 2 + (CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END) AS STRING) ELSE title END AS title, project_id FROM {sources}""")
def _s6(spark, d):
    base = load(spark, d, "sources").select("id", "project_id", "title")
    some = base.where("id % 5 = 0")
    newer = some.select("id", "project_id", F.expr("'new-' || CAST(id * 2 AS STRING)").alias("title"), F.lit(1).alias("seq"))
    newest = some.where("id % 10 = 0").select("id", "project_id", F.expr("'new-' || CAST(id * 2 + 1 AS STRING)").alias("title"), F.lit(2).alias("seq"))
    return upserted(base, newer.unionByName(newest), "seq")


@_q("s7_delete", "SELECT id, artifact_name FROM {artifacts} WHERE id NOT IN (SELECT physical_entity_id FROM {evidence} WHERE evidence_type = 'contradicting')")
def _s7(spark, d):
    gone = load(spark, d, "evidence").where("evidence_type = 'contradicting'").select(F.col("physical_entity_id").alias("id"))
    return without_keys(load(spark, d, "artifacts"), gone).select("id", "artifact_name")


@_q("p2_p5_claim_predicates", """SELECT CAST(count(*) FILTER (WHERE topic = 'Chronology' OR contains(claim_text, 'BCE') OR contains(claim_text, 'CE') OR is_quantitative) AS BIGINT) AS n_dated,
    CAST(count(*) FILTER (WHERE topic IN ('Stratigraphy', 'Measurement') OR contains(claim_text, ' cm') OR contains(claim_text, ' m.') OR contains(claim_text, 'thick')) AS BIGINT) AS n_measured,
    CAST(count(*) FILTER (WHERE contains(lower(claim_text), 'simultaneous') AND (contains(lower(claim_text), 'collapse') OR contains(lower(claim_text), 'destruction'))) AS BIGINT) AS n_simultaneous,
    CAST(count(*) FILTER (WHERE verification_status = 'PENDING_VERIFICATION' OR anomaly_flag) AS BIGINT) AS n_pending FROM {claims}""")
def _p2(spark, d):
    c = load(spark, d, "claims")
    return c.agg(F.count_if(bears_date()).alias("n_dated"), F.count_if(is_measurement()).alias("n_measured"), F.count_if(claims_simultaneity()).alias("n_simultaneous"), F.count_if(is_pending()).alias("n_pending"))


@_q("p7_membership_filter", "SELECT id, topic FROM {claims} WHERE list_contains(string_split(site_ids, ','), '7')")
def _p7(spark, d):
    return of_places(load(spark, d, "claims"), site=7).select("id", "topic")


@_q("p8_depth_filter", "SELECT period_phase, CAST(count(*) AS BIGINT) AS n FROM {catalog} WHERE depth_cm BETWEEN 290 AND 450 AND preservation_score > 85 GROUP BY 1")
def _p8(spark, d):
    return between_depths(load(spark, d, "catalog")).groupBy("period_phase").agg(F.count("*").alias("n"))


@_q("p9_triage", "SELECT artifact_id, preservation_score FROM {catalog} WHERE preservation_score < 80 OR conservation_status = 'Needs Conservation'")
def _p9(spark, d):
    return needs_care(load(spark, d, "catalog")).select("artifact_id", "preservation_score").orderBy("preservation_score", "artifact_id")


@_q("p10_p12_labels", """SELECT id, CASE WHEN trim(chapter) = '' THEN 'Unassigned Chapter' ELSE chapter END AS chapter,
    coalesce(nullif(scholar_name, ''), nullif(CAST(source_id AS STRING), ''), 'Authority A') AS authority,
    CASE WHEN length(claim_text) > 50 THEN substr(claim_text, 1, 47) || '...' ELSE claim_text END AS label FROM {claims}""")
def _p10(spark, d):
    return load(spark, d, "claims").select("id", or_label(F.col("chapter"), "Unassigned Chapter").alias("chapter"), authority_label("A").alias("authority"), shortened(F.col("claim_text")).alias("label"))


@_q("j1_claims_by_site", "SELECT DISTINCT CAST(u AS BIGINT) AS site_id, id AS claim_id FROM (SELECT id, unnest(string_split(site_ids, ',')) AS u FROM {claims}) t WHERE CAST(u AS BIGINT) IN (SELECT id FROM {sites})")
def _j1(spark, d):
    return claims_by_site(load(spark, d, "sites"), load(spark, d, "claims"))


@_q("j2_claims_by_stratum", "SELECT CAST(strata_ids AS BIGINT) AS stratum_id, id AS claim_id FROM {claims} WHERE CAST(strata_ids AS BIGINT) IN (SELECT id FROM {strata})")
def _j2(spark, d):
    return claims_by_stratum(load(spark, d, "strata"), load(spark, d, "claims"))


_CHILDREN = {"j3_strata_by_site": ("sites", "strata", "site_id"), "j4_artifacts_by_stratum": ("strata", "artifacts", "stratum_id"), "j5_samples_by_stratum": ("strata", "samples", "stratum_id"), "j6_evidence_by_claim": ("claims", "evidence", "claim_id"), "j7_claims_by_source": ("sources", "claims", "source_id")}
for _name, (_up, _down, _key) in _CHILDREN.items():
    _q(_name, f"SELECT c.{_key}, c.id FROM {{{_down}}} c JOIN {{{_up}}} p ON c.{_key} = p.id")(lambda spark, d, u=_up, r=_down, k=_key: children(load(spark, d, u), load(spark, d, r), k))


@_q("j8_star_lookup", """WITH s AS (SELECT site_id, count(*) AS n, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids FROM {strata} GROUP BY 1),
    a AS (SELECT site_id, count(*) AS n FROM {artifacts} x JOIN {strata} t ON x.stratum_id = t.id GROUP BY 1), m AS (SELECT site_id, count(*) AS n FROM {samples} x JOIN {strata} t ON x.stratum_id = t.id GROUP BY 1),
    c AS (SELECT CAST(u AS BIGINT) AS site_id, count(DISTINCT id) AS n FROM (SELECT id, unnest(string_split(site_ids, ',')) AS u FROM {claims}) z GROUP BY 1)
    SELECT i.id AS site_id, coalesce(s.ids, '') AS strata, CAST(coalesce(a.n, 0) AS BIGINT) AS n_artifacts, CAST(coalesce(m.n, 0) AS BIGINT) AS n_samples, CAST(coalesce(c.n, 0) AS BIGINT) AS n_claims
    FROM {sites} i LEFT JOIN s ON i.id = s.site_id LEFT JOIN a ON i.id = a.site_id LEFT JOIN m ON i.id = m.site_id LEFT JOIN c ON i.id = c.site_id""")
def _j8(spark, d):
    n = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return star(*[load(spark, d, t) for t in ("sites", "strata", "artifacts", "samples", "claims")]).select("site_id", F.array_join("strata", ",").alias("strata"), n("artifacts"), n("samples"), n("claims"))


@_q("j9_ungrounded_claims", "SELECT id FROM {claims} WHERE id NOT IN (SELECT claim_id FROM {evidence} WHERE evidence_type = 'supporting')")
def _j9(spark, d):
    return ungrounded(load(spark, d, "claims"), load(spark, d, "evidence")).select("id")


@_q("j9_grounded_claims", "SELECT id FROM {claims} WHERE id IN (SELECT claim_id FROM {evidence} WHERE evidence_type = 'supporting')")
def _j9b(spark, d):
    return grounded(load(spark, d, "claims"), load(spark, d, "evidence")).select("id")


@_q("j10_unsupported_claims", "SELECT id FROM {claims} WHERE id NOT IN (SELECT claim_id FROM {evidence})")
def _j10(spark, d):
    return unsupported(load(spark, d, "claims"), load(spark, d, "evidence")).select("id")


@_q("j11_unstratified_sites", "SELECT id FROM {sites} WHERE id NOT IN (SELECT site_id FROM {strata})")
def _j11(spark, d):
    return unstratified(load(spark, d, "sites"), load(spark, d, "strata")).select("id")


@_q("a1_summary_counts", "\nUNION ALL ".join(f"SELECT project_id, '{t}' AS measure, CAST(count(*) AS BIGINT) AS n FROM {{{t}}} GROUP BY 1" for t in ("sites", "strata", "artifacts", "samples", "claims", "evidence", "sources")) + """
    UNION ALL SELECT project_id, 'pending', CAST(count(*) AS BIGINT) FROM {claims} WHERE verification_status = 'PENDING_VERIFICATION' OR anomaly_flag GROUP BY 1
    UNION ALL SELECT project_id, 'ungrounded', CAST(count(*) AS BIGINT) FROM {claims} WHERE id NOT IN (SELECT claim_id FROM {evidence} WHERE evidence_type = 'supporting') GROUP BY 1""")
def _a1(spark, d):
    return summary_counts({t: load(spark, d, t) for t in ("sites", "strata", "artifacts", "samples", "claims", "evidence", "sources")})


_FLAGS = "f AS (SELECT c.*, coalesce(e.s, 0) AS s, coalesce(e.k, 0) AS k FROM {claims} c LEFT JOIN (SELECT claim_id, count(*) FILTER (WHERE evidence_type = 'supporting') AS s, count(*) FILTER (WHERE evidence_type = 'contradicting') AS k FROM {evidence} GROUP BY 1) e ON c.id = e.claim_id)"


@_q("a2_claims_breakdown", f"""WITH {_FLAGS} SELECT project_id, CAST(count(*) AS BIGINT) AS n_claims, CAST(count(*) FILTER (WHERE s > 0) AS BIGINT) AS n_supported, CAST(count(*) FILTER (WHERE k > 0) AS BIGINT) AS n_contradicted,
    CAST(count(*) FILTER (WHERE s = 0 AND k = 0) AS BIGINT) AS n_unsupported, round(count(*) FILTER (WHERE s > 0) * CAST(100 AS DOUBLE) / count(*), 6) AS grounding_percent FROM f GROUP BY 1""")
def _a2(spark, d):
    return claims_breakdown(load(spark, d, "claims"), load(spark, d, "evidence")).withColumn("grounding_percent", F.round("grounding_percent", 6))


@_q("a3_coverage", """WITH a AS (SELECT CASE WHEN trim(period) = '' THEN 'Unassigned Period' ELSE period END AS period, count(*) AS n FROM {sites} GROUP BY 1),
    b AS (SELECT CASE WHEN trim(period) = '' THEN 'Unassigned Period' ELSE period END AS period, count(*) AS n FROM {artifacts} GROUP BY 1)
    SELECT coalesce(a.period, b.period) AS period, CAST(coalesce(a.n, 0) AS BIGINT) AS n_sites, CAST(coalesce(b.n, 0) AS BIGINT) AS n_artifacts,
    CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) >= 5 THEN 'High Density' WHEN coalesce(a.n, 0) + coalesce(b.n, 0) >= 2 THEN 'Moderate' ELSE 'Sparse' END AS density FROM a FULL OUTER JOIN b ON a.period = b.period""")
def _a3(spark, d):
    return coverage(load(spark, d, "sites"), load(spark, d, "artifacts"))


@_q("a4_source_counts", """SELECT 'year' AS kind, CASE WHEN year = '' THEN 'Undated' ELSE year END AS label, CAST(count(*) AS BIGINT) AS n FROM {sources} GROUP BY 2
    UNION ALL SELECT 'type', CASE WHEN source_type = '' THEN 'Other' ELSE source_type END, CAST(count(*) AS BIGINT) FROM {sources} GROUP BY 2
    UNION ALL SELECT 'class', CASE WHEN degradation_class = '' THEN 'CLASS_B' ELSE degradation_class END, CAST(count(*) AS BIGINT) FROM {sources} GROUP BY 2""")
def _a4(spark, d):
    return source_counts(load(spark, d, "sources"))


@_q("a5_sparse_topics", """SELECT c.project_id, topic, CAST(c.n AS BIGINT) AS n_claims FROM (SELECT project_id, CASE WHEN topic = '' THEN 'General' ELSE topic END AS topic, count(*) AS n FROM {claims} GROUP BY 1, 2) c
    LEFT JOIN (SELECT project_id, count(*) AS n FROM {sources} GROUP BY 1) s ON c.project_id = s.project_id WHERE c.n >= 2 AND coalesce(s.n, 0) < 2""")
def _a5(spark, d):
    return sparse_topics(load(spark, d, "claims"), load(spark, d, "sources"))


@_q("a6_date_disagreement", "SELECT CAST(source_ids AS BIGINT) AS source_id, CAST(count(DISTINCT date_info) AS BIGINT) AS n_dates, string_agg(DISTINCT date_info, ', ' ORDER BY date_info) AS dates FROM {evidence} WHERE date_info <> '' GROUP BY 1 HAVING count(DISTINCT date_info) > 1")
def _a6(spark, d):
    return date_disagreement(load(spark, d, "evidence"))


@_q("k9_research_gaps", """SELECT 'HIGH' AS severity, 'unsupported_claim' AS kind, CASE WHEN length(claim_text) > 60 THEN substr(claim_text, 1, 57) || '...' ELSE claim_text END AS subject FROM {claims} WHERE id NOT IN (SELECT claim_id FROM {evidence})
    UNION ALL SELECT 'MEDIUM', 'sparse_topic', c.project_id || ':' || topic FROM (SELECT project_id, CASE WHEN topic = '' THEN 'General' ELSE topic END AS topic, count(*) AS n FROM {claims} GROUP BY 1, 2) c
      LEFT JOIN (SELECT project_id, count(*) AS n FROM {sources} GROUP BY 1) s ON c.project_id = s.project_id WHERE c.n >= 2 AND coalesce(s.n, 0) < 2
    UNION ALL SELECT 'LOW', 'unstratified_site', site_name FROM {sites} WHERE id NOT IN (SELECT site_id FROM {strata})""")
def _k9(spark, d):
    t = lambda n: load(spark, d, n)
    return research_gaps(t("claims"), t("evidence"), t("sources"), t("sites"), t("strata"))


@_q("a18_diversity", "WITH n AS (SELECT material, CAST(count(*) AS DOUBLE) AS n FROM {catalog} GROUP BY 1) SELECT round(sum(-(n / t) * ln(n / t)), 6) AS shannon FROM n, (SELECT sum(n) AS t FROM n) z")
def _a18(spark, d):
    return diversity(load(spark, d, "catalog")).select(F.round("shannon", 6).alias("shannon"))


@_q("a19_accumulation", "SELECT round((max(depth_cm) - min(depth_cm)) * CAST(10 AS DOUBLE) / (max(estimated_year) - min(estimated_year)), 6) AS mm_per_year FROM {catalog}")
def _a19(spark, d):
    return accumulation(load(spark, d, "catalog")).select(F.round("mm_per_year", 6).alias("mm_per_year"))
