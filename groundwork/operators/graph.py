"""The evidence graph: typed nodes and edges, composition, paths and neighbourhoods.

A node's key is "type:id".  Traversals are frontier loops of joins; each frontier
is written out and only its emptiness is read by the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions.scalars import first_named, shortened
from groundwork.operators.tables import members
from groundwork.plans.scratch import small, stored
from groundwork.registry import operator
from groundwork.views import load, with_views

TABLES = ("sites", "strata", "artifacts", "samples", "claims", "evidence", "sources")

_TABLE = dict(zip(("site", "stratum", "artifact", "sample", "claim", "evidence", "source"), TABLES, strict=True))

#: Nodes of a task that counts degrees, about.
DEGREE_ROWS = 1_000_000
#: Paths of a front that may be broadcast.
FRONT = 50_000


def _key(kind: str, column: str = "id"):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(t: dict[str, DataFrame]) -> DataFrame:
    """(node, type, label)."""
    label = {"site": "site_name", "stratum": "stratum_name", "artifact": "artifact_name", "sample": "lab_code", "claim": "claim_text", "evidence": "evidence_text", "source": "title"}
    table = dict(zip(label, TABLES, strict=True))
    rows = [t[table[k]].select(_key(k).alias("node"), F.lit(k).alias("type"), shortened(first_named(F.col(c), F.col("id").cast("string"))).alias("label")) for k, c in label.items()]
    return reduce(DataFrame.unionByName, rows)


def _links(t: dict[str, DataFrame]) -> list[tuple[DataFrame, str, tuple[str, str], tuple[str, str], str]]:
    """(rows, type, source, target, other): the ends as (node type, column of the id), and the column of the end that is not the row itself."""
    strata, claims, evidence = t["strata"], t["claims"], t["evidence"]
    return [
        (strata, "CONTAINS", ("site", "site_id"), ("stratum", "id"), "site_id"),
        (t["artifacts"], "CONTAINS", ("stratum", "stratum_id"), ("artifact", "id"), "stratum_id"),
        (t["samples"], "CONTAINS", ("stratum", "stratum_id"), ("sample", "id"), "stratum_id"),
        (strata.withColumn("b", F.explode("harris_below")), "STRATIFIED_ABOVE", ("stratum", "id"), ("stratum", "b"), "b"),
        (evidence, "EVIDENCED_BY", ("claim", "claim_id"), ("evidence", "id"), "claim_id"),
        (claims, "CITES", ("claim", "id"), ("source", "source_id"), "source_id"),
        (members(evidence, "source_ids", "u"), "CITES", ("evidence", "id"), ("source", "u"), "u"),
        (members(claims, "site_ids", "u"), "REFERENCES", ("claim", "id"), ("site", "u"), "u"),
        (members(claims, "strata_ids", "u"), "REFERENCES", ("claim", "id"), ("stratum", "u"), "u"),
        *[(evidence.where(F.col("physical_entity_type") == k), "GROUNDED_IN", ("evidence", "id"), (k, "physical_entity_id"), "physical_entity_id") for k in _TABLE],
    ]


def edges(t: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """(source, target, type): ten kinds of links in nine families, repeats kept, edges to unknown nodes dropped.

    One end of a link is a row of the table that it comes from; only the other end is looked up, by its id, in the table of its type."""

    def make(df: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str], other: str) -> DataFrame:
        ends = df.select(F.col(source[1]).alias("s"), F.col(target[1]).alias("t"))
        far, table = ("s", source[0]) if source[1] == other else ("t", target[0])
        ends = ends.join(t[_TABLE[table]].select(F.col("id").alias(far)), far, "left_semi").where("s is not null and t is not null")
        return ends.select(_key(source[0], "s").alias("source"), _key(target[0], "t").alias("target"), F.lit(kind).alias("type"))

    return reduce(DataFrame.unionByName, [make(*link) for link in _links(t)])


def degrees(known: DataFrame, links: DataFrame) -> DataFrame:
    """(node, degree, in_degree, out_degree); repeated edges count again."""
    ends = links.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(links.select("target", F.lit(0), F.lit(1)))
    n = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return known.select("node").join(n, "node", "left").select("node", (z("o") + z("i")).alias("degree"), z("i").alias("in_degree"), z("o").alias("out_degree"))


def table_degrees(t: dict[str, DataFrame], part: int = DEGREE_ROWS) -> DataFrame:
    """degrees() of the nodes and edges of the tables, by type and id, without the edges as a table of names.

    The end of a link that many rows share is counted by its id first; what is left has a few rows a node and is dealt into as many parts as
    their number asks for, so a task holds about `part` nodes whatever the size of the tables."""
    kinds = {k: i for i, k in enumerate(_TABLE)}
    row = lambda kind, id, o, i, known: (F.lit(kinds[kind]).cast("tinyint").alias("kind"), F.col(id).cast("long").alias("id"), o.cast("long").alias("o"), i.cast("long").alias("i"), F.lit(known).alias("known"))
    none, one = F.lit(0), F.lit(1)
    rows = [t[name].select(*row(kind, "id", none, none, 1)) for kind, name in _TABLE.items()]
    for df, _, source, target, other in _links(t):
        ends = df.select(F.col(source[1]).alias("s"), F.col(target[1]).alias("t")).where("s is not null and t is not null")
        far, near = (("s", source[0]), ("t", target[0])) if source[1] == other else (("t", target[0]), ("s", source[0]))
        out = lambda end, n: (n, none) if end[0] == "s" else (none, n)
        own = ends.join(t[_TABLE[far[1]]].select(F.col("id").alias(far[0])), far[0], "left_semi")
        rows.append(own.select(*row(near[1], near[0], *out(near, one), 0)))
        rows.append(ends.groupBy(far[0]).agg(F.count("*").alias("n")).select(*row(far[1], far[0], *out(far, F.col("n")), 0)))  # unknown ones are dropped below
    parts = max(t["claims"].sparkSession.sparkContext.defaultParallelism, -(-sum(t[name].count() for name in _TABLE.values()) // part))
    n = reduce(DataFrame.unionByName, rows).repartition(parts, "kind", "id").groupBy("kind", "id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("known").alias("known"))
    each = n.where("known > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("known"))))
    name = F.element_at(F.array(*[F.lit(f"{k}:") for k in kinds]), F.col("kind") + 1)
    return each.select(F.concat(name, F.col("id").cast("string")).alias("node"), (F.col("o") + F.col("i")).alias("degree"), F.col("i").alias("in_degree"), F.col("o").alias("out_degree"))


def composition(known: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, type, n)."""
    a = known.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return a.unionByName(links.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def grounding(known: DataFrame, links: DataFrame) -> DataFrame:
    """Claims, grounded ones and their ratio (1 without claims)."""
    claims = known.where("type = 'claim'").select("node")
    backed = links.where("type = 'EVIDENCED_BY'").select(F.col("source").alias("node")).distinct().withColumn("g", F.lit(1))
    a = claims.join(backed, "node", "left").agg(F.count("*").alias("n_claims"), F.count("g").alias("n_grounded"))
    return a.withColumn("grounding_ratio", F.when(F.col("n_claims") == 0, 1.0).otherwise(F.col("n_grounded") / F.col("n_claims")))


def isolated_claims(known: DataFrame, links: DataFrame) -> DataFrame:
    backed = links.where("type = 'EVIDENCED_BY'").select(F.col("source").alias("node"))
    return known.where("type = 'claim'").select("node").join(backed, "node", "left_anti")


def hubs(degree: DataFrame, k: int = 5) -> DataFrame:
    """The k nodes of highest degree, of rows (node, degree)."""
    return degree.orderBy(F.desc("degree"), "node").limit(k)


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("source", "target").union(links.select("target", "source"))


def reached(links: DataFrame, start: DataFrame, hops: int | None = None, directed: bool = False, until: str | None = None) -> DataFrame:
    """(node, hops, path) of the nodes of start(node) and those within so many hops; of equally short paths the lexically first.

    Paths are carried as lists of nodes, one per node reached, so their number is that of the nodes.  The loop ends when nothing new is reached or,
    with until, once that node is."""
    step = links.select("source", "target") if directed else _both_ways(links)
    if hops is None:  # few hops read the links as they are, without a table of them
        step = stored(step.distinct())
    front = stored(start.select("node", F.lit(0).cast("long").alias("hops"), F.array("node").alias("path")))
    seen, n = front, 0
    while hops is None or n < hops:
        n += 1
        came = step.join(small(front.select(F.col("node").alias("source"), "path"), FRONT), "source").select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        front = stored(came.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti").select("node", F.lit(n).cast("long").alias("hops"), "path"))
        if not front.take(1):
            break
        seen = seen.unionByName(front)
        if until is not None and front.where(F.col("node") == until).take(1):
            break
    return seen


def shortest_path(links: DataFrame, known: DataFrame, source: str, target: str, directed: bool = False) -> DataFrame:
    """One row (found, length, path)."""
    seen = reached(links, known.where(F.col("node") == source), directed=directed, until=target).where(F.col("node") == target)
    return seen.groupBy().agg((F.count("*") > 0).alias("found"), F.max("hops").alias("length"), F.array_join(F.min("path"), " ").alias("path"))


def with_edges(found: DataFrame, links: DataFrame, directed: bool = False) -> DataFrame:
    """The row of shortest_path() with the types of the links along the path, of several the lexically first."""
    one = stored(found.withColumn("__p", F.split("path", " ")))
    steps = one.where("found and size(__p) > 1").select("__p", F.explode(F.sequence(F.lit(1), F.size("__p") - 1)).alias("i"))
    steps = steps.select("i", F.element_at("__p", F.col("i")).alias("a"), F.element_at("__p", F.col("i") + 1).alias("b"))
    ways = links.select(F.col("source").alias("a"), F.col("target").alias("b"), "type")
    if not directed:
        ways = ways.unionByName(links.select(F.col("target").alias("a"), F.col("source").alias("b"), "type"))
    met = ways.join(steps, ["a", "b"])
    types = met.groupBy("i").agg(F.min("type").alias("type")).agg(F.array_sort(F.collect_list(F.struct("i", "type"))).alias("e"))
    return one.join(F.broadcast(types)).select(*found.columns, F.array_join("e.type", " ").alias("edges"))


def k_hop(links: DataFrame, known: DataFrame, center: str, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within so many undirected hops, and the edges among them."""
    links = stored(links)
    near = stored(reached(links, known.where(F.col("node") == center), hops).select("node", "hops"))
    ids = small(near.select("node"))
    return near, links.join(ids.withColumnRenamed("node", "source"), "source", "left_semi").join(ids.withColumnRenamed("node", "target"), "target", "left_semi")


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    t = {n: load(spark, d, n) for n in TABLES}
    known = nodes(t)
    return known, edges(t, known)


# queries ---------------------------------------------------------------------
def _label(c: str) -> str:
    x = f"coalesce(nullif({c}, ''), CAST(id AS STRING))"
    return f"CASE WHEN length({x}) > 50 THEN substr({x}, 1, 47) || '...' ELSE {x} END"


_NODES = "gn AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{k}:' || CAST(id AS STRING) AS node, '{k}' AS type, {_label(c)} AS label FROM {{{t}}}" for k, t, c in (("site", "sites", "site_name"), ("stratum", "strata", "stratum_name"), ("artifact", "artifacts", "artifact_name"), ("sample", "samples", "lab_code"), ("claim", "claims", "claim_text"), ("evidence", "evidence", "evidence_text"), ("source", "sources", "title"))) + ")"
_S = lambda k, c: f"'{k}:' || CAST({c} AS STRING)"
_GRAPH = f"""{_NODES}, ge AS MATERIALIZED (SELECT source, target, type FROM (
  SELECT {_S('site', 'site_id')} AS source, {_S('stratum', 'id')} AS target, 'CONTAINS' AS type FROM {{strata}} UNION ALL SELECT {_S('stratum', 'stratum_id')}, {_S('artifact', 'id')}, 'CONTAINS' FROM {{artifacts}}
  UNION ALL SELECT {_S('stratum', 'stratum_id')}, {_S('sample', 'id')}, 'CONTAINS' FROM {{samples}} UNION ALL SELECT {_S('stratum', 'id')}, {_S('stratum', 'u')}, 'STRATIFIED_ABOVE' FROM (SELECT id, unnest(string_split(harris_below, ',')) AS u FROM {{strata}} WHERE harris_below <> '') a
  UNION ALL SELECT {_S('claim', 'claim_id')}, {_S('evidence', 'id')}, 'EVIDENCED_BY' FROM {{evidence}} UNION ALL SELECT {_S('evidence', 'id')}, {_S('artifact', 'physical_entity_id')}, 'GROUNDED_IN' FROM {{evidence}}
  UNION ALL SELECT {_S('claim', 'id')}, {_S('source', 'source_id')}, 'CITES' FROM {{claims}} UNION ALL SELECT {_S('evidence', 'id')}, {_S('source', 'source_ids')}, 'CITES' FROM {{evidence}}
  UNION ALL SELECT DISTINCT {_S('claim', 'id')}, {_S('site', 'u')}, 'REFERENCES' FROM (SELECT id, unnest(string_split(site_ids, ',')) AS u FROM {{claims}}) b UNION ALL SELECT {_S('claim', 'id')}, {_S('stratum', 'strata_ids')}, 'REFERENCES' FROM {{claims}}) x
  WHERE source IN (SELECT node FROM gn) AND target IN (SELECT node FROM gn))"""


@operator("g8_nodes", with_views(f"WITH {_NODES} SELECT * FROM gn"))
def _g8(spark, d):
    return nodes({n: load(spark, d, n) for n in TABLES})


@operator("g9_u8_edges", with_views(f"WITH {_GRAPH} SELECT * FROM ge"))
def _g9(spark, d):
    return _graph(spark, d)[1]


@operator("a7_composition", with_views(f"WITH {_GRAPH} SELECT 'node' AS kind, type, CAST(count(*) AS BIGINT) AS n FROM gn GROUP BY 2 UNION ALL SELECT 'edge', type, CAST(count(*) AS BIGINT) FROM ge GROUP BY 2"))
def _a7(spark, d):
    return composition(*_graph(spark, d))


_DEGREE = "dg AS (SELECT gn.node, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM gn LEFT JOIN (SELECT source AS node, count(*) AS n FROM ge GROUP BY 1) o ON gn.node = o.node LEFT JOIN (SELECT target AS node, count(*) AS n FROM ge GROUP BY 1) i ON gn.node = i.node)"


_ENDS = """nd AS (SELECT 'site' AS k, id FROM {sites} UNION ALL SELECT 'stratum', id FROM {strata} UNION ALL SELECT 'artifact', id FROM {artifacts} UNION ALL SELECT 'sample', id FROM {samples} UNION ALL SELECT 'claim', id FROM {claims} UNION ALL SELECT 'evidence', id FROM {evidence} UNION ALL SELECT 'source', id FROM {sources}),
  ed AS (SELECT 'site' AS sk, site_id AS sid, 'stratum' AS tk, id AS tid FROM {strata} UNION ALL SELECT 'stratum', stratum_id, 'artifact', id FROM {artifacts} UNION ALL SELECT 'stratum', stratum_id, 'sample', id FROM {samples}
  UNION ALL SELECT 'stratum', id, 'stratum', CAST(u AS BIGINT) FROM (SELECT id, unnest(string_split(harris_below, ',')) AS u FROM {strata} WHERE harris_below <> '') a UNION ALL SELECT 'claim', claim_id, 'evidence', id FROM {evidence} UNION ALL SELECT 'evidence', id, 'artifact', physical_entity_id FROM {evidence}
  UNION ALL SELECT 'claim', id, 'source', source_id FROM {claims} UNION ALL SELECT 'evidence', id, 'source', CAST(source_ids AS BIGINT) FROM {evidence} UNION ALL SELECT DISTINCT 'claim', id, 'site', CAST(u AS BIGINT) FROM (SELECT id, unnest(string_split(site_ids, ',')) AS u FROM {claims}) b UNION ALL SELECT 'claim', id, 'stratum', CAST(strata_ids AS BIGINT) FROM {claims}),
  ok AS (SELECT ed.* FROM ed SEMI JOIN nd a ON sk = a.k AND sid = a.id SEMI JOIN nd b ON tk = b.k AND tid = b.id), dc AS (SELECT k, id, sum(o) AS o, sum(i) AS i FROM (SELECT sk AS k, sid AS id, 1 AS o, 0 AS i FROM ok UNION ALL SELECT tk, tid, 0, 1 FROM ok UNION ALL SELECT k, id, 0, 0 FROM nd) x GROUP BY 1, 2)"""


@operator("a8_g13_degrees", with_views(f"WITH {_ENDS} SELECT nd.k || ':' || CAST(nd.id AS STRING) AS node, CAST(o + i AS BIGINT) AS degree, CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree FROM nd JOIN dc ON nd.k = dc.k AND nd.id = dc.id"))
def _a8(spark, d):
    return table_degrees({n: load(spark, d, n) for n in TABLES})


@operator("w10_hubs", with_views(f"WITH {_GRAPH}, {_DEGREE} SELECT node, CAST(degree AS BIGINT) AS degree FROM dg ORDER BY degree DESC, node LIMIT 5"))
def _w10(spark, d):
    return hubs(table_degrees({n: load(spark, d, n) for n in TABLES})).select("node", "degree")


@operator("a9_grounding", with_views(f"WITH {_GRAPH}, g AS (SELECT node, node IN (SELECT source FROM ge WHERE type = 'EVIDENCED_BY') AS b FROM gn WHERE type = 'claim') SELECT CAST(count(*) AS BIGINT) AS n_claims, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS n_grounded, round(count(*) FILTER (WHERE b) / CAST(count(*) AS DOUBLE), 6) AS grounding_ratio FROM g"))
def _a9(spark, d):
    return grounding(*_graph(spark, d)).withColumn("grounding_ratio", F.round("grounding_ratio", 6))


@operator("g10_isolated_claims", with_views("SELECT 'claim:' || CAST(c.id AS STRING) AS node FROM {claims} c ANTI JOIN {evidence} e ON e.claim_id = c.id"))
def _g10(spark, d):
    return isolated_claims(*_graph(spark, d))


_BOTH = "st AS MATERIALIZED (SELECT source AS a, target AS b FROM ge UNION SELECT target, source FROM ge)"
_WALK = "SELECT '{0}' AS node, CAST(0 AS BIGINT) AS hops UNION SELECT st.b, w.hops + 1 FROM wk w JOIN st ON st.a = w.node WHERE w.hops < {1}"


@operator("g12_k_hop", with_views(f"WITH RECURSIVE {_GRAPH}, {_BOTH}, wk AS ({_WALK.format('claim:6', 2)}) SELECT node, min(hops) AS hops FROM wk GROUP BY 1"))
def _g12(spark, d):
    known, links = _graph(spark, d)
    return k_hop(links, known, "claim:6", 2)[0]


@operator("g12_k_hop_edges", with_views(f"WITH RECURSIVE {_GRAPH}, {_BOTH}, wk AS ({_WALK.format('claim:6', 2)}), nn AS (SELECT DISTINCT node FROM wk) SELECT * FROM ge WHERE source IN (SELECT node FROM nn) AND target IN (SELECT node FROM nn)"))
def _g12b(spark, d):
    known, links = _graph(spark, d)
    return k_hop(links, known, "claim:6", 2)[1]


@operator("g11_shortest_path", with_views(f"""WITH RECURSIVE {_GRAPH}, st AS MATERIALIZED (SELECT DISTINCT source AS a, target AS b FROM ge WHERE type = 'STRATIFIED_ABOVE'), wk AS (SELECT 'stratum:150' AS node, CAST(0 AS BIGINT) AS hops, ['stratum:150'] AS path UNION SELECT st.b, w.hops + 1, list_append(w.path, st.b) FROM wk w JOIN st ON st.a = w.node WHERE w.hops < 12),
  x AS (SELECT hops, path FROM wk WHERE node = 'stratum:0' ORDER BY hops, path LIMIT 1) SELECT true AS found, hops AS length, array_to_string(path, ' ') AS path, trim(repeat('STRATIFIED_ABOVE ', hops)) AS edges FROM x"""))
def _g11(spark, d):
    known, links = _graph(spark, d)
    links = stored(links.where("type = 'STRATIFIED_ABOVE'"))
    return with_edges(shortest_path(links, known, "stratum:150", "stratum:0", directed=True), links, directed=True)
