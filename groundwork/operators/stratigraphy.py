"""Order of strata: precedence, cycles, levels, date inversions.

Levels and cycles double walks: the pairs joined by a walk of exactly 2^i edges
give those of 2^(i+1), so a chain of any length takes a round for each power of
two, with a row for each node in it.  Where walks branch so much that their
doubling would outgrow the graph, the longest ones at hand are used as strides.
Each round is written out, so lineage stays short and lost executors cost one
round; only counts reach the driver.

Cycles cut the graph into small groups first: nodes of one component have the same
lowest ranks among all that reach them and among all that they reach, and edges between
nodes that differ there are on no cycle.  Groups of a bounded size are searched in the
tasks that hold their edges, larger ones by pivots over the whole cluster."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions.scalars import astro_range, year_label
from groundwork.plans.scratch import stored
from groundwork.registry import operator
from groundwork.views import load, with_views


def precedence(strata: DataFrame) -> DataFrame:
    """(older, younger), each once: what lies below is older, what lies above or cuts is younger; unknown ids are dropped."""
    part = lambda c, older, younger: strata.select("id", F.explode(c).alias("o")).select(F.col(older).alias("older"), F.col(younger).alias("younger"))
    edges = part("harris_below", "o", "id").union(part("harris_above", "id", "o")).union(part("harris_cut_by", "id", "o")).distinct()
    ids = strata.select("id")
    return edges.join(ids.withColumnRenamed("id", "older"), "older", "left_semi").join(ids.withColumnRenamed("id", "younger"), "younger", "left_semi").select("older", "younger")


#: Walks of one length may have so many rows for each node and edge of the graph.
MOST_GROWTH = 8


def _doubled_rows(walks: DataFrame) -> float:
    """Rows of the join of walks with themselves, at most the rows of walks of double length."""
    into, out = walks.groupBy(F.col("younger").alias("id")).agg(F.count("*").alias("i")), walks.groupBy(F.col("older").alias("id")).agg(F.count("*").alias("o"))
    return into.join(out, "id").agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0] or 0.0


def _doubled(walks: DataFrame) -> DataFrame:
    return walks.select("older", F.col("younger").alias("mid")).join(walks.select(F.col("older").alias("mid"), "younger"), "mid").select("older", "younger").distinct()


def levels(nodes: DataFrame, edges: DataFrame, most_growth: float = MOST_GROWTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, level), nodes on or after a cycle, edges among them).  The level is the longest path from a node without predecessors.

    With walks of n edges a node takes n and the largest level below n of the nodes where such walks to it begin; so all levels below 2n are known.
    If as many nodes end a walk of 2n edges as one of n, none has a level from n to 2n - 1, and a node of a higher level would have an ancestor of
    that level: all of them come after a cycle.  When doubling would make more than most_growth rows for each node and edge, walks of n edges are
    strides: each round adds n to the nodes that the nodes of the round before reach.  Repeated edges count once."""
    once = walks = stored(edges.select("older", "younger").distinct())
    level = stored(nodes.select("id", F.lit(0).cast("long").alias("level"), F.lit(True).alias("far")))
    most = most_growth * (level.count() + walks.count())
    length, before, doubling = 1, None, True
    while True:
        came = walks.join(level.where("far" if not doubling else "true").select(F.col("id").alias("older"), "level"), "older").groupBy(F.col("younger").alias("id")).agg(F.max("level").alias("m"))
        level = stored(level.join(came, "id", "left").select("id", F.coalesce(F.col("m") + length, "level").alias("level"), F.col("m").isNotNull().alias("far")))
        n = level.where("far").count()
        if n == 0 or n == before:
            break
        before = n
        doubling = doubling and _doubled_rows(walks) <= most
        if doubling:
            walks, length = stored(_doubled(walks)), 2 * length
    left = level.where("far").select("id")
    live = once.join(left.withColumnRenamed("id", "older"), "older", "left_semi").join(left.withColumnRenamed("id", "younger"), "younger", "left_semi").select("older", "younger")
    return level.where("not far").select("id", "level"), left, live


def _lowest_upstream(labels: DataFrame, edges: DataFrame, most_growth: float = MOST_GROWTH) -> DataFrame:
    """(id, c): the smallest of the labels c of a node and of all that reach it; null where none of them has one.

    Walks of 1, 2, 4 ... edges are followed in turn, which covers every shorter distance, up to the number of nodes.  It ends sooner when no walk is
    that long, or when neither the longest walks nor single edges change a label.  Where doubling would outgrow the graph, the walks at hand are
    followed again until single edges change nothing."""
    walks = [stored(edges.select("older", "younger").distinct())]
    c = stored(labels)
    n = c.count()
    most = most_growth * (n + walks[0].count())
    c, moved = _pulled(c, walks[0])
    while moved and 2 ** len(walks) < n:
        rows = _doubled_rows(walks[-1])
        if rows == 0:
            return c
        if rows > most:
            break
        walks.append(stored(_doubled(walks[-1])))
        c, some = _pulled(c, walks[-1])
        if not some:
            c, moved = _pulled(c, walks[0])
    if 2 ** len(walks) >= n:
        return c
    while moved:
        for w in walks[1:]:
            c, _ = _pulled(c, w)
        c, moved = _pulled(c, walks[0])
    return c


def _pulled(c: DataFrame, walks: DataFrame) -> tuple[DataFrame, bool]:
    """Labels after one step over walks, and whether one changed."""
    came = walks.join(c.where("c is not null").select(F.col("id").alias("older"), "c"), "older").groupBy(F.col("younger").alias("id")).agg(F.min("c").alias("n"))
    after = stored(c.join(came, "id", "left").select("id", F.least("c", "n").alias("c"), (F.col("n").isNotNull() & (F.col("c").isNull() | (F.col("n") < F.col("c")))).alias("moved")))
    return after.select("id", "c"), bool(after.where("moved").take(1))


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("younger").alias("older"), F.col("older").alias("younger"))


def _peeled(edges: DataFrame) -> DataFrame:
    """The stored edges that may be on a cycle: those with no edge before or none after them go, round by round, while a round takes an eighth of the rest or more."""
    edges = stored(edges)
    n, before = edges.count(), None
    while n and (before is None or 8 * n <= 7 * before):
        into, out = edges.select(F.col("younger").alias("older")), edges.select(F.col("older").alias("younger"))
        edges = stored(edges.join(into, "older", "left_semi").join(out, "younger", "left_semi").select("older", "younger"))
        before, n = n, edges.count()
    return edges


#: Independent ranks of a node; each is followed both ways.
RANKS = 2
#: Edges of a group that one task may search.
MOST_LOCAL = 100_000


def _signatures(edges: DataFrame, most_growth: float = MOST_GROWTH) -> DataFrame:
    """(id, g) for the ends of different stored edges: a hash of the lowest ranks among a node and all that reach it, and among it and all that it reaches.

    Nodes of one component have one g.  Distances are covered as in _lowest_upstream(), both ways at once; where doubling would outgrow the graph, all
    walks at hand are followed together until nothing changes."""
    up, down = [f"u{i}" for i in range(RANKS)], [f"d{i}" for i in range(RANKS)]
    ranks = [F.xxhash64("id", F.lit(i)) for i in range(RANKS)]
    ids = edges.select(F.explode(F.array("older", "younger")).alias("id")).distinct()
    c = stored(ids.select("id", *[r.alias(x) for names in (up, down) for r, x in zip(ranks, names, strict=True)]))
    n, walks = c.count(), [edges]
    most = most_growth * (n + edges.count())

    def pulled(c: DataFrame, over: DataFrame) -> tuple[DataFrame, bool]:
        """Ranks after one step over walks, and whether one changed."""
        rows = c.select("*", *[F.col(x).alias(f"own_{x}") for x in (*up, *down)])
        came = over.join(c.select(F.col("id").alias("older"), *up), "older").select(F.col("younger").alias("id"), *up)
        gone = over.join(c.select(F.col("id").alias("younger"), *down), "younger").select(F.col("older").alias("id"), *down)
        every = rows.unionByName(came, True).unionByName(gone, True).groupBy("id").agg(*[F.min(x).alias(x) for x in (*up, *down)], *[F.max(f"own_{x}").alias(f"own_{x}") for x in (*up, *down)])
        less = reduce(lambda a, b: a | b, [F.col(x) < F.col(f"own_{x}") for x in (*up, *down)])
        after = stored(every.select("id", *up, *down, less.alias("moved")))
        return after.drop("moved"), bool(after.where("moved").take(1))

    c, moved = pulled(c, edges)
    while moved and 2 ** len(walks) < n:
        rows = _doubled_rows(walks[-1])
        if rows == 0:
            break
        if rows > most:
            every = reduce(DataFrame.unionByName, walks)
            while moved:
                c, moved = pulled(c, every)
            break
        walks.append(stored(_doubled(walks[-1])))
        c, some = pulled(c, walks[-1])
        if not some:
            c, moved = pulled(c, edges)
    return c.select("id", F.xxhash64(*up, *down).alias("g"))


def _strong_parts(older: np.ndarray, younger: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, components) of the strongly connected parts of two nodes or more among some edges, by one depth-first search; named by their smallest id."""
    ids, ends = np.unique(np.concatenate([older, younger]), return_inverse=True)
    a, b = ends[: len(older)], ends[len(older) :]
    order, n = np.argsort(a, kind="stable"), len(ids)
    to, start = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    at, low, number, stack, part = start[:n], [0] * n, [0] * n, [], [-1] * n
    count = 0
    for root in range(n):
        if number[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not number[v]:
                count += 1
                number[v] = low[v] = count
                stack.append(v)
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not number[w]:
                    path.append(w)
                elif part[w] < 0:
                    low[v] = min(low[v], number[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == number[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(stack.pop())
                least = min(members)
                for w in members:
                    part[w] = least
    part = np.array(part, dtype=np.int64)
    real = np.bincount(part, minlength=n)[part] > 1
    return ids[real], ids[part[real]]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (g, older, younger) in order of g -> (id, component); some groups at once, never less than a whole one."""
    held: list[pa.RecordBatch] = []

    def found(t: pa.Table) -> pa.RecordBatch:
        ids, parts = _strong_parts(t["older"].to_numpy(), t["younger"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64())], ["id", "component"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= MOST_LOCAL:
            t = pa.Table.from_batches(held)
            cuts = np.flatnonzero(np.diff(t["g"].to_numpy()) != 0)
            if len(cuts):
                k = int(cuts[-1]) + 1
                yield found(t.slice(0, k))
                held = t.slice(k).to_batches()
    if held:
        yield found(pa.Table.from_batches(held))


def cycles(nodes: DataFrame, edges: DataFrame, most_growth: float = MOST_GROWTH, most_local: int = MOST_LOCAL) -> DataFrame:
    """(id, component): strongly connected components of two or more nodes, and self-loops; named by their smallest id.

    Edges between nodes of different signatures are on no cycle.  What they leave falls into groups; those of most_local edges at most are searched in
    the tasks that hold them, the others by pivots."""
    ids = nodes.select("id")
    own = edges.where("older = younger").select(F.col("older").alias("id")).distinct()
    known = edges.where("older <> younger").join(ids.withColumnRenamed("id", "older"), "older", "left_semi").join(ids.withColumnRenamed("id", "younger"), "younger", "left_semi")
    live = _peeled(known.select("older", "younger").distinct())
    loops = own.select("id", F.col("id").alias("component"))
    if not live.take(1):
        return loops
    g = stored(_signatures(live, most_growth))
    same = live.join(g.withColumnsRenamed({"id": "older", "g": "go"}), "older").join(g.withColumnsRenamed({"id": "younger", "g": "gy"}), "younger").where("go = gy")
    same = stored(same.select(F.col("go").alias("g"), "older", "younger"))
    large = stored(same.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > most_local).select("g"))
    real = stored(same.join(large, "g", "left_anti").repartition("g").sortWithinPartitions("g").mapInArrow(_searched, "id bigint, component bigint"))
    if large.take(1):
        rest = stored(same.join(large, "g", "left_semi").select("older", "younger"))
        real = real.unionByName(_by_pivots(rest.select(F.explode(F.array("older", "younger")).alias("id")).distinct(), rest, most_growth))
    return real.unionByName(loops.join(real.select("id"), "id", "left_anti"))


def _by_pivots(nodes: DataFrame, edges: DataFrame, most_growth: float) -> DataFrame:
    """(id, component): strongly connected components of two or more nodes of a graph without self-loops.

    Nodes that are not both after and before a cycle are dropped.  Each remaining node takes the color of a pivot, the node of lowest rank among those
    that reach it; of the nodes of a color those that reach the pivot back are its component, and the rest goes on.  Ranks are hashes that change each
    time, so the rounds grow with the logarithm of the components that follow each other."""
    _, ids, live = levels(nodes, edges, most_growth)
    found, turn = None, 0
    while True:
        _, ids, live = levels(ids, _flipped(live), most_growth)
        ids, live = stored(ids), stored(_flipped(live))
        if not ids.take(1):
            break
        rank = F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("p"))
        color = stored(_lowest_upstream(ids.select("id", rank.alias("c")), live, most_growth).select("id", F.col("c.p").alias("p")))
        same = live.join(color.withColumnsRenamed({"id": "older", "p": "po"}), "older").join(color.withColumnsRenamed({"id": "younger", "p": "py"}), "younger").where("po = py").select("older", "younger")
        back = _lowest_upstream(color.select("id", F.when(F.col("id") == F.col("p"), F.col("p")).alias("c")), _flipped(same), most_growth)
        own_color = stored(back.where("c is not null").select("id", "c"))
        found = own_color if found is None else found.unionByName(own_color)
        # what is left of a color may still follow or precede components of others, but shares none with them
        rest = stored(ids.join(own_color, "id", "left_anti"))
        kept = same.join(rest.withColumnRenamed("id", "older"), "older", "left_semi").join(rest.withColumnRenamed("id", "younger"), "younger", "left_semi").select("older", "younger")
        _, ids, live = levels(rest, kept, most_growth)
        turn += 1
    if found is None:
        return nodes.select("id", F.col("id").alias("component")).limit(0)
    named = found.groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return stored(found.join(named, "c").select("id", "component"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, older, younger): sorted lists of direct neighbours."""
    a = edges.groupBy(F.col("younger").alias("id")).agg(F.array_sort(F.collect_set("older")).alias("older"))
    b = edges.groupBy(F.col("older").alias("id")).agg(F.array_sort(F.collect_set("younger")).alias("younger"))
    none = F.array().cast("array<bigint>")
    return a.join(b, "id", "full_outer").select("id", F.coalesce("older", none).alias("older"), F.coalesce("younger", none).alias("younger"))


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumn("y", astro_range(F.col("date_start_bce"), F.col("date_start_ce"), F.col("date_end_bce"), F.col("date_end_ce")))


def stratum_inversions(strata: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose lower stratum begins after the upper one ends (advisory)."""
    y = _dates(strata).select("id", "y")
    low, up = y.select(F.col("id").alias("older"), F.col("y.first").alias("low")), y.select(F.col("id").alias("younger"), F.col("y.last").alias("up"))
    both = edges.join(low, "older").join(up, "younger").where("low > up")
    return both.select("older", "younger", "low", "up", year_label(F.col("low").cast("double")).alias("low_label"), year_label(F.col("up").cast("double")).alias("up_label"))


def sample_inversions(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of samples across an edge whose intervals don't meet and whose lower one is younger, with both lab codes."""
    y = _dates(samples).where("y.first is not null").select("stratum_id", "lab_code", "y")
    low = y.select(F.col("stratum_id").alias("older"), F.col("lab_code").alias("low_code"), F.col("y.first").alias("low"))
    up = y.select(F.col("stratum_id").alias("younger"), F.col("lab_code").alias("up_code"), F.col("y.last").alias("up"))
    return edges.join(low, "older").join(up, "younger").where("low > up").select("older", "younger", "low_code", "up_code", "low", "up")


def report(strata: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per site: strata, edges, cyclic strata, validity and both kinds of inversion; edges count at the site of their younger end."""
    edges = stored(precedence(strata))
    bad = cycles(strata, edges)
    at = strata.select(F.col("id").alias("younger"), "site_id")
    per = lambda df, name: df.join(at, "younger").groupBy("site_id").agg(F.count("*").alias(name))
    parts = [per(edges, "n_edges"), per(bad.select(F.col("id").alias("younger")), "n_cyclic"), per(stratum_inversions(strata, edges), "n_stratum_inversions"), per(sample_inversions(samples, edges), "n_sample_inversions")]
    out = strata.groupBy("site_id").agg(F.count("*").alias("n_strata"))
    for p in parts:
        out = out.join(p, "site_id", "left")
    out = out.na.fill(0)
    return out.withColumn("is_valid", F.col("n_cyclic") == 0)


# queries ---------------------------------------------------------------------
_EDGES = """pe AS (SELECT DISTINCT older, younger FROM (SELECT CAST(u AS BIGINT) AS older, id AS younger FROM (SELECT id, unnest(string_split(harris_below, ',')) AS u FROM {strata} WHERE harris_below <> '') a
  UNION ALL SELECT id, CAST(harris_above AS BIGINT) FROM {strata} WHERE harris_above <> '' UNION ALL SELECT id, CAST(harris_cut_by AS BIGINT) FROM {strata} WHERE harris_cut_by <> '') x WHERE older IN (SELECT id FROM {strata}) AND younger IN (SELECT id FROM {strata}))"""
_REACH = f"WITH RECURSIVE {_EDGES}, rc AS (SELECT older AS a, younger AS b FROM pe UNION SELECT rc.a, pe.younger FROM rc JOIN pe ON rc.b = pe.older)"
_RANGE = """CASE WHEN {s}ce > 0 THEN {s}ce WHEN {s}bce > 0 THEN 1 - {s}bce END"""
_YEARS = "(SELECT *, least(coalesce(a, b), coalesce(b, a)) AS y0, greatest(coalesce(a, b), coalesce(b, a)) AS y1 FROM (SELECT *, " + _RANGE.format(s="date_start_") + " AS a, " + _RANGE.format(s="date_end_") + " AS b FROM {T}) q)"


def _years(t: str) -> str:
    return _YEARS.replace("{T}", "{" + t + "}")


@operator("g1_precedence", with_views(f"WITH {_EDGES} SELECT older, younger FROM pe"))
def _g1(spark, d):
    return precedence(load(spark, d, "strata"))


@operator("g2_cycles", with_views(_REACH + " SELECT a AS id, least(a, min(b)) AS component FROM (SELECT r.a, r.b FROM rc r JOIN rc s ON r.a = s.b AND r.b = s.a) z GROUP BY a"))
def _g2(spark, d):
    strata = load(spark, d, "strata")
    return cycles(strata, stored(precedence(strata)))


@operator("g3_levels", with_views(f"""WITH RECURSIVE {_EDGES}, rc AS (SELECT older AS a, younger AS b FROM pe UNION SELECT rc.a, pe.younger FROM rc JOIN pe ON rc.b = pe.older), cyc AS (SELECT DISTINCT a AS id FROM rc WHERE a = b), bad AS (SELECT id FROM cyc UNION SELECT b FROM rc WHERE a IN (SELECT id FROM cyc)),
  ok AS (SELECT id FROM {{strata}} WHERE id NOT IN (SELECT id FROM bad)), lv AS (SELECT id, CAST(0 AS BIGINT) AS level FROM ok UNION SELECT pe.younger, lv.level + 1 FROM lv JOIN pe ON pe.older = lv.id WHERE pe.younger IN (SELECT id FROM ok)) SELECT id, max(level) AS level FROM lv GROUP BY 1"""))
def _g3(spark, d):
    strata = load(spark, d, "strata")
    return levels(strata, precedence(strata))[0]


@operator("g4_neighbours", with_views(f"""WITH {_EDGES}, a AS (SELECT younger AS id, string_agg(CAST(older AS STRING), ',' ORDER BY older) AS l FROM pe GROUP BY 1), b AS (SELECT older AS id, string_agg(CAST(younger AS STRING), ',' ORDER BY younger) AS l FROM pe GROUP BY 1)
  SELECT coalesce(a.id, b.id) AS id, coalesce(a.l, '') AS older, coalesce(b.l, '') AS younger FROM a FULL OUTER JOIN b ON a.id = b.id"""))
def _g4(spark, d):
    return neighbours(precedence(load(spark, d, "strata"))).select("id", F.array_join("older", ",").alias("older"), F.array_join("younger", ",").alias("younger"))


@operator("g5_stratum_inversions", with_views(f"WITH {_EDGES}, y AS {_years('strata')} SELECT older, younger, CAST(l.y0 AS BIGINT) AS low, CAST(u.y1 AS BIGINT) AS up FROM pe JOIN y l ON l.id = older JOIN y u ON u.id = younger WHERE l.y0 > u.y1"))
def _g5(spark, d):
    strata = load(spark, d, "strata")
    return stratum_inversions(strata, precedence(strata)).select("older", "younger", F.col("low").cast("long").alias("low"), F.col("up").cast("long").alias("up"))


@operator("g6_j22_sample_inversions", with_views(f"WITH {_EDGES}, y AS {_years('samples')} SELECT older, younger, l.lab_code AS low_code, u.lab_code AS up_code FROM pe JOIN y l ON l.stratum_id = older JOIN y u ON u.stratum_id = younger WHERE l.y0 > u.y1"))
def _g6(spark, d):
    return sample_inversions(load(spark, d, "samples"), precedence(load(spark, d, "strata"))).select("older", "younger", "low_code", "up_code")


@operator("g7_stratigraphy_report", with_views(_REACH + f""", y AS {_years('strata')}, sy AS {_years('samples')}, cyc AS (SELECT DISTINCT a AS id FROM rc WHERE a = b), pl AS (SELECT id, site_id FROM {{strata}}),
  n AS (SELECT site_id, count(*) AS n FROM pl GROUP BY 1), e AS (SELECT site_id, count(*) AS n FROM pe JOIN pl ON pl.id = younger GROUP BY 1), c AS (SELECT site_id, count(*) AS n FROM cyc JOIN pl ON pl.id = cyc.id GROUP BY 1),
  s AS (SELECT pl.site_id, count(*) AS n FROM pe JOIN y l ON l.id = older JOIN y u ON u.id = younger JOIN pl ON pl.id = younger WHERE l.y0 > u.y1 GROUP BY 1), m AS (SELECT pl.site_id, count(*) AS n FROM pe JOIN sy l ON l.stratum_id = older JOIN sy u ON u.stratum_id = younger JOIN pl ON pl.id = younger WHERE l.y0 > u.y1 GROUP BY 1)
  SELECT n.site_id, CAST(n.n AS BIGINT) AS n_strata, CAST(coalesce(e.n, 0) AS BIGINT) AS n_edges, CAST(coalesce(c.n, 0) AS BIGINT) AS n_cyclic, CAST(coalesce(s.n, 0) AS BIGINT) AS n_stratum_inversions, CAST(coalesce(m.n, 0) AS BIGINT) AS n_sample_inversions, coalesce(c.n, 0) = 0 AS is_valid
  FROM n LEFT JOIN e ON n.site_id = e.site_id LEFT JOIN c ON n.site_id = c.site_id LEFT JOIN s ON n.site_id = s.site_id LEFT JOIN m ON n.site_id = m.site_id"""))
def _g7(spark, d):
    return report(load(spark, d, "strata"), load(spark, d, "samples"))
