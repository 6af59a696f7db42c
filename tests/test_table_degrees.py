"""Degrees counted by type and id against those of the edges by name."""

from groundwork.operators import graph
from groundwork.views import load


def _rows(df):
    return sorted(tuple(r) for r in df.select("node", "degree", "in_degree", "out_degree").collect())


def test_equal_to_the_degrees_of_the_edges(spark, data):
    t = {n: load(spark, data, n) for n in graph.TABLES}
    # a site twice, links to nowhere and links without an end
    t["sites"] = t["sites"].where("id <> 3").unionAll(t["sites"].where("id = 5"))
    t["claims"] = t["claims"].selectExpr("* EXCEPT (source_id)", "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 11 = 1 THEN -1 ELSE source_id END AS source_id")
    known = graph.nodes(t)
    wanted = _rows(graph.degrees(known, graph.edges(t, known)))
    assert _rows(graph.table_degrees(t)) == wanted
    assert _rows(graph.table_degrees(t, part=500)) == wanted


def test_parts_grow_with_the_tables(spark, data):
    t = {n: load(spark, data, n) for n in graph.TABLES}
    n = sum(t[x].count() for x in graph.TABLES)
    assert graph.table_degrees(t, part=200).rdd.getNumPartitions() == -(-n // 200)
