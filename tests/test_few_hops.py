"""Few hops move no more rows than the links."""

from groundwork.operators import graph


def test_few_hops_store_no_table_of_both_directions(spark, monkeypatch):
    pairs = [("c", "a"), ("c", "a"), ("b", "c"), ("b", "b"), ("b", "d"), ("d", "e")] + [(f"x{i}", f"y{i}") for i in range(60)]
    links = spark.createDataFrame([(*p, "T") for p in pairs], "source string, target string, type string")
    known = spark.createDataFrame([(n,) for n in sorted({x for p in pairs for x in p})], "node string")
    sizes, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (sizes.append((out := stored(df)).count()), out)[1])
    near, among = graph.k_hop(links, known, "c", 2)
    assert sorted(tuple(r) for r in near.collect()) == [("a", 1), ("b", 1), ("c", 0), ("d", 2)]
    assert sorted(tuple(r)[:2] for r in among.select("source", "target").collect()) == [("b", "b"), ("b", "c"), ("b", "d"), ("c", "a"), ("c", "a")]
    assert max(sizes) <= len(pairs)
    paths = {r.node: r.path for r in graph.reached(links, known.where("node = 'c'")).collect()}
    assert paths == {"c": ["c"], "a": ["c", "a"], "b": ["c", "b"], "d": ["c", "b", "d"], "e": ["c", "b", "d", "e"]}
