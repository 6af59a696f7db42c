"""Levels and cycles by doubled walks, against plain searches, and their rounds."""

import random

import pytest

from groundwork.operators import stratigraphy


def _frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(list(edges), "older long, younger long")


def _after(nodes, edges):
    """Nodes reached from each by one edge or more."""
    out = {n: set() for n in nodes}
    for a, b in edges:
        out[a].add(b)
    found = {}
    for n in nodes:
        seen, todo = set(), list(out[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(out[x])
        found[n] = seen
    return found


def _expected(nodes, edges):
    after = _after(nodes, edges)
    parts = {n: min(x for x in after[n] if n in after[x]) for n in nodes if n in after[n]}
    bad = set(parts) | {x for n in parts for x in after[n]}
    into = {n: [a for a, b in edges if b == n] for n in nodes}
    known = {}

    def level(n):
        if n not in known:
            known[n] = max((level(a) + 1 for a in into[n]), default=0)
        return known[n]

    return {n: level(n) for n in nodes if n not in bad}, bad, parts


def _graph(seed):
    r = random.Random(seed)
    n = r.choice([6, 15, 40])
    nodes = r.sample(range(1000), n)
    edges = {(nodes[i], nodes[j]) for i, j in ((r.randrange(n), r.randrange(n)) for _ in range(r.choice([n // 2, n, 2 * n])))}
    if seed % 2:  # mostly acyclic
        edges = {(a, b) if nodes.index(a) <= nodes.index(b) or r.random() < 0.05 else (b, a) for a, b in edges}
    return nodes, edges


@pytest.mark.parametrize(("seed", "growth"), [(1, 8), (2, 8), (3, 0)])
def test_same_as_plain_searches(spark, seed, growth):
    nodes, edges = _graph(seed)
    level, bad, parts = _expected(nodes, edges)
    n, e = _frames(spark, nodes, edges)
    done, left, live = stratigraphy.levels(n, e, growth)
    assert {r.id: r.level for r in done.collect()} == level and {r.id for r in left.collect()} == bad
    assert {(r.older, r.younger) for r in live.collect()} == {(a, b) for a, b in edges if a in bad and b in bad}
    assert {r.id: r.component for r in stratigraphy.cycles(n, e, growth).collect()} == parts


@pytest.fixture
def writes(monkeypatch):
    seen = []
    real = stratigraphy.stored
    monkeypatch.setattr(stratigraphy, "stored", lambda df: seen.append(1) or real(df))
    return seen


def test_long_chain_in_few_rounds(spark, writes):
    ids = list(range(10_000))
    random.Random(1).shuffle(ids)
    n, e = _frames(spark, ids, zip(ids, ids[1:], strict=False))
    done, left, _ = stratigraphy.levels(n, e)
    assert {r.id: r.level for r in done.collect()} == {x: i for i, x in enumerate(ids)} and left.count() == 0
    # two tables a round and two to begin with
    assert len(writes) <= 2 * 16


def test_cycles_with_long_tails_and_many_components(spark, writes):
    tail = 200
    before, after = range(10_000, 10_000 + tail), range(20_000, 20_000 + tail)
    pairs = [(2 * i, 2 * i + 1) for i in range(16)]
    edges = [x for a, b in pairs for x in ((a, b), (b, a))] + [(pairs[i][1], pairs[i + 1][0]) for i in range(15)]
    edges += list(zip(before, before[1:], strict=False)) + list(zip(after, after[1:], strict=False)) + [(before[-1], 0), (31, after[0])]
    ring = list(range(30_000, 30_100))
    edges += list(zip(ring, ring[1:] + ring[:1], strict=True))
    n, e = _frames(spark, [*before, *after, *range(32), *ring], edges)
    found = {r.id: r.component for r in stratigraphy.cycles(n, e).collect()}
    assert found == {x: x - x % 2 for x in range(32)} | dict.fromkeys(ring, 30_000)
    assert len(writes) < 250


def test_repeated_edges_and_empty_graphs(spark):
    n, e = _frames(spark, [1, 2, 3], [(1, 2), (1, 2), (3, 3), (3, 3)])
    assert {r.id: r.level for r in stratigraphy.levels(n, e)[0].collect()} == {1: 0, 2: 1}
    assert {r.id: r.component for r in stratigraphy.cycles(n, e).collect()} == {3: 3}
    n, e = _frames(spark, [1, 2], [])
    assert {r.id: r.level for r in stratigraphy.levels(n, e)[0].collect()} == {1: 0, 2: 0} and stratigraphy.cycles(n, e).count() == 0
