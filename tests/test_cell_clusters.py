"""Clusters by cells of near sites, against a plain search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from groundwork.functions.scalars import EARTH_KM
from groundwork.functions.sphere import with_xyz
from groundwork.operators import cell_clusters, spatial


def _km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))


def _plain(rows, eps, least):
    near = {a[0]: [b[0] for b in rows if a[0] == b[0] or _km(a, b) <= eps] for a in rows}
    core = {i for i, n in near.items() if len(n) >= least}
    first = {}
    for i in sorted(core):
        todo = [i] if i not in first else []
        while todo:
            j = todo.pop()
            if j not in first:
                first[j] = i
                todo += [x for x in near[j] if x in core]
    number = {f: n + 1 for n, f in enumerate(sorted(set(first.values())))}
    for i in near:
        if i not in core and (around := [first[j] for j in near[i] if j in core]):
            first[i] = min(around)
    return {i: number[f] for i, f in first.items()}


def _random_sites():
    r = random.Random(11)
    at = [(r.gauss(31.7, 0.4), r.gauss(35.2, 0.4)) for _ in range(150)] + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(80)]
    at += [(r.uniform(88, 90), r.uniform(-180, 180)) for _ in range(30)] + [(5 + r.random(), r.choice((-180, 179.5)) + r.random() / 2) for _ in range(30)]
    return [(i, la, lo) for i, (la, lo) in enumerate(at + [(52.5, 13.4)] * 10)]


@pytest.mark.parametrize("eps, least", [(35, 1), (20, 4), (150, 3), (12, 8), (2500, 5), (0, 2), (0.0005, 1), (20100, 3)])
def test_same_as_plain_search(spark, eps, least, monkeypatch):
    monkeypatch.setattr(cell_clusters, "FEW_PAIRS", 4)
    rows = _random_sites()
    sites = spark.createDataFrame(rows, "id long, latitude double, longitude double")
    assert {r.id: r.cluster for r in spatial.density_clusters(sites, eps, least).collect()} == _plain(rows, eps, least)


def test_two_dense_places_a_gap_apart(spark):
    """Two places of 30,000 sites whose nearest sites are some 40 km apart: linked at an eps above that and not below, and few pairs of parts are met."""
    r = lambda seed: F.rand(seed) * 0.3
    west = spark.range(0, 60_000, 2).select("id", (31 + r(1)).alias("latitude"), (35 + r(2)).alias("longitude"))
    east = spark.range(1, 60_000, 2).select("id", (31 + r(3)).alias("latitude"), (35.72 + r(4)).alias("longitude"))
    sites = west.unionByName(east)
    edge = sites.agg(F.max(F.when(F.col("longitude") < 35.5, F.col("longitude"))), F.min(F.when(F.col("longitude") > 35.5, F.col("longitude")))).first()
    least = (edge[1] - edge[0]) * math.cos(math.radians(31.3)) * EARTH_KM * math.pi / 180
    apart = spatial.density_clusters(sites, least * 0.995, 5)
    assert {(r.c, r.n) for r in apart.groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("n")).collect()} == {(1, 30_000), (2, 30_000)}
    assert spatial.density_clusters(sites, least * 1.05, 5).agg(F.min("cluster"), F.max("cluster"), F.count("*")).first()[:] == (1, 1, 60_000)


def test_no_sites(spark):
    sites = spark.createDataFrame([], "id long, latitude double, longitude double")
    assert spatial.density_clusters(sites, 35, 1).count() == 0
    one = spark.createDataFrame([(7, 1.0, 1.0), (8, None, 1.0), (9, 0.0, 0.0)], "id long, latitude double, longitude double")
    assert [tuple(r) for r in spatial.density_clusters(one, 35, 1).collect()] == [(7, 1)]
    assert [tuple(r) for r in spatial.density_clusters(one, -1, 1).collect()] == [(7, 1)] and spatial.density_clusters(one, 35, 2).count() == 0
