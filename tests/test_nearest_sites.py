"""Nearest neighbours by cells of equal numbers, against a plain search."""

import math
import random

from pyspark.sql import functions as F

from groundwork.functions.scalars import EARTH_KM
from groundwork.operators import nearest_sites, spatial


def _sites(spark, rows):
    return spark.createDataFrame(rows, "id long, latitude double, longitude double, elevation double, name string")


def _km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * EARTH_KM * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))


def _plain(rows, k):
    return {(a[0], i + 1): (round(d, 6), b) for a in rows for i, (d, b) in enumerate(sorted((_km(a, b), b[0]) for b in rows if b[0] != a[0])[:k])}


def _got(df):
    return {(r.id, r.rank): (round(r.distance_km, 6), r.neighbour) for r in df.collect()}


def test_uneven_density_poles_date_line_and_equal_positions(spark):
    r = random.Random(5)
    at = [(r.gauss(31.7, 0.05), r.gauss(35.2, 0.05)) for _ in range(300)]
    at += [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)]
    at += [(r.uniform(88, 90), r.uniform(-180, 180)) for _ in range(20)] + [(10 + r.random(), r.choice((-180, 179.5)) + r.random() / 2) for _ in range(20)]
    at += [(52.5, 13.4)] * 40 + [(-52.5, -166.6)]
    rows = [(i, la, lo, float(i), "s") for i, (la, lo) in enumerate(at)]
    for k, cell in ((5, 8), (1, 32), (12, 8)):
        assert _got(nearest_sites.nearest(_sites(spark, rows), k, cell, 4)) == _plain(rows, k), k


def test_few_or_no_sites(spark):
    rows = [(1, 10.0, 10.0, 5.0, "a"), (2, 11.0, 10.0, 0.0, "b"), (3, 10.0, 10.0, 7.0, "c")]
    assert _got(spatial.nearest(_sites(spark, rows), 5)) == _plain(rows, 5)
    assert {(r.id, r.neighbour): r.elevation_difference for r in spatial.nearest(_sites(spark, rows), 1).collect()} == {(1, 3): 2.0, (2, 1): 5.0, (3, 1): -2.0}
    for none in (spatial.nearest(_sites(spark, rows[:1]), 5), spatial.nearest(_sites(spark, rows), 0), spatial.nearest(_sites(spark, []), 5)):
        assert none.count() == 0 and none.columns == ["id", "neighbour", "rank", "distance_km", "bearing", "compass", "elevation_difference"]


def test_one_city_of_many_sites_and_few_far_ones(spark):
    """A hundred thousand sites in 20 km, a fifth of them at one place: few cells are looked into for each group."""
    noise = lambda seed: F.randn(seed) * 0.05
    city = spark.range(100_000).withColumn("one", F.col("id") % 5 == 0).select("id", F.when(F.col("one"), 31.7).otherwise(31.7 + noise(1)).alias("latitude"), F.when(F.col("one"), 35.2).otherwise(35.2 + noise(2)).alias("longitude"), F.lit(0.0).alias("elevation"))
    # one of these is at (0, 0) and not valid
    far = spark.range(100_000, 100_020).select("id", (F.col("id") % 20 * 4.0 - 40).alias("latitude"), (F.col("id") % 20 * 17.0 - 170).alias("longitude"), F.lit(0.0).alias("elevation"))
    sites = city.unionByName(far)
    _, cells = nearest_sites.nearest_lists(sites, 5)
    per = cells.groupBy("g").count().agg(F.avg("count").alias("mean"), F.max("count").alias("most")).first()
    assert per["mean"] < 20 and per["most"] < 100
    got = spatial.nearest(sites, 5)
    assert got.agg(F.count("*"), F.countDistinct("id")).first()[:] == (500_095, 100_019)
    same = {r.id: r.n for r in got.where("id in (0, 5, 25, 99995)").groupBy("id").agg(F.sort_array(F.collect_list("neighbour")).alias("n")).collect()}
    assert same == {0: [5, 10, 15, 20, 25], 5: [0, 10, 15, 20, 25], 25: [0, 5, 10, 15, 20], 99995: [0, 5, 10, 15, 20]}
