"""Density clusters by cells whose sites are all within eps of each other.

Space is cut into cubes whose diagonal is the chord of eps.  A cube with min_pts sites
has only core sites; sites of other cubes, fewer than min_pts in each, are compared
with those of the cubes around.  Cubes are nodes of the cluster graph: two are linked
if any two of their core sites are within eps.  That is found by halving: boxes that
are surely near link their cubes, boxes that are surely far or farther than another
pair of the same cubes end, the rest are cut into parts; pairs of small parts are
compared site by site.  So no table of pairs of sites is made: rows grow with the
sites, times min_pts where cubes are thin.

Sites at one position count as one with a weight."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.scalars import haversine_km
from groundwork.functions.sphere import AXES, SLACK, box, box_columns, chord_of, gap, numbered, span, with_xyz
from groundwork.operators.components import connected_components
from groundwork.plans.scratch import stored

#: Below a metre a cell is one position, since rounding would count in cubes of that size.
LEAST_KM = 1e-3
#: Pairs of parts with so many pairs of sites at most are compared site by site.
FEW_PAIRS = 4096
MOST_CUTS = 12

_KEY = ["cx", "cy", "cz", "alone"]


def _cubes(side: float) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("long") for c in AXES]


def _cells(points: DataFrame) -> DataFrame:
    return stored(points.groupBy("cell").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("cz").alias("cz"), F.sum("w").alias("n"), *box()))


def _near_cells(cells: DataFrame, most: float, side: float) -> DataFrame:
    """(a, b) of cells, either way and each with itself, whose boxes are within a chord: the 125 cubes around are looked at, without those off the sphere."""
    steps = F.array(*[F.lit(i).cast("long") for i in (-2, -1, 0, 1, 2)])
    out = cells.select(F.col("cell").alias("a"), *[F.col(c).alias(f"a_{c}") for c in box_columns()], "cx", "cy", "cz")
    for c in ("cx", "cy", "cz"):
        out = out.withColumn("step", F.explode(steps)).withColumn(c, F.col(c) + F.col("step")).drop("step")
    low = [F.col(c) * side for c in ("cx", "cy", "cz")]
    inner = sum((F.pow(F.greatest(v, -(v + side), F.lit(0.0)), 2) for v in low), F.lit(0.0))
    outer = sum((F.pow(F.greatest(F.abs(v), F.abs(v + side)), 2) for v in low), F.lit(0.0))
    out = out.where((inner <= 1 + 1e-9) & (outer >= 1 - 1e-9))
    b = cells.select(F.col("cell").alias("b"), *[F.col(c).alias(f"b_{c}") for c in box_columns()], "cx", "cy", "cz")
    return out.join(b, ["cx", "cy", "cz"]).where(gap("a_", "b_") <= most + SLACK).select("a", "b")


def _within(a: str, b: str, km: float) -> Column:
    return haversine_km(F.col(f"{a}.latitude"), F.col(f"{a}.longitude"), F.col(f"{b}.latitude"), F.col(f"{b}.longitude")) <= km


def linked_cells(points: DataFrame, near: DataFrame, eps_km: float, side: float) -> DataFrame:
    """(a, b), a < b: pairs of near(a, b) with a site of points in each that are within eps of each other."""
    most = chord_of(eps_km)
    whole = F.lit(0).cast("long")
    at = near.where("a < b").select("a", "b", whole.alias("pa"), whole.alias("pb"))
    cut, part, linked = side, whole, None
    for i in range(MOST_CUTS + 1):
        # parts whose hashes are equal are one, which only widens it
        up, part = part, F.xxhash64(*_cubes(cut))
        parts = stored(points.groupBy("cell", up.alias("up"), part.alias("part")).agg(F.count("*").alias("k"), *box()))
        side_of = lambda s: parts.select(F.col("cell").alias(s), F.col("up").alias(f"p{s}"), F.col("part").alias(f"part_{s}"), F.col("k").alias(f"k_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in box_columns()])
        met = at.join(side_of("a"), ["a", "pa"]).join(side_of("b"), ["b", "pb"])
        met = met.withColumns({"gap": gap("a_", "b_"), "span": span("a_", "b_")}).where(F.col("gap") <= most + SLACK)
        nearest = F.min("span").over(Window.partitionBy("a", "b"))
        met = stored(met.withColumn("best", nearest).select("a", "b", F.col("part_a").alias("pa"), F.col("part_b").alias("pb"), (F.col("k_a") * F.col("k_b")).alias("pairs"), "gap", "best"))
        sure = met.where(F.col("best") <= most - SLACK).select("a", "b").distinct()
        open_ = met.where((F.col("best") > most - SLACK) & (F.col("gap") <= F.col("best") + SLACK))
        last = i == MOST_CUTS
        few = open_ if last else open_.where(F.col("pairs") <= FEW_PAIRS)
        own = points.select("cell", part.alias("part"), "latitude", "longitude")
        x = few.join(own.select(F.col("cell").alias("a"), F.col("part").alias("pa"), F.struct("latitude", "longitude").alias("x")), ["a", "pa"])
        x = x.join(own.select(F.col("cell").alias("b"), F.col("part").alias("pb"), F.struct("latitude", "longitude").alias("y")), ["b", "pb"])
        found = stored(sure.unionByName(x.where(_within("x", "y", eps_km)).select("a", "b").distinct()))
        linked = found if linked is None else linked.unionByName(found)
        if last:
            break
        at = stored(open_.where(F.col("pairs") > FEW_PAIRS).select("a", "b", "pa", "pb").join(found, ["a", "b"], "left_anti"))
        if not at.take(1):
            break
        cut /= 4
    return linked


def density_clusters(valid: DataFrame, eps_km: float, min_pts: int) -> DataFrame:
    """(id, cluster) of valid(id, latitude, longitude): clusters are numbered from 1 by their smallest core id; noise is left out.

    A site is core if min_pts sites, itself included, are within eps; a border site joins the cluster of smallest core id of those it is adjacent to."""
    sites = stored(valid.select("id", "latitude", "longitude"))
    if eps_km < 0:  # not even a site's own position
        alone = sites.select("id") if min_pts <= 1 else sites.select("id").limit(0)
        return numbered(alone, ["id"], "cluster").select("id", F.col("cluster").cast("long").alias("cluster"))
    most = chord_of(max(eps_km, LEAST_KM))
    side = (most - 2 * SLACK) / math.sqrt(3)
    points = with_xyz(sites.groupBy("latitude", "longitude").agg(F.min("id").alias("id"), F.count("*").alias("w")))
    points = points.withColumns(dict(zip(_KEY, [*_cubes(side), F.col("id") if eps_km < LEAST_KM else F.lit(0).cast("long")])))
    points = stored(points)
    named = points.groupBy(*_KEY).agg(F.min("id").alias("cell"))
    points = stored(points.join(named, _KEY))
    cells = _cells(points)
    near = stored(_near_cells(cells, most, side))
    # sites of thin cells meet the sites around them; they are counted as they are met
    thin = cells.where(F.col("n") < min_pts).select("cell")
    seekers = points.join(thin, "cell", "left_semi").select(F.col("cell").alias("a"), "id", "latitude", "longitude")

    def met(seekers: DataFrame, around: DataFrame, *columns: str) -> DataFrame:
        s, p = seekers.join(near, "a").alias("s"), around.withColumnRenamed("cell", "b").alias("p")
        return s.join(p, "b").where(_within("s", "p", eps_km)).select("s.id", *[F.col(f"p.{c}") for c in columns])

    enough = met(seekers, points.select("cell", "latitude", "longitude", "w"), "w").groupBy("id").agg(F.sum("w").alias("n")).where(F.col("n") >= min_pts).select("id")
    core = stored(points.join(thin, "cell", "left_anti").unionByName(points.join(enough, "id", "left_semi").select(*points.columns)))
    with_core = core.groupBy("cell").agg(F.min("id").alias("least"))
    both = near.join(with_core.select(F.col("cell").alias("a")), "a", "left_semi").join(with_core.select(F.col("cell").alias("b")), "b", "left_semi")
    part = connected_components(linked_cells(core, both, eps_km, side))
    group = with_core.join(part.withColumnRenamed("node", "cell"), "cell", "left").select("cell", "least", F.coalesce("component", "cell").alias("component"))
    first = group.groupBy("component").agg(F.min("least").alias("first"))
    group = stored(group.join(first, "component").select("cell", "first"))
    cores = core.join(group, "cell").select("id", "first")
    rest = seekers.join(core.select("id"), "id", "left_anti")
    border = met(rest, core.select("cell", "latitude", "longitude").join(group, "cell"), "first").groupBy("id").agg(F.min("first").alias("first"))
    of_position = cores.unionByName(border).join(numbered(group.select("first").distinct(), ["first"], "cluster"), "first").select("id", "cluster")
    placed = points.select("id", "latitude", "longitude").join(of_position, "id").select("latitude", "longitude", "cluster")
    return sites.join(placed, ["latitude", "longitude"]).select("id", F.col("cluster").cast("long").alias("cluster"))
