"""Exact nearest neighbours of all sites, whatever their density.

Sites are cut into cells of equal numbers along a space-filling curve, and cells into
nodes of `fan` cells, so a crowded place has many small cells and an empty one few.
A site's own cell gives a first bound of its k-th distance.  Sites of a cell with like
bounds walk down the nodes together: nodes beyond the bound end, and the farthest
point of any node seen lowers it, since a node has more than k sites.  No radius is
given, and no pairs of a crowded place are made.

Sites at one position have the same neighbours, of which only the k + 1 smallest ids
can be near to anything; so a position counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.scalars import bearing_degrees, compass, haversine_km
from groundwork.functions.sphere import AXES, SLACK, box, box_columns, box_of_boxes, chord, curve_place, gap, numbered, span, with_xyz
from groundwork.plans.scratch import stored

_POINT = ("id", "latitude", "longitude", "elevation", *AXES)


def _candidates(valid: DataFrame, k: int) -> DataFrame:
    """The k + 1 smallest ids of every position, with their place in it, and numbered along the curve."""
    inside = Window.partitionBy("latitude", "longitude").orderBy("id")
    few = valid.withColumn("copy", F.row_number().over(inside)).where(F.col("copy") <= k + 1)
    return numbered(with_xyz(few).withColumn("place", curve_place(F.col("latitude"), F.col("longitude"))), ["place", "id"], "at")


def _nodes(points: DataFrame, leaves: int, fan: int) -> list[tuple[DataFrame, int]]:
    """(node, box) of each level with its number of nodes, from the cells up to at most `fan` nodes."""
    levels = [(stored(points.groupBy(F.col("leaf").alias("node")).agg(*box())), leaves)]
    while levels[-1][1] > fan:
        below, n = levels[-1]
        levels.append((stored(below.withColumn("node", F.floor(F.col("node") / fan)).groupBy("node").agg(*box_of_boxes())), -(-n // fan)))
    return levels


def near_cells(seekers: DataFrame, levels: list[tuple[DataFrame, int]], fan: int) -> DataFrame:
    """(g, leaf, reach): the cells that may hold a k-th neighbour of seekers of group g or of the one seeker `alone`, and the lowered reach.

    A group that meets more than 2 * fan nodes of a level, as thinly spread sites around a crowded place do, goes on as single seekers."""
    ours = box_columns("g_")
    groups = seekers.groupBy("g").agg(F.max("reach").alias("reach"), *box("g_"))
    top = F.sequence(F.lit(0).cast("long"), F.lit(levels[-1][1] - 1).cast("long"))
    at = groups.select("g", "reach", *ours, F.lit(False).alias("single"), F.explode(top).alias("node"))
    of_group = Window.partitionBy("g")
    for i in range(len(levels) - 1, -1, -1):
        boxes = at.join(levels[i][0], "node").select("g", "reach", *ours, "single", "node", gap("g_", "").alias("gap"), span("g_", "").alias("span"))
        lowered = boxes.withColumn("reach", F.least("reach", F.min("span").over(of_group) + SLACK))
        at = lowered.where(F.col("gap") <= F.col("reach") + SLACK).select("g", "reach", *ours, "single", "node")
        if i:
            met = stored(at.withColumn("met", F.count("*").over(of_group)))
            wide = ~F.col("single") & (F.col("met") > 2 * fan)
            point = [F.col(f"s.{c}").alias(f"g_{n}_{c}") for c in AXES for n in ("lo", "hi")]
            apart = met.where(wide).alias("m").join(seekers.alias("s"), "g").select(F.col("s.alone").alias("g"), F.least("m.reach", "s.reach").alias("reach"), *point, F.lit(True).alias("single"), "m.node")
            first = F.col("node") * fan
            below = F.sequence(first, F.least(first + fan - 1, F.lit(levels[i - 1][1] - 1).cast("long")))
            at = met.where(~wide).drop("met").unionByName(apart).withColumn("node", F.explode(below))
    return at.select("g", F.col("node").alias("leaf"), "reach")


def nearest_lists(valid: DataFrame, k: int, cell: int = 32, fan: int = 16) -> tuple[DataFrame, DataFrame]:
    """(latitude, longitude, near) for every position: its k + 1 nearest sites by distance and id, itself included; and the cells looked into by groups of seekers, (g, leaf, reach)."""
    points = stored(_candidates(valid, k))
    n = points.count()
    want, size = min(k + 1, n), max(cell, k + 1)
    leaves = max(n // size, 1)
    points = points.withColumn("leaf", F.expr(f"(at - 1) * {leaves} div {max(n, 1)}")).select(*_POINT, "copy", "leaf")
    points = stored(points)
    seekers = points.where("copy = 1").drop("copy")
    # a cell has at most twice `size` sites
    own = seekers.alias("a").join(points.alias("b"), "leaf").groupBy("a.id").agg(F.sort_array(F.collect_list(chord())).alias("d"))
    bounded = seekers.join(own.select("id", (F.element_at("d", max(want, 1)) + SLACK).alias("reach")), "id")
    # groups whose hashes are equal are one, which only widens it
    scale = F.floor(F.log2("reach")) + 2
    bounded = stored(bounded.withColumns({"g": F.xxhash64("leaf", scale, *[F.floor(F.col(c) / F.pow(F.lit(2.0), scale)) for c in AXES]), "alone": F.xxhash64("id", F.lit("alone"))}))
    levels = _nodes(points, leaves, fan)
    cells = stored(near_cells(bounded, levels, fan))
    mine = bounded.select("id", F.explode(F.array("g", "alone")).alias("g"), "latitude", "longitude", *AXES, F.col("reach").alias("own"), *[F.col(c).alias(f"p_{n}_{c}") for c in AXES for n in ("lo", "hi")])
    asked = mine.join(cells, "g").join(levels[0][0].withColumnRenamed("node", "leaf"), "leaf").withColumn("own", F.least("own", "reach"))
    asked = asked.where(gap("p_", "") <= F.col("own") + SLACK).select("id", "latitude", "longitude", *AXES, "own", "leaf")
    a, b = asked.alias("a"), points.alias("b")
    met = a.join(b, "leaf").where(chord() <= F.col("a.own") + SLACK)
    km = haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    met = met.select(F.col("a.id").alias("seeker"), F.col("a.latitude"), F.col("a.longitude"), km.alias("distance_km"), *[F.col(f"b.{c}").alias(f"b_{c}") for c in _POINT[:4]])
    order = Window.partitionBy("seeker").orderBy("distance_km", "b_id")
    top = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    one = F.struct("rank", "distance_km", "b_id", "b_latitude", "b_longitude", "b_elevation")
    return top.groupBy("latitude", "longitude").agg(F.sort_array(F.collect_list(one)).alias("near")), cells


def nearest(valid: DataFrame, k: int = 5, cell: int = 32, fan: int = 16) -> DataFrame:
    """(id, neighbour, rank, distance_km, bearing, compass, elevation_difference): the k nearest of every site of valid(id, latitude, longitude, elevation), ties by smaller id; none for k <= 0."""
    valid = stored(valid.select("id", *_POINT[1:4]) if k > 0 else valid.select("id", *_POINT[1:4]).limit(0))
    k = max(k, 1)
    lists, _ = nearest_lists(valid, k, cell, fan)
    others = F.slice(F.filter("near", lambda x: x.b_id != F.col("id")), 1, k)
    rows = valid.join(lists, ["latitude", "longitude"]).select("id", "latitude", "longitude", "elevation", F.posexplode(others).alias("at", "o"))
    bearing = bearing_degrees(F.col("latitude"), F.col("longitude"), F.col("o.b_latitude"), F.col("o.b_longitude"))
    return rows.select("id", F.col("o.b_id").alias("neighbour"), (F.col("at") + 1).alias("rank"), "o.distance_km", bearing.alias("bearing"), compass(bearing).alias("compass"), (F.col("o.b_elevation") - F.col("elevation")).alias("elevation_difference"))
