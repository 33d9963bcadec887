"""Spatial joins: points in polygons and nearest objects, on grid cells instead of cross joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barrow.functions import geo
from barrow.session import cut


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 0.25) -> DataFrame:
    """GEO-13: (point_id, polygon_id) of points(point_id, lat, lon) inside polygons(polygon_id, ring).

    Polygons are copied into the grid cells their bounding box covers, so candidates come from an equi-join on cells.
    Rings of fewer than three points hold nothing; null coordinates are nowhere.
    """
    at = lambda c: F.floor(c / cell).cast("long")
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    boxed = polygons.where(F.size("ring") > 2).select("polygon_id", "ring", F.explode(F.sequence(at(F.array_min(lats)), at(F.array_max(lats)))).alias("cy"), F.sequence(at(F.array_min(lons)), at(F.array_max(lons))).alias("cxs"))
    boxed = boxed.select("polygon_id", "ring", "cy", F.explode("cxs").alias("cx"))
    placed = points.where("lat is not null and lon is not null").select("point_id", "lat", "lon", at(F.col("lat")).alias("cy"), at(F.col("lon")).alias("cx"))
    return placed.join(boxed, ["cy", "cx"]).where(geo.inside(F.col("ring"), F.col("lat"), F.col("lon"))).select("point_id", "polygon_id").distinct()

#: Radii in km of the rounds of nearest(); the last is half the way round the earth.
ROUNDS = (0.5, 8.0, 128.0, 2048.0, 20040.0)
EARTH_KM = 6371.0088


def segments(shapes: DataFrame, key: str) -> DataFrame:
    """(key, lat1, lon1, lat2, lon2) of shapes(key, ring): one point is a segment of no length, two a line, more a closed ring.

    Points without both coordinates are left out.
    """
    ring = F.filter("ring", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    held = shapes.select(F.col(key), ring.alias("_r")).where(F.size("_r") > 0)
    ends = F.when(F.size("_r") > 2, F.concat(F.slice("_r", 2, F.size("_r") - 1), F.slice("_r", 1, 1))).when(F.size("_r") == 2, F.slice("_r", 2, 1)).otherwise(F.col("_r"))
    starts = F.when(F.size("_r") == 2, F.slice("_r", 1, 1)).otherwise(F.col("_r"))
    sides = F.zip_with(starts, ends, lambda a, b: F.struct(a["lat"].alias("lat1"), a["lon"].alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2")))
    return held.select(key, F.inline(sides))


def side_km(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Distance in km of two segments (lat1, lon1, lat2, lon2): 0 if they cross, else the least great-circle distance of an
    end of one to the nearest place of the other, found on the plane with longitudes shrunk at their middle latitude."""
    shrink = F.cos(F.radians((a[0] + b[0]) / 2))

    def to(lat: Column, lon: Column, s: tuple[Column, ...]) -> Column:
        dy, dx = s[2] - s[0], (s[3] - s[1]) * shrink
        size = dy * dy + dx * dx
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lat - s[0]) * dy + (lon - s[1]) * shrink * dx) / size))).otherwise(0.0)
        return geo.haversine(lat, lon, s[0] + t * (s[2] - s[0]), s[1] + t * (s[3] - s[1]))

    crossed = geo.crosses(a[:2], a[2:], b[:2], b[2:])
    least = F.least(to(a[0], a[1], b), to(a[2], a[3], b), to(b[0], b[1], a), to(b[2], b[3], a))
    return F.when(crossed, F.lit(0.0)).otherwise(least)


_SIDE = ("lat1", "lon1", "lat2", "lon2")


def _bands(low: Column, high: Column, left: Column, right: Column, km: float) -> Column:
    """array<struct<cy,cx>> of the grid cells of a round that a box of degrees covers.

    Bands of latitude are as high as the radius; the cells of a band are as wide as the radius is at its latitude nearest
    to a pole, so the radius never reaches beyond the next cell.
    """
    angle = km / EARTH_KM
    height = math.degrees(angle)

    def width(cy: Column) -> Column:
        top = F.greatest(F.abs(cy * height), F.abs((cy + 1) * height))
        share = math.sin(min(angle, math.pi / 2)) / F.cos(F.radians(F.least(top, F.lit(90.0))))
        return F.when((top >= 90) | (share >= 1), F.lit(360.0)).otherwise(F.greatest(F.degrees(F.asin(F.least(share, F.lit(1.0)))), F.lit(1e-6)))

    rows = F.sequence(F.floor(low / height).cast("long"), F.floor(high / height).cast("long"))
    cells = F.transform(rows, lambda cy: F.transform(F.sequence(F.floor(left / width(cy)).cast("long"), F.floor(right / width(cy)).cast("long")), lambda cx: F.struct(cy.alias("cy"), cx.alias("cx"))))
    return F.flatten(cells)


def _short(sides: DataFrame, key: str, km: float) -> DataFrame:
    """Segments cut into parts of at most eight radii, so that a long slanting one does not fill its whole box with cells."""
    parts = F.greatest(F.lit(1), F.ceil(geo.haversine(*[F.col(c) for c in _SIDE]) / (8 * km)).cast("int"))
    pieces = sides.select("*", parts.alias("_n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_k"))
    at = lambda a, b, k: F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    return pieces.select(key, *_SIDE, at("lat1", "lat2", F.col("_k")).alias("_a"), at("lon1", "lon2", F.col("_k")).alias("_b"), at("lat1", "lat2", F.col("_k") + 1).alias("_c"), at("lon1", "lon2", F.col("_k") + 1).alias("_d"))


def _placed(sides: DataFrame, key: str, km: float, reach: float) -> DataFrame:
    """Segments in the grid cells of a round, their boxes widened by `reach` km."""
    angle = reach / EARTH_KM
    low, high = F.least("_a", "_c") - math.degrees(angle), F.greatest("_a", "_c") + math.degrees(angle)
    share = math.sin(min(angle, math.pi / 2)) / F.cos(F.radians(F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))))
    wide = F.when((F.greatest(F.abs(low), F.abs(high)) >= 90) | (share >= 1), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(share, F.lit(1.0)))))
    left, right = F.greatest(F.least("_b", "_d") - wide, F.lit(-180.0)), F.least(F.greatest("_b", "_d") + wide, F.lit(180.0))
    boxed = _short(sides, key, km)
    cells = _bands(F.greatest(low, F.lit(-90.0)), F.least(high, F.lit(90.0)), left, right, km)
    return boxed.select(key, *_SIDE, F.inline(cells)).distinct()


def nearest(shapes: DataFrame, targets: DataFrame, places: int = 6) -> DataFrame:
    """GEO-14, AGG-05: the nearest target of each shape: (shape_id, target_id, km), km rounded to `places`, ties to the smaller id.

    shapes(shape_id, ring), targets(target_id, ring), ring array<struct<lat,lon>>, one or more rows for an id; a target of
    the shape's own id does not count. Distances are those of shapes: 0 where they cross or one lies in the other, else
    from the nearest places of their edges. Every shape gets its nearest target, however far: rounds of growing radius
    join segments by grid cells, and a shape whose nearest is within the radius is done, for nothing nearer can be outside.
    Longitudes run from -180 to 180 and distances are not taken across the date line. Shapes without points and shapes
    without any other target have no row.
    """
    own = cut(segments(shapes, "shape_id").distinct())
    theirs = cut(segments(targets, "target_id").distinct())
    first = lambda df, key: df.where(F.size("ring") > 0).select(F.col(key).alias("point_id"), F.col("ring")[0]["lat"].alias("lat"), F.col("ring")[0]["lon"].alias("lon"))
    within = points_in_polygons(first(shapes, "shape_id"), targets.select(F.col("target_id").alias("polygon_id"), "ring")).select(F.col("point_id").alias("shape_id"), F.col("polygon_id").alias("target_id"))
    around = points_in_polygons(first(targets, "target_id"), shapes.select(F.col("shape_id").alias("polygon_id"), "ring")).select(F.col("polygon_id").alias("shape_id"), F.col("point_id").alias("target_id"))
    zero = within.unionByName(around).where("shape_id <> target_id").groupBy("shape_id").agg(F.min("target_id").alias("target_id")).withColumn("km", F.lit(0.0))
    zero = cut(zero)
    done = []
    for km in ROUNDS:
        # Shapes may differ from their targets by a rounding; half a metre more is looked at than is believed.
        left = _placed(own, "shape_id", km, km + 5e-4).withColumnsRenamed({c: f"s_{c}" for c in _SIDE})
        pairs = left.join(_placed(theirs, "target_id", km, 0.0), ["cy", "cx"]).where("shape_id <> target_id")
        far = F.round(side_km(tuple(F.col(f"s_{c}") for c in _SIDE), tuple(F.col(c) for c in _SIDE)), places)
        best = pairs.select("shape_id", F.struct(far.alias("km"), "target_id").alias("m")).groupBy("shape_id").agg(F.min("m").alias("m")).where(F.col("m.km") <= km)
        found = cut(best.select("shape_id", "m.target_id", "m.km"))
        done.append(found)
        own = cut(own.join(found.select("shape_id"), "shape_id", "left_anti"))
        if own.isEmpty():
            break
    every = reduce(DataFrame.unionByName, [zero.select("shape_id", "target_id", "km"), *done])
    return every.groupBy("shape_id").agg(F.min(F.struct("km", "target_id")).alias("m")).select("shape_id", "m.target_id", "m.km")


#: Segments that the shapes of one report may have; they are sent to every task.
MOST_SIDES = 100_000


def proximity(offer: DataFrame, cards: DataFrame, metric=geo.haversine, places: int = 6) -> DataFrame:
    """GEO-14, SRT-02: (card_id, km): the least distance of every card to one offer, all shapes of both compared.

    offer(ring), cards(card_id, ring), one row for each shape. The nearest places of two shapes are found on the plane of
    degrees, the distance is the metric between them; 0 where they cross or one lies in the other. An offer is one document:
    its segments are counted and broadcast; more than MOST_SIDES are an error. Cards are not shuffled but by their id.
    """
    keyed = offer.withColumn("_o", F.monotonically_increasing_id())
    own = cut(segments(keyed, "_o").withColumnsRenamed({c: f"o_{c}" for c in _SIDE}))
    if own.count() > MOST_SIDES:
        raise ValueError("one offer has more segments than a task can keep")
    numbered = cards.select("card_id", "ring", F.xxhash64("card_id", F.to_json("ring")).alias("_c"))
    sides = segments(numbered.select(F.struct("card_id", "_c").alias("_k"), "ring"), "_k").select("_k.card_id", "_k._c", *_SIDE)
    a, b = tuple(F.col(f"o_{c}") for c in _SIDE), tuple(F.col(c) for c in _SIDE)

    def place(lat: Column, lon: Column, s: tuple[Column, ...]) -> Column:
        dy, dx = s[2] - s[0], s[3] - s[1]
        size = dy * dy + dx * dx
        t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lat - s[0]) * dy + (lon - s[1]) * dx) / size))).otherwise(0.0)
        y, x = s[0] + t * dy, s[1] + t * dx
        return F.struct(((lat - y) * (lat - y) + (lon - x) * (lon - x)).alias("d"), lat.alias("y1"), lon.alias("x1"), y.alias("y2"), x.alias("x2"))

    crossed = F.when(geo.crosses(a[:2], a[2:], b[:2], b[2:]), F.struct(F.lit(0.0).alias("d"), a[0].alias("y1"), a[1].alias("x1"), a[0].alias("y2"), a[1].alias("x2")))
    near = F.coalesce(crossed, F.array_min(F.array(place(a[0], a[1], b), place(a[2], a[3], b), place(b[0], b[1], a), place(b[2], b[3], a))))
    best = sides.join(F.broadcast(own)).groupBy("card_id", "_c", "_o").agg(F.min(near).alias("m"))
    told = best.select("card_id", metric(F.col("m.y1"), F.col("m.x1"), F.col("m.y2"), F.col("m.x2")).alias("km"))
    first = lambda df, key: df.where(F.size("ring") > 0).select(F.col(key).alias("point_id"), F.col("ring")[0]["lat"].alias("lat"), F.col("ring")[0]["lon"].alias("lon"))
    inner = points_in_polygons(first(numbered, "card_id"), keyed.select(F.col("_o").alias("polygon_id"), "ring")).select(F.col("point_id").alias("card_id"))
    outer = points_in_polygons(first(keyed, "_o"), numbered.select(F.col("card_id").alias("polygon_id"), "ring")).select(F.col("polygon_id").alias("card_id"))
    zero = inner.unionByName(outer).distinct().withColumn("km", F.lit(0.0))
    return told.unionByName(zero).groupBy("card_id").agg(F.round(F.min("km"), places).alias("km"))
