"""Geometric types as structs, cubes as arrays, and distances on the earth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.base import Registry

R = Registry()
EARTH_METERS = 6378168.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def box(a: Column, b: Column) -> Column:
    """By any two opposite corners; high holds the larger coordinates."""
    pick = lambda f: point(f(a["x"], b["x"]), f(a["y"], b["y"]))
    return F.struct(pick(F.greatest).alias("high"), pick(F.least).alias("low"))


def box_width(b: Column) -> Column:
    return b["high"]["x"] - b["low"]["x"]


def box_height(b: Column) -> Column:
    return b["high"]["y"] - b["low"]["y"]


def box_area(b: Column) -> Column:
    return box_width(b) * box_height(b)


def box_center(b: Column) -> Column:
    return point((b["high"]["x"] + b["low"]["x"]) / 2, (b["high"]["y"] + b["low"]["y"]) / 2)


def box_contains(b: Column, p: Column) -> Column:
    return p["x"].between(b["low"]["x"], b["high"]["x"]) & p["y"].between(b["low"]["y"], b["high"]["y"])


def box_overlaps(a: Column, b: Column) -> Column:
    return (a["low"]["x"] <= b["high"]["x"]) & (b["low"]["x"] <= a["high"]["x"]) & (a["low"]["y"] <= b["high"]["y"]) & (b["low"]["y"] <= a["high"]["y"])


def box_intersection(a: Column, b: Column) -> Column:
    low = point(F.greatest(a["low"]["x"], b["low"]["x"]), F.greatest(a["low"]["y"], b["low"]["y"]))
    high = point(F.least(a["high"]["x"], b["high"]["x"]), F.least(a["high"]["y"], b["high"]["y"]))
    return F.when(box_overlaps(a, b), F.struct(high.alias("high"), low.alias("low")))


def circle(center: Column, radius: Column) -> Column:
    return F.struct(center.alias("center"), radius.cast("double").alias("radius"))


def circle_area(c: Column) -> Column:
    return F.pi() * c["radius"] * c["radius"]


def diameter(c: Column) -> Column:
    return 2 * c["radius"]


def circle_contains(c: Column, p: Column) -> Column:
    return distance(c["center"], p) <= c["radius"]


def circle_distance(a: Column, b: Column) -> Column:
    return F.greatest(distance(a["center"], b["center"]) - a["radius"] - b["radius"], F.lit(0.0))


def slope(a: Column, b: Column) -> Column:
    return F.when(a["x"] != b["x"], (a["y"] - b["y"]) / (F.nullif(a["x"] - b["x"], F.lit(0.0))))


def segment_distance(s: Column, e: Column, p: Column) -> Column:
    """From a point to the segment between two points."""
    dx, dy = e["x"] - s["x"], e["y"] - s["y"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, ((p["x"] - s["x"]) * dx + (p["y"] - s["y"]) * dy) / F.nullif(n, F.lit(0.0))).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(p["x"] - (s["x"] + t * dx), p["y"] - (s["y"] + t * dy))


def polygon_area(points: Column) -> Column:
    """By the shoelace sum over an array of points."""
    after = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def polygon_contains(points: Column, p: Column) -> Column:
    """Crossing count of a ray to the right."""
    after = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    crosses = F.zip_with(
        points, after,
        lambda a, b: (((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])).cast("int"),
    )
    return F.aggregate(crosses, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 2 == 1


# cubes are arrays of coordinates


def cube_distance(a: Column, b: Column, kind: str = "euclid") -> Column:
    d = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    if kind == "taxicab":
        return F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
    if kind == "chebyshev":
        return F.array_max(d)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def cube_subset(a: Column, *dims: int) -> Column:
    return F.array(*(F.element_at(a, d) for d in dims))


def earth_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in meters."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_METERS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


@R.frame(
    "F_geo_basic",
    """SELECT n_nationkey AS k, round(sqrt((n_nationkey - 3) * (n_nationkey - 3) + (n_regionkey - 4) * (n_regionkey - 4)), 9) AS d, n_nationkey <= 10 AND n_regionkey <= 2 AS inside,
       CAST(abs(n_nationkey - 20) * abs(n_regionkey - 9) AS DOUBLE) AS area, sqrt(n_nationkey * n_nationkey + n_regionkey * n_regionkey) <= 6 AS near FROM nation""",
)
def _basic(t):
    p = point(F.col("n_nationkey"), F.col("n_regionkey"))
    at = lambda x, y: point(F.lit(x), F.lit(y))
    return t.nation.select(
        F.col("n_nationkey").alias("k"), F.round(distance(p, at(3, 4)), 9).alias("d"), box_contains(box(at(10, 2), at(0, 0)), p).alias("inside"),
        box_area(box(p, at(20, 9))).alias("area"), circle_contains(circle(at(0, 0), F.lit(6)), p).alias("near"),
    )


@R.frame("F_geo_polygon", "SELECT n_nationkey AS k, CAST((n_nationkey + 1) * (n_nationkey + 1) AS DOUBLE) AS a, n_nationkey + 1 > 5.5 AS c FROM nation")
def _polygon(t):
    n = F.col("n_nationkey") + 1
    square = F.array(point(F.lit(0), F.lit(0)), point(n, F.lit(0)), point(n, n), point(F.lit(0), n))
    return t.nation.select(F.col("n_nationkey").alias("k"), polygon_area(square).alias("a"), polygon_contains(square, point(F.lit(5.5), F.lit(5.5))).alias("c"))


@R.frame(
    "F_geo_cube",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS e, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS t,
       round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS c FROM embeddings""",
)
def _cube(t):
    zero = F.transform("embedding", lambda x: F.lit(0.0))
    return t.embeddings.select("vec_id", *(F.round(cube_distance(F.col("embedding"), zero, k), 6).alias(k[0]) for k in ("euclid", "taxicab", "chebyshev")))


@R.frame(
    "F_geo_earth",
    """SELECT n_nationkey AS k, round(2 * 6378168.0 * asin(sqrt(pow(sin(radians(n_nationkey) / 2), 2) + cos(radians(n_nationkey)) * pow(sin(radians(n_regionkey * 10) / 2), 2))), 3) AS d FROM nation""",
)
def _earth(t):
    zero = F.lit(0.0)
    return t.nation.select(F.col("n_nationkey").alias("k"), F.round(earth_distance(zero, zero, F.col("n_nationkey"), F.col("n_regionkey") * 10), 3).alias("d"))
