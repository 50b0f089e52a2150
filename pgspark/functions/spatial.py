"""Shapes as GeoJSON-like structs: ``struct<type:string, rings:array<array<struct<x,y>>>, crs:string>``.

A point is one ring of one position, a line one ring, a polygon an outer ring and
holes. All functions are Column expressions; containment casts a ray.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
WGS84 = "EPSG:4326"


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def st_point(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.array(_xy(x, y))).alias("rings"), F.lit(WGS84).alias("crs"))


def st_makepolygon(positions: Column) -> Column:
    """From an array of (x, y) structs; the ring is closed if it is open."""
    first = F.get(positions, F.lit(0))
    ring = F.when(F.try_element_at(positions, F.lit(-1)) == first, positions).otherwise(F.concat(positions, F.array(first)))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("rings"), F.lit(WGS84).alias("crs"))


def st_geomfromgeojson(text: Column) -> Column:
    """Points, lines and polygons."""
    kind = F.get_json_object(text, "$.type")
    at = F.get_json_object(text, "$.coordinates")
    ring = lambda r: F.transform(r, lambda p: _xy(p[0], p[1]))
    point = F.array(ring(F.array(F.from_json(at, "array<double>"))))
    line = F.array(ring(F.from_json(at, "array<array<double>>")))
    polygon = F.transform(F.from_json(at, "array<array<array<double>>>"), ring)
    rings = F.when(kind == "Point", point).when(kind == "LineString", line).when(kind == "Polygon", polygon)
    return F.when(rings.isNotNull(), F.struct(kind.alias("type"), rings.alias("rings"), F.lit(WGS84).alias("crs")))


def st_asgeojson(g: Column) -> Column:
    pair = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, pair), ","), F.lit("]"))
    at = F.when(g["type"] == "Point", pair(g["rings"][0][0])).when(g["type"] == "LineString", ring(g["rings"][0])).otherwise(F.concat(F.lit("["), F.array_join(F.transform(g["rings"], ring), ","), F.lit("]")))
    return F.concat(F.lit('{"type":"'), g["type"], F.lit('","coordinates":'), at, F.lit("}"))


def st_x(g: Column) -> Column:
    return F.when(g["type"] == "Point", g["rings"][0][0]["x"])


def st_y(g: Column) -> Column:
    return F.when(g["type"] == "Point", g["rings"][0][0]["y"])


def st_geometrytype(g: Column) -> Column:
    return g["type"]


def st_isvalid(g: Column) -> Column:
    """Not empty, and every polygon ring closed with at least four positions."""
    closed = F.forall(g["rings"], lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.try_element_at(r, F.lit(-1))))
    filled = (F.size(g["rings"]) > 0) & F.forall(g["rings"], lambda r: F.size(r) > 0)
    return filled & ((g["type"] != "Polygon") | closed)


def st_distancesphere(a: Column, b: Column) -> Column:
    """Great-circle metres between two points."""
    y1, y2 = F.radians(st_y(a)), F.radians(st_y(b))
    dx = F.radians(st_x(b) - st_x(a))
    h = F.pow(F.sin((y2 - y1) / 2), 2) + F.cos(y1) * F.cos(y2) * F.pow(F.sin(dx / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def _positions(g: Column) -> Column:
    return F.flatten(g["rings"])


def st_distance(a: Column, b: Column) -> Column:
    """Metres between two WGS84 points; else the least planar distance between positions."""
    planar = F.array_min(F.flatten(F.transform(_positions(a), lambda p: F.transform(_positions(b), lambda q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))))))
    points = (a["type"] == "Point") & (b["type"] == "Point") & (a["crs"] == WGS84) & (b["crs"] == WGS84)
    return F.when(points, st_distancesphere(a, b)).otherwise(planar)


def st_dwithin(a: Column, b: Column, d: Column) -> Column:
    return st_distance(a, b) <= d


def st_equals(a: Column, b: Column) -> Column:
    return (a["rings"] == b["rings"]) & (a["crs"] == b["crs"])


def _steps(ring: Column) -> Column:
    """Consecutive positions (p, q) of a ring."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.transform(F.arrays_zip(F.slice(ring, F.lit(1), n).alias("p"), F.slice(ring, F.lit(2), n).alias("q")), lambda s: s)


def _inside(ring: Column, p: Column) -> Column:
    """Ray casting: an odd number of crossings to the right."""
    crossed = F.filter(_steps(ring), lambda s: ((s["p"]["y"] > p["y"]) != (s["q"]["y"] > p["y"])) & (p["x"] < (s["q"]["x"] - s["p"]["x"]) * (p["y"] - s["p"]["y"]) / F.nullif(s["q"]["y"] - s["p"]["y"], F.lit(0.0)) + s["p"]["x"]))
    return F.size(crossed) % 2 == 1


def st_contains(g: Column, other: Column) -> Column:
    """Every position of ``other`` is in the outer ring and in no hole."""
    outer, holes = g["rings"][0], F.slice(g["rings"], F.lit(2), F.greatest(F.size(g["rings"]) - 1, F.lit(0)))
    return (g["type"] == "Polygon") & F.forall(_positions(other), lambda p: _inside(outer, p) & ~F.exists(holes, lambda h: _inside(h, p)))


def st_within(a: Column, b: Column) -> Column:
    return st_contains(b, a)


def st_envelope(g: Column) -> Column:
    xs, ys = F.transform(_positions(g), lambda p: p["x"]), F.transform(_positions(g), lambda p: p["y"])
    a, b, c, d = F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)
    ring = F.array(_xy(a, b), _xy(c, b), _xy(c, d), _xy(a, d), _xy(a, b))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("rings"), g["crs"].alias("crs"))


def _boxes_meet(a: Column, b: Column) -> Column:
    e, f = st_envelope(a)["rings"][0], st_envelope(b)["rings"][0]
    return (e[0]["x"] <= f[2]["x"]) & (f[0]["x"] <= e[2]["x"]) & (e[0]["y"] <= f[2]["y"]) & (f[0]["y"] <= e[2]["y"])


def _turn(p: Column, q: Column, r: Column) -> Column:
    return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))


def st_intersects(a: Column, b: Column) -> Column:
    """Boxes meet, and a position lies inside the other or two sides cross."""
    sides = lambda g: F.flatten(F.transform(g["rings"], _steps))
    crossing = F.exists(sides(a), lambda s: F.exists(sides(b), lambda t: (_turn(s["p"], s["q"], t["p"]) != _turn(s["p"], s["q"], t["q"])) & (_turn(t["p"], t["q"], s["p"]) != _turn(t["p"], t["q"], s["q"]))))
    touching = lambda g, h: (g["type"] == "Polygon") & F.exists(_positions(h), lambda p: _inside(g["rings"][0], p))
    return _boxes_meet(a, b) & (crossing | touching(a, b) | touching(b, a) | (a["rings"] == b["rings"]))


def st_area(g: Column) -> Column:
    """Planar area: the outer ring less the holes; 0 for points and lines."""
    ring = lambda r: F.abs(F.aggregate(_steps(r), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2
    areas = F.transform(g["rings"], ring)
    return F.when(g["type"] == "Polygon", 2 * areas[0] - F.aggregate(areas, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def st_length(g: Column) -> Column:
    """Planar length of all rings; 0 for points."""
    ring = lambda r: F.aggregate(_steps(r), F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e["q"]["x"] - e["p"]["x"], 2) + F.pow(e["q"]["y"] - e["p"]["y"], 2)))
    return F.aggregate(F.transform(g["rings"], ring), F.lit(0.0), lambda s, x: s + x)


FUNCTIONS = {f.__name__: f for f in (st_point, st_geomfromgeojson, st_makepolygon, st_x, st_y, st_geometrytype, st_isvalid, st_asgeojson, st_contains, st_within, st_intersects, st_equals, st_dwithin, st_distance, st_distancesphere, st_area, st_length, st_envelope)}
