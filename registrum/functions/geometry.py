"""Planar geometry over arrays. A ring is array<struct<x, y>>, a polygon array<ring> (outer, then holes), a geometry array<polygon>.

The rules are the register's: even-odd rays with half-open edges, crossings by strict orientation signs, boxes that may touch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x: double, y: double>>"
GEOMETRY = f"array<array<{RING}>>"


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def edges(ring: Column) -> Column:
    """a, b of every edge, closing the ring."""
    return F.transform(ring, lambda p, i: F.struct(F.when(i == 0, F.element_at(ring, -1)).otherwise(F.get(ring, i - 1)).alias("a"), p.alias("b")))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        run = F.when(b["y"] == a["y"], F.lit(None)).otherwise((a["x"] - b["x"]) * (y - b["y"]) / (a["y"] - b["y"]) + b["x"])
        return ((b["y"] > y) != (a["y"] > y)) & F.coalesce(x < run, F.lit(False))

    odd = F.aggregate(edges(ring), F.lit(False), lambda inside, e: inside != crosses(e))
    return (F.size(ring) >= 3) & odd


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return (F.size(polygon) > 0) & point_in_ring(x, y, F.get(polygon, F.lit(0))) & ~F.exists(holes, lambda r: point_in_ring(x, y, r))


def point_in_geometry(x: Column, y: Column, geometry: Column) -> Column:
    return F.exists(geometry, lambda p: point_in_polygon(x, y, p))


def bbox(geometry: Column) -> Column:
    """Box of all outer rings; empty: zeros."""
    pts = F.flatten(F.transform(geometry, lambda p: F.flatten(p)))
    m = lambda f, c: F.coalesce(f(F.transform(pts, lambda q: q[c])), F.lit(0.0))
    return F.struct(m(F.array_min, "x").alias("x0"), m(F.array_min, "y").alias("y0"), m(F.array_max, "x").alias("x1"), m(F.array_max, "y").alias("y1"))


def boxes_overlap(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def _turn(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def segments_cross(s: Column, t: Column) -> Column:
    """Each parts the other's ends; an orientation of zero counts as not positive."""
    up = lambda a, b, c: _turn(a, b, c) > 0
    return (up(s["a"], s["b"], t["a"]) != up(s["a"], s["b"], t["b"])) & (up(t["a"], t["b"], s["a"]) != up(t["a"], t["b"], s["b"]))


def polygons_intersect(p: Column, q: Column) -> Column:
    outer = lambda x: F.coalesce(F.get(x, F.lit(0)), F.array().cast(RING))
    inside = lambda a, b: F.exists(outer(a), lambda v: point_in_polygon(v["x"], v["y"], b))
    crossing = F.exists(edges(outer(p)), lambda e: F.exists(edges(outer(q)), lambda f: segments_cross(e, f)))
    return inside(p, q) | inside(q, p) | crossing


def geometries_intersect(a: Column, b: Column, box_a: Column, box_b: Column) -> Column:
    """Boxes first, then polygons."""
    return boxes_overlap(box_a, box_b) & F.exists(a, lambda p: F.exists(b, lambda q: polygons_intersect(p, q)))


def from_geojson(json: Column) -> Column:
    """The polygons of a GeoJSON geometry text; other types have none."""
    point = "array<double>"
    kind = F.get_json_object(json, "$.type")
    coords = F.get_json_object(json, "$.coordinates")
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    polygon = lambda p: F.transform(p, ring)
    one = F.array(polygon(F.from_json(coords, f"array<array<{point}>>")))
    many = F.transform(F.from_json(coords, f"array<array<array<{point}>>>"), polygon)
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).otherwise(F.array().cast(GEOMETRY))
