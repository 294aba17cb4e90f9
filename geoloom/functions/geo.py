"""Geometry as column expressions over parsed WKT.

A geometry is a struct (kind, rings, west, south, east, north); rings is an
array of arrays of (x, y), degrees of longitude and latitude. A point is one
ring of one vertex, a line one open ring, a polygon its outer ring and holes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Metres of a degree of latitude on that sphere.
DEGREE_M = EARTH_M * math.pi / 180
NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def parsed(wkt: Column) -> Column:
    """POINT, LINESTRING, POLYGON and their MULTI forms; null for other text. A polygon counts before a line in mixed text."""
    kind = F.when(wkt.contains("POLYGON"), "polygon").when(wkt.contains("LINESTRING"), "line").when(wkt.contains("POINT"), "point")
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    vertices = lambda ring: F.transform(
        F.regexp_extract_all(ring, F.lit(rf"({NUMBER}\s+{NUMBER})"), F.lit(1)),
        lambda v: F.struct(F.split(v, r"\s+")[0].cast("double").alias("x"), F.split(v, r"\s+")[1].cast("double").alias("y")),
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.transform(rings, vertices).alias("rings")))


def with_geometry(df, wkt: str = "wkt"):
    """df with the column geom, parsed once, and its box."""
    flat = F.flatten(F.col("g_.rings"))
    xs, ys = F.transform(flat, lambda v: v["x"]), F.transform(flat, lambda v: v["y"])
    box = [f(c).alias(n) for f, c, n in ((F.array_min, xs, "west"), (F.array_min, ys, "south"), (F.array_max, xs, "east"), (F.array_max, ys, "north"))]
    return df.withColumn("g_", parsed(F.col(wkt))).withColumn("geom", F.when(F.col("g_").isNotNull() & (F.size(flat) > 0), F.struct("g_.kind", "g_.rings", *box))).drop("g_")


def point_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Metres along the great circle (haversine)."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2))
    a = half(y2 - y1) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * half(x2 - x1)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def edges(geom: Column) -> Column:
    """The edges (a, b) of all rings; a point's edge runs from it to itself."""
    of = lambda ring: F.when(F.size(ring) == 1, F.transform(ring, lambda v: F.struct(v.alias("a"), v.alias("b")))).otherwise(
        F.transform(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), lambda v, i: F.struct(v.alias("a"), F.get(ring, i + 1).alias("b")))
    )
    return F.flatten(F.transform(geom["rings"], of))


def vertices(geom: Column) -> Column:
    return F.flatten(geom["rings"])


def local(x: Column, y: Column, x0: Column, y0: Column) -> tuple[Column, Column]:
    """Metres east and north of (x0, y0) on the tangent plane, the short way round."""
    east = x - x0
    east = F.when(east > 180, east - 360).when(east < -180, east + 360).otherwise(east)
    return east * F.cos(F.radians(y0)) * DEGREE_M, (y - y0) * DEGREE_M


def plane_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to an edge of a plane."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / square))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _local(v: Column, x0: Column, y0: Column) -> tuple[Column, Column]:
    return local(v["x"], v["y"], x0, y0)


def _to_edge(px: Column, py: Column, e: Column, x0: Column, y0: Column) -> Column:
    return plane_distance(px, py, *_local(e["a"], x0, y0), *_local(e["b"], x0, y0))


def to_edge(v: Column, e: Column, x0: Column, y0: Column) -> Column:
    """Metres from a vertex to an edge on the plane that touches (x0, y0)."""
    return _to_edge(*_local(v, x0, y0), e, x0, y0)


def box_distance(x: Column, y: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Metres that no point of the box is nearer to (x, y) than: the least differences of latitude and longitude with the least cosine."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2))
    gap = lambda v, low, high: F.greatest(F.lit(0.0), low - v, v - high)
    across = F.least(gap(x, west, east), gap(x + 360, west, east), gap(x - 360, west, east))
    highest = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(north)))
    a = half(gap(y, south, north)) + F.greatest(F.lit(0.0), F.cos(F.radians(y)) * F.cos(F.radians(highest))) * half(across)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _side(a: Column, b: Column, c: Column) -> Column:
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def crosses(e: Column, f: Column) -> Column:
    """The edges meet in one point inside both."""
    return (_side(e["a"], e["b"], f["a"]) * _side(e["a"], e["b"], f["b"]) < 0) & (_side(f["a"], f["b"], e["a"]) * _side(f["a"], f["b"], e["b"]) < 0)


def on_edge(v: Column, e: Column) -> Column:
    between = lambda p, a, b: (p >= F.least(a, b)) & (p <= F.greatest(a, b))
    return (F.abs(_side(e["a"], e["b"], v)) < 1e-12) & between(v["x"], e["a"]["x"], e["b"]["x"]) & between(v["y"], e["a"]["y"], e["b"]["y"])


def on_boundary(v: Column, geom: Column) -> Column:
    return F.exists(edges(geom), lambda e: on_edge(v, e))


def inside(v: Column, geom: Column) -> Column:
    """Within a polygon's rings by parity, holes counting; the boundary is not told apart."""
    hit = lambda e: ((e["a"]["y"] > v["y"]) != (e["b"]["y"] > v["y"])) & (
        v["x"] < (e["b"]["x"] - e["a"]["x"]) * (v["y"] - e["a"]["y"]) / F.when(e["b"]["y"] == e["a"]["y"], F.lit(1.0)).otherwise(e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
    )
    return F.size(F.filter(edges(geom), hit)) % 2 == 1


def within(a: Column, b: Column) -> Column:
    """All of a lies in the polygon b and some of it in b's interior; contact with the boundary alone is not enough."""
    middle = lambda e: F.struct(((e["a"]["x"] + e["b"]["x"]) / 2).alias("x"), ((e["a"]["y"] + e["b"]["y"]) / 2).alias("y"))
    points = F.concat(vertices(a), F.transform(edges(a), middle))
    covered = F.forall(points, lambda v: on_boundary(v, b) | inside(v, b))
    interior = F.exists(points, lambda v: inside(v, b) & ~on_boundary(v, b)) | ((a["kind"] == "polygon") & covered)
    cut = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: crosses(e, f)))
    return (b["kind"] == "polygon") & covered & interior & ~cut


def distance(a: Column, b: Column) -> Column:
    """Metres between two geometries: great circle between points, else least distance of their edges on the tangent plane, 0 where they touch."""
    va, vb = vertices(a), vertices(b)
    x0, y0 = F.get(vb, F.lit(0))["x"], F.get(vb, F.lit(0))["y"]
    to = lambda points, other: F.array_min(F.flatten(F.transform(points, lambda v: F.transform(edges(other), lambda e: _to_edge(*_local(v, x0, y0), e, x0, y0)))))
    touch = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: crosses(e, f)))
    held = ((b["kind"] == "polygon") & inside(F.get(va, F.lit(0)), b)) | ((a["kind"] == "polygon") & inside(F.get(vb, F.lit(0)), a))
    points = (a["kind"] == "point") & (b["kind"] == "point")
    first = lambda v, k: F.get(v, F.lit(0))[k]
    return F.when(points, point_distance(first(va, "x"), first(va, "y"), first(vb, "x"), first(vb, "y"))).when(touch | held, F.lit(0.0)).otherwise(F.least(to(va, b), to(vb, a)))


def _row(j: Column, cell: float, reach: float) -> Column:
    """The least cosine of the latitudes of a grid row and reach degrees around it."""
    highest = F.greatest(F.abs(j * cell), F.abs((j + 1) * cell)) + reach
    return F.greatest(F.lit(0.0), F.cos(F.radians(F.least(F.lit(90.0), highest))))


def grid_cell(x: Column, y: Column, cell: float, reach: float) -> Column:
    """The cell (i, j) of a point. Rows are cell degrees high; along a row cells are wider in degrees the farther it is from the equator, so of like size in metres. reach must be that of the other side of a join."""
    j = F.floor(y / cell)
    return F.struct(F.floor((x + 180) * _row(j, cell, reach) / cell).alias("i"), j.alias("j"))


def edge_cells(x1: Column, y1: Column, x2: Column, y2: Column, y0: Column, cell: float, reach: float, widened: bool = True) -> Column:
    """The grid cells along an edge, and those within reach degrees (of latitude) of it, unless it is not to be widened: as many as its length asks for, not its box.

    y0: the latitude of the plane that distances to the edge are measured on.
    Cells are numbered by reach, so both sides of a join must have the same.
    """
    wide = reach if widened else 0.0
    n = F.greatest(F.lit(1.0), F.ceil(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)) / cell)).cast("int")
    sine = math.sin(math.radians(min(90.0, reach / 2)))

    def along(low: Column, high: Column, j: Column) -> Column:
        least = _row(j, cell, reach)
        # Near a pole a small distance is many degrees of longitude, at last all.
        factor = F.when(least > 10 * sine, 1.01).otherwise(3.15)
        around = wide * F.greatest(factor, least / F.greatest(F.cos(F.radians(y0)), F.lit(1e-9)))
        a, b, whole = (low + 180) * least - around, (high + 180) * least + around, 360 * least
        last = F.floor(whole / cell)
        numbers = F.sequence(F.greatest(F.lit(0), F.floor(a / cell)), F.least(last, F.greatest(F.lit(0), F.floor(b / cell))))
        west = F.when(a < 0, F.sequence(F.greatest(F.lit(0), F.least(last, F.floor((a + whole) / cell))), last)).otherwise(F.array().cast("array<bigint>"))
        east = F.when(b > whole, F.sequence(F.lit(0).cast("long"), F.least(last, F.greatest(F.lit(0), F.floor((b - whole) / cell))))).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.array_distinct(F.concat(numbers, west, east)), lambda i: F.struct(i.alias("i"), j.alias("j")))

    def piece(k: Column) -> Column:
        at = lambda p, q, t: p + (q - p) * t / n
        xa, xb, ya, yb = at(x1, x2, k), at(x1, x2, k + 1), at(y1, y2, k), at(y1, y2, k + 1)
        rows = F.sequence(F.floor((F.least(ya, yb) - wide) / cell), F.floor((F.greatest(ya, yb) + wide) / cell))
        return F.flatten(F.transform(rows, lambda j: along(F.least(xa, xb), F.greatest(xa, xb), j)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), piece)))
