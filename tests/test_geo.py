import math
import random
import re

import numpy as np
import pandas as pd

from geoloom.functions import geo
from geoloom.operators import spatial
from pyspark.sql import functions as F

SQUARE = "POLYGON((0 0,10 0,10 10,0 10,0 0),(4 4,6 4,6 6,4 6,4 4))"


def test_within(spark):
    cases = [("POINT(1 1)", True), ("POINT(0 0)", False), ("POINT(0 5)", False), ("POINT(5 5)", False), ("POINT(11 5)", False), ("LINESTRING(1 1,2 2)", True),
             ("LINESTRING(0 0,0 5)", False), ("LINESTRING(1 1,12 1)", False), ("LINESTRING(1 5,9 5)", False), ("POLYGON((1 1,2 1,2 2,1 1))", True), (SQUARE, True)]
    rows = geo.with_geometry(spark.createDataFrame([(i, w) for i, (w, _) in enumerate(cases)], "id int, wkt string"))
    area = geo.with_geometry(spark.createDataFrame([(100, SQUARE)], "id int, wkt string"))
    got = {r.id for r in spatial.within_join(rows, area, cell=3.0).collect()}
    assert got == {i for i, (_, inside) in enumerate(cases) if inside}


def test_distance(spark):
    rows = spark.createDataFrame([("POINT(4.87 45.78)", "POINT(4.88 45.78)"), ("POINT(4.87 45.781)", "LINESTRING(4.86 45.78,4.88 45.78)"), ("LINESTRING(0 0,1 1)", "LINESTRING(0 1,1 0)"), ("POINT(5 5)", "POLYGON((0 0,10 0,10 10,0 10,0 0))")], "a string, b string")
    rows = geo.with_geometry(geo.with_geometry(rows, "a").withColumnRenamed("geom", "ga"), "b")
    got = [r[0] for r in rows.select(geo.distance(F.col("ga"), F.col("geom"))).collect()]
    a = math.cos(math.radians(45.78)) * math.sin(math.radians(0.005))
    assert abs(got[0] - 2 * geo.EARTH_M * math.asin(a)) < 1e-6
    assert abs(got[1] - 0.001 * geo.DEGREE_M) < 0.01
    assert got[2] == 0 and got[3] == 0


def test_no_geometry(spark):
    rows = geo.with_geometry(spark.createDataFrame([("CIRCLE(1 2)",), (None,), ("POINT EMPTY",)], "wkt string"))
    assert [r.geom for r in rows.collect()] == [None, None, None]


def test_nearest_each(spark):
    left = geo.with_geometry(spark.createDataFrame([(i, f"POINT({i * 0.01} 45)") for i in range(40)], "id int, wkt string"))
    right = geo.with_geometry(spark.createDataFrame([(i, f"POINT({i * 0.13} 45.00{i})") for i in range(4)], "id int, wkt string"))

    def meters(x1, y1, x2, y2):
        h = lambda d: math.sin(math.radians(d) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(h(y2 - y1) + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * h(x2 - x1)))

    want = {i: min(range(4), key=lambda j: meters(i * 0.01, 45, j * 0.13, float(f"45.00{j}"))) for i in range(40)}
    assert {r.id: r.other for r in spatial.nearest_each(left, right).collect()} == want
    assert spatial.nearest_each(left, right.limit(0)).count() == 0


def meters(x1, y1, x2, y2):
    h = lambda d: math.sin(math.radians(d) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1.0, math.sqrt(h(y2 - y1) + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * h(x2 - x1))))


def places(rng, n):
    """Points in a town, all over the globe, near both poles and on either side of the antimeridian."""
    pick = [lambda: (4.8 + rng.random() * 0.02, 45.7 + rng.random() * 0.02), lambda: (rng.uniform(-180, 180), rng.uniform(-90, 90)), lambda: (rng.uniform(-180, 180), rng.choice([-1, 1]) * (90 - rng.random() * 0.01)), lambda: (rng.choice([-1, 1]) * (180 - rng.random() * 0.01), 10 + rng.random() * 0.01), lambda: (rng.uniform(0, 1), 85 + rng.random() * 0.01)]
    return [pick[i % 5]() for i in range(n)]


def points_of(spark, rows):
    return geo.with_geometry(spark.createDataFrame([(i, f"POINT({x:.7f} {y:.7f})") for i, (x, y) in enumerate(rows)], "id int, wkt string"))


def test_nearest_anywhere(spark):
    rng = random.Random(1)
    a, b = [[(round(x, 7), round(y, 7)) for x, y in places(rng, n)] for n in (60, 400)]
    left, right = points_of(spark, a), points_of(spark, b)
    best = {i: min((meters(*p, *q), j) for j, q in enumerate(b)) for i, p in enumerate(a)}
    got = {r.id: (r.other, r.distance) for r in spatial.nearest_each(left, right).collect()}
    assert set(got) == set(best)
    assert all(abs(got[i][1] - d) < 1e-3 and (got[i][0] == j or abs(meters(*a[i], *b[got[i][0]]) - d) < 1e-6) for i, (d, j) in best.items())
    closest = spatial.nearest_each(left, right, closest=True).orderBy("distance").first()
    assert abs(closest.distance - min(d for d, _ in best.values())) < 1e-6


def test_points_within_distance_anywhere(spark):
    rng = random.Random(2)
    a, b = [[(round(x, 7), round(y, 7)) for x, y in places(rng, 250)] for _ in range(2)]
    for metres in (50.0, 400.0):
        want = {(i, j) for i, p in enumerate(a) for j, q in enumerate(b) if meters(*p, *q) <= metres}
        got = {(r.id, r.other) for r in spatial.distance_join(points_of(spark, a), points_of(spark, b), metres).collect()}
        assert got == want and len(want) > 10


def test_long_lines_and_large_polygons(spark):
    """A line across a continent and a polygon of a country's size: cells along the one, nine at most for the other."""
    line = geo.with_geometry(spark.createDataFrame([(1, "LINESTRING(0 40,3 42)"), (2, "LINESTRING(0 0.5,0.0001 0.5)")], "id int, wkt string"))
    rng = random.Random(3)
    on = [(3 * t, 40 + 2 * t + rng.uniform(-2e-4, 2e-4)) for t in (rng.random() for _ in range(80))]
    pairs = points_of(spark, on).select("id", "geom")
    brute = pairs.crossJoin(line.select(F.col("id").alias("other"), F.col("geom").alias("g2"))).select("id", "other", geo.distance(F.col("geom"), F.col("g2")).alias("d")).filter("d <= 10").collect()
    got = spatial.distance_join(pairs, line, 10.0).collect()
    assert {(r.id, r.other, round(r.distance, 6)) for r in got} == {(r.id, r.other, round(r.d, 6)) for r in brute} and len(got) > 10
    assert spatial.edge_rows(line, 0.001, 1e-4, "other").filter("other = 1").count() < 20_000
    country = geo.with_geometry(spark.createDataFrame([(7, "POLYGON((-5 42,8 42,8 51,-5 51,-5 42))"), (8, "POLYGON((4.8 45.7,4.81 45.7,4.81 45.71,4.8 45.71,4.8 45.7))")], "id int, wkt string"))
    cover = spatial.Covering(country, 0.002)
    assert cover.edges.select("other", "i", "j").distinct().count() <= 18 and cover.inside.count() <= 2
    inside = points_of(spark, [(4.805, 45.705), (0, 50), (9, 50), (8, 45)])
    assert {(r.id, r.other) for r in spatial.within_join(inside, country).collect()} == {(0, 7), (0, 8), (1, 7)}
    near = spatial.distance_join(inside, country, 5.0).collect()
    assert {(r.id, r.other, r.distance) for r in near} == {(0, 7, 0.0), (0, 8, 0.0), (1, 7, 0.0), (3, 7, 0.0)}


def test_distance_of_shapes(spark):
    shapes = ["LINESTRING(0 0,0.01 0.01)", "LINESTRING(0 0.01,0.01 0)", "POLYGON((0 0,0.02 0,0.02 0.02,0 0.02,0 0))", "LINESTRING(0.0202 0,0.0202 0.02)", "POLYGON((0.005 0.005,0.006 0.005,0.006 0.006,0.005 0.005))", "POINT(0.019 0.019)", "LINESTRING(1 1,1.1 1.1)"]
    rows = geo.with_geometry(spark.createDataFrame(list(enumerate(shapes)), "id int, wkt string")).select("id", "geom")
    every = rows.crossJoin(rows.select(F.col("id").alias("other"), F.col("geom").alias("g2"))).select("id", "other", geo.distance(F.col("geom"), F.col("g2")).alias("d")).filter("d <= 30")
    got = spatial.distance_join(rows, rows, 30.0).collect()
    assert {(r.id, r.other, round(r.distance, 6)) for r in got} == {(r.id, r.other, round(r.d, 6)) for r in every.collect()}


def star(rng, n, x, y, size, holes=True):
    """A polygon around (x, y) with n vertices at random distances, and a hole like it."""
    ring = lambda r: [(x + r * d * math.cos(a), y + r * d * math.sin(a)) for a, d in ((2 * math.pi * i / n, rng.uniform(0.6, 1)) for i in range(n))]
    rings = [ring(size)] + ([ring(size / 3)] if holes else [])
    return "POLYGON(" + ",".join("(" + ",".join(f"{p:.6f} {q:.6f}" for p, q in [*r, r[0]]) + ")" for r in rings) + ")"


def test_within_random_shapes(spark):
    """Points, lines and polygons, many with vertices on corners and edges, against every pair, for coverings of one cell and of many."""
    rng = random.Random(11)
    areas = [star(rng, rng.choice([3, 8, 300]), rng.uniform(0, 1), rng.uniform(0, 1), rng.choice([0.02, 0.2, 0.7])) for _ in range(12)] + ["POLYGON((0 0,0.5 0,0.5 0.5,0 0.5,0 0))", "MULTIPOLYGON(((0.6 0.6,0.9 0.6,0.9 0.9,0.6 0.9,0.6 0.6)),((0.1 0.6,0.3 0.6,0.3 0.9,0.1 0.9,0.1 0.6)))", "POLYGON((0.25 0.25,0.75 0.25,0.75 0.75,0.25 0.75,0.25 0.25),(0.4 0.4,0.6 0.4,0.6 0.6,0.4 0.6,0.4 0.4))"]
    at = lambda: (rng.choice([0, 0.25, 0.5, rng.uniform(0, 1), rng.uniform(0, 1)]), rng.choice([0, 0.25, 0.4, rng.uniform(0, 1), rng.uniform(0, 1)]))
    shapes = [f"POINT({x:.6f} {y:.6f})" for x, y in (at() for _ in range(150))] + areas + [star(rng, 5, *at(), 0.03, False) for _ in range(30)]
    for _ in range(40):
        x, y = at()
        shapes.append(f"LINESTRING({x} {y},{x + rng.choice([0, 0.05])} {y + rng.choice([0, 0.05])},{x + rng.uniform(0, 0.1):.6f} {y})")
    shapes += ["POINT(" + v + ")" for v in re.findall(r"[-\d.]+ [-\d.]+", areas[1])[:5]]
    rows = geo.with_geometry(spark.createDataFrame(list(enumerate(shapes)), "id int, wkt string")).select("id", "geom")
    polygons = geo.with_geometry(spark.createDataFrame(list(enumerate(areas)), "id int, wkt string")).select("id", "geom")
    every = rows.crossJoin(polygons.select(F.col("id").alias("other"), F.col("geom").alias("g2"))).filter(geo.within(F.col("geom"), F.col("g2"))).select("id", "other")
    want = {tuple(r) for r in every.collect()}
    for cell in (0.002, 5.0):
        got = [tuple(r) for r in spatial.within_join(rows, polygons, cell).collect()]
        assert set(got) == want and len(got) == len(want)
    assert len(want) > 100 and {i for i, _ in want} & set(range(165, 195)) and {i for i, _ in want} & set(range(195, 235))
    assert spatial.within_join(rows, polygons.limit(0)).count() == 0 and spatial.within_join(rows.limit(0), polygons).count() == 0


def test_country(spark):
    """An outline of 100,000 vertices over a million points; each point's side is known by its angle. No row holds the outline."""
    n, rng = 100_000, np.random.default_rng(4)
    angle = 2 * np.pi * np.arange(n) / n
    far = 4 + 0.5 * np.sin(7 * angle) + 0.2 * np.sin(91 * angle) + rng.uniform(0, 0.0005, n)
    vx, vy = np.round(5 + far * np.cos(angle), 7), np.round(45 + far * np.sin(angle), 7)
    wkt = "POLYGON((" + ",".join(f"{a} {b}" for a, b in zip([*vx, vx[0]], [*vy, vy[0]], strict=True)) + "))"
    country = geo.with_geometry(spark.createDataFrame([(1, wkt)], "id long, wkt string")).select("id", "geom")
    x, y = np.round(rng.uniform(0, 10, 1_000_000), 6), np.round(rng.uniform(40, 50, 1_000_000), 6)
    turn = np.arctan2(y - 45, x - 5) % (2 * np.pi)
    k = np.minimum((turn / (2 * np.pi / n)).astype(int), n - 1)
    m = (k + 1) % n
    side = (vx[m] - vx[k]) * (y - vy[k]) - (vy[m] - vy[k]) * (x - vx[k])
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x, "y": y}))
    cover = spatial.Covering(country, 0.002)
    assert cover.edges.groupBy("i", "j").count().agg(F.max("count")).first()[0] < 2_000
    held = cover.holding(points.repartition(8)).select("id").toPandas()["id"].to_numpy()
    clear = np.abs(side) > 1e-9  # vertices are rounded, so an angle at a vertex may belong to the next edge
    got = np.zeros(len(x), bool)
    got[held] = True
    wrong = np.flatnonzero((got != (side > 0)) & clear)
    assert len(held) == got.sum() and len(wrong) <= 3 and 300_000 < got.sum() < 700_000


def test_long_line_near_lines(spark):
    """A line of 50,000 vertices and a polygon against short lines: edges meet edges, and no row holds the whole line."""
    n = 50_000
    line = "LINESTRING(" + ",".join(f"{i * 1e-4:.4f} {45 + (i % 2) * 1e-4:.4f}" for i in range(n)) + ")"
    short = [(i, f"LINESTRING({i * 0.05 + 0.00003:.5f} 45.00012,{i * 0.05 + 0.00003:.5f} {45.0002 if i % 3 else 46})") for i in range(90)] + [(200, "LINESTRING(1 47,2 47)"), (201, "POLYGON((-1 44,6 44,6 46.5,-1 46.5,-1 44))")]
    long = geo.with_geometry(spark.createDataFrame([(1, line)], "id int, wkt string")).select("id", "geom")
    others = geo.with_geometry(spark.createDataFrame(short, "id int, wkt string")).select("id", "geom")
    got = {r.id: r.distance for r in spatial.distance_join(others, long, 30.0).collect()}
    assert set(got) ^ (set(range(90)) | {201}) == set() and got[201] == 0.0
    # The nearest edge rises from (0, 0) to (1, 1) or falls, in steps of 0.0001 degrees; the short line's lower end is 0.3 steps east and 1.2 up.
    for i in range(90):
        x, y = (i * 0.05 + 0.00003) % 1e-4 / 1e-4, 1.2
        near = min(edge_metres(x, y, *e) for e in ((0, 0, 1, 1), (1, 1, 2, 0), (-1, 1, 0, 0), (0, 1, 1, 0), (1, 0, 2, 1), (-1, 0, 0, 1)))
        assert near - 0.01 <= got[i] <= 11.13 * 1.3
    swapped = {r.other: r.distance for r in spatial.distance_join(long, others, 30.0).collect()}
    assert set(swapped) == set(got) and all(abs(swapped[i] - got[i]) < 0.01 for i in got)


def edge_metres(x, y, x1, y1, x2, y2):
    east, north = math.cos(math.radians(45)) * geo.DEGREE_M * 1e-4, geo.DEGREE_M * 1e-4
    ax, ay, bx, by = (x1 - x) * east, (y1 - y) * north, (x2 - x) * east, (y2 - y) * north
    t = max(0, min(1, -(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    return math.hypot(ax + t * (bx - ax), ay + t * (by - ay))
