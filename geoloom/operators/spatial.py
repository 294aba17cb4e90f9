"""Spatial joins by grid cells, and searches around a constant point.

Rows have an id and the column geom of functions.geo. A join compares rows
that meet in a grid cell only; the hot cells of dense places are equi-join keys
that adaptive execution can split.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.triples import written


def spread(rows: DataFrame) -> DataFrame:
    """A written table in at least as many partitions as there are cores: its rows are about to become many, and few files would leave most cores idle."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= n else rows.repartition(n)


def corner(rows: DataFrame) -> DataFrame:
    """rows of points with x and y."""
    v = F.get(geo.vertices(F.col("geom")), F.lit(0))
    return rows.withColumns({"x": v["x"], "y": v["y"]})


def nearest(rows: DataFrame, x: float, y: float, n: int = 1) -> DataFrame:
    """The n points nearest to a point: id and distance, ties by id."""
    d = geo.point_distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y))
    return corner(rows).select("id", d.alias("distance")).orderBy("distance", "id").limit(n)


def around(rows: DataFrame, x: float, y: float, metres: float) -> DataFrame:
    """The points within so many metres of a point: a box first, then the distance."""
    tall = metres / geo.DEGREE_M * 1.001
    wide = tall / max(1e-6, math.cos(math.radians(min(89.9, abs(y) + tall))))
    east = F.pmod(F.col("x") - F.lit(x) + 180.0, F.lit(360.0)) - 180.0
    box = corner(rows).filter(F.col("y").between(y - tall, y + tall) & (F.abs(east) <= min(180.0, wide)))
    return box.withColumn("distance", geo.point_distance(F.col("x"), F.col("y"), F.lit(x), F.lit(y))).filter(F.col("distance") <= metres).drop("x", "y")


def kinds(rows: DataFrame) -> set[str]:
    """The kinds of geometry (three at most) that rows holds."""
    return {r[0] for r in rows.select("geom.kind").distinct().collect()}


#: Where the grid of a covering begins: off any round number, so that corners of cells do not fall on vertices.
ORIGIN = (1000.00012345678917, 1000.00009876543213)
EDGES_EACH, MOST_CELLS = 32, 512


class Covering:
    """Polygons as cells of a grid, each polygon at a level of its own.

    A cell that no edge passes is wholly inside a polygon or outside; those
    inside answer for their points. A cell at the edge has the edges that pass
    it and the parity of its corner: the way from a point to the corner stays in
    the cell, so the edges of the cell tell whether the two are on one side. A
    polygon has about one cell's width for every EDGES_EACH edges, MOST_CELLS at
    most.
    """

    def __init__(self, polygons: DataFrame, cell: float):
        g = F.col("geom")
        n = F.size(geo.edges(g))
        wide = F.greatest(g["east"] - g["west"], g["north"] - g["south"], F.lit(1e-7))
        level = F.ceil(F.log2(wide / F.greatest(F.lit(1), F.least(F.lit(MOST_CELLS), F.ceil(n / EDGES_EACH))) / cell)).cast("int")
        # What is worked out of the whole outline is worked out before its edges become rows.
        rows = polygons.filter(g["kind"] == "polygon").select(F.col("id").alias("other"), level.alias("level"), geo.edges(g).alias("edges"))
        rows = rows.select("other", "level", F.explode("edges").alias("e")).select("other", "level", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
        rows = spread(written(rows.withColumn("size", self.size(cell))))
        self.cell, self.none = cell, F.lit(None).cast(polygons.schema["id"].dataType)
        self.levels = sorted(r[0] for r in rows.select("level").distinct().collect())  # a few dozen at most
        corners = self._corners(rows)
        edges = rows.withColumn("at", F.explode(self.passed(*map(F.col, ("x1", "y1", "x2", "y2", "size"))))).select("other", "level", "at.i", "at.j", "x1", "y1", "x2", "y2")
        own = ["other", "level", "i", "j"]
        odd = corners.withColumn("odd", F.lit(1))
        #: other, level, i, j, x1, y1, x2, y2 and the corner's parity, odd, of the cells at edges.
        self.edges = written(edges.join(odd, own, "left").withColumn("odd", F.coalesce("odd", F.lit(0))))
        #: other, level, i, j of the cells wholly inside.
        self.inside = corners.join(self.edges.select(*own), own, "left_anti")

    @staticmethod
    def size(cell: float):
        return cell * F.pow(F.lit(2.0), F.col("level"))

    @staticmethod
    def place(x, y, size):
        """The cell of a point."""
        return F.floor((x + ORIGIN[0]) / size), F.floor((y + ORIGIN[1]) / size)

    @staticmethod
    def passed(x1, y1, x2, y2, size):
        """The cells that an edge passes, and perhaps some beside it."""
        n = F.greatest(F.lit(1.0), F.ceil(F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)) / size)).cast("int")
        slack = size * 1e-6 + 1e-11

        def piece(k):
            at = lambda p, q, t: p + (q - p) * t / n
            side = lambda p, q, o: F.sequence(F.floor((F.least(at(p, q, k), at(p, q, k + 1)) - slack + o) / size), F.floor((F.greatest(at(p, q, k), at(p, q, k + 1)) + slack + o) / size))
            rows = side(y1, y2, ORIGIN[1])
            return F.flatten(F.transform(side(x1, x2, ORIGIN[0]), lambda i: F.transform(rows, lambda j: F.struct(i.alias("i"), j.alias("j")))))

        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), piece)))

    @staticmethod
    def _corners(rows: DataFrame) -> DataFrame:
        """other, level, i, j of the cells whose corner is inside: along the lower line of each row of cells, what lies between an odd crossing and the next."""
        size, line = F.col("size"), F.col("j") * F.col("size") - ORIGIN[1]
        low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
        first, last = F.floor((low + ORIGIN[1]) / size), F.floor((high + ORIGIN[1]) / size) + 1
        crossing = rows.withColumn("j", F.explode(F.sequence(first, last))).filter((F.col("y1") > line) != (F.col("y2") > line))
        crossing = crossing.withColumn("x", (F.col("x2") - F.col("x1")) * (line - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
        along = Window.partitionBy("other", "level", "j").orderBy("x")
        spans = crossing.select("other", "level", "size", "j", "x", F.lead("x").over(along).alias("to"), F.row_number().over(along).alias("nth")).filter("nth % 2 = 1 and `to` is not null")
        start, end = F.ceil((F.col("x") + ORIGIN[0]) / size), F.ceil((F.col("to") + ORIGIN[0]) / size) - 1
        return spans.filter(start <= end).select("other", "level", F.explode(F.sequence(start, end)).alias("i"), "j").distinct()

    def holding(self, points: DataFrame) -> DataFrame:
        """(the columns of points, other, on): the points (x, y) that lie in a polygon, or on its boundary (on). Each point once for each polygon; points have columns that tell them apart."""
        if not self.levels:
            return points.limit(0).withColumns({"other": self.none, "on": F.lit(False)})
        columns = points.columns
        levelled = points.withColumn("level", F.explode(F.array(*map(F.lit, self.levels)).cast("array<int>")))
        i, j = self.place(F.col("x"), F.col("y"), self.size(self.cell))
        levelled = levelled.withColumns({"i": i, "j": j})
        key = ["level", "i", "j"]
        whole = levelled.join(self.inside, key).select(*columns, "other", F.lit(False).alias("on"))
        met = levelled.join(self.edges, key)
        x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
        size = self.size(self.cell)
        cx, cy = F.col("i") * size - ORIGIN[0], F.col("j") * size - ORIGIN[1]
        between = lambda value, p, q: (value > p) != (value > q)
        safe = lambda d: F.when(d == 0, F.lit(1.0)).otherwise(d)
        across = ((y1 > y) != (y2 > y)) & between((x2 - x1) * (y - y1) / safe(y2 - y1) + x1, cx, x)
        down = ((x1 > cx) != (x2 > cx)) & between((y2 - y1) * (cx - x1) / safe(x2 - x1) + y1, cy, y)
        v = lambda p, q: F.struct(p.alias("x"), q.alias("y"))
        on = geo.on_edge(v(x, y), F.struct(v(x1, y1).alias("a"), v(x2, y2).alias("b")))
        judged = met.groupBy(*columns, "other").agg((F.max("odd") + F.count_if(across) + F.count_if(down)).alias("crossed"), F.bool_or(on).alias("on"))
        return whole.unionByName(judged.filter((F.col("crossed") % 2 == 1) | F.col("on")).select(*columns, "other", "on"))

    def crossed(self, edges: DataFrame) -> DataFrame:
        """(id, other): the geometries with an edge that crosses one of a polygon's. edges: id, x1, y1, x2, y2."""
        if not self.levels:
            return edges.limit(0).select("id", self.none.alias("other"))
        names = {c: c + "_" for c in ("x1", "y1", "x2", "y2")}
        own = edges.select("id", *[F.col(c).alias(n) for c, n in names.items()]).withColumn("level", F.explode(F.array(*map(F.lit, self.levels)).cast("array<int>")))
        own = own.withColumn("at", F.explode(self.passed(*[F.col(n) for n in names.values()], self.size(self.cell)))).select("id", *names.values(), "level", "at.i", "at.j")
        return own.join(self.edges, ["level", "i", "j"]).filter(geo.crosses(edge_of("x1_", "y1_", "x2_", "y2_"), edge_of("x1", "y1", "x2", "y2"))).select("id", "other").distinct()


def edge_of(x1: str, y1: str, x2: str, y2: str):
    v = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.struct(v(x1, y1).alias("a"), v(x2, y2).alias("b"))


def plain_edges(rows: DataFrame, id_: str = "id") -> DataFrame:
    """(id, kind, x0, y0, x1, y1, x2, y2): the edges of each geometry, with its first vertex."""
    v = F.get(geo.vertices(F.col("geom")), F.lit(0))
    out = rows.select(F.col("id").alias(id_), "geom.kind", v["x"].alias("x0"), v["y"].alias("y0"), geo.edges(F.col("geom")).alias("edges"))
    return out.select(id_, "kind", "x0", "y0", F.explode("edges").alias("e")).select(id_, "kind", "x0", "y0", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def within_join(left: DataFrame, polygons: DataFrame, cell: float = 0.002) -> DataFrame:
    """(id, other): the geometries that lie within a polygon, of whatever size.

    Points are told by their cell alone, or by the cell's edges. Of lines and
    polygons all vertices and middles of edges must lie in the polygon or on its
    boundary, some of them, but for polygons, off the boundary, and no edge may
    cross one of the polygon's.
    """
    a = spread(written(left.select("id", "geom")))
    cover = Covering(polygons, cell)
    single = (F.col("geom.kind") == "point") & (F.size(geo.vertices(F.col("geom"))) == 1)
    if not a.filter(~single).limit(1).count():
        return cover.holding(corner(a).select("id", "x", "y")).filter("not on").select("id", "other")
    edges = written(plain_edges(a.filter(~single)))
    numbered = edges.withColumn("k", F.monotonically_increasing_id())  # tells the places of a written table apart
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    places = numbered.select("id", "kind", "k", F.posexplode(F.array(place(x1, y1), place((x1 + x2) / 2, (y1 + y2) / 2), place(x2, y2))).alias("nth", "v")).select("id", "kind", "k", "nth", "v.x", "v.y")
    points = corner(a.filter(single)).select("id", F.lit("point").alias("kind"), F.lit(-1).cast("long").alias("k"), F.lit(0).alias("nth"), "x", "y")
    held = cover.holding(places.unionByName(points)).groupBy("id", "kind", "other").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.bool_or(~F.col("on")).alias("off"))
    held = held.filter("off or kind = 'polygon'")
    counts = edges.groupBy("id").agg((F.count("*") * 3).alias("n"))
    whole = held.filter("k >= 0").join(counts, ["id", "n"]).join(cover.crossed(edges), ["id", "other"], "left_anti")
    return held.filter("k < 0").select("id", "other").unionByName(whole.select("id", "other"))


def edge_rows(rows: DataFrame, cell: float, reach: float, id_: str, widened: bool = True) -> DataFrame:
    """(id, kind, x0, y0, x1, y1, x2, y2, i, j): the edges of each geometry in the grid cells along them, widened by reach degrees."""
    out = plain_edges(rows, id_)
    at = geo.edge_cells(*map(F.col, ("x1", "y1", "x2", "y2", "y0")), cell, reach, widened)
    return out.withColumn("at", F.explode(at)).select(*out.columns, "at.i", "at.j")


def distance_join(left: DataFrame, right: DataFrame, metres: float, cell: float | None = None) -> DataFrame:
    """(id, other, distance): pairs within so many metres of each other, at any latitude and across the antimeridian.

    Points, lines and polygons meet edge by edge, as plain numbers, in the grid
    cells along the edges; a pair's distance is the least of its edges'. A
    geometry inside a polygon may be far from its edges: that is told apart, by
    the polygon's covering.
    """
    reach = metres / geo.DEGREE_M * 1.001
    cell = cell or max(0.001, 2 * reach)
    a, b = spread(written(left.select("id", "geom"))), spread(written(right.select("id", "geom")))
    of_a, of_b = kinds(a), kinds(b)
    found = []
    edges = edge_rows(b, cell, reach, "other")
    if "point" in of_a:
        own = corner(a.filter("geom.kind = 'point'")).select("id", "x", "y")
        at = geo.grid_cell(F.col("x"), F.col("y"), cell, reach)
        own = own.withColumn("at", at).select("id", "x", "y", "at.i", "at.j")
        v = F.struct(F.col("x").alias("x"), F.col("y").alias("y"))
        line = geo.to_edge(v, edge_of("x1", "y1", "x2", "y2"), F.col("x0"), F.col("y0"))
        distance = F.when(F.col("kind") == "point", geo.point_distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))).otherwise(line)
        found.append(own.join(edges, ["i", "j"]).select("id", "other", distance.alias("distance")).filter(F.col("distance") <= metres))
    if of_a - {"point"}:
        own = edge_rows(a.filter("geom.kind <> 'point'"), cell, reach, "id", widened=False)
        own = own.select("id", *[F.col(c).alias(c + "_") for c in ("x1", "y1", "x2", "y2")], "i", "j")
        pairs = own.join(edges, ["i", "j"]).drop("i", "j").withColumn("crossing", geo.crosses(edge_of("x1_", "y1_", "x2_", "y2_"), edge_of("x1", "y1", "x2", "y2")))
        # Metres on the plane, each worked out once.
        for end in ("1", "2", "1_", "2_"):
            east, north = geo.local(F.col("x" + end), F.col("y" + end), F.col("x0"), F.col("y0"))
            pairs = pairs.withColumns({"e" + end: east, "n" + end: north})
        ends = [[F.col(k + end) for end in (point, *line) for k in ("e", "n")] for point, line in (("1_", "12"), ("2_", "12"), ("1", ("1_", "2_")), ("2", ("1_", "2_")))]
        pairs = pairs.withColumns({f"d{i}": geo.plane_distance(*numbers) for i, numbers in enumerate(ends)})
        distance = F.when(F.col("crossing"), F.lit(0.0)).otherwise(F.least("d0", "d1", "d2", "d3"))
        found.append(pairs.select("id", "other", distance.alias("distance")).filter(F.col("distance") <= metres))
    if "polygon" in of_b:
        found.append(Covering(b, 0.002).holding(corner(a).select("id", "x", "y")).select("id", "other", F.lit(0.0).alias("distance")))
    if "polygon" in of_a:
        back = Covering(a, 0.002).holding(corner(b).select("id", "x", "y"))
        found.append(back.select(F.col("other").alias("id"), F.col("id").alias("other"), F.lit(0.0).alias("distance")))
    if not found:
        return a.limit(0).select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"))
    return reduce(DataFrame.unionByName, found).groupBy("id", "other").agg(F.min("distance").alias("distance"))


STEP = 3  # bits from a level of cells to the next


def levels_of(points: DataFrame, cell: float) -> list[tuple[DataFrame, int]]:
    """The occupied cells of points (x2, y2) by level, the finest first: i, j, a box and one point of each, and how many bits the level's numbers have lost. The last has 64 cells at most; a level that would have over half the cells of the one below is left out."""
    low = points.withColumns({"i": F.floor(F.col("x2") / cell), "j": F.floor(F.col("y2") / cell)}).groupBy("i", "j")
    one = F.min(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))).alias("one")
    out = [(written(low.agg(F.min("x2").alias("west"), F.max("x2").alias("east"), F.min("y2").alias("south"), F.max("y2").alias("north"), one)), 0)]
    n, bits = out[0][0].count(), 0
    while n > 64:
        bits += STEP
        below, had = out[-1]
        up = below.groupBy(F.shiftright("i", bits - had).alias("i"), F.shiftright("j", bits - had).alias("j"))
        up = up.agg(F.min("west").alias("west"), F.max("east").alias("east"), F.min("south").alias("south"), F.max("north").alias("north"), F.min("one").alias("one"))
        m = up.count()
        if m <= max(64, n // 2):
            out.append((written(up), bits))
            n = m
    return out


def nearest_each(left: DataFrame, right: DataFrame, cell: float = 0.0005, closest: bool = False) -> DataFrame:
    """(id, other, distance): for each point of left the nearest of right, ties by the smaller id. closest: only the pairs that may be the closest of all.

    A search down a pyramid of right's occupied cells. Of the cells open for a
    point those go whose box is farther than a known point of another; the
    others are replaced by the occupied cells within them, down to the finest,
    whose points are compared. No point meets all of right, wherever it lies.
    """
    a = spread(written(corner(left).select("id", "x", "y")))
    b = written(corner(right).select(F.col("id").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2")))
    pyramid = levels_of(b, cell)
    own = Window.partitionBy("id")
    x, y = F.col("x"), F.col("y")
    box = geo.box_distance(x, y, *map(F.col, ("west", "south", "east", "north")))
    top = pyramid[-1][0].collect()  # 64 cells at most
    if not top:
        return a.limit(0).select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"))
    cells = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("i", "j", "west", "east", "south", "north")], F.struct(*[F.lit(r["one"][c]).alias(c) for c in ("x", "y")]).alias("one")) for r in top])
    open_ = a.withColumn("c", F.explode(cells)).select("id", "x", "y", "c.*")
    for level in reversed(range(len(pyramid))):
        bound = F.min(geo.point_distance(x, y, F.col("one.x"), F.col("one.y")))
        judged = open_.withColumns({"near": box, "bound": bound.over(own)})
        if closest:
            judged = written(judged)
            least = judged.agg(F.min("bound")).first()[0]
            judged = judged.filter(F.col("near") <= F.lit(least) + 1e-3) if least is not None else judged
        # A millimetre for rounding.
        open_ = judged.filter(F.col("near") <= F.col("bound") + 1e-3).select("id", "x", "y", F.col("i").alias("i_"), F.col("j").alias("j_"))
        if level:
            (below, had), bits = pyramid[level - 1], pyramid[level][1]
            below = below.withColumns({"i_": F.shiftright("i", bits - had), "j_": F.shiftright("j", bits - had)})
            open_ = open_.join(below, ["i_", "j_"]).drop("i_", "j_")
    theirs = b.withColumns({"i_": F.floor(F.col("x2") / cell), "j_": F.floor(F.col("y2") / cell)})
    pairs = open_.join(theirs, ["i_", "j_"]).withColumn("distance", geo.point_distance(x, y, F.col("x2"), F.col("y2")))
    best = pairs.groupBy("id").agg(F.min(F.struct("distance", "other")).alias("best"))
    return best.select("id", "best.other", "best.distance")
