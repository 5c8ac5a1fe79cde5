"""Points near other points, and points inside regions, by adaptive coverage.

A region is covered by cells. Cells that lie wholly inside it are *interior*:
any point in them is accepted by the equi-join on the cell alone. Cells that the
border crosses are *boundary*: their matches get the exact test.

* ``near`` covers the circle around each location adaptively: by cells of twice
  its radius where locations are sparse and of half its radius where they are
  dense, on a grid of rows of equal latitude whose columns narrow to the poles.
* ``within`` covers polygons by a quadtree that splits border cells only, so a
  polygon's interior takes few large cells; points look themselves up at each
  size that occurs.

Defined results: locations with a null id or coordinate are left out, repeated
ids count once (the smallest coordinates). Distances are on a sphere; equal to
the limit is not near. Polygon edges are straight in latitude and longitude,
borders count half open (a shared border belongs to one side). Rings of fewer
than three corners contain nothing. Empty tables give empty results.

Cells in which very many pairs meet are cut into tiles, so no task holds more
than ``TILE`` rows of either side at once. Lists of cells are broadcast up to a
checked number and joined by shuffle beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.plans.lineage import cut
from terrane.plans.once import once
from terrane.plans.skew import hot_keys, meet, salted, skew_join

#: Fixed value: metres.
EARTH_RADIUS = 6_371_010.0
#: Locations in a cell beyond which its cover is refined, and into how many parts a side.
DENSE, SPLIT = 64, 4
#: Rows of either side that meet in one tile of a hot cell.
TILE = 8_000


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres between points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.asin(F.least(F.sqrt(h), F.lit(1.0))) * (2 * EARTH_RADIUS)


class Grid:
    """Rows ``side`` metres high; each row has a whole number of columns at least ``side`` wide."""

    def __init__(self, side: float):
        self.step = math.degrees(side / EARTH_RADIUS)
        self.around = 2 * math.pi * EARTH_RADIUS / side

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.step).cast("int")

    def columns(self, row: Column) -> Column:
        """Columns of a row, from its edge nearer to the pole; rows that reach the pole have one."""
        low = row * self.step - 90.0
        far = F.greatest(F.abs(low), F.abs(low + self.step))
        return F.when(far < 89.9, F.greatest(F.floor(F.cos(F.radians(far)) * self.around), F.lit(1))).otherwise(F.lit(1)).cast("int")

    def column(self, lng: Column, columns: Column) -> Column:
        return F.pmod(F.floor((lng + 180.0) / 360.0 * columns).cast("int"), columns)


def cover_circle(df: DataFrame, grid: Grid, radius: float, rows: range) -> DataFrame:
    """The cells of the given row offsets around ``lat, lng`` as ``row, col``: every cell within ``radius`` is among them."""
    reach = math.degrees(radius / EARTH_RADIUS) * 1.001
    df = df.select("*", F.explode(F.array(*[F.lit(r) for r in rows])).alias("_off"))
    df = df.withColumn("row", F.col("_off") + grid.row(F.col("lat")))
    # Rows out of reach go before their columns are looked for.
    low = F.col("row") * grid.step - 90.0
    df = df.where(F.greatest(low - F.col("lat"), F.col("lat") - low - grid.step) <= reach)
    df = once(df, _n=grid.columns(F.col("row")))
    # The widest the circle gets in longitude, anywhere in it.
    top = F.least(F.abs(F.col("lat")) + reach, F.lit(89.95))
    wide = F.lit(reach) / F.cos(F.radians(top))
    place = lambda lng: F.floor((lng + 180.0) / 360.0 * F.col("_n")).cast("int")
    first, last = place(F.col("lng") - wide), place(F.col("lng") + wide)
    every = (F.col("_n") == 1) | (last - first + 1 >= F.col("_n"))
    df = df.select("*", F.explode(F.when(every, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(F.sequence(first, last))).alias("_c"))
    west = F.col("_c") * (360.0 / F.col("_n")) - 180.0
    meets, _ = box_and_circle(low, grid.step, west, F.lit(360.0) / F.col("_n"), radius)
    return df.where(every | meets).withColumn("col", F.pmod("_c", "_n")).drop("_off", "_n", "_c")


def box_and_circle(low: Column, high: float, west: Column, width: Column, radius: float) -> tuple[Column, Column]:
    """Whether the box of degrees meets the circle around ``lat, lng``, and whether it lies wholly inside it, both on the safe side.

    The margins exceed the error of measuring on a plane; near the poles every box meets and none is inside.
    """
    reach = math.degrees(radius / EARTH_RADIUS)
    lat, lng = F.col("lat"), F.col("lng")
    plain = F.abs(lat) < 89.0
    # Degrees of latitude to the farthest and the nearest edge; those of longitude on the widest and narrowest circle of the box and the centre.
    up = F.greatest(F.abs(low - lat), F.abs(low + high - lat))
    gap = F.greatest(low - lat, lat - low - high, F.lit(0.0))
    side = F.greatest(F.abs(west - lng), F.abs(west + width - lng)) * F.cos(F.radians(F.greatest(F.abs(lat) - up, F.lit(0.0))))
    off = F.greatest(west - lng, lng - west - width, F.lit(0.0)) * F.cos(F.radians(F.least(F.abs(lat) + up, F.lit(90.0))))
    return ~plain | (gap * gap + off * off <= (reach * 1.001) ** 2), plain & (up * up + side * side < (reach * 0.999) ** 2)


def aside(lng: Column, of: Column) -> Column:
    """``lng`` less ``of``, the short way round."""
    return F.pmod(lng - of + 180.0, F.lit(360.0)) - 180.0


def cell_of(df: DataFrame, grid: Grid, at: str) -> DataFrame:
    """``df`` with the cell ``row, col`` of the point in column ``at``."""
    df = df.withColumn("row", grid.row(F.col(at)["lat"]))
    return df.withColumn("col", grid.column(F.col(at)["lng"], grid.columns(F.col("row"))))


def cover_box(df: DataFrame, grid: Grid, radius: float, points: Column, cells: DataFrame | None = None) -> DataFrame:
    """``df`` with ``row, col`` of every cell that has a place within ``radius`` of the box around ``points``, at any latitude and across 180 degrees; only of ``cells`` (few), where given."""
    reach = math.degrees(radius / EARTH_RADIUS) * 1.001
    lats = F.transform(points, lambda p: p["lat"])
    lngs = F.transform(points, lambda p: points[0]["lng"] + aside(p["lng"], points[0]["lng"]))
    df = once(df, _s=F.array_min(lats), _n=F.array_max(lats), _w=F.array_min(lngs), _e=F.array_max(lngs))
    top = F.greatest(F.abs("_s"), F.abs("_n")) + reach
    df = once(df, _wide=F.lit(reach) / F.cos(F.radians(F.least(top, F.lit(89.9)))), _pole=top >= 89.9)
    df = df.withColumn("row", F.explode(F.sequence(grid.row(F.greatest(F.col("_s") - reach, F.lit(-90.0))), grid.row(F.least(F.col("_n") + reach, F.lit(90.0))))))
    if cells is not None:
        df = df.join(F.broadcast(cells.select("row").distinct()), "row", "left_semi")
    df = once(df, _k=grid.columns(F.col("row")))
    place = lambda lng: F.floor((lng + 180.0) / 360.0 * F.col("_k")).cast("int")
    first, last = place(F.col("_w") - F.col("_wide")), place(F.col("_e") + F.col("_wide"))
    every = F.col("_pole") | (last - first + 1 >= F.col("_k"))
    df = df.select("*", F.explode(F.when(every, F.sequence(F.lit(0), F.col("_k") - 1)).otherwise(F.sequence(first, last))).alias("_c"))
    df = df.withColumn("col", F.pmod("_c", "_k")).drop("_s", "_n", "_w", "_e", "_wide", "_pole", "_k", "_c")
    return df if cells is None else df.join(F.broadcast(cells.select("row", "col").distinct()), ["row", "col"], "left_semi")


def _fine(df: DataFrame, grid: Grid) -> DataFrame:
    """``sub``: which of the ``SPLIT`` by ``SPLIT`` parts of its cell a location is in."""
    part = lambda x: F.least(F.greatest(F.floor(x * SPLIT).cast("int"), F.lit(0)), F.lit(SPLIT - 1))
    up = (F.col("lat") + 90.0) / grid.step - F.col("row")
    n = grid.columns(F.col("row"))
    # 180 degrees is in column 0, like -180.
    on = F.pmod(F.col("lng") + 180.0, F.lit(360.0)) / 360.0 * n - F.col("col")
    return df.withColumn("sub", part(up) * SPLIT + part(on))


def _fine_cover(df: DataFrame, grid: Grid, radius: float) -> DataFrame:
    """Probes of whole cells as probes ``sub, interior`` of those parts of them that the circle meets."""
    df = once(df, _w=F.lit(360.0) / grid.columns(F.col("row")))
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPLIT * SPLIT - 1))).alias("sub"))
    low = (F.col("row") + F.floor(F.col("sub") / SPLIT) / SPLIT) * grid.step - 90.0
    west = (F.col("col") + F.pmod("sub", F.lit(SPLIT)) / SPLIT) * F.col("_w") - 180.0
    # The part nearest to the centre, the short way round.
    west = F.col("lng") + aside(west, F.col("lng"))
    split = F.col("lng") + aside(west + F.col("_w") / SPLIT, F.col("lng")) < west
    meets, inside_ = box_and_circle(low, grid.step / SPLIT, west, F.col("_w") / SPLIT, radius)
    return once(df.where(split | meets), interior=~split & inside_).drop("_w")


def near(locations: DataFrame, radius: float, dense: int = DENSE, tile: int = TILE) -> DataFrame:
    """``(loc_a, loc_b)``, ``loc_a < loc_b``: locations ``(loc, lat, lng)`` in degrees less than ``radius`` metres apart.

    The circle around each location is covered by cells of twice its radius. Where
    those hold more than ``dense`` locations the cover is refined to cells of half
    the radius, whose interior ones accept without a test. Cells in which more than
    ``tile * tile`` pairs meet are cut into tiles of ``tile`` by ``tile`` rows.
    """
    one = cut(locations.where("loc IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL").groupBy("loc").agg(F.min(F.struct("lat", "lng")).alias("at")).select("loc", "at.lat", "at.lng"))
    grid = Grid(2 * radius)
    placed = one.withColumn("row", grid.row(F.col("lat"))).withColumn("col", grid.column(F.col("lng"), grid.columns(F.col("row"))))
    # Each pair meets once: from the lower row upwards, within a row from the smaller name.
    probes = cover_circle(one, grid, radius, range(0, 2)).withColumn("same", F.col("row") == grid.row(F.col("lat")))
    sure = F.lit(False)
    full = cut(placed.groupBy("row", "col").agg(F.count("*").alias("n")).where(F.col("n") > dense))
    keys = ["row", "col"]
    if not full.isEmpty():
        mark = full.select("row", "col", F.col("n").alias("_n"))
        split = lambda df: meet(df, mark, ["row", "col"], "left", n="_n")
        placed, probes = split(placed), split(probes)
        whole = F.lit(-1)
        placed = _fine(placed, grid).withColumn("sub", F.when(F.col("_n").isNull(), whole).otherwise(F.col("sub")))
        wide = probes.where("_n IS NULL").withColumn("sub", whole).withColumn("interior", F.lit(False))
        fine = _fine_cover(probes.where("_n IS NOT NULL"), grid, radius)
        keys = ["row", "col", "sub"]
        probing = fine.groupBy(*keys).agg(F.count("*").alias("m"))
        own = placed.where("_n IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"))
        hot = cut(own.join(probing, keys).where(F.col("n") * F.col("m") > F.lit(tile).cast("bigint") * tile))
        placed, probes = placed.drop("_n"), wide.unionByName(fine).drop("_n")
        if not hot.isEmpty():
            sides = hot.select(*keys, F.ceil(F.col("n") / tile).cast("int").alias("_a"), F.ceil(F.col("m") / tile).cast("int").alias("_b"), (F.col("n") + F.col("m")).alias("_n"))
            a, b = F.coalesce("_a", F.lit(1)), F.coalesce("_b", F.lit(1))
            every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
            mine = salted([F.col("loc")], a)
            theirs = salted([F.col("loc"), F.lit(1)], b)
            placed = meet(placed, sides, keys, "left", n="_n").withColumn("ta", mine).withColumn("tb", every(b)).drop("_a", "_b", "_n")
            probes = meet(probes, sides, keys, "left", n="_n").withColumn("tb", theirs).withColumn("ta", every(a)).drop("_a", "_b", "_n")
            keys = [*keys, "ta", "tb"]
        sure = F.col("interior")
    probes = probes.select(F.col("loc").alias("p"), F.col("lat").alias("plat"), F.col("lng").alias("plng"), "same", *keys, *(["interior"] if "sub" in keys else []))
    # Neither side is small: left to choose, the engine would broadcast one by a guess at its size.
    met = placed.join(probes.hint("merge"), keys)
    close = sure | (distance(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")) < radius)
    return met.where((~F.col("same") | (F.col("p") < F.col("loc"))) & close).select(F.least("p", "loc").alias("loc_a"), F.greatest("p", "loc").alias("loc_b"))


#: Quadtree over 2^DEEPEST cells a side of the whole plane of 1e-7 degrees; a cell of level k has the side 2^(32-k).
SPAN = 32
COARSEST, DEEPEST = 4, 20
#: Cells to a region before splitting stops early; what is left at the border is boundary.
MOST_CELLS = 256
#: Edges that a border cell carries unless it can't be split further.
CELL_EDGES = 64
#: Cells and their edges up to which they are broadcast: some tens of megabytes.
BROADCAST_CELLS, BROADCAST_EDGES = 100_000, 500_000


def _crosses(x0: int, y0: int, x1: int, y1: int, ax: int, ay: int, bx: int, by: int) -> bool:
    """Whether the segment a-b meets the closed rectangle."""
    if max(ax, bx) < x0 or min(ax, bx) > x1 or max(ay, by) < y0 or min(ay, by) > y1:
        return False
    dx, dy = bx - ax, by - ay
    s = [(dx * (y - ay) - dy * (x - ax)) for x in (x0, x1) for y in (y0, y1)]
    return not (min(s) > 0 or max(s) < 0)


def inside(x: int, y: int, ring: list[tuple[int, int]]) -> bool:
    """Even-odd, half open; exact in integers."""
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y):
            t = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
            if t != 0 and (t < 0) == (by > ay):
                odd = not odd
    return odd


def cover_ring(ring: list[tuple[int, int]], most: int = MOST_CELLS, deepest: int = DEEPEST, edges_to_a_cell: int = CELL_EDGES) -> list[tuple[int, int, int, bool, bool, list]]:
    """Cells ``(level, x, y, interior, corner, edges)`` that cover a ring of ``(lng_e7, lat_e7)`` corners; border cells are split largest first.

    A border cell carries the edges that meet it and whether its lower left corner
    is inside: that decides every point in it. Splitting goes on past ``most`` cells
    for those with more than ``edges_to_a_cell`` edges.
    """
    if len(ring) < 3:
        return []
    edges = list(zip(ring, ring[1:] + ring[:1]))
    half = 1 << (SPAN - 1)
    xs, ys = [p[0] + half for p in ring], [p[1] + half for p in ring]
    level = max(COARSEST, min(deepest, SPAN - max(max(xs) - min(xs), max(ys) - min(ys), 1).bit_length()))
    k = SPAN - level
    todo = []
    for x in range(min(xs) >> k, (max(xs) >> k) + 1):
        todo += [(level, x, y, edges, inside((x << k) - half, (y << k) - half, ring)) for y in range(min(ys) >> k, (max(ys) >> k) + 1)]
    out: list[tuple[int, int, int, bool, bool, list]] = []
    at = 0
    while at < len(todo):
        level, x, y, own, corner = todo[at]
        at += 1
        k = SPAN - level
        x0, y0 = (x << k) - half, (y << k) - half
        met = [e for e in own if _crosses(x0, y0, x0 + (1 << k), y0 + (1 << k), *e[0], *e[1])]
        if not met:
            if corner:
                out.append((level, x, y, True, True, []))
        elif level >= deepest or (len(met) <= edges_to_a_cell and len(out) + len(todo) - at >= most):
            out.append((level, x, y, False, corner, met))
        else:
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                todo.append((level + 1, 2 * x + i, 2 * y + j, met, _turned(corner, met, x0, y0, x0 + (i << (k - 1)), y0 + (j << (k - 1)))))
    return out


def _turned(corner: bool, edges: list, x0: int, y0: int, x: int, y: int) -> bool:
    """As ``in_cell``, of numbers."""
    for (ax, ay), (bx, by) in edges:
        dx, dy = bx - ax, by - ay
        if (ax > x0) != (bx > x0):
            low, high = ((x0 - ax) * dy - (p - ay) * dx for p in (y0, y))
            flat = dy * dx <= 0
            corner ^= (low == 0 and flat or (low < 0) == (dx > 0) and low != 0) != (high == 0 and flat or (high < 0) == (dx > 0) and high != 0)
        if (ay > y) != (by > y):
            west, east = ((p - ax) * dy - (y - ay) * dx for p in (x0, x))
            corner ^= (west != 0 and (west < 0) == (dy > 0)) != (east != 0 and (east < 0) == (dy > 0))
    return corner


_CELL = "region bigint, level int, x bigint, y bigint, interior boolean, corner boolean, edges array<struct<ax:bigint,ay:bigint,bx:bigint,by:bigint>>"


def _cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for region, ring in zip(pdf["region"], pdf["ring"]):
            corners = [(int(p["lng_e7"]), int(p["lat_e7"])) for p in ring if p is not None and p["lng_e7"] is not None and p["lat_e7"] is not None]
            rows += [(region, *c[:5], [dict(zip(("ax", "ay", "bx", "by"), (*p, *q))) for p, q in c[5]]) for c in cover_ring(corners)]
        yield pd.DataFrame(rows, columns=["region", "level", "x", "y", "interior", "corner", "edges"])


def in_cell(corner: Column, edges: Column, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """Whether a point of a border cell is inside: its corner's side, turned by each edge on the way along the west border and then east.

    The same half open rule as ``inside``, in whole numbers: a place is taken a hair
    to the east and a far smaller one to the north of its point, so no edge is touched.
    Coordinates are 32 bits, so products stay within 128 bits as decimals.
    """
    wide = lambda c: c.cast("decimal(11,0)")

    def side(e: Column, px: Column, py: Column) -> Column:
        """Sign of the turn from an edge to a point."""
        return F.signum(wide(px - e["ax"]) * wide(e["by"] - e["ay"]) - wide(py - e["ay"]) * wide(e["bx"] - e["ax"]))

    def flips(e: Column) -> Column:
        east = (e["bx"] > e["ax"]).cast("int") * 2 - 1
        slope = F.signum((e["by"] - e["ay"]).cast("double")) * east
        # Below a place on the west border: the edge passes it to the south.
        below = lambda py: (side(e, x0, py) * -east > 0) | ((side(e, x0, py) == 0) & (slope <= 0))
        north = ((e["ax"] > x0) != (e["bx"] > x0)) & (below(y) != below(y0))
        # East of a place at the point's height.
        up = (e["by"] > e["ay"]).cast("int") * 2 - 1
        east_of = lambda px: side(e, px, y) * up < 0
        along = ((e["ay"] > y) != (e["by"] > y)) & (east_of(x0) != east_of(x))
        return north != along

    return corner != (F.size(F.filter(edges, flips)) % 2 == 1)


def contains(ring: Column, lng: Column, lat: Column) -> Column:
    """Exact even-odd test in 1e-7 degrees; products stay within 128 bits as decimals of 38 digits."""
    n = F.size(ring)
    wide = lambda c: c.cast("decimal(11,0)")

    def flips(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        t = wide(lng - a["lng_e7"].cast("bigint")) * wide(b["lat_e7"].cast("bigint") - a["lat_e7"]) - wide(lat - a["lat_e7"].cast("bigint")) * wide(b["lng_e7"].cast("bigint") - a["lng_e7"])
        up = b["lat_e7"] > a["lat_e7"]
        return F.coalesce(((a["lat_e7"] > lat) != (b["lat_e7"] > lat)) & F.when(up, t < 0).otherwise(t > 0), F.lit(False))

    return F.when(n < 3, F.lit(False)).otherwise(F.size(F.filter(F.sequence(F.lit(0), n - 1), flips)) % 2 == 1)


def within(points: DataFrame, regions: DataFrame, keep: list[str]) -> DataFrame:
    """Points ``(lat_e7, lng_e7, *keep)`` with each ``region`` that contains them, of ``regions`` ``(region, ring)``. A region in several rows has each ring looked at on its own.

    Points meet cells once, and a cell decides without its ring: interior ones
    accept, border ones test the few edges that they carry. Up to
    ``BROADCAST_CELLS`` cells of bounded size are broadcast; more are joined by
    shuffle, with the points of hot cells left in place.
    """
    cells = cut(regions.select("region", "ring").where("region IS NOT NULL AND ring IS NOT NULL").mapInPandas(_cover, _CELL))
    n, edges = cells.agg(F.count("*"), F.coalesce(F.sum(F.size("edges")), F.lit(0))).first()
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # no more than DEEPEST
    at = lambda c: F.expr(f"shiftright(cast({c} as bigint) + {1 << (SPAN - 1)}L, {SPAN} - level)")
    placed = points.where("lat_e7 IS NOT NULL AND lng_e7 IS NOT NULL").select(*keep, "lat_e7", "lng_e7", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")).alias("level"))
    placed = placed.withColumn("x", at("lng_e7")).withColumn("y", at("lat_e7"))
    keys = ["level", "x", "y"]
    if n <= BROADCAST_CELLS and edges <= BROADCAST_EDGES:
        met = placed.join(F.broadcast(cells), keys)
    else:
        # One row to a cell, so that a hot cell's points need not move to it.
        grouped = cut(cells.groupBy(*keys).agg(F.collect_list(F.struct("region", "interior", "corner", "edges")).alias("_in")))
        hot = hot_keys(placed.groupBy(*keys).agg(F.count("*").alias("n")), keys)
        met = skew_join(placed, grouped.hint("merge"), keys, hot).select(*keep, "lat_e7", "lng_e7", *keys, F.inline("_in"))
    west = lambda c: F.expr(f"shiftleft({c}, {SPAN} - level) - {1 << (SPAN - 1)}L")
    hit = met.where(F.col("interior") | in_cell(F.col("corner"), F.col("edges"), west("x"), west("y"), F.col("lng_e7").cast("bigint"), F.col("lat_e7").cast("bigint")))
    return hit.select(*keep, "region")
