"""Operators on areas: colouring neighbours, snapping edges to paths, sightlines and approaches to entrances."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import geo, sphere as S
from terrane.operators.proximity import Grid, cell_of, cover_box, within
from terrane.plans.lineage import cut
from terrane.plans.skew import meet
from terrane.world import KEY


def containing(points: DataFrame, areas: DataFrame) -> DataFrame:
    """``(point, type, ns, value)``: each of ``points`` (features) with the ``areas`` (features) one of whose polygons holds it outside its holes."""
    e7 = lambda x: F.struct(F.round(x["lat"] * 1e7).cast("int").alias("lat_e7"), F.round(x["lng"] * 1e7).cast("int").alias("lng_e7"))
    loops = areas.select(*KEY, F.posexplode("polygons").alias("polygon", "p")).select(*KEY, "polygon", F.explode("p").alias("loop"))
    # Numbered once: the numbers are those of the rows as written.
    loops = cut(loops.select(*KEY, "polygon", F.transform("loop", e7).alias("ring"), F.monotonically_increasing_id().alias("region")))
    at = e7(F.col("points")[0])
    placed = points.where("type = 'point'").select(F.struct(*KEY).alias("point"), at["lat_e7"].alias("lat_e7"), at["lng_e7"].alias("lng_e7"))
    hit = meet(within(placed, loops.select("region", "ring"), ["point"]), cut(loops.drop("ring")), ["region"])
    odd = hit.groupBy("point", *KEY, "polygon").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.select("point", *KEY).distinct()


def adjacent(areas: DataFrame, scale: float = 1e5) -> DataFrame:
    """``(a, b)`` both ways: areas ``(id, polygons)`` that have a vertex in one cell of ``1 / scale`` degrees (a metre or so)."""
    v = areas.select("id", F.explode(F.flatten(F.flatten("polygons"))).alias("p"))
    cells = v.select("id", F.round(F.col("p.lat") * scale).cast("bigint").alias("y"), F.round(F.col("p.lng") * scale).cast("bigint").alias("x")).distinct()
    other = cells.select(F.col("id").alias("b"), "y", "x")
    return cells.join(other, ["y", "x"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def colour(areas: DataFrame) -> DataFrame:
    """``(id, colour)`` so that neighbours differ. In each round the uncoloured areas with more neighbours than all uncoloured neighbours (ties by id) take the least colour that is free."""
    near = cut(adjacent(areas))
    rank = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    todo = cut(areas.select("id").distinct().join(rank, "id", "left").select("id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("id").alias("h"), "id").alias("rank")))
    done = cut(todo.select("id", F.lit(0).alias("colour")).limit(0))
    while not todo.isEmpty():
        other = todo.select(F.col("id").alias("b"), F.col("rank").alias("rank_b"))
        beaten = near.join(todo, near.a == todo.id).join(other, "b").where("rank_b > rank").select("id").distinct()
        pick = todo.join(beaten, "id", "left_anti").select("id")
        used = pick.join(near, pick.id == near.a, "left").join(done.select(F.col("id").alias("b"), "colour"), "b", "left").groupBy("id").agg(F.collect_set("colour").alias("used"))
        free = F.element_at(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")), 1)
        new = cut(used.select("id", free.alias("colour")))
        done = cut(done.unionByName(new))
        todo = cut(todo.join(new, "id", "left_anti"))
    return done


def snap_edges(areas: DataFrame, paths: DataFrame, threshold: float) -> DataFrame:
    """``(id, polygons)``: each edge of all loops of ``areas`` moved onto the one of ``paths`` that is nearest to its farther end, if that is nearer than ``threshold`` metres; a loop that would lose its shape keeps it.

    Edges of 0.1 metres or less go. Where two that follow each other no longer
    meet, both ends are corners, and between them the place where the edges,
    longer by the threshold at both ends, cross.
    """
    from terrane.operators.graph import near_paths

    loops = areas.select("id", F.posexplode("polygons").alias("p", "loops")).select("id", "p", F.posexplode("loops").alias("l", "loop"))
    shut = (F.size("loop") > 1) & (F.get("loop", F.lit(0)) == F.get("loop", F.size("loop") - 1))
    loops = cut(loops.withColumn("loop", F.when(shut, F.slice("loop", F.lit(1), F.greatest(F.size("loop") - 1, F.lit(0)))).otherwise(F.col("loop"))))
    corners = loops.select(F.struct("id", "p", "l").alias("of"), F.size("loop").alias("n"), F.posexplode("loop").alias("i", "at"))
    near = near_paths(corners.select(F.struct("of", "i").alias("id"), "at"), paths, threshold).where(F.col("metres") < threshold)
    near = cut(near.select("id.of", "id.i", "path", "at", "metres").join(corners.select("of", "i", "n"), ["of", "i"]))
    ends = near.select("of", F.pmod(F.col("i") - 1, F.col("n")).alias("i"), "path", F.col("at").alias("b"), F.col("metres").alias("_m"))
    moved = near.select("of", "i", "path", F.col("at").alias("a"), "metres").join(ends, ["of", "i", "path"])
    moved = moved.groupBy("of", "i").agg(F.min(F.struct(F.greatest("metres", "_m").alias("m"), "path", "a", "b")).alias("e"))
    moved = moved.groupBy("of").agg(F.collect_list(F.struct("i", "e.a", "e.b")).alias("edges"))
    ring = loops.withColumn("of", F.struct("id", "p", "l")).join(moved, "of", "left")
    none = F.array().cast(moved.schema["edges"].dataType)
    ring = ring.select("id", "p", "l", _snapped(threshold)(F.col("loop"), F.coalesce("edges", none)).alias("loop"))
    one = ring.groupBy("id", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "loop"))), lambda x: x["loop"]).alias("loops"))
    whole = one.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "loops"))), lambda x: x["loops"]).alias("_snapped"))
    return areas.select("id", "polygons").join(whole, "id", "left").select("id", F.coalesce("_snapped", "polygons").alias("polygons"))


#: Fixed value: metres up to which ends of edges are one corner.
SAME = 0.1


def _beyond(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """The place at the angle ``x`` before ``a``, seen from ``b``."""
    t = S.normal(b - np.dot(a, b) * a)
    return S.normal(math.cos(x) * a - math.sin(x) * t)


def _snapped(threshold: float):
    x, same = threshold / S.R, SAME / S.R

    def run(loop, edges):
        at = {e["i"]: (e["a"], e["b"]) for e in edges}
        if not at:
            return list(loop)
        n = len(loop)
        both = [at.get(i, (loop[i], loop[(i + 1) % n])) for i in range(n)]
        v = [(geo._path([a])[0], geo._path([b])[0], a, b) for a, b in both]
        v = [e for e in v if S.angle(e[0], e[1]) > same]
        out = []
        for (a, b, p, q), (c, d, _, _) in zip(v, v[1:] + v[:1]):
            out.append(p)
            if S.angle(b, c) > same:
                out.append(q)
                e, f, g, h = _beyond(a, b, x), _beyond(b, a, x), _beyond(c, d, x), _beyond(d, c, x)
                m, k = np.cross(e, f), np.cross(g, h)
                sides = np.sign([m @ g, m @ h, k @ e, k @ f])
                if sides[0] * sides[1] < 0 and sides[2] * sides[3] < 0 and sides[0] != sides[2]:
                    place = S.normal(np.cross(m, k))
                    place = place if place @ (e + f) > 0 else -place
                    if S.angle(place, b) > same and S.angle(place, c) > same:
                        out.append(geo._one(place))
        pairs = [(p["lat"], p["lng"]) for p in out]
        valid = len(set(pairs)) > 2 and all(p != q for p, q in zip(pairs, pairs[1:] + pairs[:1]))
        return out if valid else list(loop)

    return geo._pandas(geo.PATH)(run)


def _view(center: tuple[float, float], radius: float, loops: list[list[tuple[float, float]]], rays: int = 128) -> list[tuple[float, float]]:
    """The corners of what is seen from a centre within ``radius`` metres past loops of ``(lat, lng)``, on a plane around it."""
    lat0, lng0 = center
    k = math.radians(1) * S.R
    plane = lambda p: (((p[1] - lng0 + 180.0) % 360.0 - 180.0) * math.cos(math.radians(lat0)) * k, (p[0] - lat0) * k)
    a, b = [], []
    for loop in loops:
        pts = [plane(p) for p in loop]
        a += pts
        b += pts[1:] + pts[:1]
    angles = {2 * math.pi * i / rays for i in range(rays)}
    for x, y in a:
        if math.hypot(x, y) <= radius * 1.5:
            t = math.atan2(y, x)
            angles |= {t - 1e-5, t, t + 1e-5}
    t = np.array(sorted(x % (2 * math.pi) for x in angles))
    far = np.full(len(t), float(radius))
    d = np.column_stack([np.cos(t), np.sin(t)])
    for (ax, ay), (bx, by) in zip(a, b):
        ex, ey = bx - ax, by - ay
        den = d[:, 0] * ey - d[:, 1] * ex
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (ax * ey - ay * ex) / den
            u = (ax * d[:, 1] - ay * d[:, 0]) / den
        hit = (np.abs(den) > 1e-12) & (s > 0) & (u >= 0) & (u <= 1)
        far = np.where(hit & (s < far), s, far)
    return [(lat0 + f * y / k, (lng0 + f * x / k / math.cos(math.radians(lat0)) + 180.0) % 360.0 - 180.0) for f, (x, y) in zip(far, d)]


def sightlines(origins: DataFrame, buildings: DataFrame, radius: float) -> DataFrame:
    """``(id, polygons)`` seen from ``origins`` ``(id, at)`` past ``buildings`` ``(polygons)``: they are met by cells of the radius, then swept once an origin."""
    grid = Grid(radius)
    o = cell_of(origins, grid, "at")
    loops = buildings.select(F.monotonically_increasing_id().alias("b"), F.explode(F.flatten("polygons")).alias("loop"))
    loops = cut(loops)
    spread = cover_box(loops, grid, radius, F.col("loop"))
    met = o.join(spread, ["row", "col"], "left").select("id", "at", "loop").distinct().groupBy("id", "at").agg(F.collect_list("loop").alias("loops"))
    # One polygon of all loops.
    met = met.select("id", "at", geo.flat(F.array("loops")).alias("loops"))

    def run(it):
        for pdf in it:
            rows = []
            for id, at, ls in zip(pdf["id"], pdf["at"], pdf["loops"]):
                seen = _view((at["lat"], at["lng"]), radius, [[(p["lat"], p["lng"]) for p in x] for x in geo.nested(ls)[0]])
                rows.append((id, [[[{"lat": a, "lng": b} for a, b in seen]]]))
            yield pd.DataFrame(rows, columns=["id", "polygons"])

    return met.mapInPandas(run, f"id {dict(origins.dtypes)['id']}, polygons {geo.AREA}")


def entrance_approach(doors: DataFrame, paths: DataFrame, metres: float = 4.0) -> DataFrame:
    """``(id, at)``: for each building's ``doors`` ``(id, polygons, door, at)`` the point ``metres`` along a path ``(path, nodes, points)`` that leaves there and outside the building; entrances come before other corners, then by path."""
    # The places of all nodes of a path are found in one go, so no node carries its path along.
    near = F.arrays_zip(F.col("nodes").alias("door"), geo.ahead_and_back(F.col("points"), metres).alias("at"))
    steps = paths.select("path", F.explode(near).alias("s")).select("path", "s.door", F.explode(F.array("s.at.ahead", "s.at.back")).alias("at")).where("at IS NOT NULL")
    at = doors.select("id", "polygons", "entrance", "door").join(steps, "door")
    outside = at.where(~geo.contains(F.col("polygons"), F.col("at")))
    return outside.groupBy("id").agg(F.min(F.struct((~F.col("entrance")).alias("last"), "path", "at")).alias("m")).select("id", F.col("m.at").alias("at"))


def simplify_path(path: Column, metres: float) -> Column:
    """Douglas-Peucker: no point left out is farther than ``metres`` from what stays."""

    def run(points):
        if len(points) < 3:
            return list(points)
        keep = S.simplify(geo._path(points), metres / S.R)
        return [p for p, k in zip(points, keep) if k]

    return geo._pandas(geo.PATH)(run)(path)
