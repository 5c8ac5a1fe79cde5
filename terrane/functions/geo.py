"""Geometry columns: points are ``struct<lat,lng>`` in degrees, paths arrays of them, areas polygons of loops of them.

What has a closed form stays native. Exact spherical tests and constructions run
on Arrow batches in numpy, behind native box tests where they select rows.
"""

from __future__ import annotations

import inspect
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions import sphere as S

R = S.R
POINT = "struct<lat:double,lng:double>"
PATH = f"array<{POINT}>"
LOOPS = f"array<{PATH}>"
AREA = f"array<{LOOPS}>"
_P = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
_TYPES = {POINT: _P, PATH: T.ArrayType(_P), LOOPS: T.ArrayType(T.ArrayType(_P)), AREA: T.ArrayType(T.ArrayType(T.ArrayType(_P))), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def ll(lat, lng) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.struct(c(lat).cast("double").alias("lat"), c(lng).cast("double").alias("lng"))


def wrapped(p: Column) -> Column:
    """A point whose latitude runs past a pole, on the other side of it."""
    over = F.radians(p["lat"])
    lng = F.pmod(p["lng"] + F.when(F.cos(over) < 0, F.lit(180.0)).otherwise(F.lit(0.0)) + 180.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(p["lat"]) > 90.0, ll(F.degrees(F.asin(F.sin(over))), lng)).otherwise(ll(p["lat"], p["lng"]))


def _angle(a: Column, b: Column) -> Column:
    """Angle of two points by the arc tangent form, which is well conditioned at any distance."""
    p, q, d = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lng"] - a["lng"])
    x = F.cos(q) * F.sin(d)
    y = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return F.atan2(F.sqrt(x * x + y * y), F.sin(p) * F.sin(q) + F.cos(p) * F.cos(q) * F.cos(d))


def distance(a: Column, b: Column) -> Column:
    return _angle(a, b) * R


def length(path: Column) -> Column:
    """Metres; 0 for fewer than two points."""
    legs = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), _angle)
    return F.when(F.size(path) < 2, F.lit(0.0)).otherwise(F.aggregate(legs, F.lit(0.0), lambda s, x: s + x) * R)


def vertices(points: Column, polygons: Column) -> Column:
    """All vertices of a geometry: of a path its points, of an area polygon by polygon, loop by loop."""
    return F.when(polygons.isNotNull(), F.flatten(F.flatten(polygons))).otherwise(points)


def near_box(points: Column, polygons: Column, lat: float, lng: float, radius: float) -> Column:
    """Whether a geometry's bounding box meets that of a cap: true whenever the geometry may touch it."""
    d = math.degrees(radius / R) * 1.0001 + 1e-9
    w = 360.0 if abs(lat) + d > 89.9 else d / math.cos(math.radians(abs(lat) + d))
    v = vertices(points, polygons)
    low = lambda k: F.array_min(F.transform(v, lambda p: p[k]))
    high = lambda k: F.array_max(F.transform(v, lambda p: p[k]))
    return (low("lat") <= lat + d) & (high("lat") >= lat - d) & (low("lng") <= lng + w) & (high("lng") >= lng - w)


def join(a: Column, b: Column) -> Column:
    """Two paths end to end; a shared end is not repeated."""
    return F.concat(a, F.when(F.element_at(a, -1) == b[0], F.slice(b, F.lit(2), F.size(b))).otherwise(b))


def ordered_join(a: Column, b: Column) -> Column:
    """As ``join``, after turning either path round so that shared ends meet; none is an error."""
    a0, a1, b0, b1 = a[0], F.element_at(a, -1), b[0], F.element_at(b, -1)
    rest = lambda x: F.slice(x, F.lit(2), F.size(x))
    ra, rb = F.reverse(a), F.reverse(b)
    return F.when(a1 == b0, F.concat(a, rest(b))).when(a1 == b1, F.concat(a, rest(rb))).when(a0 == b0, F.concat(ra, rest(b))).when(a0 == b1, F.concat(ra, rest(rb))).otherwise(F.raise_error(F.lit("the paths share no end")).cast(PATH))


def rectangle_polygon(a: Column, b: Column) -> Column:
    """The rectangle of two corners as an area of one loop, anticlockwise from its south west."""
    s, n, w, e = F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]), F.least(a["lng"], b["lng"]), F.greatest(a["lng"], b["lng"])
    return F.array(F.array(F.array(ll(s, w), ll(s, e), ll(n, e), ll(n, w))))


def cap_polygon(center: Column, radius: Column | float, n: int = 128) -> Column:
    """A regular polygon of ``n`` corners at ``radius`` metres, anticlockwise from the north."""
    r = (radius if isinstance(radius, Column) else F.lit(float(radius))) / R
    lat = F.radians(center["lat"])

    def corner(i: Column) -> Column:
        t = -i * (2 * math.pi / n)
        y = F.asin(F.sin(lat) * F.cos(r) + F.cos(lat) * F.sin(r) * F.cos(t))
        x = F.atan2(F.sin(t) * F.sin(r) * F.cos(lat), F.cos(r) - F.sin(lat) * F.sin(y))
        return ll(F.degrees(y), center["lng"] + F.degrees(x))

    return F.array(F.array(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), corner)))


def collect_areas(polygons: Column) -> Column:
    """Aggregate: all polygons of all areas in one, nothing dissolved."""
    return F.flatten(F.collect_list(polygons))


# numpy side ------------------------------------------------------------------


def _path(x) -> np.ndarray:
    return S.unit([(p["lat"], p["lng"]) for p in x])


def _loop(x) -> np.ndarray:
    pts = [(p["lat"], p["lng"]) for p in x]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    return S.oriented(S.unit(pts)) if len(pts) > 2 else S.unit(pts)


def flat(polygons: Column) -> Column:
    """Polygons for numpy: all points, the sizes of loops, and the number of loops of each polygon.

    Nested arrays that are all empty are not sent as they are: of those the inner
    ones come without the offsets that readers expect.
    """
    loops = F.flatten(polygons)
    return F.struct(F.flatten(loops).alias("p"), F.transform(loops, F.size).alias("s"), F.transform(polygons, F.size).alias("n"))


def nested(x) -> list[list[list]]:
    """Loops of points by polygon, from ``flat``."""
    points, sizes, out = list(x["p"]), list(x["s"]), []
    at = k = 0
    for n in x["n"]:
        loops = []
        for size in sizes[k : k + n]:
            loops.append(points[at : at + size])
            at += size
        k += n
        out.append(loops)
    return out


def _polygons(x) -> list[list[np.ndarray]]:
    return [[_loop(y) for y in p] for p in nested(x)]


def _out(v) -> list[dict]:
    return [{"lat": float(a), "lng": float(b)} for a, b in S.latlng(v)]


def _one(v) -> dict:
    return _out(v)[0]


def _none(a) -> bool:
    return a is None or isinstance(a, float) and math.isnan(a) or isinstance(a, dict) and a.get("p", a) is None


def _typed(run, f, out):
    """Spark wants the arguments in the signature."""
    n = len(inspect.signature(f).parameters)
    names = ", ".join(f"a{i}" for i in range(n))
    scope = {"run": run}
    exec(f"def call({names}):\n    return run({names})", scope)  # noqa: S102
    scope["call"].__annotations__ = dict.fromkeys(names.split(", "), pd.Series) | {"return": out}
    return scope["call"]


def _pandas(type: str):
    """A function of one row's values as an Arrow-batched one; a null argument gives null."""

    def wrap(f):
        def run(*series: pd.Series):
            rows = []
            for args in zip(*[s.to_dict("records") if isinstance(s, pd.DataFrame) else s for s in series]):
                rows.append(None if any(_none(a) for a in args) else f(*args))
            if type.startswith("struct"):
                return pd.DataFrame([r if r is not None else {"lat": None, "lng": None} for r in rows], columns=["lat", "lng"], dtype=float)
            return pd.Series(rows, dtype="float64" if type == "double" else object)

        return F.pandas_udf(_typed(run, f, pd.DataFrame if type.startswith("struct") else pd.Series), _TYPES[type])

    return wrap


@_pandas("double")
def _area(polygons):
    total = 0.0
    for p in _polygons(polygons):
        if p and all(len(x) > 2 for x in p):
            total += S.loop_area(p[0]) - sum(S.loop_area(x) for x in p[1:])
    return total * R * R


@_pandas(POINT)
def interpolate(path, fraction):
    return _one(S.interpolate(_path(path), fraction)) if len(path) else None


@_pandas("double")
def distance_to_point(path, point):
    """Metres along a path from its start to where a point falls on it."""
    return S.project(_path(path), _path([point])[0])[2] * R if len(path) else None


def _lists(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of all points of paths, and where each path begins and the last ends."""
    x = x.fill_null([])
    p, n = x.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.column_stack([pc.struct_field(p, i).to_numpy(zero_copy_only=False) for i in (0, 1)]).reshape(-1, 2), n


def _listed(values: pa.Array, sizes: list[int], null: pa.Array) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=null if null.null_count or pc.any(null).as_py() else None)


def _places(v: np.ndarray) -> pa.Array:
    at = np.ascontiguousarray(latlng_of(v).T)
    return pa.StructArray.from_arrays([pa.array(at[0]), pa.array(at[1])], ["lat", "lng"])


def latlng_of(v: np.ndarray) -> np.ndarray:
    return S.latlng(v) if len(v) else np.empty((0, 2))


def distances_to_points(path: Column, points: Column) -> Column:
    """``distance_to_point`` of many points of one path at once; null of an empty path."""

    def call(path: pa.Array, points: pa.Array) -> pa.Array:
        (p, n), (q, m) = _lists(path), _lists(points)
        got = [S.projected(S.unit(p[i:j]), S.unit(q[k:l])) * R if j > i else np.full(l - k, np.nan) for i, j, k, l in zip(n, n[1:], m, m[1:])]
        values = np.concatenate([*got, []])
        return _listed(pa.array(values, mask=np.isnan(values)), np.diff(m), pc.or_(path.is_null(), points.is_null()))

    return F.arrow_udf(call, T.ArrayType(T.DoubleType()))(path, points)


def ahead_and_back(path: Column, metres: float) -> Column:
    """For each point of a path the places ``metres`` on and ``metres`` back along it, or its end there; null where the path ends."""

    def call(path: pa.Array) -> pa.Array:
        p, n = _lists(path)
        sides = [[], []]
        for i, j in zip(n, n[1:]):
            if j > i:
                v = S.unit(p[i:j])
                far = np.concatenate([[0], np.cumsum(S.angle(v[:-1], v[1:]).astype(np.longdouble))])
                sides[0].append(S.along(v, np.minimum(far + metres / R, far[-1])))
                sides[1].append(S.along(v, np.maximum(far - metres / R, 0)))
        ends = np.zeros(len(p), bool), np.zeros(len(p), bool)
        ends[0][n[1:][n[1:] > n[:-1]] - 1] = True
        ends[1][n[:-1][n[1:] > n[:-1]]] = True
        columns = [pa.StructArray.from_arrays(_places(np.concatenate([*x, np.empty((0, 3))])).flatten(), ["lat", "lng"], mask=pa.array(e)) for x, e in zip(sides, ends)]
        return _listed(pa.StructArray.from_arrays(columns, ["ahead", "back"]), np.diff(n), path.is_null())

    way = T.ArrayType(T.StructType([T.StructField("ahead", _P), T.StructField("back", _P)]))
    return F.arrow_udf(call, way)(path)


@_pandas(POINT)
def path_centroid(path):
    return _one(S.centroid(_path(path), False)) if len(path) else None


def area(polygons: Column) -> Column:
    """Square metres of the polygons whose loops have three corners or more; holes count off."""
    return _area(flat(polygons))


@_pandas(POINT)
def _area_centroid(polygons):
    v = list(polygons["p"])
    return _one(S.centroid(_path(v), True)) if v else None


def area_centroid(polygons: Column) -> Column:
    return _area_centroid(flat(polygons))


def sample(path: Column, meters: Column) -> Column:
    """Points every ``meters`` along a path, with both ends; repeats go."""

    def call(path: pa.Array, meters: pa.Array) -> pa.Array:
        p, n = _lists(path)
        got = []
        for i, j, metres in zip(n, n[1:], meters.to_pylist()):
            if j == i or metres is None:
                got.append(np.empty((0, 2)))
                continue
            v = S.unit(p[i:j])
            total = float(S.angle(v[:-1], v[1:]).sum()) if len(v) > 1 else 0.0
            step = 1.0 if total < 1.6e-9 else metres / R / total
            at = np.cumsum(np.concatenate([[0.0], np.full(int(1 / step) + 2, step)]))
            out = S.latlng(np.concatenate([S.along(v, fractions=at[at < 1.0]), v[-1:]]))
            first = np.sort(np.unique(out, axis=0, return_index=True)[1])
            got.append(out[first])
        at = np.concatenate([*got, np.empty((0, 2))])
        values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(at[:, k])) for k in (0, 1)], ["lat", "lng"])
        return _listed(values, [len(x) for x in got], pc.or_(path.is_null(), meters.is_null()))

    return F.arrow_udf(call, _TYPES[PATH])(path, meters)


@_pandas(AREA)
def hull_of(points):
    """The convex hull of points as an area; fewer than three of them give an area without polygons."""
    if len(points) < 3:
        return []
    h = S.hull(_path(points))
    return [[_out(h)]] if len(h) > 2 else []


def _contains(polygons: Column, point: Column) -> Column:
    def call(polygons: pa.Array, point: pa.Array) -> pa.Array:
        (v, n), sizes, per = _lists(polygons.field("p")), polygons.field("s").fill_null([]), polygons.field("n").fill_null([])
        null = np.asarray(pc.or_(pc.or_(polygons.field("p").is_null(), polygons.is_null()), point.is_null()))
        size, count = sizes.flatten().to_numpy(), per.flatten().to_numpy()
        # The polygon and then the row of each loop.
        polygon = np.repeat(np.arange(len(count)), count)
        row = np.repeat(np.arange(len(per)), pc.list_value_length(per).to_numpy(zero_copy_only=False))
        begin = np.cumsum(size) - size
        some = size > 1
        closed = np.zeros(len(size), bool)
        closed[some] = (v[begin[some]] == v[begin[some] + size[some] - 1]).all(axis=1)
        keep = np.flatnonzero(size - closed > 2)
        m = (size - closed)[keep]
        p = S.unit(np.column_stack([pc.struct_field(point, k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
        hit = np.zeros(len(point), bool)
        if len(keep):
            at = np.cumsum(m) - m
            each = np.repeat(np.arange(len(keep)), m)
            u = S.unit(v[begin[keep][each] + np.arange(len(each)) - at[each]])
            q = p[row[polygon[keep]]][each]
            odd = S.insides(u, q, at, each)
            inside = np.bincount(polygon[keep], odd, len(count)).astype(int) % 2 == 1
            hit[row[inside]] = True
        return pa.array(hit, mask=null)

    return F.arrow_udf(call, T.BooleanType())(polygons, point)


def contains(polygons: Column, point: Column) -> Column:
    return _contains(flat(polygons), point)


def cap_touches(type: Column, points: Column, polygons: Column, lat: Column, lng: Column, radius: Column) -> Column:
    """A path's nearest point within reach; an area with an edge within reach, or around the centre (its convex loops, even-odd)."""
    return _cap_touches(type, points, flat(polygons), lat, lng, radius)


@_pandas("boolean")
def _cap_touches(type, points, polygons, lat, lng, radius):
    c, r = S.unit([(lat, lng)])[0], radius / R
    if len(polygons["n"]):
        for poly in _polygons(polygons):
            odd = 0
            for loop in poly:
                a, b = loop, np.roll(loop, -1, axis=0)
                if len(loop) and float(S.edge_distance(c, a, b).min()) <= r:
                    return True
                odd += bool(np.all(np.cross(a, b) @ c > 0))
            if odd % 2:
                return True
        return False
    if points is None or not len(points):
        return False
    v = _path(points)
    return bool(S.angle(c, v[0]) <= r) if len(v) == 1 else float(S.edge_distance(c, v[:-1], v[1:]).min()) <= r


def meets(type: Column, points: Column, polygons: Column, kind: str, coordinates) -> Column:
    """The predicate of a feature against a fixed geometry.

    Fixed by results to match: a path meets an area by its vertices only, a point
    is tried against an area's first polygon only, and a point meets a path
    within a millimetre.
    """
    mm = 1e-3 / R
    if kind == "area":
        target = [[S.oriented(S.unit(x[:-1] if len(x) > 1 and x[0] == x[-1] else x)) for x in poly] for poly in coordinates]
    else:
        target = S.unit([coordinates] if kind == "point" and not isinstance(coordinates[0], (tuple, list)) else coordinates)

    def test(type, points, polygons):
        own = _polygons(polygons) if len(polygons["n"]) else None
        v = _path(points) if own is None and points is not None and len(points) else None
        if own is None and v is None:
            return False
        if kind == "point":
            p = target[0]
            if own is not None:
                return any(S.in_polygon(p, x) for x in own)
            if len(v) == 1:
                return bool(np.all(np.abs(v[0] - p) < 1e-15))
            return float(S.edge_distance(p, v[:-1], v[1:]).min()) < mm
        if kind == "path":
            if own is not None:
                return any(S.in_polygon(p, x) for p in target for x in own)
            if len(v) == 1:
                return float(S.edge_distance(v[0], target[:-1], target[1:]).min()) < mm
            return any(S.crosses(target[i], target[i + 1], v[:-1], v[1:]) for i in range(len(target) - 1))
        if own is not None:
            return any(S.polygons_meet(x, y) for x in own for y in target)
        if len(v) == 1:
            return S.in_polygon(v[0], target[0])
        return any(S.in_polygon(p, x) for p in v for x in target)

    return _pandas("boolean")(test)(type, F.coalesce(points, F.array().cast(PATH)), flat(F.coalesce(polygons, F.array().cast(AREA))))
