"""One query for each function of geometry, cells, tiles, graphs and GeoJSON, and for layers and tag joins, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane import ids, query as Q, shell, world as W
from terrane.functions import cells, geo, geojson as J, tiles as T
from terrane.operators import areas as A, connect as Cn, graph as G, render as Rn
from terrane.operators.collections import Collection
from terrane.operators.histogram import assign
from terrane.plans.lineage import cut, fresh
from terrane.queries import registry as R
from terrane.sources import derived as D, ingest
from terrane.sources.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None, name: str | None = None):
    def add(f):
        n = name or f.__name__.rstrip("_")
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


_LAT, _LNG = "((515000000 + (c_custkey * 7919) % 200000) / 1e7)", "((-1300000 + (c_custkey * 104729) % 300000) / 1e7)"


def _hav(a, b, c, d):
    return f"2 * 6371010 * asin(least(1, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_COLS = "SELECT p_partkey % 20 AS k, count(*) AS n, min(p_partkey // 20) AS lo, max(p_partkey // 20) AS hi FROM part GROUP BY 1"
_M = "(6371010 * radians(0.001))"  # metres from one row of junctions to the next


def _points(s, d):
    return D.customers(s, d).select("type", "ns", "value", F.col("points")[0].alias("at"), "points")


def _columns(s, d):
    return D.streets(s, d).where("ns = 'tables/col'")


# Geometry


@q(f"SELECT CAST(c_custkey AS BIGINT) AS id, {_LAT} AS lat, {_LNG} AS lng FROM customer")
def ll(s, d):
    return _points(s, d).select(F.col("value").alias("id"), "at.*")


@q(f"SELECT CAST(c_custkey AS BIGINT) AS id, round({_hav(_LAT, _LNG, 51.51, -0.12)}, 3) AS metres FROM customer")
def distance_meters(s, d):
    return _points(s, d).select(F.col("value").alias("id"), F.round(geo.distance(F.col("at"), geo.ll(51.51, -0.12)), 3).alias("metres"))


@q(f"SELECT k AS id, round((hi - lo) * {_M}, 3) AS metres FROM ({_COLS})")
def length(s, d):
    return _columns(s, d).select(F.col("value").alias("id"), F.round(geo.length(F.col("points")), 3).alias("metres"))


@q(f"SELECT k AS id, CAST(round(51.5 + 0.25 * (hi - lo) * 0.001, 7) AS DOUBLE) AS lat FROM ({_COLS})")
def interpolate(s, d):
    return _columns(s, d).select(F.col("value").alias("id"), F.round(geo.interpolate(F.col("points"), F.lit(0.25))["lat"], 7).alias("lat"))


@q(f"SELECT CAST(p_partkey AS BIGINT) AS part, round((p_partkey // 20) * {_M}, 2) AS metres FROM part")
def distance_to_point_meters(s, d):
    far = geo.distances_to_points(F.col("points"), F.col("points"))
    on = _columns(s, d).select(F.explode(F.arrays_zip(F.col("refs").alias("ref"), far.alias("metres"))).alias("p"))
    return on.select(F.col("p.ref.value").alias("part"), F.round("p.metres", 2).alias("metres"))


@q("SELECT CAST(p_partkey % 20 AS BIGINT) AS path, CAST(p_partkey // 20 AS INTEGER) AS i, (515000000 + (p_partkey // 20) * 10000) / 1e7 AS lat FROM part")
def points(s, d):
    return _columns(s, d).select(F.col("value").alias("path"), F.posexplode(geo.vertices(F.col("points"), F.col("polygons"))).alias("i", "p")).select("path", "i", "p.lat")


@q(f"SELECT k AS path, CAST(ceil((hi - lo) * {_M} / 50.0) + 1 AS BIGINT) AS n FROM ({_COLS}) WHERE hi > lo")
def sample_points(s, d):
    return _columns(s, d).where(F.size("points") > 1).select(F.col("value").alias("path"), F.size(geo.sample(F.col("points"), F.lit(50.0))).cast("bigint").alias("n"))


@q(f"SELECT CAST(sum(ceil((hi - lo) * {_M} / 50.0) + 1) AS BIGINT) AS n FROM ({_COLS}) WHERE hi > lo")
def sample_points_along_paths(s, d):
    return _columns(s, d).where(F.size("points") > 1).select(F.explode(geo.sample(F.col("points"), F.lit(50.0))).alias("p")).distinct().agg(F.count("*").alias("n"))


def _halves(s, d):
    n = F.size("points")
    at = F.floor((n + 1) / 2).cast("int")
    return _columns(s, d).where(n > 2).select("value", F.slice("points", F.lit(1), at).alias("a"), F.slice("points", at, n).alias("b"), "points")


_JOINED = f"SELECT k AS id, CAST(n AS INTEGER) AS n, true AS same FROM ({_COLS}) WHERE n > 2"


@q(_JOINED)
def join(s, d):
    j = geo.join(F.col("a"), F.col("b"))
    return _halves(s, d).select(F.col("value").alias("id"), F.size(j).alias("n"), (j == F.col("points")).alias("same"))


@q(_JOINED)
def ordered_join(s, d):
    j = geo.ordered_join(F.reverse("a"), F.reverse("b"))
    return _halves(s, d).select(F.col("value").alias("id"), F.size(j).alias("n"), ((j == F.col("points")) | (F.reverse(j) == F.col("points"))).alias("same"))


_RECT = "SELECT CAST(n_nationkey AS BIGINT) AS id, 51.5 + (n_nationkey // 5) * 0.004 AS s, -0.13 + (n_nationkey % 5) * 0.006 AS w FROM nation"
_AREA = "6371010.0 * 6371010.0 * radians(0.006) * (sin(radians(s + 0.004)) - sin(radians(s)))"


def _nations(s, d):
    return D.areas(s, d).where("ns = 'tables/nation'")


@q(f"SELECT id, round({_AREA} / 100) AS ares FROM ({_RECT})")
def area(s, d):
    return _nations(s, d).select(F.col("value").alias("id"), F.round(geo.area(F.col("polygons")) / 100).alias("ares"))


@q(f"SELECT CAST(c_custkey AS BIGINT) AS id, round(least({_LAT}, 51.51), 7) AS south, round(greatest({_LNG}, -0.12), 7) AS east FROM customer")
def rectangle_polygon(s, d):
    r = geo.rectangle_polygon(F.col("at"), geo.ll(51.51, -0.12))[0][0]
    return _points(s, d).select(F.col("value").alias("id"), F.round(r[0]["lat"], 7).alias("south"), F.round(r[1]["lng"], 7).alias("east"))


@q(f"SELECT CAST(c_custkey AS BIGINT) AS id, 128 AS n, round({_LAT} + degrees(100 / 6371010.0), 7) AS north FROM customer")
def cap_polygon(s, d):
    r = geo.cap_polygon(F.col("at"), 100.0)[0][0]
    return _points(s, d).select(F.col("value").alias("id"), F.size(r).alias("n"), F.round(r[0]["lat"], 7).alias("north"))


@q(f"SELECT id, CAST(round(s + 0.002, 5) AS DOUBLE) AS lat, CAST(round(w + 0.003, 5) AS DOUBLE) AS lng FROM ({_RECT})")
def centroid(s, d):
    c = geo.area_centroid(F.col("polygons"))
    return _nations(s, d).select(F.col("value").alias("id"), F.round(c["lat"], 5).alias("lat"), F.round(c["lng"], 5).alias("lng"))


@q(f"SELECT k AS id, CAST(round(51.5 + 0.0005 * (hi - lo), 6) AS DOUBLE) AS lat FROM ({_COLS}) WHERE hi > lo")
def get_centroid(s, d):
    return _columns(s, d).where(F.size("points") > 1).select(F.col("value").alias("id"), F.round(geo.path_centroid(F.col("points"))["lat"], 6).alias("lat"))


@q("SELECT CAST(count(*) AS INTEGER) AS n FROM nation")
def collect_areas(s, d):
    return _nations(s, d).agg(F.size(geo.collect_areas(F.col("polygons"))).alias("n"))


@q("SELECT 'all' AS id, CAST(round(max((p_partkey // 20)) * 0.001 + 51.5, 5) AS DOUBLE) AS north FROM part")
def convex_hull(s, d):
    # Partial hulls first: a hull of hulls is the hull, so no task holds all points.
    p = D.parts(s, d).select(F.spark_partition_id().alias("g"), F.col("points")[0].alias("p"))
    some = p.groupBy("g", F.pmod(F.xxhash64("p"), F.lit(64)).alias("h")).agg(F.collect_list("p").alias("ps")).select(geo.hull_of(F.col("ps")).alias("a"), "ps")
    few = some.select(F.explode(F.when(F.size("a") > 0, F.flatten(F.flatten("a"))).otherwise(F.col("ps"))).alias("p"))
    hull = few.agg(F.collect_list("p").alias("ps")).select(geo.hull_of(F.col("ps")).alias("a"))
    return hull.select(F.lit("all").alias("id"), F.round(F.array_max(F.transform(F.flatten(F.flatten("a")), lambda x: x["lat"])), 5).alias("north"))


@q()
def snap_area_edges(s, d):
    paths = D.streets(s, d).select(F.concat_ws("/", "ns", F.col("value").cast("string")).alias("path"), "points")
    snapped = A.snap_edges(_nations(s, d).select(F.col("value").alias("id"), "polygons"), paths.where(F.size("points") > 1), 100.0)
    return snapped.select("id", F.size(F.flatten(F.flatten("polygons"))).alias("corners"))


@q()
def sightline(s, d):
    seen = A.sightlines(_points(s, d).select(F.col("value").alias("id"), "at"), _nations(s, d), 50.0)
    return seen.select("id", F.round(geo.area(F.col("polygons"))).alias("m2"))


@q("""WITH p AS (SELECT p_partkey AS k, p_partkey // 20 AS r, p_partkey % 20 AS c FROM part), n AS (SELECT c, min(r) AS lo, max(r) AS hi FROM p GROUP BY c)
SELECT CAST(k AS BIGINT) AS id, round((515000000 + r * 10000) / 1e7 + CASE WHEN r > lo THEN -1 ELSE 1 END * degrees(4 / 6371010.0), 6) AS lat, round((-1300000 + c * 15000) / 1e7, 6) AS lng FROM p JOIN n USING (c) WHERE lo < hi""")
def entrance_approach(s, d):
    st = D.streets(s, d).select(F.concat_ws("/", "ns", F.col("value").cast("string")).alias("path"), F.transform("refs", lambda r: r["value"]).alias("nodes"), "points")
    doors = D.parts(s, d).select(F.col("value").alias("id"), geo.cap_polygon(F.col("points")[0], 2.0, 8).alias("polygons"), F.col("value").alias("door"), F.lit(True).alias("entrance"))
    return A.entrance_approach(doors, st.where(F.size("points") > 1)).select("id", F.round("at.lat", 6).alias("lat"), F.round("at.lng", 6).alias("lng"))


@q("SELECT k AS id, 2 AS n FROM (" + _COLS + ") WHERE n > 1")
def simplify(s, d):
    return _columns(s, d).where(F.size("points") > 1).select(F.col("value").alias("id"), F.size(A.simplify_path(F.col("points"), 1.0)).alias("n"))


# Cells and tiles


@q()
def s2_grid(s, d):
    return _nations(s, d).select(F.col("value").alias("id"), F.posexplode(cells.grid_tokens(F.col("polygons"), 15)).alias("i", "token"))


@q()
def s2_covering(s, d):
    return _nations(s, d).select(F.col("value").alias("id"), F.posexplode(cells.covering_tokens(F.col("polygons"), 10, 16)).alias("i", "token"))


@q()
def s2_points(s, d):
    t = _nations(s, d).select(F.explode(cells.covering_tokens(F.col("polygons"), 10, 16)).alias("token")).distinct()
    return t.select("token", cells.token_center(F.col("token")).alias("p")).select("token", F.round("p.lat", 7).alias("lat"), F.round("p.lng", 7).alias("lng"))


def _cell_sql(level: int, columns: str) -> str:
    """Cells of the face around the north pole, where all of these places are."""
    back = lambda s_: f"(CASE WHEN {s_} >= 0.5 THEN (4 * pow({s_}, 2) - 1) / 3 ELSE (1 - 4 * pow(1 - {s_}, 2)) / 3 END)"
    on = lambda u: f"(CASE WHEN {u} >= 0 THEN 0.5 * sqrt(1 + 3 * {u}) ELSE 1 - 0.5 * sqrt(1 - 3 * {u}) END)"
    n = 1 << level
    corner = lambda di, dj: f"SELECT id, {back(f'((i + {di}) / {n})')} AS u, {back(f'((j + {dj}) / {n})')} AS v FROM c"
    parts = [(0.5, 0.5)] if columns.startswith("id, round(lat") else [(0, 0), (0, 1), (1, 0), (1, 1)]
    return f"""
WITH p AS (SELECT CAST(c_custkey AS BIGINT) AS id, radians({_LAT}) AS la, radians({_LNG}) AS lo FROM customer),
x AS (SELECT id, -cos(la) * cos(lo) / sin(la) AS u, -cos(la) * sin(lo) / sin(la) AS v FROM p),
c AS (SELECT id, floor({on("u")} * {n}) AS i, floor({on("v")} * {n}) AS j FROM x),
w AS ({" UNION ALL ".join(corner(*k) for k in parts)}),
g AS (SELECT id, degrees(atan2(1, sqrt(u * u + v * v))) AS lat, degrees(atan2(-v, -u)) AS lng FROM w)
SELECT {columns} FROM g {"" if len(parts) == 1 else "GROUP BY id"}"""


@q(_cell_sql(20, "id, round(lat, 7) AS lat, round(lng, 7) AS lng"))
def s2_center(s, d):
    c = cells.token_center(cells.point_token(F.col("at"), 20))
    return _points(s, d).select(F.col("value").alias("id"), c.alias("c")).select("id", F.round("c.lat", 7).alias("lat"), F.round("c.lng", 7).alias("lng"))


@q(_cell_sql(16, "id, round(min(lat), 7) AS south, round(max(lat), 7) AS north, round(min(lng), 7) AS west, round(max(lng), 7) AS east"))
def s2_polygon(s, d):
    p = cells.token_polygon(cells.point_token(F.col("at"), 16))
    ring = _points(s, d).select(F.col("value").alias("id"), p[0][0].alias("r"))
    of = lambda f, k: F.round(f(F.transform("r", lambda x: x[k])), 7)
    return ring.select("id", of(F.array_min, "lat").alias("south"), of(F.array_max, "lat").alias("north"), of(F.array_min, "lng").alias("west"), of(F.array_max, "lng").alias("east"))


@q("SELECT CAST(c_custkey AS BIGINT) AS id, '16/' || CAST(floor((%s + 180) / 360 * 65536) AS BIGINT) || '/' || CAST(floor(32768 - 32768 / pi() * 0.5 * ln((1 + sin(radians(%s))) / (1 - sin(radians(%s))))) AS BIGINT) AS tile FROM customer" % (_LNG, _LAT, _LAT))
def tile_paths(s, d):
    return T.tile_paths(_points(s, d), F.col("points"), 16, ["value"]).select(F.col("value").alias("id"), "tile")


def _tile_sql(hash: str, rows: str, out: str) -> str:
    return f"WITH t AS ({rows}), x AS (SELECT type, ns, value, {hash} AS h FROM t) SELECT type, ns, value, {out} AS tile_id FROM x"


def _area_rows() -> str:
    at = "[2::HUGEINT] || " + R._bytes("'tables/{ns}'") + " || " + R._le("CAST({k} AS BIGINT)") + " || " + R._le("CAST({p} AS BIGINT)")
    one = "SELECT 'area' AS type, 'tables/{ns}' AS ns, CAST({k} AS BIGINT) AS value, " + at + " AS b FROM {rest}"
    nations = one.format(ns="nation", k="n_nationkey", p="0", rest="nation")
    return nations + " UNION ALL " + one.format(ns="region", k="n_regionkey", p="p", rest="(SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey) - 1 AS p FROM nation)")


@q(_tile_sql(R._FNV1, _area_rows(), R._SIGNED))
def tile_ids(s, d):
    return T.tile_ids(D.areas(s, d))


@q(_tile_sql(R._FNV1, f"SELECT 'point' AS type, 'tables/customer' AS ns, CAST(c_custkey AS BIGINT) AS value, [0::HUGEINT] || {R._bytes("'tables/customer'")} || {R._le('CAST(c_custkey AS BIGINT)')} AS b FROM customer", "printf('%x', h::UBIGINT)"))
def tile_ids_hex(s, d):
    return T.tile_ids_hex(D.customers(s, d))


# Graph: walks of up to four steps on the grid are all shortest paths under the limit.

LIMIT = 400.0
_WALK = f"""
WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_partkey // 20 AS r, p_partkey % 20 AS c, p_brand FROM part),
e AS (SELECT a.k AS a, b.k AS b, {_hav("(51.5 + a.r * 0.001)", "(-0.13 + a.c * 0.0015)", "(51.5 + b.r * 0.001)", "(-0.13 + b.c * 0.0015)")} AS m FROM p a JOIN p b ON (a.r = b.r AND b.k IN (a.k - 1, a.k + 1)) OR b.k IN (a.k - 20, a.k + 20)),
w AS (SELECT k AS origin, k AS node, CAST(0 AS DOUBLE) AS m FROM p UNION SELECT w.origin, e.b, w.m + e.m FROM w JOIN e ON w.node = e.a WHERE w.m + e.m < {LIMIT}),
best AS (SELECT origin, node AS destination, min(m) AS m FROM w GROUP BY ALL)
"""


def _net(s, d):
    return D.world(s, d, "part", "street")


def _segments(w):
    # Tagged points would all be nodes; here every junction is one anyway.
    return cut(G.segments(w))


def _starts(s, d):
    """The world, its edges, and where searches from all points begin."""
    w = _net(s, d)
    g = cut(G.edges(_segments(w), {"mode": "highway"}))
    return w, g, G.starts(w, w.features.where("type = 'point'"), g)


def _reach(s, d):
    w, g, starts = _starts(s, d)
    return w, cut(G.reach(starts, g, LIMIT))


def _hits(s, d, found):
    w, g, starts = _starts(s, d)
    return w, G.hits(starts, g, LIMIT, G.ends(w, found(w)))


def _features(w):
    return w.features


def _key(c):
    return F.element_at(F.split(c, "/"), -1).cast("bigint")


def _brand(w):
    return w.find(Q.Tagged("#brand", "Brand#12"), order=False)


@q("SELECT CAST(p_partkey AS BIGINT) AS node, (p_partkey %% 20 > 0)::BIGINT + (p_partkey %% 20 < 19 AND p_partkey + 1 <= m)::BIGINT + (p_partkey >= 20)::BIGINT + (p_partkey + 20 <= m)::BIGINT AS n FROM part, (SELECT max(p_partkey) AS m FROM part)".replace("%%", "%"))
def degree(s, d):
    return G.degree(_segments(_net(s, d))).select(_key(F.col("node")).alias("node"), "n")


@q(_WALK + "SELECT origin, destination, round(m, 3) AS metres FROM best")
def reachable(s, d):
    h = _hits(s, d, _features)[1]
    return h.select(_key(F.col("origin")).alias("origin"), _key(F.col("destination")).alias("destination"), F.round("distance", 3).alias("metres"))


@q()
def reachable_area(s, d):
    w, g, starts = _starts(s, d)
    at = w.features.where("type = 'point'").select(G.text(F.struct(*W.KEY)).alias("node"), F.col("points")[0].alias("p"))
    return G.reached_area(starts, g, LIMIT, at).select(_key(F.col("origin")).alias("origin"), F.round("steradians", 15).alias("steradians"))


@q(_WALK + "SELECT p.k AS key, b.destination AS value FROM p LEFT JOIN best b ON b.origin = p.k AND b.destination <> p.k")
def accessible_all(s, d):
    w, h = _hits(s, d, _features)
    out = G.accessible_all(w.features.where("type = 'point'"), h)
    return out.select(_key(F.col("key")).alias("key"), _key(F.col("value")).alias("value"))


@q(_WALK + "SELECT b.origin, b.destination, round(b.m, 3) AS cost FROM best b JOIN p ON p.k = b.destination WHERE p.p_brand = 'Brand#12' AND b.origin <> b.destination")
def accessible_routes(s, d):
    w, g, starts = _starts(s, d)
    steps = G.routes_to(starts, g, LIMIT, G.ends(w, _brand(w)))
    return steps.groupBy(_key(F.col("origin")).alias("origin"), _key(F.col("destination")).alias("destination")).agg(F.round(F.max("cost"), 3).alias("cost"))


@q(_WALK + "SELECT p.k AS key, b.destination AS value FROM p LEFT JOIN (SELECT best.* FROM best JOIN p ON p.k = destination WHERE p.p_brand = 'Brand#12' AND origin <> destination) b ON b.origin = p.k")
def filter_accessible(s, d):
    w, r = _reach(s, d)
    pairs = G.accessible_all(w.features.where("type = 'point'"), G.reachable(w, r, w.features))
    as_id = lambda c: F.when(F.col(c).isNotNull(), D.id_of("point", "part", _key(F.col(c))))
    kept = Collection(pairs.select(as_id("key").alias("key"), as_id("value").alias("value"))).keep_values_in(_brand(w))
    return kept.df.select(F.col("key.value").alias("k"), F.col("value.value").alias("v")).toDF("key", "value")


@q(_WALK + """, b AS (SELECT k AS area, [k, k + 1, k + 21, k + 20] AS ring FROM p WHERE k % 7 = 0 AND k % 20 < 19 AND k + 21 <= (SELECT max(k) FROM p))
SELECT DISTINCT best.origin AS key, b.area AS value FROM best JOIN b ON list_contains(b.ring, best.destination) WHERE best.m > 0""")
def building_access(s, d):
    w, g, starts = _starts(s, d)
    w = W.World(w.features.unionByName(D.buildings(s, d)))
    h = G.hits(starts, g, LIMIT, G.ends(w, G.buildings(w)))
    return h.select(_key(F.col("origin")).alias("key"), _key(F.col("destination")).alias("value"))


_NEAR = _WALK + "SELECT p.k AS origin, round(coalesce(min(b.m), 0), 3) AS metres FROM p LEFT JOIN (SELECT best.* FROM best JOIN p ON p.k = destination WHERE p.p_brand = 'Brand#12') b ON b.origin = p.k GROUP BY 1"


@q(_WALK + "SELECT b.origin, round(min(b.m), 3) AS metres FROM best b JOIN p ON p.k = destination WHERE p.p_brand = 'Brand#12' GROUP BY 1")
def closest(s, d):
    h = _hits(s, d, _brand)[1]
    return G.closest(h).select(_key(F.col("origin")).alias("origin"), F.round("distance", 3).alias("metres"))


@q(_NEAR)
def closest_distance(s, d):
    w, h = _hits(s, d, _brand)
    every = w.features.where("type = 'point'").select(F.col("value").alias("origin"))
    near = G.closest(h).select(_key(F.col("origin")).alias("origin"), F.round("distance", 3).alias("m"))
    return every.join(near, "origin", "left").select("origin", F.coalesce("m", F.lit(0.0)).alias("metres"))


@q(_WALK.replace("best AS (", """x AS (SELECT k AS origin, k AS node, CAST(0 AS DOUBLE) AS m, 0 AS hops, CAST([] AS VARCHAR[]) AS way FROM p
  UNION ALL SELECT x.origin, e.b, x.m + e.m, x.hops + 1, list_append(x.way, CASE WHEN abs(e.a - e.b) = 1 THEN 'path/tables/row/' || (e.a // 20) ELSE 'path/tables/col/' || (e.a % 20) END) FROM x JOIN e ON x.node = e.a WHERE x.m + e.m < 400.0),
one AS (SELECT origin, node, arg_min(way, (m, hops, way)) AS way FROM x WHERE node IN (SELECT k FROM p WHERE p_brand = 'Brand#12') GROUP BY ALL),
best AS (""") + "SELECT way[i] AS path, count(*) AS n FROM one, range(1, len(way) + 1) t(i) WHERE i = 1 OR way[i - 1] <> way[i] GROUP BY 1")
def paths_to_reach(s, d):
    w, g, starts = _starts(s, d)
    return G.uses(starts, g, LIMIT, G.ends(w, _brand(w)))


def _connected(s, d, features):
    """The paths that the change adds, by their ends."""
    w = _net(s, d)
    w = W.World(w.features.unionByName(features))
    change = Cn.connect_features(w, features, G.network(w, _segments(w), Cn.REACH))
    added = w.with_change(change).features.where(F.col("ns") == Cn.ACCESS_PATHS)
    return added.select(F.get("refs", F.lit(0))["value"].alias("id"), F.get("refs", F.lit(1))["value"].alias("node"), F.round(geo.length(F.col("points")), 2).alias("metres"))


def _legs_sql(points: str) -> str:
    """The nearest leg within 500 m by comparing with all of them: on a plane around the point, as legs are short."""
    return f"""
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, (515000000 + (p_partkey // 20) * 10000) / 1e7 AS lat, (-1300000 + (p_partkey % 20) * 15000) / 1e7 AS lng FROM part),
e AS (SELECT a.k AS a, b.k AS b, a.lat AS alat, a.lng AS alng, b.lat AS blat, b.lng AS blng, CASE WHEN b.k = a.k + 1 THEN 'row/' || (a.k // 20) ELSE 'col/' || (a.k % 20) END AS path FROM p a JOIN p b ON (b.k = a.k + 1 AND a.k // 20 = b.k // 20) OR b.k = a.k + 20),
q AS ({points}),
m AS (SELECT q.*, e.*, cos(radians(q.lat)) AS c FROM q JOIN e ON abs(e.alat - q.lat) < 0.02 AND abs(e.alng - q.lng) < 0.02),
f AS (SELECT *, greatest(0, least(1, -((alng - lng) * c * (blng - alng) * c + (alat - lat) * (blat - alat)) / (pow((blng - alng) * c, 2) + pow(blat - alat, 2)))) AS t FROM m),
g AS (SELECT *, {_hav("lat", "lng", "(alat + t * (blat - alat))", "(alng + t * (blng - alng))")} AS metres FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, path, a) AS r FROM g WHERE metres < 500)
SELECT n.id, p.k AS node, round({_hav("n.lat", "n.lng", "p.lat", "p.lng")}, 2) AS metres FROM n JOIN p ON p.k IN (n.a, n.b) WHERE r = 1"""


@q(_legs_sql(f"SELECT CAST(c_custkey AS BIGINT) AS id, {_LAT} AS lat, {_LNG} AS lng FROM customer"))
def connect_to_network_all(s, d):
    return _connected(s, d, D.customers(s, d))


@q(_legs_sql("SELECT CAST(s_suppkey AS BIGINT) AS id, (515000000 + (s_suppkey * 6007) % 200000) / 1e7 AS lat, (-1300000 + (s_suppkey * 15013) % 300000) / 1e7 AS lng FROM supplier"))
def connect_to_network(s, d):
    return _connected(s, d, D.suppliers(s, d))


@q("SELECT count(*) FILTER (p_partkey = 21) AS connected, (SELECT count(DISTINCT p_partkey // 20) + count(DISTINCT p_partkey % 20) + 1 FROM part) AS paths FROM part")
def connect(s, d):
    """Of two pairs of points the one without a direct segment gets a path with the id value 1."""
    w = _net(s, d)
    at = lambda k: ids.FeatureID("point", "tables/part", k)
    segs = _segments(w)
    near, far = Cn.connect_points(w, segs, at(1), at(2)), Cn.connect_points(w, segs, at(0), at(21))
    return w.with_change(near).with_change(far).features.where("type = 'path'").agg(F.count_if(F.col("ns") == Cn.ACCESS_PATHS).alias("connected"), F.count("*").alias("paths"))


# GeoJSON


def _docs(s, d):
    """Customers' points as GeoJSON texts."""
    return _points(s, d).select(F.col("value").alias("id"), J.to_geojson(F.lit("point"), F.col("points"), F.lit(None).cast(geo.AREA)).alias("text"))


_LATLNG = f"SELECT CAST(c_custkey AS BIGINT) AS id, {_LAT} AS lat, {_LNG} AS lng FROM customer"


@q(_LATLNG)
def parse_geojson(s, d):
    g = J.geometry(F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates")))
    return _docs(s, d).select("id", J.parse(F.col("text")).alias("g")).select("id", g["points"][0].alias("p")).select("id", "p.*")


@q(f"SELECT CAST(c_custkey AS BIGINT) AS id, 'Point' AS type, {_LNG} AS lng, {_LAT} AS lat FROM customer")
def to_geojson(s, d):
    """Read by the engine's own functions on JSON texts."""
    at = lambda p: F.get_json_object("text", p)
    return _docs(s, d).select("id", at("$.type").alias("type"), at("$.coordinates[0]").cast("double").alias("lng"), at("$.coordinates[1]").cast("double").alias("lat"))


def _collection_doc(s, d) -> DataFrame:
    a = _nations(s, d).select("value", J.to_geojson(F.lit("area"), F.col("points"), F.col("polygons")).alias("text"))
    return J.to_collection(a, "text", ["value"])


@q("SELECT count(*) AS n FROM nation")
def to_geojson_collection(s, d):
    return _collection_doc(s, d).select(F.size(J.features(J.parse(F.col("value")))).cast("bigint").alias("n"))


def _file(s, d) -> str:
    path = fresh(s)
    _collection_doc(s, d).coalesce(1).write.text(path)
    return path


def _read_back(s, d) -> DataFrame:
    return J.read_file(s, _file(s, d) + "/part-*")


@q("SELECT count(*) AS n FROM nation")
def parse_geojson_file(s, d):
    return _read_back(s, d).select(F.size(J.features(F.col("geojson"))).cast("bigint").alias("n"))


@q(f"SELECT 'area' AS type, 'tables/made' AS ns, CAST(n_nationkey AS BIGINT) AS value FROM nation")
def import_geojson(s, d):
    docs = _collection_doc(s, d).select(J.parse(F.col("value")).alias("g"))
    return J.import_features(docs, "g", "tables/made").added.select("type", "ns", "value")


@q(SQL["import_geojson"])
def import_geojson_file(s, d):
    return J.import_features(_read_back(s, d), "geojson", "tables/made").added.select("type", "ns", "value")


@q(f"SELECT round({_AREA} / 100) AS ares FROM ({_RECT})")
def geojson_areas(s, d):
    return J.areas(_collection_doc(s, d).select(J.parse(F.col("value")).alias("g")), "g").select(F.round(geo.area(F.col("polygons")) / 100).alias("ares"))


def _north(g):
    up = F.transform(g["points"], lambda p: geo.ll(p["lat"] + 1, p["lng"]))
    return F.struct(g["kind"].alias("kind"), up.alias("points"), g["polygons"].alias("polygons"))


def _applied(s, d, kind):
    docs = _docs(s, d).select("id", J.parse(F.col("text")).alias("g"))
    out = docs.select("id", J.map_geometries(F.col("g"), J.apply_to(kind, _north))[0]["points"][0].alias("p"))
    return out.select("id", F.round("p.lat", 7).alias("lat"), F.round("p.lng", 7).alias("lng"))


_MOVED = f"SELECT CAST(c_custkey AS BIGINT) AS id, round({_LAT} + 1, 7) AS lat, round({_LNG}, 7) AS lng FROM customer"
for _kind, _sql in (("point", _MOVED), ("path", _MOVED.replace(" + 1", "")), ("area", _MOVED.replace(" + 1", ""))):
    q(_sql, f"apply_to_{_kind}")(lambda s, d, k=_kind: _applied(s, d, k))
q(_MOVED, "map_geometries")(lambda s, d: _applied(s, d, "point"))


# Sources and layers


@q("SELECT CAST(c_custkey AS BIGINT) AS id, n_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
def join_tags(s, d):
    c, n = table(s, d, "customer"), table(s, d, "nation")
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("/point/tables/customer/"), F.col("c_custkey").cast("string")).alias("id"), F.col("n_name").alias("#country"))
    return ingest.join_tags(D.customers(s, d), rows).select(F.col("value").alias("id"), Q.first_value("#country").alias("value"))


@q()
def colour_areas(s, d):
    return A.colour(_nations(s, d).select(F.col("value").alias("id"), "polygons"))


@q("SELECT 'people' AS layer, count(*) AS n FROM customer UNION ALL SELECT 'shops', count(*) FROM supplier")
def basemap(s, d):
    rules = [("#supplier", "yes", 10, 20, "shops"), ("#nation", None, 5, 16, "people"), ("#brand", None, 17, 20, "parts")]
    return Rn.basemap(D.world(s, d, "customer", "supplier", "part").features, rules, 12).groupBy("layer").agg(F.count("*").alias("n"))


@q("SELECT CAST(c_custkey AS BIGINT) AS id, c_nationkey AS v FROM customer ORDER BY c_custkey LIMIT 10000")
def query_layer(s, d):
    hits = D.world(s, d, "customer").find(Q.Keyed("#segment"), order=False)
    return Rn.query_layer(hits, Q.first_value("#nation").cast("int")).select(F.col("value").alias("id"), "v")


@q("SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1")
def histogram_layer(s, d):
    f = D.customers(s, d)
    a = assign(Collection(f.select(F.struct("type", "ns", "value").alias("key"), Q.first_value("#segment").alias("value"))))
    return Rn.histogram_layer(f, a).select(Q.first_value("#segment").alias("label"), "bucket").groupBy("label").agg(F.count("*").alias("n"))


@q("SELECT 'customer' AS kind, count(DISTINCT o_custkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'supplier', count(DISTINCT l_suppkey) FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def collection_layer(s, d):
    hit = Rn.collection_layer(D.world(s, d, "customer", "supplier", "part").features, D.od_items(s, d))
    return hit.groupBy(F.element_at(F.split("ns", "/"), 2).alias("kind")).agg(F.count("*").alias("n"))


# The pipeline language


@q("SELECT CAST(p_size AS VARCHAR) AS key, count(*) AS value FROM part WHERE p_brand = 'Brand#12' GROUP BY 1")
def shell_pipeline(s, d):
    return shell.Evaluator(D.world(s, d, "part"))('find [#brand="Brand#12"] | map {f -> get-string f "size"} | count-values').df


@q("SELECT c_mktsegment AS key, count(*) AS value FROM customer GROUP BY 1")
def evaluate_feature(s, d):
    id = ids.FeatureID("expression", "tables/made", 1)
    w = D.world(s, d, "customer").with_change(W.add_expression(s, id, [], 'find [#segment] | map (get-string "#segment") | count-values'))
    return shell.Evaluator(w).evaluate_feature(id).df
