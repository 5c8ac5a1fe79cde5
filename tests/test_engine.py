"""The engine on a hand-built world and known values."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane import ids, query as Q, shell, validate, world as W
from terrane.functions import cells, geo, geojson as J, numbers as N, sphere as S, tiles, wkt
from terrane.ids import FeatureID
from terrane.operators import areas as A, connect as Cn, graph as G, histogram as H, render
from terrane.operators.collections import Collection
from terrane.queries import spatial
from terrane.sources import ingest, transit
from terrane.streaming import deltas

NS = "mini/node"


def P(v):
    return ("point", NS, v)


def _pt(v, lat, lng, *tags):
    return {"type": "point", "ns": NS, "value": v, "tags": list(tags), "points": [(lat, lng)]}


# A street of five points eastwards, a side street, a one-way street, a square building round a hole.
STEP = 0.001


@pytest.fixture(scope="module")
def mini(spark):
    at = {i: (0.0, i * STEP) for i in range(5)} | {10: (STEP, 2 * STEP), 11: (2 * STEP, 2 * STEP)}
    rows = [_pt(i, *at[i], *([("name", "plain")] if i == 3 else [])) for i in at]
    path = lambda v, pts, *tags: {"type": "path", "ns": "mini/way", "value": v, "tags": list(tags), "points": [at[p] for p in pts], "refs": [P(p) for p in pts]}
    rows += [path(1, [0, 1, 2, 3, 4], ("#highway", "residential")), path(2, [2, 10, 11], ("#highway", "footway"), ("network:weight", "2")), path(3, [4, 11], ("#highway", "primary"), ("oneway", "yes"))]
    sq = lambda a, b: [(a, a), (a, b), (b, b), (b, a)]
    rows.append({"type": "area", "ns": "mini/way", "value": 9, "tags": [("#building", "yes"), ("#building", "no"), ("@wikidata", "Q1")], "polygons": [[sq(0.0, 0.004), sq(0.001, 0.002)]], "refs": [("path", "mini/way", 2)]})
    rows.append({"type": "relation", "ns": "mini/rel", "value": ids.signed((1 << 63) + 5), "tags": [("#route", "bus")], "members": [(P(0), "stop")]})
    return W.World(W.feature_rows(spark, rows))


def names(df):
    return [f"{r.type}/{r.value}" for r in df.collect()]


def test_find_and_matches_differ(mini):
    assert names(mini.find(Q.Keyed("name"))) == []  # not a search key
    assert mini.features.where(mini.matches(Q.Keyed("name"))).count() == 1
    assert names(mini.find(Q.Keyed("@wikidata"))) == ["area/9"]
    assert names(mini.find(Q.Tagged("#building", "no"))) == ["area/9"]  # any of a repeated key's values is found
    assert mini.features.where(mini.matches(Q.Tagged("#building", "no"))).count() == 0  # the first one counts
    assert names(mini.find(Q.IsValid())) == [] and mini.features.where(mini.matches(Q.IsValid())).count() == mini.features.count()
    assert len(names(mini.find(Q.Typed("point", Q.All())))) == 1  # points without tags are not indexed
    typed = Q.Typed("path", Q.Tagged("#highway", "primary"))
    assert names(mini.find(typed)) == ["path/3"] and mini.features.where(mini.matches(typed)).count() == 3


def test_find_is_in_order_of_ids(mini):
    assert names(mini.find(Q.All()))[-1] == f"relation/{ids.signed((1 << 63) + 5)}"
    assert names(mini.find(Q.Keyed("#highway") | Q.Keyed("#building"))) == ["path/1", "path/2", "path/3", "area/9"]
    assert names(mini.find(Q.Keyed("#highway") & Q.Tagged("#highway", "primary"))) == ["path/3"]


def test_queries_simplify_and_round_trip():
    q = (Q.Keyed("#a") & Q.Keyed("#b")) & (Q.Keyed("#c") & Q.Typed("area", Q.Tagged("#d", "e")))
    assert len(q.queries) == 4 and Q.from_dict(json.loads(json.dumps(q.to_dict()))) == q
    assert Q.intersecting("area", ()) == Q.Empty()


def test_missing_feature_is_an_error(mini):
    with pytest.raises(Exception, match="no feature"):
        mini.find_feature(FeatureID("point", NS, 99)).collect()
    with pytest.raises(TypeError):
        mini.find_area(FeatureID("point", NS, 1))


def test_spatial_queries(mini):
    assert names(mini.find(Q.Keyed("#highway") & Q.IntersectsCap(0.0, 0.0045, 60.0))) == ["path/1", "path/3"]
    area = mini.features.where("type = 'area'")
    inside = lambda lat, lng: area.where(Q.IntersectsGeometry("point", (lat, lng)).column()).count()
    assert (inside(0.0005, 0.0005), inside(0.0015, 0.0015), inside(0.005, 0.005)) == (1, 0, 0)
    box = ((((-0.0005, 0.0035), (-0.0005, 0.0045), (0.0005, 0.0045), (0.0005, 0.0035)),),)
    assert names(mini.find(Q.Keyed("#highway") & Q.IntersectsGeometry("area", box))) == ["path/1", "path/3"]
    assert names(mini.find(Q.Keyed("#highway") & Q.IntersectsGeometry("path", ((-0.001, 0.0025), (0.001, 0.0025))))) == ["path/1"]


def test_tokens(mini):
    got = mini.features.where("type = 'area'").select(Q.tokens().alias("t")).first().t
    assert got == ["*", "building=no", "building=yes", "wikidata"]


def test_tag_changes(mini, spark):
    id = FeatureID("area", "mini/way", 9)
    tags = lambda w: [tuple(t) for t in w.find_feature(id).first().tags]
    assert tags(mini.with_change(W.add_tag(spark, id, "#building", "hut"))) == [("#building", "hut"), ("#building", "no"), ("@wikidata", "Q1")]
    assert tags(mini.with_change(W.add_tag(spark, id, "new", "1")))[-1] == ("new", "1")
    assert tags(mini.with_change(W.remove_tag(spark, id, "#building"))) == [("@wikidata", "Q1")]
    both = W.merge_changes(mini, W.remove_tag(spark, id, "#building"), W.add_tag(spark, id, "z", "1"), W.add_tag(spark, id, "z", "2"))
    assert tags(mini.with_change(both)) == [("@wikidata", "Q1"), ("z", "2")]
    assert len(tags(mini)) == 3
    with pytest.raises(KeyError):
        W.merge_changes(mini, W.add_tag(spark, FeatureID("area", "mini/way", 77), "a", "b"))


def test_overlay_replaces_and_base_stays(mini, spark):
    w = mini.with_change(W.add_point(spark, 1.0, 1.0, FeatureID("point", NS, 0), [("#amenity", "cafe")]))
    assert names(w.find(Q.Keyed("#amenity"))) == ["point/0"] and names(mini.find(Q.Keyed("#amenity"))) == []
    assert w.features.count() == mini.features.count()


def test_worlds(mini, spark):
    ws, id = W.Worlds(mini), FeatureID("collection", ids.WORLDS, 1)
    ws.apply(id, W.add_point(spark, 1.0, 1.0, FeatureID("point", NS, 50), [("#a", "b")]))
    assert ws.list() == [id] and ws.find_or_create(id).features.count() == mini.features.count() + 1
    ws.add_world_with_change(id, W.add_point(spark, 1.0, 1.0, FeatureID("point", NS, 51), [("#a", "b")]))
    assert names(ws.find_or_create(id).find(Q.Keyed("#a"))) == ["point/51"]
    ws.delete(id)
    assert ws.list() == []


def test_changes_round_trip(mini, spark, tmp_path):
    c = W.merge_changes(mini, W.add_tag(spark, FeatureID("area", "mini/way", 9), "k", "v"), W.add_collection(FeatureID("collection", "c", 1), [("t", "u")], Collection.from_list(spark, ["x", "y"], "string")))
    back = W.changes_from_file(spark, W.changes_to_file(c, str(tmp_path / "c")))
    w = mini.with_change(back)
    assert [r.value for r in w.list_feature(FeatureID("collection", "c", 1)).df.orderBy("ord").collect()] == ["x", "y"]
    assert W.export_world(w, str(tmp_path / "w")) == mini.features.count() + 1 == W.read_world(spark, str(tmp_path / "w")).features.count()


def test_references(mini):
    pts = mini.features.where("type = 'point' AND value = 2")
    assert sorted(r.value for r in mini.point_paths(pts).collect()) == [1, 2]
    assert sorted(r.target.value for r in mini.point_features(mini.features.where("type = 'area'")).collect()) == [2, 10, 11]


# Graph


def test_segments_and_degree(mini):
    segs = G.segments(mini)
    ends = sorted((r.first_node.split("/")[-1], r.last_node.split("/")[-1]) for r in segs.where("forward").collect())
    # Nodes: ends of paths, points of two paths, points with tags (3).
    assert ends == [("0", "2"), ("2", "11"), ("2", "3"), ("3", "4"), ("4", "11")]
    assert {r.node.split("/")[-1]: r.n for r in G.degree(segs).collect()} == {"0": 1, "2": 3, "3": 2, "4": 2, "11": 2}


@pytest.mark.parametrize("mode", ["simple", "highway", "walk", "bus", "car"])
def test_searches_agree(mini, rows, mode):
    g = G.edges(G.segments(mini), {"mode": mode})
    starts = G.starts(mini, mini.features.where("type = 'point'"), g)
    assert rows(G.reach(starts, g, 400.0)) == rows(G.reach(starts, g, 400.0, 0))


@pytest.mark.parametrize("seed", range(3))
def test_searches_agree_on_ties(spark, rows, seed):
    """Whole costs, so many ways are equal, with unequal numbers of hops; some cost nothing, in circles too."""
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(90)}
    e = [(a, b, f"p{rnd.randrange(6)}", float(rnd.choice([0, 1, 1, 2, 3]))) for a, b in pairs for _ in range(rnd.choice([1, 1, 2]))]
    g = spark.createDataFrame(e, "a string, b string, path string, cost double")
    starts = spark.createDataFrame([("o", "n1"), ("o", "n2"), ("q", "n3"), ("r", "nowhere")], "origin string, node string")
    small, large = G.reach(starts, g, 7.0), G.reach(starts, g, 7.0, 0)
    assert rows(small) == rows(large)
    got = {(r.origin, r.node): r for r in small.collect()}
    for (o, v), r in got.items():
        ways = [(got[o, a].distance + c, got[o, a].hops + 1, a, p) for a, b, p, c in e if b == v and (o, a) in got]
        assert r.hops == 0 or min(ways) == (r.distance, r.hops, r.prev, r.via)
    # Ways are followed back step by step.
    steps = {}
    for x in G.routes(small, small.select(F.col("node").alias("destination"))).collect():
        steps.setdefault((x.origin, x.destination), {})[x.ord] = x
    for (o, v), r in got.items():
        way = []
        while r.hops:
            way.append((r.hops - 1, r.via, r.node, r.distance))
            r = got[o, r.prev]
        assert sorted((x.ord, x.via, x.node, x.cost) for x in steps.get((o, v), {}).values()) == sorted(way)


def test_weights(mini):
    m = math.radians(STEP) * S.R
    segs = G.segments(mini)
    cost = lambda **o: {(r.a.split("/")[-1], r.b.split("/")[-1]): r.cost for r in G.edges(segs, o).collect()}
    assert cost(mode="walk")[("0", "2")] == pytest.approx(2 * m * 1.25) and cost(mode="highway")[("2", "11")] == pytest.approx(4 * m)
    car = cost(mode="car")
    assert ("2", "11") not in car and ("4", "11") in car and ("11", "4") not in car
    with pytest.raises(ValueError):
        G.weights({"mode": "flying"})


def test_limit_is_strict(mini):
    g = G.edges(G.segments(mini), {"mode": "simple"})
    at = mini.features.where("type = 'point' AND value = 0")
    limit = g.where("a LIKE '%/0'").first().cost
    assert G.reach(G.starts(mini, at, g), g, limit).count() == 1


def test_routes_and_accessible(mini):
    g = G.edges(G.segments(mini), {"mode": "highway"})
    origin = mini.features.where("type = 'point' AND value IN (0, 1)")
    r = G.reach(G.starts(mini, origin, g), g, 600.0)
    hits = G.reachable(mini, r, mini.features)
    # The area is reached through point 2; point 1 is no node, so it reaches nothing.
    assert {(x.origin[-1], x.destination.split("/")[-1]) for x in hits.where("kind = 1").collect()} == {("0", "9")}
    acc = {(x.key[-1], x.value and x.value.split("/")[-1]) for x in G.accessible_all(origin, hits).collect()}
    assert ("1", None) in acc and ("0", "4") in acc and ("0", "0") not in acc
    assert len(G.accessible_all(origin, hits, flip=True).where("key IS NULL").collect()) == 0
    steps = G.routes(r, hits.where("destination LIKE '%/4'")).orderBy("ord").collect()
    assert [s.node.split("/")[-1] for s in steps] == ["2", "3", "4"]
    assert {(x.path.split("/")[-1], x.n) for x in G.paths_to_reach(G.routes(r, hits.where("kind = 0"))).collect()} >= {("1", 3)}
    assert G.closest(hits.where("destination <> origin")).first().destination.endswith("/2")


def test_transit_and_climb(spark):
    pts = [_pt(i, 0.0, i * STEP, ("ele", str(e))) if e is not None else _pt(i, 0.0, i * STEP) for i, e in enumerate([0, 10, None, 4])]
    path = {"type": "path", "ns": "gtfs", "value": 1, "tags": [("#highway", "x"), ("gtfs:peak", "180")], "points": [(0.0, i * STEP) for i in range(4)], "refs": [P(i) for i in range(4)]}
    w = W.World(W.feature_rows(spark, [*pts, path]))
    segs = G.with_climb(G.segments(w), w)
    got = {(r.first, r.last): (r.climb, r.fall) for r in segs.collect()}
    assert got[(0, 1)] == (10, 0) and got[(1, 3)] == (0, 6) and got[(1, 0)] == (10, 0)
    e = G.edges(G.segments(w), {"mode": "transit", "peak": "yes"}).collect()
    assert {r.cost for r in e} == {180.0} and all(r.a < r.b for r in e)


def test_network_and_nearest(mini, spark):
    assert {r.path.split("/")[-1] for r in G.network(mini, G.segments(mini), 200.0).collect()} == {"1", "2", "3"}
    assert G.network(mini, G.segments(mini), 5000.0).count() == 0
    at = spark.createDataFrame([("a", (0.0001, 0.0015)), ("far", (1.0, 1.0))], f"id string, at {geo.POINT}")
    paths = mini.features.where("type = 'path'").select(F.col("value").cast("string").alias("path"), "points")
    (r,) = G.connect_nearest(at, paths, 50.0).collect()
    assert (r.id, r.path) == ("a", "1") and r.metres == pytest.approx(math.radians(0.0001) * S.R, rel=1e-3)


def test_network_measures_nodes_between_the_extremes(spark):
    t = math.degrees(500.0 / S.R)

    def kept(diagonal, lng):
        at = {0: (0.0, lng), 1: (0.9 * t, lng), 2: (0.0, lng + 0.9 * t), 3: (diagonal * t, lng + diagonal * t)}
        at = {i: (a, (b + 180.0) % 360.0 - 180.0) for i, (a, b) in at.items()}
        rows = [_pt(i, *p) for i, p in at.items()]
        rows += [{"type": "path", "ns": "w", "value": i, "tags": [("#highway", "residential")], "points": [at[0], at[i]], "refs": [P(0), P(i)]} for i in (1, 2, 3)]
        w = W.World(W.feature_rows(spark, rows))
        return {r.path.split("/")[-1] for r in G.network(w, G.segments(w), 500.0).collect()}

    assert kept(0.85, 0.0) == {"1", "2", "3"}
    assert kept(0.6, 0.0) == set()
    assert kept(0.85, 180.0 - 0.5 * t) == {"1", "2", "3"}


def test_features_connect_within_500_metres_to_the_network_only(spark, rows, monkeypatch):
    t = math.degrees(500.0 / S.R)
    at = {0: (0.0, 0.0), 1: (0.0, 2 * t), 2: (0.6 * t, t), 3: (0.6 * t, 1.1 * t)}
    path = lambda v, a, b: {"type": "path", "ns": "w", "value": v, "tags": [("#highway", "residential")], "points": [at[a], at[b]], "refs": [P(a), P(b)]}
    w = W.World(W.feature_rows(spark, [*[_pt(i, *p) for i, p in at.items()], path(1, 0, 1), path(2, 2, 3)]))
    customers = W.feature_rows(spark, [{"type": "point", "ns": "c", "value": 7, "points": [(0.5 * t, t)]}])
    monkeypatch.setattr(spatial, "_net", lambda s, d: w)
    monkeypatch.setattr(spatial.D, "customers", lambda s, d: customers)
    monkeypatch.setattr(spatial.D, "suppliers", lambda s, d: customers)
    # The isolated path is nearer, but no network: both ends of the other one are led to.
    far = pytest.approx(math.hypot(250.0, 500.0), abs=0.1)
    assert rows(spatial.connect_to_network_all(spark, "")) == [(7, 0, far), (7, 1, far)]
    assert rows(spatial.connect_to_network(spark, "")) == [(7, 0, far), (7, 1, far)]


@pytest.fixture(scope="module")
def block(spark):
    """A street of three points along the equator, a house with a door, one without, one on the street, and a lone point."""
    m = math.degrees(1 / S.R)
    at = {0: (0, 0), 1: (0, 300), 2: (0, 900)}  # metres north, east
    at |= {10: (20, 100), 11: (20, 140), 12: (60, 140), 13: (60, 100)} | {20: (-50, 398), 21: (-30, 398), 22: (-30, 402), 23: (-50, 402)} | {30: (40, 300), 31: (40, 340), 40: (70, 2), 41: (5000, 0)}
    place = {i: (a * m, b * m) for i, (a, b) in at.items()}
    rows = [_pt(i, *p, *([("entrance", "main")] if i == 12 else [])) for i, p in place.items()]
    path = lambda v, pts, *tags: {"type": "path", "ns": "w", "value": v, "tags": list(tags), "points": [place[p] for p in pts], "refs": [P(p) for p in pts]}
    area = lambda v: {"type": "area", "ns": "w", "value": v, "polygons": [], "refs": [("path", "w", v)]}
    rows += [path(1, [0, 1, 2], ("#highway", "residential")), path(5, [10, 11, 12, 13, 10]), path(6, [20, 21, 22, 23, 20]), path(7, [1, 30, 31, 1]), area(5), area(6), area(7)]
    return W.World(W.feature_rows(spark, rows))


def _ways(w, change):
    new = w.with_change(change).features.where(F.col("ns") == Cn.ACCESS_PATHS).collect()
    return {(tuple(r.refs[0][1:]), tuple(r.refs[1][1:])) for r in new if r.tags[0][0] == G.CONNECTION[0]}


def test_connecting_to_points_that_exist(spark, block):
    network = spark.createDataFrame([("path/w/1",)], "path string")
    features = block.features.where("type = 'area' OR value IN (0, 40, 41)")
    change = Cn.connect_features(block, features.unionByName(features), network)
    # The door; the nearer end of the nearest side; what is on the street stays as it is.
    n = lambda a, b: ((NS, a), (NS, b))
    assert _ways(block, change) == {n(12, 0), n(12, 1), n(22, 1), n(22, 2), n(40, 0), n(40, 1)}
    assert Cn.connect_features(block, features.limit(0), network).added.count() == 0


def test_connecting_inserts_and_clusters_points(spark, block):
    network = spark.createDataFrame([("path/w/1",)], "path string")
    change = Cn.connect_features(block, block.features.where("type = 'area' OR value IN (0, 40, 41)"), network, "insert")
    w = block.with_change(change)
    street = w.features.where("type = 'path' AND ns = 'w' AND value = 1").first()
    east = [round(math.radians(p.lng) * S.R) for p in street.points]
    # 140 m of the door and 400 m of the other house are new; 2 m is the street's first point.
    assert east == [0, 140, 300, 400, 900] and [r.ns for r in street.refs][0] == NS and street.refs[1].ns == Cn.ACCESS_POINTS + "/w"
    ways = _ways(block, change)
    assert {a[1] for a, _ in ways} == {12, 21, 40} and ((NS, 40), (NS, 0)) in ways and len(ways) == 3
    new = {(r.ns, r.value) for r in w.features.where("type = 'point'").where(F.col("ns").startswith(Cn.ACCESS_POINTS)).collect()}
    assert new == {b for a, b in ways if a[1] != 40} and len(new) == 2
    with pytest.raises(ValueError):
        Cn.connect_features(block, block.features, network, "other")


def test_insertions_that_lie_close_are_one(spark):
    m = math.degrees(1 / S.R)
    at = {0: (0.0, 0.0), 1: (0.0, 900 * m)} | {10 + i: (20 * m, x * m) for i, x in enumerate([100, 103, 105, 112])}
    rows = [_pt(i, *p) for i, p in at.items()] + [{"type": "path", "ns": "w", "value": 1, "tags": [("#highway", "x")], "points": [at[0], at[1]], "refs": [P(0), P(1)]}]
    w = W.World(W.feature_rows(spark, rows))
    change = Cn.connect_features(w, w.features.where("value >= 10"), spark.createDataFrame([("path/w/1",)], "path string"), "insert")
    street = w.with_change(change).features.where("type = 'path' AND ns = 'w'").first()
    # 100 and 103 meet at 101.5, 105 is 3.5 from there: 103.25; 112 is on its own.
    assert [round(math.radians(p.lng) * S.R, 1) for p in street.points] == [0, 103.2, 112, 900] or [round(math.radians(p.lng) * S.R, 2) for p in street.points] == [0, 103.25, 112, 900]


def test_connecting_two_points(mini):
    segs = G.segments(mini)
    at = lambda v: FeatureID("point", NS, v)
    assert Cn.connect_points(mini, segs, at(0), at(2)).added.count() == 0
    (r,) = Cn.connect_points(mini, segs, at(0), at(11)).added.collect()
    assert (r.type, r.value, [x.value for x in r.refs]) == ("path", 1, [0, 11])


def test_faults_of_features(spark, mini):
    at = [(0.0, 0.0), (0.0, 0.001), (0.001, 0.001)]
    path = lambda v, pts, refs=(): {"type": "path", "ns": "n", "value": v, "points": pts, "refs": list(refs)}
    area = lambda v, p: {"type": "area", "ns": "n", "value": v, "polygons": [], "refs": [("path", "n", p)]}
    rows = [path(1, [at[0]]), path(2, at), path(3, [*at, at[0]]), path(4, [*at[::-1], at[2]]), path(5, None, [P(0), P(99)]), path(6, [at[0], at[1], at[0]]), area(1, 3), area(2, 2), area(3, 77), {"type": "point", "ns": "", "value": 1}, {"type": "relation", "ns": "n", "value": 1}]
    got = sorted((r.type, r.value, r.fault) for r in validate.faults(mini, W.feature_rows(spark, rows)).collect())
    assert got == sorted([("path", 1, "few points"), ("path", 4, "clockwise"), ("path", 5, "missing point"), ("path", 6, "few corners"), ("area", 2, "open path"), ("area", 3, "missing path"), ("point", 1, "id")])
    good = validate.checked(mini, W.Change(added=W.feature_rows(spark, [rows[3]])))
    assert [tuple(p) for p in good.added.first().points] == [at[2], at[0], at[1], at[2]]
    for bad, invert in (([rows[3]], False), ([rows[0]], True)):
        with pytest.raises(ValueError):
            validate.checked(mini, W.Change(added=W.feature_rows(spark, bad)), invert)


def test_merged_worlds(spark, rows):
    one = W.World(W.feature_rows(spark, [_pt(1, 0.0, 0.0, ("k", "a")), _pt(2, 0.0, 0.0)]))
    two = W.World(W.feature_rows(spark, [_pt(1, 1.0, 1.0, ("k", "b")), _pt(3, 0.0, 0.0)]))
    got = W.World.merged(one, two)
    assert rows(got.features.select("value", Q.first_value("k"))) == [(1, "a"), (2, None), (3, None)] and got.items is None


def test_well_known_text(spark):
    texts = ["POINT (1.5 -2)", " linestring(0 0, 1 1.5e0 7)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "CIRCLE (1 2)", "", None]
    g = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", wkt.parse(F.col("t")).alias("g")).select("i", "g.*")
    got = {r.i: r for r in g.withColumn("back", wkt.to_wkt(F.col("kind"), F.col("points"), F.col("polygons"))).collect()}
    assert tuple(got[0].points[0]) == (-2.0, 1.5) and [tuple(p) for p in got[1].points] == [(0.0, 0.0), (1.5, 1.0)]
    assert [len(x) for x in got[2].polygons[0]] == [3, 3] and len(got[3].polygons) == 2 and {got[i].kind for i in (4, 5, 6)} == {"invalid"}
    assert got[0].back == "POINT (1.5 -2.0)" and got[2].back == "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0))" and got[4].back is None


def test_timetable_as_a_world(spark):
    stops = spark.createDataFrame([("a", "0.0", "0.0"), ("b", "0.0", " 0.01"), ("c", "x", "0"), ("a", "0.0", "0.0")], "stop_id string, stop_lat string, stop_lon string")
    times = spark.createDataFrame([("t", "a", "1", "09:00:00", "09:00:00"), ("t", "b", "2", "09:02:30", "09:02:30"), ("t", "c", "3", "09:05:00", "09:05:00")], "trip_id string, stop_id string, stop_sequence string, arrival_time string, departure_time string")
    w = transit.world(stops, times)
    (p,) = w.features.where("type = 'path'").collect()
    assert [tuple(t) for t in p.tags] == [("#gtfs", "connection"), ("gtfs:peak", "180")] and len(w.features.where("type = 'point'").collect()) == 2
    reached = G.reach(G.starts(w, w.features.where("type = 'point'"), g := G.edges(G.segments(w), {"mode": "transit", "peak": "yes", "connection": "#gtfs=connection"})), g, 500.0)
    assert {r.distance for r in reached.collect()} == {0.0, 180.0}


def test_meeting_features_and_cells(mini):
    assert {r.value for r in mini.find(Q.intersects_feature(mini.find_feature(FeatureID("path", "mini/way", 2))), "path").collect()} == {1}
    token = cells.token(cells.from_point(S.unit([(0.0, 0.001)])[0], 16))
    assert {r.value for r in mini.find(Q.intersects_cells([token]), "path").collect()} == {1}
    assert isinstance(Q.intersects_feature(mini.features.where("type = 'relation'")), Q.Empty)


def test_holes_and_several_polygons_contain(spark):
    sq = lambda a, b: [(a, a), (a, b), (b, b), (b, a)]
    areas = W.feature_rows(spark, [{"type": "area", "ns": "a", "value": 1, "polygons": [[sq(0.0, 9.0), sq(3.0, 6.0)], [sq(20.0, 21.0)]]}, {"type": "area", "ns": "a", "value": 2, "polygons": [[sq(4.0, 5.0)]]}])
    points = W.feature_rows(spark, [_pt(i, x, x) for i, x in enumerate([1.0, 4.5, 20.5, 30.0])])
    assert sorted((r.point.value, r.value) for r in A.containing(points, areas).collect()) == [(0, 1), (1, 2), (2, 1)]


# Geometry


def test_cells_known_ids():
    # A published pair of a place and its leaf cell.
    assert cells.from_point(S.unit([(49.703498679, 11.770681595)])[0]) == 0x47A1CBD595522B39
    rnd = random.Random(1)
    for _ in range(200):
        p = S.unit([(math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180))])[0]
        c = cells.from_point(p, 14)
        assert cells.level_of(c) == 14 and cells.from_token(cells.token(c)) == c and S.inside(p, cells.corners(c)) and cells.from_point(cells.center(c), 14) == c
        assert cells.parent(cells.from_point(p, 20), 14) == c and c in cells.children(cells.parent(c, 13))


def test_coverings():
    poly = [[S.unit([(51.5, -0.1), (51.5, -0.09), (51.51, -0.09), (51.51, -0.1)])]]
    cover = cells.covering(poly, 8, 16)
    rnd = random.Random(2)
    for _ in range(100):
        p = S.unit([(rnd.uniform(51.5, 51.5099), rnd.uniform(-0.1, -0.0901))])[0]
        assert any(cells.from_point(p, cells.level_of(c)) == c for c in cover)
    assert all(8 <= cells.level_of(c) <= 16 for c in cover)


def test_sphere_against_closed_forms():
    octant = S.unit([(0, 0), (0, 90), (90, 0)])
    assert S.loop_area(octant) == pytest.approx(math.pi / 2) and S.loop_area(octant[::-1]) == pytest.approx(4 * math.pi - math.pi / 2)
    assert S.inside(S.unit([(30, 45)])[0], octant) and not S.inside(S.unit([(-30, 45)])[0], octant) and not S.inside(S.unit([(-30, -135)])[0], octant)
    path = S.unit([(0, 0), (0, 10), (10, 10)])
    assert S.latlng(S.interpolate(path, 0.25))[0] == pytest.approx([0, 5])
    foot, edge, along = S.project(path, S.unit([(3, 4)])[0])
    assert edge == 0 and math.degrees(along) == pytest.approx(4, abs=0.02)
    rnd = np.random.default_rng(1)
    pts = S.unit(np.column_stack([rnd.uniform(50, 51, 200), rnd.uniform(0, 1, 200)]))
    h = S.hull(pts)
    assert all(S.inside(p, h) or np.min(S.angle(np.broadcast_to(p, h.shape), h)) < 1e-9 for p in pts) and S.loop_area(h) < math.pi
    line = S.unit([(0, x / 100) for x in range(50)] + [(0.3, 0.5)])
    keep = S.simplify(line, math.radians(0.001))
    assert keep.sum() == 3


def test_joins_of_paths(spark):
    a, b, c = [(0.0, 0.0), (0.0, 1.0)], [(0.0, 1.0), (0.0, 2.0)], [(5.0, 5.0), (6.0, 6.0)]
    df = spark.createDataFrame([(a, b)], f"a {geo.PATH}, b {geo.PATH}")
    assert len(df.select(geo.join(F.col("a"), F.col("b")).alias("j")).first().j) == 3
    assert len(df.select(geo.ordered_join(F.reverse("a"), F.reverse("b")).alias("j")).first().j) == 3
    with pytest.raises(Exception, match="share no end"):
        spark.createDataFrame([(a, c)], f"a {geo.PATH}, b {geo.PATH}").select(geo.ordered_join(F.col("a"), F.col("b"))).collect()


def test_area_with_hole_and_sample(mini):
    side = math.radians(0.004) * S.R
    hole = math.radians(0.001) * S.R
    assert mini.features.where("type = 'area'").select(geo.area(F.col("polygons")).alias("a")).first().a == pytest.approx(side**2 - hole**2, rel=1e-4)
    r = mini.features.where("type = 'path' AND value = 1").select(geo.sample(F.col("points"), F.lit(100.0)).alias("s"), geo.length(F.col("points")).alias("l")).first()
    assert len(r.s) == 6 and r.l == pytest.approx(math.radians(4 * STEP) * S.R)


def test_sightline_and_snap(spark):
    wall = [[[(0.0002, -0.001), (0.0002, 0.001), (0.0003, 0.001), (0.0003, -0.001)]]]
    b = spark.createDataFrame([(wall,)], f"polygons {geo.AREA}")
    o = spark.createDataFrame([("o", (0.0, 0.0))], f"id string, at {geo.POINT}")
    seen = A.sightlines(o, b, 100.0)
    inside = lambda lat, lng: seen.select(geo.contains(F.col("polygons"), geo.ll(lat, lng)).alias("c")).first().c
    assert inside(-0.0005, 0.0) and inside(0.0001, 0.0) and not inside(0.0005, 0.0)
    street = spark.createDataFrame([("p", [(0.00025, -0.01), (0.00025, 0.01)])], f"path string, points {geo.PATH}")
    got = A.snap_edges(spark.createDataFrame([("a", wall)], f"id string, polygons {geo.AREA}"), street, 20.0).first().polygons
    assert all(p.lat in (pytest.approx(0.00025), ) or p.lat in (0.0002, 0.0003) for p in got[0][0])


@pytest.mark.parametrize("lat, lng", [(80.0, 10.0), (-75.0, 179.9999), (0.0, -179.9999)])
def test_windows_at_any_latitude_and_across_180(spark, lat, lng):
    k = math.degrees(1 / S.R)
    turn = lambda x: (x + 180.0) % 360.0 - 180.0
    east = lambda m, up=0.0: (lat + up * k, turn(lng + m * k / math.cos(math.radians(lat))))
    for m in (-99.0, -60.0, 60.0, 99.0):
        at = spark.createDataFrame([("o", (lat, lng))], f"id string, at {geo.POINT}")
        path = spark.createDataFrame([("p", [east(m, -5.0), east(m, 5.0)])], f"path string, points {geo.PATH}")
        assert G.connect_nearest(at, path, 100.0).first().metres == pytest.approx(abs(m), abs=0.1)
        spots = spark.createDataFrame([(east(m), 7.0)], f"at {geo.POINT}, ele double")
        assert ingest.elevation(at, spots, 100.0).first().ele == pytest.approx(7.0)
        wall = [[[east(m, -5.0), east(m, 5.0), east(m * 2, 5.0), east(m * 2, -5.0)]]]
        ring = A.sightlines(at, spark.createDataFrame([(wall,)], f"polygons {geo.AREA}"), 100.0).first().polygons[0][0]
        ahead = [turn(p.lng - lng) * math.cos(math.radians(lat)) / k for p in ring if abs(p.lat - lat) < k]
        assert max(x * math.copysign(1, m) for x in ahead) == pytest.approx(abs(m), abs=0.1)


def test_colouring(spark, rows):
    grid = [(f"{i}{j}", [[[(i, j), (i, j + 1), (i + 1, j + 1), (i + 1, j)]]]) for i in range(3) for j in range(3)]
    df = spark.createDataFrame([(n, [[[(float(a), float(b)) for a, b in x] for x in p] for p in poly]) for n, poly in grid], f"id string, polygons {geo.AREA}")
    c = dict(rows(A.colour(df)))
    assert len(c) == 9 and all(c[r.a] != c[r.b] for r in A.adjacent(df).collect()) and max(c.values()) <= 8


def test_tiles(spark):
    assert spark.range(1).select(tiles.tile_x(F.lit(-0.1), 10).alias("x"), tiles.tile_y(F.lit(51.5), 10).alias("y")).first() == (511, 340)
    r = spark.range(1).select(tiles.tile_id(F.lit(2), F.lit(1), F.lit(3)).alias("i")).first().i
    assert r == (2 << 59) | (3 << 2) | 1
    t = spark.createDataFrame([(3, 5, 6)], "zoom int, x bigint, y bigint")
    assert {tuple(x) for x in tiles.children_to_parents(t, 5).collect()} == {(3, 5, 6), (2, 2, 3), (1, 1, 1), (0, 0, 0)}


def test_hashes():
    # Published values of both hashes.
    assert ids.fnv1(b"") == ids.fnv1a(b"") == 0xCBF29CE484222325
    assert ids.fnv1(b"a") == 0xAF63BD4C8601B7BE and ids.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_ids():
    assert ids.parse("/n/123") == ids.osm_node_id(123) and ids.parse("/area/a/b/7") == FeatureID("area", "a/b", 7)
    big = FeatureID("point", "x", (1 << 64) - 1)
    assert ids.parse(str(big)) == big and ids.signed(big.value) == -1
    assert ids.value_postcode(ids.postcode_value("ab1 2cd")) == "AB12CD"
    for bad in ("", "/x", "/nope/a/1", "/point/a/b"):
        with pytest.raises(ValueError):
            ids.parse(bad)


def test_postcode_number(spark):
    df = spark.createDataFrame([("AB1 2CD",), ("ab12cd",), ("A-1",), (None,), ("",)], "p string")
    v = ids.postcode_value("AB12CD")
    assert [r.v for r in df.select(ingest.postcode_number(F.col("p")).alias("v")).collect()] == [v, v, None, None, None]


# GeoJSON


def test_geojson(spark):
    poly = '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}'
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":%s,"properties":{"a":"b"}},{"type":"Feature","geometry":{"type":"Point","coordinates":[3.5,4.5]},"properties":null}]}' % poly
    df = spark.createDataFrame([(doc,)], "t string").select(J.parse(F.col("t")).alias("g"))
    got = J.import_features(df, "g", "x").added.orderBy("value").collect()
    assert [(r.type, r.value, [tuple(t) for t in r.tags]) for r in got] == [("area", 0, [("a", "b")]), ("point", 1, [])]
    assert len(got[0].polygons[0][0]) == 3 and tuple(got[1].points[0]) == (4.5, 3.5)
    assert J.areas(df, "g").count() == 1
    bare = spark.createDataFrame([(poly,), ("nonsense",), (None,)], "t string").select(J.parse(F.col("t")).alias("g"))
    assert J.areas(bare, "g").count() == 1
    back = spark.createDataFrame([([[[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]]],)], f"p {geo.AREA}").select(J.to_geojson(F.lit("area"), F.lit(None).cast(geo.PATH), F.col("p")).alias("t")).first().t
    assert json.loads(back) == {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}


# Collections and arithmetic


def _c(spark, pairs, schema="key string, value bigint"):
    return Collection.of(spark, pairs, schema)


def test_collection_fixtures(spark, rows):
    c = _c(spark, [("total", 100), ("children", 50), ("total", 200)])
    assert rows(c.sum_by_key().df) == [("children", 50), ("total", 300)]
    assert rows(Collection.from_list(spark, [2, 3, 2], "bigint").count_values().df) == [(2, 2), (3, 1)]
    base, joined = _c(spark, [(1, "b"), (3, "b")], "key bigint, value string"), _c(spark, [(k, "j") for k in (0, 1, 2, 4)], "key bigint, value string")
    assert [tuple(r) for r in base.join_missing(joined).df.collect()] == [(0, "j"), (1, "b"), (2, "j"), (3, "b"), (4, "j")]
    assert [r.value for r in Collection.from_list(spark, [3.0, 1.0, 1.0, 2.0], "double").percentiles().df.orderBy("ord").collect()] == [0.75, 0.0, 0.0, 0.5]
    assert [r.value for r in Collection.from_list(spark, random.Random(0).sample(range(1000), 1000), "bigint").top(3).df.collect()] == [999, 998, 997]
    assert c.take(0).df.count() == 0 and c.take(-1).df.count() == 0 and [r.value for r in c.take(2).df.collect()] == [100, 50]
    empty = _c(spark, [])
    assert empty.top(3).df.count() == 0 and empty.sum().first().value == 0 and empty.percentiles().df.count() == 0


def test_collection_errors(spark):
    with pytest.raises(TypeError):
        Collection.of(spark, [1], "key bigint, value bigint")
    with pytest.raises(TypeError):
        Collection.from_list(spark, ["a"], "string").top(1)
    with pytest.raises(TypeError):
        Collection.from_list(spark, [1], "bigint").filter(lambda v: v + 1)
    with pytest.raises(Exception, match="no boolean"):
        Collection.from_list(spark, [None], "bigint").filter(lambda v: v > 1).df.collect()


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(N.divide(F.lit(-7), F.lit(2))) == -3 and one(N.divide(F.lit(6), F.lit(4.0), N.INT, N.FLOAT)) == 1.5
    assert one(N.divide(F.lit(1.0), F.lit(0.0), N.FLOAT, N.FLOAT)) == math.inf and math.isnan(one(N.divide(F.lit(0.0), F.lit(0.0), N.FLOAT, N.FLOAT)))
    assert one(N.add(F.lit(2), F.lit(3))) == 5 and one(N.clamp(F.lit(5), F.lit(10), F.lit(1))) == 10
    with pytest.raises(Exception):
        one(N.divide(F.lit(1), F.lit(0)))
    with pytest.raises(TypeError):
        N.gt(F.lit(1), F.lit(1.0), N.INT, N.FLOAT)


def test_histograms(spark):
    words = ["fold"] * 5 + ["epping"] * 4 + ["a"] * 3 + ["b"] * 2 + ["c", "d", "e"]
    got = {r.label: r.n for r in H.histogram(Collection.from_list(spark, words, "string")).collect()}
    assert got == {"fold": 5, "epping": 4, "a": 3, "b": 2, "c": 1, "other": 2}
    numbers = [1] * 4 + [2] * 3 + [3] * 2 + [4, 5, 6, 7]
    got = [(r.label, r.n) for r in H.histogram(Collection.from_list(spark, numbers, "bigint")).orderBy("bucket").collect()]
    assert got == [("1", 4), ("2", 3), ("3", 2), ("4", 1), ("5", 1), ("6-", 2)]
    assert {r.label: r.n for r in H.histogram(Collection.from_list(spark, [1] * 6 + [2], "bigint")).collect()} == {"1": 6, "2": 1}


# Sources, layers, language, streams


def test_transit(spark):
    df = spark.createDataFrame([("t", "08:00:00", "08:00:00", "A", "1"), ("t", "08:02:10", "08:03:00", "B", "2"), ("t", "08:05:00", "", "C", "10"), ("u", "23:59:30", "23:59:30", "A", "1"), ("u", "24:01:00", "x", "B", "2")], "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string")
    got = {(r.from_stop, r.to_stop): (r.peak, r.off_peak) for r in transit.connections(transit.hops(df)).collect()}
    assert got == {("A", "B"): (180, 120), ("B", "C"): (120, None)}


def test_map_data(spark):
    t = "array<struct<key:string,value:string>>"
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id bigint")
    ways = spark.createDataFrame([(1, [1, 2, 3, 1], [("building", "yes")]), (2, [1, 2], [("name", "x")]), (3, [1, 99], []), (4, [5], [])], f"id bigint, nodes array<bigint>, tags {t}")
    got = sorted((r.type, r.value, [tuple(x) for x in r.tags]) for r in ingest.way_features(ways, nodes).collect())
    assert got == [("area", 1, [("#building", "yes")]), ("path", 1, [("#building", "yes")]), ("path", 2, [("name", "x")])]
    rel = spark.createDataFrame([(7, [("type", "multipolygon")], [(1, "outer"), (1, "inner"), (1, "")]), (8, [("type", "multipolygon")], [(1, "outer"), (2, "inner")])], f"id bigint, tags {t}, members array<struct<id:bigint,role:string>>")
    assert [(r.value, r.polygons) for r in ingest.multipolygons(rel, ways).collect()] == [(7, [[1, 1], [1]])]


def test_addresses_and_heights(spark):
    raw = spark.createDataFrame([("1", "51.5349035", "-0.1257194"), ("2", "51.5349035", "-0.1257194"), ("3", "51.536685", "-0.127258"), ("x", "1", "1"), ("4", "", "1")], "`﻿UPRN` string, LATITUDE string, LONGITUDE string")
    pts = ingest.addresses(raw)
    assert pts.count() == 3 and sorted(r.n for r in ingest.clusters(pts).collect()) == [1, 2]
    p = spark.createDataFrame([("a", (0.0, 0.0))], f"id string, at {geo.POINT}")
    h = spark.createDataFrame([((0.0001, 0.0), 10.0), ((-0.0001, 0.0), 20.0), ((0.01, 0.0), 99.0)], f"at {geo.POINT}, ele double")
    assert ingest.elevation(p, h).first().ele == pytest.approx(15.0)


def test_layers(mini):
    rules = [("#building", None, 0, 20, "buildings"), ("#highway", "primary", 15, 20, "roads")]
    assert render.basemap(mini.features, rules, 12).count() == 1 and render.basemap(mini.features, rules, 16).count() == 2
    g = mini.features.limit(1).select(render.gradient(F.lit(0.5), [(0.0, (0, 0, 0)), (1.0, (255, 255, 255))]).alias("c"), render.gradient(F.lit(9.0), [(0.0, (0, 0, 0)), (1.0, (255, 0, 0))]).alias("d")).first()
    assert (g.c, g.d) == ("#808080", "#ff0000")


def test_language(mini, rows):
    ev = shell.Evaluator(mini)
    assert rows(ev('find [#highway] | map {f -> get-string f "#highway"} | count-values').df) == [("footway", 1), ("primary", 1), ("residential", 1)]
    assert rows(ev('find (keyed "#highway") | filter [#highway=primary] | count')) == [(1,)]
    assert rows(ev('{"a": 1, "b": 2} | map {x -> add x 3}').df.select("key", "value")) == [("a", 4), ("b", 5)]
    assert rows(ev("{3, 1, 2} | sum")) == [(6,)]
    assert shell.simplify(shell.parse('{a -> get-string a "k"}')) == shell.parse('get-string "k"')
    # The parameter is used again, so it stays.
    assert isinstance(shell.simplify(shell.parse("{a -> add a (add a 1)}")), shell.Lambda)
    assert shell.simplify(shell.parse('and (keyed "#a") (tagged "#b" "c")')).value == Q.Keyed("#a") & Q.Tagged("#b", "c")
    for text in ('find [#a=b & #c] | take 3', '{f -> get-string f "x"}', "/n/5 | get-string \"a\""):
        assert shell.parse(shell.unparse(shell.parse(text))) == shell.parse(text)
    for bad in ("find [", "a )", "$", "{a ->"):
        with pytest.raises(SyntaxError):
            shell.parse(bad)
    with pytest.raises(NameError):
        ev("nothing 1")


#: Every function of the language, by an expression that uses it and what it gives.
EVERY = [
    ("{0: 5} | map {x -> add x 1}", [(0, 6)]), ("{0: 5} | map-parallel {x -> add-ints x 1}", [(0, 6)]), ("{1: 2} | map-items {p -> pair (second p) (first p)}", [(2, 1)]), ("{7: 1} | filter {x -> gt x 3}", []),
    ("find [#highway=primary] | map all-tags | flatten | count", [(2,)]), ("{3, 1} | take 1", [(0, 3)]), ("{3, 9} | top 1", [(1, 9)]), ('{"a", "a"} | count-values', [("a", 2)]), ("{1: 2} | count-keys", [(1, 1)]), ("{1: /n/5} | count-valid-keys", [(1, 1)]),
    ("{1: 2} | sum-by-key", [(1, 2)]), ("{4, 5} | sum", [(9,)]), ("{4, 5} | count", [(2,)]), ("{0: /n/5} | count-valid-ids", [(1,)]), ("{4, 5} | percentiles | count", [(2,)]), ("join-missing {1: 2} {1: 3, 2: 4}", [(1, 2), (2, 4)]), ("{1, 1} | histogram", "change"),
    ("{1, 1} | histogram-swatch", "change"), ("histogram-with-id {1, 1} /collection/h/1", "change"), ("histogram-swatch-with-id {1, 1} /collection/h/1", "change"),
    ("with-change (add-collection /collection/c/1 {} {1: 2}) {-> list-feature /collection/c/1}", [("1", "2")]), ("find-feature /path/mini/way/1 | length", 444.8), ("find-area /area/mini/way/9 | area", None), ('find-relation /relation/mini/rel/9223372036854775813 | get-string "#route"', [("bus",)]),
    ("with-change (add-collection /collection/c/1 {} {1: 2}) {-> find-collection /collection/c/1 | to-str}", None), ("find [#building] | count", [(1,)]), ("find-areas [#building] | count", [(1,)]), ("find-relations [#route] | count", [(1,)]), ("containing-areas (find (type-point)) [#building] | count", [(1,)]),
    ("find (and (keyed \"#highway\") (intersecting (ll 0.0 0.001))) | count", [(1,)]), ("find (intersecting-cap (ll 0.0 0.0) 10.0) | count", None), ("find (within (cap-polygon (ll 0.0 0.001) 20.0)) | count", None), ("find (within-cap (ll 0.0 0.0) 10.0) | count", None),
    ('find (tagged "#highway" "primary") | count', [(1,)]), ('find (typed "path" (or (keyed "#highway") (keyed "#building"))) | count', [(3,)]), ("find (and (all) (type-path)) | count", [(3,)]), ("find (type-area) | count", [(1,)]), ("find (is-valid) | count", [(0,)]), ("find [#highway] | filter (matches [#highway=footway]) | count", [(1,)]),
    ('find [#highway=primary] | map {f -> matches f [#highway="primary"]} | count-values', [(True, 1)]), ("find [#highway] | filter (intersecting-cap (ll 0.0 0.0) 10.0) | count", [(1,)]), ('{0: 1} | map {x -> value (tag "k" "v")}', [(0, "v")]), ('{0: 1} | map {x -> int-value (tag "k" "7")}', [(0, 7)]), ('{0: 1} | map {x -> float-value (tag "k" "7.5")}', [(0, 7.5)]),
    ('find-feature /path/mini/way/2 | get "network:weight" | value', [("2",)]), ('find-feature /path/mini/way/2 | get-int "network:weight"', [(2,)]), ('find-feature /path/mini/way/2 | get-float "network:weight"', [(2.0,)]), ('find [#highway=primary] | map {f -> count-tag-value f "oneway"} | flatten', [("yes", 1)]), ("find-feature /point/mini/node/2 | degree", None),
    ("find [#highway=primary] | map points | flatten | count", [(2,)]), ("find-feature /path/mini/way/1 | point-features | count", [(5,)]), ("find-feature /point/mini/node/2 | point-paths | count", [(2,)]), ("find [#highway=primary] | map (sample-points 1000.0) | flatten | count", [(2,)]), ("find [#highway] | sample-points-along-paths 1000.0 | count", None),
    ("find [#highway=primary] | map {f -> length (join f f)} | count", [(1,)]), ("find [#highway=primary] | map {f -> length (ordered-join f f)} | count", [(1,)]), ('with-change (add-expression /expression/e/1 {} (find [#highway])) {-> evaluate-feature /expression/e/1 | count}', [(3,)]), ("call {x -> add x 1} 2", None), ("get-centroid /path/mini/way/1 | distance-meters (ll 0.0 0.002)", 0.0),
    ("find [#building] | map (s2-points 10 14) | flatten | count", None), ("find [#building] | map (s2-covering 10 14) | flatten | count", None), ("find [#building] | map (s2-grid 14) | flatten | count", None), ('{0: "487604c5"} | map {t -> distance-meters (s2-center t) (s2-center t)}', [(0, 0.0)]), ('{0: "487604c5"} | map {t -> distance-meters (centroid (s2-polygon t)) (s2-center t)} | count', [(1,)]),
    ("{0: 7} | map {x -> divide x 2}", [(0, 3)]), ("{0: 7} | map {x -> divide-int x 2.0}", [(0, 3.5)]), ("{0: 7} | map to-str", [(0, "7")]), ("{0: 7} | map {x -> clamp x 1 5}", [(0, 5)]), ("{0: 7} | map {x -> first (pair x 1)}", [(0, 7)]), ("collection (pair 1 2)", None),
    ('find-feature /point/mini/node/0 | reachable {"mode": "highway"} 300.0 (type-point) | count', None), ('find-feature /point/mini/node/0 | reachable-area {"mode": "highway"} 300.0', None), ('accessible-all (find (type-point)) [#building] 300.0 {"mode": "highway"} | count', None), ('find-feature /point/mini/node/0 | accessible-routes (type-point) 600.0 {"mode": "highway"} | count', None),
    ('filter-accessible (accessible-all (find (type-point)) (type-point) 300.0 {"mode": "highway"}) [#building] | count', None), ('find-feature /point/mini/node/0 | closest {"mode": "highway"} 300.0 (type-point) | count', None), ('find-feature /point/mini/node/0 | closest-distance {"mode": "highway"} 300.0 (type-point)', None), ('find-feature /point/mini/node/0 | paths-to-reach {"mode": "highway"} 600.0 (type-point) | count', None),
    ("connect (find-feature /point/mini/node/0) (find-feature /point/mini/node/11)", "change"), ("connect-to-network (find-feature /point/mini/node/0)", "change"), ("connect-to-network-all {0: /point/mini/node/0}", "change"), ('building-access {0: /point/mini/node/0} 600.0 "highway" | count', None),
    ("find [#building] | collect-areas | area", None), ("find-feature /path/mini/way/1 | distance-to-point-meters (ll 0.0 0.001)", 111.2), ("find-feature /path/mini/way/1 | interpolate 0.5 | distance-meters (ll 0.0 0.0)", 222.4), ("{0: 1} | map {x -> area (rectangle-polygon (ll 0.0 0.0) (ll 0.001 0.001))} | count", [(1,)]), ("find [#highway] | convex-hull | area", None),
    ("find-feature /point/mini/node/3 | sightline 50.0 | count", [(1,)]), ("find-feature /area/mini/way/9 | entrance-approach | count", None), ("find-feature /area/mini/way/9 | snap-area-edges [#highway] 50.0 | count", [(1,)]), ("find [#building] | map tile-ids | count", [(1,)]), ("find-feature /area/mini/way/9 | tile-ids-hex | count", [(1,)]), ("find [#highway=primary] | map (tile-paths 10) | count", [(2,)]),
    ('parse-geojson "{\\"type\\":\\"Point\\",\\"coordinates\\":[1.5,2.5]}" | to-str', None), ("find [#building] | map to-geojson | count", [(1,)]), ("find [#highway] | to-geojson-collection", None), ('import-geojson (parse-geojson "{\\"type\\":\\"Point\\",\\"coordinates\\":[1.5,2.5]}") "ns"', "change"), ('geojson-areas (parse-geojson "{}") | count', [(0,)]),
    ('map-geometries (parse-geojson "{\\"type\\":\\"Point\\",\\"coordinates\\":[1.5,2.5]}") (apply-to-point {p -> cap-polygon p 10.0}) | geojson-areas | count', [(1,)]), ('map-geometries (parse-geojson "{\\"type\\":\\"Point\\",\\"coordinates\\":[1.5,2.5]}") (apply-to-path centroid) | geojson-areas | count', [(0,)]), ('map-geometries (parse-geojson "{\\"type\\":\\"Point\\",\\"coordinates\\":[1.5,2.5]}") (apply-to-area centroid) | geojson-areas | count', [(0,)]),
    ('id-to-relation-id "ns" (find-feature /point/mini/node/0)', None), ('with-change (add-tag /point/mini/node/0 (tag "#x" "y")) {-> find [#x] | count}', [(1,)]), ('with-change (add-tags {/point/mini/node/0: tag "#x" "y"}) {-> find [#x=y] | count}', [(1,)]), ('with-change (remove-tag /path/mini/way/1 "#highway") {-> find [#highway] | count}', [(2,)]), ('with-change (remove-tags {/path/mini/way/1: "#highway"}) {-> find [#highway] | count}', [(2,)]),
    ('with-change (add-point (ll 1.0 2.0) /point/new/1 {tag "#x" "y"}) {-> find [#x] | count}', [(1,)]), ('with-change (add-relation /relation/new/1 {tag "#x" "y"} {/point/mini/node/0: "stop"}) {-> find [#x] | count}', [(1,)]), ('merge-changes {add-tag /point/mini/node/0 (tag "#x" "y"), add-tag /point/mini/node/1 (tag "#x" "z")}', "change"), ('add-world-with-change /collection/worlds/1 (add-tag /point/mini/node/0 (tag "#x" "y")) | count', [(1,)]),
    ("materialise /collection/m/1 (find [#highway] | map {f -> get-string f \"#highway\"})", "change"), ("materialise-map (find [#highway]) /collection/m/2 {f -> get-string f \"#highway\"}", "change"), ("find [#highway=primary] | map debug-tokens | flatten | count", [(2,)]), ('debug-all-query "highway=primary" | count', [(1,)]), ("{0: 1} | map {x -> distance-meters (ll 0.0 0.0) (ll 0.0 0.0)}", [(0, 0.0)]),
]


def test_every_function_of_the_language(mini, rows, tmp_path):
    ev = shell.Evaluator(mini)
    doc = tmp_path / "doc.json"
    doc.write_text('{"type":"Point","coordinates":[1.5,2.5]}')
    more = [(f'parse-geojson-file "{doc}" | to-str', None), (f'import-geojson-file "{doc}" "ns"', "change"), (f'with-change (add-tag /point/mini/node/0 (tag "#x" "y")) {{-> changes-to-file "{tmp_path}/c"}}', None), (f'with-change (changes-from-file "{tmp_path}/c") {{-> find [#x] | count}}', [(1,)]), (f'export-world "{tmp_path}/w"', None)]
    used = set()
    for text, want in EVERY + more:
        used |= {t for k, t in shell.lex(text) if k == "symbol"}
        got = ev(text)
        if want == "change":
            assert isinstance(got, W.Change) and (got.added is None or got.added.count() >= 0), text
        elif isinstance(want, float):
            assert got.df.first()[0] == pytest.approx(want, abs=0.1), text
        elif want is not None:
            df = got.df if hasattr(got, "df") else got
            have = rows(df.select(*[c for c in ("key", "value") if c in df.columns]))
            assert have == want, text
        elif hasattr(got, "df") and not isinstance(got, Column):
            got.df.collect()
    assert set(ev.functions) - used == set()
    assert len(ev.functions) == 140


def test_stream_keeps_what_a_batch_gives(spark, tmp_path, rows):
    from terrane.operators.orphans import first_deliveries, advance, orphan_keys

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    ref, rec = lambda o, k, d, g=None: ("t", o, 0, k, d, g), lambda k, d, g=None: (None, None, None, k, d, g)
    day = lambda n: dt.datetime(2024, 1, n)
    batches = [[ref("a", "x", day(1)), rec("x", day(2)), ref("b", "y", day(1))], [ref("a", "x", day(3)), rec("x", day(2)), rec("y", day(9)), (None, None, None, None, None, None)], [rec("x", day(4), True), ref("c", "y", day(4))], [ref("a", "x", day(5), True)]]
    for rows_ in batches:
        spark.createDataFrame(rows_, deltas.DELIVERY).coalesce(1).write.mode("append").parquet(src)
        query = deltas.follow(spark.readStream.schema(deltas.DELIVERY).option("maxFilesPerTrigger", 1).parquet(src), out, str(tmp_path / "cp"), buckets=3)
        query.processAllAvailable()
        query.stop()
    kept = deltas.Kept(spark, out)
    refs, state = kept.current()
    every = spark.createDataFrame([r for b in batches for r in b], deltas.DELIVERY).where("key IS NOT NULL").withColumn("gone", F.coalesce("gone", F.lit(False)).cast("bigint"))
    want = advance(first_deliveries(every.where("ref_table IS NOT NULL")), first_deliveries(every.where("ref_table IS NULL"), ["key"]))
    assert rows(refs) == rows(want[0].select(*refs.columns)) and rows(state) == rows(want[1])
    assert [r.key for r in orphan_keys(state).collect()] == [] and {r.key: r.exists for r in state.collect()} == {"x": 0, "y": 1}
    # A batch that runs again changes nothing.
    before = rows(state)
    again = deltas.Kept(spark, out, 3)
    again.step(spark.createDataFrame(batches[3], deltas.DELIVERY), 3)
    assert rows(again.current()[1]) == before


@pytest.mark.parametrize("up_to", [G.BROADCAST_SEGMENTS, 0])
def test_searches_emit_what_is_found(mini, rows, up_to):
    """what the searches emit is what follows from the whole table of reached nodes, by either way."""
    g = G.edges(G.segments(mini), {"mode": "highway"})
    starts = G.starts(mini, mini.features.where("type = 'point'"), g)
    r, to = G.reach(starts, g, 600.0), G.ends(mini, mini.features)
    found = G.hits(starts, g, 600.0, to, up_to)
    assert found.where("kind = 1").count() and rows(found) == rows(G.reachable(mini, r, mini.features))
    steps = G.routes_to(starts, g, 600.0, to, up_to)
    want = G.routes(r, to.where("kind = 0").select("destination"))
    assert steps.count() and rows(steps.select(want.columns)) == rows(want)
    assert rows(G.uses(starts, g, 600.0, to, up_to)) == rows(G.paths_to_reach(want))
    at = mini.features.where("type = 'point'").select(G.text(F.struct(*W.KEY)).alias("node"), F.col("points")[0].alias("p"))
    hull = r.join(at, "node").groupBy("origin").agg(F.collect_list("p").alias("ps")).select("origin", (F.coalesce(geo.area(geo.hull_of(F.col("ps"))), F.lit(0.0)) / S.R / S.R).alias("a"))
    got = {x.origin: x.steradians for x in G.reached_area(starts, g, 600.0, at, up_to).collect()}
    assert got == {x.origin: pytest.approx(x.a, abs=1e-16) for x in hull.collect()} and max(got.values()) > 0


def test_places_along_long_paths(spark):
    """all points of a path of 20,000 in one go, as one by one."""
    rng = np.random.default_rng(3)
    bent = S.unit(np.column_stack([51 + np.cumsum(rng.normal(0, 0.001, 300)), np.cumsum(rng.normal(0, 0.001, 300))]))
    bent[10] = bent[9]
    q = np.vstack([bent, S.unit(np.column_stack([51 + rng.normal(0, 0.02, 50), rng.normal(0, 0.02, 50)]))])
    assert S.projected(bent, q, 4) == pytest.approx([S.project(bent, x)[2] for x in q], abs=1e-15)
    d, k = math.radians(0.001) * S.R, 20_000
    line = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: geo.ll(i * 0.001, F.lit(0.0))).alias("p"))
    got = line.select(geo.distances_to_points(F.col("p"), F.col("p")).alias("d"), F.size(geo.sample(F.col("p"), F.lit(50.0))).alias("n"), geo.ahead_and_back(F.col("p"), 4.0).alias("w")).first()
    assert got.d == pytest.approx([i * d for i in range(k + 1)], abs=1e-5) and got.n == math.ceil(k * d / 50) + 1
    assert got.w[0].back is None and got.w[k].ahead is None and got.w[5].ahead.lat - 0.005 == pytest.approx(math.degrees(4 / S.R)) and got.w[5].back.lat - 0.005 == pytest.approx(-math.degrees(4 / S.R))


def test_snapping_moves_edges_of_all_loops(spark):
    """F8, F14: edges of every polygon and loop follow the nearest path; what lies past a pole is covered once."""
    box = lambda s, w, n, e: [(s, w), (s, e), (n, e), (n, w)]
    k = math.degrees(1 / S.R)
    areas = [[[box(0.0, 0.0, 0.01, 0.01), box(0.004, 0.004, 0.006, 0.006)], [box(0.0, 0.02, 0.01, 0.03)]]]
    ways = [("south", [(-5 * k, -0.1), (-5 * k, 0.1)]), ("hole", [(0.004 + 3 * k, 0.003), (0.004 + 3 * k, 0.007)]), ("past", [(111.0, 0.0), (111.001, 0.0)])]
    paths = spark.createDataFrame(ways, f"path string, points {geo.PATH}")
    got = A.snap_edges(spark.createDataFrame([("a", areas[0])], f"id string, polygons {geo.AREA}"), paths, 20.0).first().polygons
    south = lambda loop: min(p.lat for p in loop)
    assert [len(p) for p in got] == [2, 1]
    assert south(got[0][0]) == pytest.approx(-5 * k, abs=1e-9) and south(got[1][0]) == pytest.approx(-5 * k, abs=1e-9)
    # The hole's edge moves inwards, and the sides keep their own corners.
    assert {round(p.lat - 0.004, 7) for p in got[0][1]} == {0.0, round(3 * k, 7), 0.002}
    assert len(got[0][0]) == 6
    near = G.connect_nearest(spark.createDataFrame([("o", (69.0, 180.0))], f"id string, at {geo.POINT}"), paths, 20.0).first()
    assert near.path == "past" and near.metres == pytest.approx(0.0, abs=1e-3)
