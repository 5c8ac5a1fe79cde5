"""The general data problems on small inputs: the rule, and nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import hierarchy, orphans, proximity, wide
from terrane.plans import skew
from terrane.plans.skew import hot_keys, skew_join
from terrane.sources import delimited

T = lambda d: dt.datetime(2024, 1, d)


# Orphans


def _orphans(spark, refs, recs):
    r = spark.createDataFrame(refs, "owner string, ord bigint, target string, loaded_at timestamp, key string, n int")
    e = spark.createDataFrame(recs, "id string, deleted_at timestamp, loaded_at timestamp, refs int")
    return orphans.orphans(*orphans.advance(orphans.references(r, "t", F.col("owner"), F.col("ord"), F.col("target")), orphans.records(e, F.col("id"))))


def test_orphans_reasons(spark):
    refs = [("a", 0, "there", T(2), "x", 1), ("a", 1, "gone", T(2), "x", 1), ("a", 2, "never", T(2), "x", 1), ("a", 3, "late", T(2), "x", 1), ("b", 0, "late", T(9), "x", 1), ("c", 0, None, T(1), None, None), ("d", 0, "same", T(2), "", 0), ("e", 0, "there", None, "", 0), (None, 0, "never", T(2), "", 0)]
    recs = [("there", None, T(1), 1), ("gone", T(5), T(1), 1), ("late", None, T(8), 1), ("late", None, T(20), 1), ("same", None, T(2), 1), (None, None, T(1), 1)]
    got = {(r.owner_id, r.ref_ord): r.reason for r in _orphans(spark, refs + refs, recs + recs).collect()}
    assert got == {("a", 1): "deleted", ("a", 2): "missing", ("a", 3): "late", (None, 0): "missing"}


def test_orphans_first_delivery_counts(spark):
    got = _orphans(spark, [("a", 0, "k", T(3), "", 0), ("a", 0, "k", T(9), "", 0)], [("k", None, T(5), 0)]).collect()
    assert [(r.owner_id, r.reason) for r in got] == [("a", "late")]


def test_orphans_empty(spark):
    assert _orphans(spark, [], []).count() == 0
    assert _orphans(spark, [], [("k", None, T(1), 0)]).count() == 0
    assert _orphans(spark, [("a", 0, "k", T(1), "", 0)], []).count() == 1


def test_orphans_of_many_keys_are_looked_up_by_shuffle(spark, rows, monkeypatch):
    refs = [(f"o{i}", 0, "hot" if i % 3 else f"k{i}", T(3), "", 0) for i in range(90)]
    recs = [("hot", None, T(1), 0), ("k3", None, T(5), 0), ("k6", T(9), T(1), 0)]
    want = rows(_orphans(spark, refs, recs))
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(orphans, "hot_keys", lambda c, k, n="n": hot_keys(c, k, n, share=10, least=5))
    assert rows(_orphans(spark, refs, recs)) == want and len(want) == 29 + 1


def test_batches_give_what_all_at_once_gives(spark, rows):
    """Redeliveries, deletions and withdrawals in later batches, and rows that come before what they follow."""
    rnd = random.Random(5)
    refs = [(f"o{rnd.randint(0, 30)}", rnd.randint(0, 2), f"k{rnd.randint(0, 20)}", T(rnd.randint(1, 28)), rnd.random() < 0.1) for _ in range(200)]
    recs = [(f"k{rnd.randint(0, 20)}", T(9) if rnd.random() < 0.15 else None, T(rnd.randint(1, 28))) for _ in range(60)]
    r = spark.createDataFrame(refs, "owner string, ord bigint, target string, loaded_at timestamp, off boolean")
    e = spark.createDataFrame(recs, "id string, deleted_at timestamp, loaded_at timestamp")
    both = lambda keep: (orphans.references(r.where(keep), "t", F.col("owner"), F.col("ord"), F.col("target"), gone=F.col("off")), orphans.records(e.where(keep), F.col("id")))
    whole = orphans.advance(*both(F.lit(True)))
    known = state = None
    for keep in (F.dayofmonth("loaded_at") > 20, F.dayofmonth("loaded_at") < 11, F.dayofmonth("loaded_at").between(11, 20), F.dayofmonth("loaded_at") < 5):
        known, state = (orphans.cut(x) for x in orphans.advance(*both(keep), known, state))
    assert rows(state) == rows(whole[1]) and rows(known) == rows(whole[0])
    assert rows(orphans.orphans(known, state)) == rows(orphans.orphans(*whole)) and not whole[1].where("deleted > 0").isEmpty()


def test_weekly_deliveries_give_p1_found(spark, rows):
    from terrane.queries import p1

    sf = "/root/testdata/sf0.001"
    known = state = None
    for k in range(3):
        # Weeks are dealt in turn, so first deliveries and redeliveries fall into different batches.
        batch = p1.deliveries(spark, sf, lambda df: df.where(F.pmod(F.weekofyear("loaded_at"), F.lit(3)) == k))
        known, state = (orphans.cut(x) for x in orphans.advance(*batch, known, state))
    got = orphans.orphans(known, state).select("ref_table", "owner_id", "ref_ord").distinct()
    assert rows(got) == rows(p1.p1_found(spark, sf))


def test_skew_join_meets_hot_keys(spark, rows):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, v int")
    right = spark.createDataFrame([("hot", "h"), ("k1", "a"), ("k2", "b")], "k string, w string")
    hot = hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], share=10, least=20)
    assert [r.k for r in hot.collect()] == ["hot"]
    for how in ("inner", "left", "left_semi"):
        assert rows(skew_join(left, right, ["k"], hot, how)) == rows(left.join(right, ["k"], how))


# Hierarchies


def _links(spark, pairs):
    return hierarchy.links(spark.createDataFrame(pairs, "c string, p string"), F.col("c"), F.col("p"))


def test_paths_against_walking(spark):
    rnd = random.Random(1)
    up = {i: rnd.randint(max(0, i - 5), i - 1) for i in range(1, 150)}
    solved = hierarchy.paths(_links(spark, [(str(a), str(b)) for a, b in up.items()] * 2 + [(None, "1"), ("1", None)]), 40).collect()
    assert len(solved) == 150
    for r in solved:
        way = [int(r.node)]
        while way[-1] in up:
            way.append(up[way[-1]])
        assert r.path == [str(x) for x in reversed(way)] and r.depth == len(way) - 1 and r.root == "0"


def test_paths_below_cycles_are_null(spark):
    got = {r.node: r.depth for r in hierarchy.paths(_links(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("x", "y"), ("s", "s")]), 2).collect()}
    assert got == {"a": None, "b": None, "c": None, "x": 1, "y": 0, "s": None}


def test_descendants(spark, rows):
    got = rows(hierarchy.descendants(hierarchy.paths(_links(spark, [("b", "a"), ("c", "b"), ("d", "b")]))))
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]


@pytest.mark.parametrize("n, size", [(60, 60), (90, 40)])
def test_below_and_paths_over_all_parents(spark, n, size):
    rnd = random.Random(n)
    edges = {(str(rnd.randrange(size)), str(rnd.randrange(size))) for _ in range(n)} | {(f"c{i + 1}", f"c{i}") for i in range(20)} | {("c0", "0"), ("c9", "c3")}
    under = {}
    for c, p in edges:
        under.setdefault(p, []).append(c)
    want = {}
    for top in under:
        now, d = {top}, 0
        while now:
            d, now = d + 1, {c for x in now for c in under.get(x, []) if (top, c) not in want}
            want |= {(top, c): d for c in now}
    links = _links(spark, sorted(edges))
    got = hierarchy.below(links).collect()
    assert len(got) == len(want) and {(r.node, r.descendant): r.distance for r in got} == want
    solved = {r.node: r for r in hierarchy.paths(links, 20).collect()}
    roots = set(under) - {c for c, _ in edges}
    for v, r in solved.items():
        rooted = v in roots or any((x, v) in want for x in roots)
        assert (r.path is not None) == rooted and (not rooted or r.path[0] in roots and r.path[-1] == v and all(e in edges for e in zip(r.path[1:], r.path)))


def test_path_leaves_a_cycle_of_first_parents(spark, rows):
    solved = hierarchy.paths(_links(spark, [("a", "b"), ("b", "a"), ("b", "r"), ("c", "a")]), 2)
    assert rows(solved.select("node", "parent", "root", "depth")) == [("a", "b", "r", 2), ("b", "r", "r", 1), ("c", "a", "r", 3), ("r", None, "r", 0)]


@pytest.mark.parametrize("n, most", [(320, 10_000), (700, 3)])
def test_cycles_against_strong_parts(spark, n, most):
    rnd = random.Random(n)
    edges = {(rnd.randrange(250), rnd.randrange(250)) for _ in range(n)}
    after = [[] for _ in range(250)]
    for a, b in edges:
        after[a].append(b)
    part, _ = hierarchy.strong(after)
    want = {str(v) for v in range(250) if part.count(part[v]) > 1 or (v, v) in edges}
    assert {r.node for r in hierarchy.cyclic_nodes(_links(spark, [(str(a), str(b)) for a, b in edges]), 100, most).collect()} == want


@pytest.mark.parametrize("kind", ["cycle", "chain", "both"])
def test_long_chains_contract_across_fragments(spark, kind, monkeypatch):
    """Links in no order of ids, a fragment holds almost none of a chain's neighbours."""
    n = 150
    name = random.Random(7).sample(range(1000), n)
    edges = [(str(a), str(b)) for a, b in zip(name, name[1:])]
    edges += [(str(name[-1]), str(name[0]))] if kind == "cycle" else [] if kind == "chain" else [(str(name[-1]), str(name[60])), (str(name[10]), "end")]
    levels = []
    merge = hierarchy._merge
    monkeypatch.setattr(hierarchy, "_merge", lambda e, f, level, stuck: levels.append(level) or merge(e, f, level, stuck))
    monkeypatch.setattr(hierarchy, "_spread", None)
    cyclic = {r.node for r in hierarchy.cyclic_nodes(_links(spark, edges), 12).collect()}
    assert cyclic == {str(x) for x in {"cycle": name, "chain": [], "both": name[60:]}[kind]} and levels and len(levels) < 15
    if kind != "both":
        for full in (True, False):
            got = {r.node: (r.root, r.depth) for r in hierarchy.paths(_links(spark, edges), 12, full).collect()}
            assert got == {str(x): (str(name[-1]), n - 1 - i) if kind == "chain" else (None, None) for i, x in enumerate(name)}


def test_a_core_without_chains(spark):
    """Every node has two ways in and two on."""
    edges = [(str(i), str((i * k + 1) % 61)) for i in range(61) for k in (2, 3)]
    assert hierarchy.cyclic_nodes(_links(spark, edges), 8).count() == 61


def test_hierarchy_empty(spark):
    assert hierarchy.cyclic_nodes(_links(spark, [])).count() == 0
    assert hierarchy.paths(_links(spark, [])).count() == 0


# Proximity


def _metres(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
    return 2 * 6371010 * math.asin(min(1, h**0.5))


@pytest.mark.parametrize("limits", [{}, {"dense": 2, "tile": 5}, {"dense": 2}])
@pytest.mark.parametrize("at", [(0.0, 0.0), (51.5, -0.1), (-63.2, 180.0), (89.999, 20.0), (-90.0, 0.0)])
def test_near_against_all_pairs(spark, rows, at, limits):
    rnd = random.Random(int(at[0]))
    scale = math.cos(math.radians(min(abs(at[0]), 89.9)))
    pts = []
    for i in range(250):
        lat = max(-90.0, min(90.0, at[0] + rnd.uniform(-0.001, 0.001)))
        lng = (at[1] + rnd.uniform(-0.001, 0.001) / scale + 180) % 360 - 180
        pts.append((f"p{i:03}", lat, lng))
    pts += [("q1", at[0], at[1]), ("q2", at[0], at[1])]
    df = spark.createDataFrame(pts + pts[:5] + [(None, 1.0, 1.0), ("z", None, 1.0)], "loc string, lat double, lng double")
    want = sorted((a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and _metres(a[1:], b[1:]) < 25)
    assert rows(proximity.near(df.withColumn("row", F.lit(1)), 25.0, **limits)) == want and want


def test_near_splits_hot_cells(spark, rows):
    pts = [(f"a{i}", 10.0, 10.0) for i in range(90)] + [("b", 20.0, 20.0)]
    got = rows(proximity.near(spark.createDataFrame(pts, "loc string, lat double, lng double"), 25.0, tile=10))
    assert len(got) == len(set(got)) == 90 * 89 // 2


def test_near_with_shuffled_marks(spark, rows, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    pts = [(f"a{i}", 10.0 + i // 30 * 1.2e-4, 10.0) for i in range(90)]
    got = rows(proximity.near(spark.createDataFrame(pts, "loc string, lat double, lng double"), 25.0, dense=4, tile=10))
    assert len(got) == len(set(got)) == 90 * 89 // 2 - 900


def test_near_empty(spark):
    assert proximity.near(spark.createDataFrame([], "loc string, lat double, lng double"), 25.0).count() == 0


@pytest.mark.parametrize("most", [(4, 2, 100_000), (256, 64, 100_000), (256, 64, 0)])
def test_within_against_exact(spark, rows, monkeypatch, most):
    cover = proximity.cover_ring
    monkeypatch.setattr(proximity, "cover_ring", lambda ring: cover(ring, most[0], 20, most[1]))
    monkeypatch.setattr(proximity, "BROADCAST_CELLS", most[2])
    rnd = random.Random(3)
    ring = [(0, 0), (4_000_000, 500_000), (5_000_000, 4_000_000), (2_000_000, 2_000_000), (-1_000_000, 5_000_000)]  # lng, lat
    pts = [(i, rnd.randint(-2_000_000, 6_000_000), rnd.randint(-2_000_000, 6_000_000)) for i in range(400)] + [(900 + i, y, x) for i, (x, y) in enumerate(ring)]
    regions = spark.createDataFrame([(7, [(y, x) for x, y in ring]), (8, [(1, 1), (2, 2)]), (None, None)], "region bigint, ring array<struct<lat_e7:int,lng_e7:int>>")
    got = rows(proximity.within(spark.createDataFrame([*pts, (999, None, 1)], "id bigint, lat_e7 int, lng_e7 int"), regions, ["id"]))
    assert got == sorted(((i, 7) for i, y, x in pts if proximity.inside(x, y, ring)), key=repr)
    cells = cover(ring)
    assert any(c[3] for c in cells) and any(not c[3] for c in cells)


@pytest.mark.parametrize("seed", range(30))
def test_a_cells_edges_decide_every_place_in_it(seed):
    """On a grid so coarse that corners, borders and points fall together."""
    rnd = random.Random(seed)
    ring = [(rnd.randint(-9, 9) * 4, rnd.randint(-9, 9) * 4) for _ in range(rnd.randint(3, 9))]
    for level, x, y, interior, corner, edges in proximity.cover_ring(ring, most=6, deepest=30):
        side = 1 << (proximity.SPAN - level)
        x0, y0 = x * side - (1 << 31), y * side - (1 << 31)
        for px, py in [(px, py) for px in range(max(x0, -40), min(x0 + side, 41)) for py in range(max(y0, -40), min(y0 + side, 41))]:
            assert proximity.inside(px, py, ring) == proximity._turned(corner, edges, x0, y0, px, py)


def test_within_empty(spark):
    pts = spark.createDataFrame([], "id bigint, lat_e7 int, lng_e7 int")
    regions = spark.createDataFrame([], "region bigint, ring array<struct<lat_e7:int,lng_e7:int>>")
    assert proximity.within(pts, regions, ["id"]).count() == 0


# Lines that fail

STOP = ["id", "c", "n", "d", "51.5", "-0.1", "", "", "0", "", "", "", "", ""]


def _stop(**cells):
    return ",".join(cells.get(k, v) for k, v in zip(delimited.STOPS.columns, STOP))


LINES = [
    ("stops", _stop(), None), ("stops", _stop() + "\r\n", None), ("stops", None, "null"), ("stops", "", "columns"), ("other", _stop(), "feed"), (None, "x", "feed"),
    ("stops", _stop(stop_name='"a,b\n""c"""'), None), ("stops", _stop(stop_name='a"b'), "quoting"), ("stops", _stop(stop_name=' "b"'), "quoting"), ("stops", _stop(stop_name='"b" '), "quoting"),
    ("stops", _stop(stop_name='"b'), "quoting"), ("stops", _stop(stop_name='""'), None), ("stops", _stop(stop_name='"""'), "quoting"), ("stops", _stop(stop_name='""""'), None),
    ("stops", _stop() + ",", "columns"), ("stops", _stop()[:-1], "columns"), ("stops", _stop(stop_lat=" +51.50 "), None), ("stops", _stop(stop_lat="90.1"), "stop_lat"), ("stops", _stop(stop_lat="1e1"), "stop_lat"),
    ("stops", _stop(stop_lat="5."), "stop_lat"), ("stops", _stop(stop_lat=""), "stop_lat"), ("stops", _stop(stop_lat=" ", stop_lon="", location_type=" 3 "), None), ("stops", _stop(stop_lon="", location_type='"4"'), None),
    ("stops", _stop(stop_lon="\t1"), "stop_lon"), ("stops", _stop(stop_lon="180"), None), ("stops", _stop(stop_lon='"-180.0"'), None), ("stops", _stop(stop_lat="x", location_type="3"), "stop_lat"),
    ("codepoint", "AB1 2CD,1,2,3,4,5", None), ("codepoint", '"ab12cd",,,,,', None), ("codepoint", "A B C D,1,2,3,4,5", "postcode"), ("codepoint", "AB12CDEF,1,2,3,4,5", "postcode"), ("codepoint", ",1,2,3,4,5", "postcode"),
    ("codepoint", "AB1-2C,1,2,3,4,5", "postcode"), ("codepoint", "#B12CD,1,2,3,4,5", "postcode"), ("stops", _stop(stop_name='"' + '""' * 20_000 + '"'), None), ("stops", _stop(stop_name="x" * 300_000), None),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, f, line, "x", 0) for i, (f, line, _) in enumerate(LINES)], "raw_id bigint, feed string, line string, reason string, cells int")
    got = {r.raw_id: r.reason for r in delimited.read_lines(df, delimited.FEEDS).select("raw_id", "reason").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(LINES)}


def test_good_rows_have_their_cells(spark):
    df = spark.createDataFrame([(1, "stops", _stop(stop_name='"a,b\n""c"""', stop_code=" x ", stop_desc='""'))], "raw_id bigint, feed string, line string")
    r = delimited.good_rows(delimited.read_lines(df, delimited.FEEDS), "stops", delimited.STOPS, ["raw_id"]).first()
    assert (r.stop_name, r.stop_code, r.stop_desc, r.zone_id) == ('a,b\n"c"', " x ", "", "")


def test_lines_that_only_the_reader_rejects(spark, monkeypatch):
    feed = {"two": delimited.Feed(("a", "b"))}
    df = spark.createDataFrame([(1, "two", "x,y"), (2, "two", "x,"), (3, "two", '"' + "," * 30_000 + '",y'), (4, "two", "," * 30_000), (5, "two", "x,y,z")], "raw_id bigint, feed string, line string")
    got = {r.raw_id: (r.reason, r.cells) for r in delimited.read_lines(df, feed).collect()}
    assert got == {1: (None, {"a": "x", "b": "y"}), 2: (None, {"a": "x", "b": ""}), 3: ("reader", None), 4: ("columns", None), 5: ("columns", None)}
    # A reader that wants another separator rejects every line.
    monkeypatch.setattr(delimited, "READER", delimited.READER | {"sep": ";"})
    assert {r.reason for r in delimited.read_lines(df.where("raw_id < 3"), feed).collect()} == {"reader"}


def test_lines_empty(spark):
    assert delimited.read_lines(spark.createDataFrame([], "raw_id bigint, feed string, line string"), delimited.FEEDS).count() == 0


# Wide tables

TYPES = {"n": "int", "x": "double", "b": "bool", "d": "date", "s": "string"}


def _wide(spark, data):
    df = spark.createDataFrame(data, "e string, k string, v string, o int, attributes int")
    return wide.widen(wide.attribute_maps(df, ["e"], "k", "v", "o", list(TYPES)), ["e"], TYPES)


@pytest.mark.parametrize(
    "key, text, good",
    [("n", " -12 ", True), ("n", "1234567890", False), ("n", "1.0", False), ("n", "", False), ("x", "+1.50", True), ("x", ".5", False), ("x", "1e3", False), ("x", "NaN", False), ("b", " YES", True), ("b", "y", False), ("d", "2024-02-29", True),
     ("d", "2023-02-29", False), ("d", "2024-2-1", False), ("s", "", True), ("n", "٣", False), ("n", "9" * 100_000, False)],
)
def test_types(spark, key, text, good):
    r = _wide(spark, [("e", key, text, 0, 1)]).first()
    assert (r[key] is not None) == good and (r.failed == ({} if good else {key: text}))


def test_wide_resolves_first_not_null(spark):
    data = [("e", "n", None, 0, 1), ("e", "n", "2", 2, 1), ("e", "n", "1", 1, 1), ("e", "n", "1", 1, 1), ("e", None, "7", 0, 1), ("e", "other", "7", 0, 1), ("f", "other", "1", 0, 1), (None, "n", "3", 0, 1), ("g", "n", "5", 0, 1), ("g", "n", "4", 0, 1)]
    got = {r.e: r.n for r in _wide(spark, data).collect()}
    assert got == {"e": 1, "f": None, None: 3, "g": 4}
    assert _wide(spark, []).count() == 0


def test_wide_clashing_names(spark):
    df = spark.createDataFrame([("e", "E", "1", 0)], "e string, k string, v string, o int")
    assert wide.widen(wide.attribute_maps(df, ["e"], "k", "v", "o", ["E"]), ["e"], {"E": "int"}).first()["value_E"] == 1


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from terrane.plans import lineage

    sc = SimpleNamespace(applicationId="app-cluster", master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None))
    with pytest.raises(RuntimeError):
        lineage.shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: None)))
