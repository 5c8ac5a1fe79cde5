"""The functions of the pipeline language beyond collections: geometry, cells, tiles, graphs, GeoJSON, changes and worlds.

Values are columns while a pipeline is traced: of a feature (``Feature``), of a
geometry of a known kind (``Geometry``) or of anything else (``Scalar`` where it
belongs to a single row). Functions that need other rows of the world are joins:
called with a feature they look at that one, given to ``map`` they are evaluated
for all features of the collection at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane import ids, query as Q, world as W
from terrane.functions import cells, geo, geojson as J, tiles as T
from terrane.operators import areas as A, connect as Cn, graph as G, histogram as H
from terrane.operators.collections import Collection
from terrane.plans.lineage import cut
from terrane.world import KEY


@dataclass(frozen=True)
class Feature:
    """A feature: a struct column, of the one row of ``frame`` where there is one."""

    column: Column
    frame: DataFrame | None = None


@dataclass(frozen=True)
class Geometry:
    """A point, path or area."""

    kind: str
    column: Column
    frame: DataFrame | None = None


@dataclass(frozen=True)
class Scalar:
    """A value of the one row of ``frame``."""

    column: Column
    frame: DataFrame

    @property
    def df(self) -> DataFrame:
        return self.frame.select(self.column.alias("value"))


#: The id of a histogram that is given none.
UNNAMED = ids.FeatureID("collection", "histograms", 0)
KINDS = {geo.POINT: "point", geo.PATH: "path", geo.AREA: "area"}


def wrap(v: Column, type: str):
    """A collection's value as what it is."""
    if "tags:array" in type:
        return Feature(v)
    return Geometry(KINDS[type], v) if type in KINDS else v


def column(x) -> Column:
    if isinstance(x, (Feature, Geometry, Scalar)):
        return x.column
    if isinstance(x, tuple):
        return geo.ll(*x)
    if isinstance(x, ids.FeatureID):
        return x.column()
    return x if isinstance(x, Column) else F.lit(x)


def frame_of(*args) -> DataFrame | None:
    found = [a.frame for a in args if isinstance(a, (Feature, Geometry, Scalar)) and a.frame is not None]
    if len({id(f) for f in found}) > 1:
        raise TypeError("a function of single features takes values of one of them")
    return found[0] if found else None


def at(x) -> Column:
    """The place of a point."""
    return F.get(x.column["points"], F.lit(0)) if isinstance(x, Feature) else column(x)


def points(x) -> Column:
    """The vertices of anything."""
    if isinstance(x, Feature):
        return geo.vertices(x.column["points"], x.column["polygons"])
    if isinstance(x, Geometry) and x.kind == "area":
        return F.flatten(F.flatten(x.column))
    return x.column if isinstance(x, Geometry) and x.kind == "path" else F.array(column(x))


def polygons(x) -> Column:
    return x.column["polygons"] if isinstance(x, Feature) else column(x)


def listed(array: Column) -> Column:
    """An array as the pairs of a collection."""
    return F.transform(array, lambda v, i: F.struct(i.alias("key"), v.alias("value")))


def on(f: Callable, out: str | None = None) -> Callable:
    """A function of columns; ``out`` is the kind of geometry that it gives."""

    def run(*args):
        got, frame = f(*args), frame_of(*args)
        if out:
            return Geometry(out, got, frame)
        return Scalar(got, frame) if frame is not None else got

    return run


class Join:
    """A function that looks at features through the world: ``f(features, *args)`` gives ``(type, ns, value, k, v)`` rows, ``k`` where it gives collections."""

    def __init__(self, f: Callable[..., DataFrame], args: tuple = ()):
        self.f, self.args = f, args

    def rows(self, features: DataFrame) -> Collection:
        got = self.f(features, *self.args)
        return Collection(got.select((F.col("k") if "k" in got.columns else F.struct(*KEY)).alias("key"), F.col("v").alias("value")))

    def over(self, c: Collection) -> Collection:
        """For all features of a collection."""
        got = self.f(c.df.select("value.*"), *self.args)
        return Collection(got.select(F.struct(*KEY).alias("key"), F.col("v").alias("value")))


def join(n: int, f: Callable) -> tuple[int, Callable]:
    def run(*args):
        *rest, feature = args[1:] + args[:1]
        if isinstance(feature, Feature) and feature.frame is not None:
            return Join(f, tuple(rest)).rows(feature.frame)
        raise TypeError("this function takes a feature, or is given to map")

    run.join = f
    return n, run


def functions(ev) -> dict[str, tuple[int, Callable]]:
    """``name: (number of arguments, function)`` in the world of an evaluator."""
    w: W.World = ev.world
    spark = w.spark

    def value_of(x):
        """A constant as Python has it."""
        frame = frame_of(x)
        return (frame if frame is not None else spark.range(1)).select(column(x)).first()[0]

    def options(c) -> dict:
        """Options are a literal collection."""
        return {r["key"]: str(r["value"]) for r in c.df.select("key", "value").collect()} if isinstance(c, Collection) else dict(c or {})

    def tags_of(c) -> list[tuple[str, str]]:
        """Tags written out as a literal collection of tags."""
        return [(r["value"]["key"], r["value"]["value"]) for r in c.df.collect()] if isinstance(c, Collection) else [tuple(t) for t in c]

    def id_of(x) -> ids.FeatureID:
        return x if isinstance(x, ids.FeatureID) else ids.FeatureID(*x.frame.select(*KEY).first())

    def feature(df: DataFrame) -> Feature:
        return Feature(F.struct(*df.columns), df)

    def as_features(df: DataFrame) -> Collection:
        return Collection(df.select(F.struct(*KEY).alias("key"), F.struct(*df.columns).alias("value")))

    def values(c: Collection) -> DataFrame:
        """The features of a collection of features, or of ids."""
        if "tags:array" in c.types["value"]:
            return c.df.select("value.*")
        return w.features.join(c.df.select("value.*").distinct(), KEY, "left_semi")

    def constant_geometry(x, kind=None) -> Q.Query:
        kind = x.kind if isinstance(x, Geometry) else kind or "point"
        if isinstance(x, Feature):
            r = x.frame.select("type", "points", "polygons").first()
            kind, v = r[0], r[2] if r[0] == "area" else r[1]
            v = v[0] if kind == "point" else v
        else:
            v = value_of(x)
        if kind == "area":
            return Q.intersecting("area", tuple(tuple(tuple((p["lat"], p["lng"]) for p in loop) for loop in poly) for poly in v))
        return Q.intersecting(kind, (v["lat"], v["lng"]) if kind == "point" else tuple((p["lat"], p["lng"]) for p in v))

    # Graphs: all searches of a call go over one table of segments.

    def search(origins: DataFrame, opts, limit):
        g = G.edges(cut(G.segments(w)), options(opts))
        return cut(G.reach(G.starts(w, origins, g), g, float(limit)))

    def keyed(df: DataFrame, text: str) -> DataFrame:
        """Ids from the text form that searches use."""
        p = F.split(text, "/")
        return df.select("*", p[0].alias("type"), F.array_join(F.slice(p, F.lit(2), F.size(p) - 2), "/").alias("ns"), F.element_at(p, -1).cast("bigint").alias("value"))

    def id_text(text: str) -> Column:
        p = F.split(text, "/")
        return F.struct(p[0].alias("type"), F.array_join(F.slice(p, F.lit(2), F.size(p) - 2), "/").alias("ns"), F.element_at(p, -1).cast("bigint").alias("value"))

    def whole(df: DataFrame) -> DataFrame:
        """Ids in ``to`` as features."""
        f = w.features.select(F.struct(*KEY).alias("to"), F.struct(*w.features.columns).alias("v"))
        return df.join(f, "to")

    def hits(origins, opts, limit, query):
        return G.reachable(w, search(origins, opts, limit), w.find(query, order=False))

    def reachable(origins, opts, limit, query):
        got = keyed(hits(origins, opts, limit, query), "origin").withColumn("to", id_text("destination"))
        return whole(got).select(*KEY, F.col("to").alias("k"), "v")

    def closest(origins, opts, limit, query):
        return whole(keyed(G.closest(hits(origins, opts, limit, query)), "origin").withColumn("to", id_text("destination"))).select(*KEY, "v")

    def closest_distance(origins, opts, limit, query):
        near = keyed(G.closest(hits(origins, opts, limit, query)), "origin").select(*KEY, "distance")
        return origins.select(*KEY).join(near, KEY, "left").select(*KEY, F.coalesce("distance", F.lit(0.0)).alias("v"))

    def paths_to_reach(origins, opts, limit, query):
        r = search(origins, opts, limit)
        used = G.paths_to_reach(G.routes(r, G.reachable(w, r, w.find(query, order=False))))
        return keyed(used.select(id_text("path").alias("k"), F.col("n").alias("v"), "path"), "path").select(*KEY, "k", "v")

    def reachable_area(origins, opts, limit):
        place = w.features.where("type = 'point'").select(G.text(F.struct(*KEY)).alias("node"), F.get("points", F.lit(0)).alias("p"))
        hull = search(origins, opts, limit).join(place, "node").groupBy("origin").agg(geo.hull_of(F.collect_list("p")).alias("a"))
        return keyed(hull, "origin").select(*KEY, (F.coalesce(geo.area(F.col("a")), F.lit(0.0)) / geo.R / geo.R).alias("v"))

    def routes(origins, query, limit, opts):
        r = search(origins, opts, limit)
        steps = G.routes(r, G.reachable(w, r, w.find(query, order=False)))
        each = steps.groupBy("origin", "destination").agg(F.array_sort(F.collect_list(F.struct("ord", "via", "node", "cost"))).alias("v"))
        return keyed(each, "origin").select(*KEY, id_text("destination").alias("k"), "v")

    def accessible_all(origins, query, limit, opts):
        o = values(origins)
        pairs = G.accessible_all(o, hits(o, opts, limit, query), options(opts).get("flip") == "yes")
        return Collection(pairs.select(id_text("key").alias("key"), F.when(F.col("value").isNotNull(), id_text("value")).alias("value")))

    def building_access(origins, limit, mode):
        pairs = G.building_access(w, search(values(origins), {"mode": "simple" if mode == "" else "highway"}, limit))
        return Collection(pairs.select(id_text("key").alias("key"), id_text("value").alias("value")))

    def connect_all(features: DataFrame) -> W.Change:
        segs = cut(G.segments(w))
        return Cn.connect_features(w, features, G.network(w, segs, Cn.REACH))

    def degree(features):
        n = keyed(G.degree(G.segments(w)), "node").select(*KEY, F.col("n").alias("v"))
        return features.select(*KEY).join(n, KEY, "left").select(*KEY, F.coalesce("v", F.lit(0)).alias("v"))

    def doors(areas: DataFrame) -> DataFrame:
        ring = w.features.where("type = 'path'").select(F.struct(*KEY).alias("path"), F.explode("refs").alias("ref"))
        marked = w.features.where("type = 'point'").select(F.struct(*KEY).alias("ref"), Q.first_value("entrance").isNotNull().alias("entrance"))
        own = areas.where("type = 'area'").select(F.struct(*KEY).alias("id"), "polygons", F.explode("refs").alias("path")).join(ring, "path").join(marked, "ref")
        return own.select("id", "polygons", G.text(F.col("ref")).alias("door"), "entrance")

    def approach(areas):
        ways = w.features.where("type = 'path'").where(Q.first_value("#highway").isNotNull()).select(G.text(F.struct(*KEY)).alias("path"), F.transform("refs", G.text).alias("nodes"), "points")
        return A.entrance_approach(doors(areas), ways).select("id.*", F.col("at").alias("v"))

    def sightline(features, radius):
        seen = features.select(F.struct(*KEY).alias("id"), F.get("points", F.lit(0)).alias("at"))
        buildings = w.features.where("type = 'area'").where(Q.first_value("#building").isNotNull())
        # The sweep takes ids as text.
        got = A.sightlines(seen.select(G.text(F.col("id")).alias("id"), "at"), buildings, float(radius))
        return keyed(got, "id").select(*KEY, F.col("polygons").alias("v"))

    def snapped(areas, query, threshold):
        paths = w.find(query, "path", False).select(G.text(F.struct(*KEY)).alias("path"), "points")
        got = A.snap_edges(areas.where("type = 'area'").select(G.text(F.struct(*KEY)).alias("id"), "polygons"), paths, float(threshold))
        return keyed(got, "id").select(*KEY, F.col("polygons").alias("v"))

    def referred(method):
        def run(features):
            got = method(features).select(F.col("target").alias("_t"), F.struct(*KEY).alias("to"))
            return whole(got)

        return run

    point_paths = referred(w.point_paths)

    def paths_of(features):
        return point_paths(features).select("_t.*", F.col("to").alias("k"), "v")

    def points_of(features):
        got = w.point_features(features).select(*KEY, F.col("target").alias("to"))
        return whole(got).select(*KEY, F.col("to").alias("k"), "v")

    # Changes

    def tag_rows(c: Collection, valued: bool) -> DataFrame:
        """A collection of ids to tags, or to keys, as rows."""
        pick = [F.col("_v.key").alias("k"), F.col("_v.value").alias("v")] if valued else [F.col("_v").alias("k")]
        return c.df.select("key.*", F.struct(F.col("value").alias("_x")).alias("_s")).select(*KEY, F.col("_s._x").alias("_v")).select(*KEY, *pick)

    def with_change(change, f):
        world = w.with_change(change)
        inner = type(ev)(world, change if ev.change is None else W.merge_changes(None, ev.change, change), ev.worlds)
        return ev.within(inner, f)

    def world_with_change(id, change):
        ev.worlds.add_world_with_change(id, change)
        touched = [df.select(*KEY) for df in (change.added, change.ops) if df is not None]
        both = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
        both = both.distinct().select(F.struct(*KEY).alias("key"))
        return Collection(both.select("key", F.col("key").alias("value")))

    def changes_to_file(path):
        if ev.change is None:
            raise ValueError("this world has no changes")
        return W.changes_to_file(ev.change, path)

    def materialise(id, f):
        return W.materialise(id, ev.text_of(f), f() if callable(f) else f)

    def materialise_map(c, id, f):
        per = ev.map(c, f) if not isinstance(c, DataFrame) else c
        return W.add_collection(id, [], Collection(per.df.select("key", per.df["value"].cast("string").alias("value"))))

    def bars(swatch):
        return lambda c, id: H.histogram_change(c, id, "", swatch)

    def relation_id(ns, x):
        frame, c = frame_of(x), column(x)
        c = F.struct(*[c[k].alias(k) for k in KEY])
        got = F.struct(F.lit("relation").alias("type"), F.lit(ns).alias("ns"), T.fnv1a_text(ids.id_text(c)).alias("value"))
        return Scalar(got, frame) if frame is not None else got

    doc = lambda df: Scalar(F.col("geojson"), df)
    drawn = lambda x: J.to_geojson(x.column["type"], x.column["points"], x.column["polygons"]) if isinstance(x, Feature) else J.to_geojson(F.lit(x.kind if isinstance(x, Geometry) else "point"), points(x), polygons(x) if isinstance(x, Geometry) and x.kind == "area" else F.lit(None).cast(geo.AREA))

    def drawn_all(c: Collection):
        each = c.df.select(F.monotonically_increasing_id().alias("i"), drawn(wrap(F.col("value"), c.types["value"])).alias("text"))
        return Scalar(F.col("value"), J.to_collection(each, "text", ["i"]))

    def file_doc(path):
        return J.read_file(spark, path)

    def imported(d, ns):
        return J.import_features(d.frame.select(d.column.alias("g")), "g", ns)

    def applied(kind):
        def run(f):
            def inner(g):
                # The function sees a geometry of its kind and gives one.
                own = {"point": lambda: Geometry("point", F.get(g["points"], F.lit(0))), "path": lambda: Geometry("path", g["points"]), "area": lambda: Geometry("area", g["polygons"])}[kind]()
                got = f(own)
                new = got.kind if isinstance(got, Geometry) else kind
                c = column(got)
                made = F.struct(F.lit(new).alias("kind"), (F.lit(None) if new == "area" else F.array(c) if new == "point" else c).cast(geo.PATH).alias("points"), (c if new == "area" else F.lit(None)).cast(geo.AREA).alias("polygons"))
                return F.when(g["kind"] == kind, made).otherwise(g)

            return inner

        return run

    def mapped(d, f):
        # A row to a geometry, so that functions of any kind can be applied.
        each = d.frame.select(F.posexplode(J.features(d.column)).alias("i", "x")).select("i", J.geometry(F.col("x.geometry")).alias("g")).select("i", f(F.col("g")).alias("g"))
        text = F.concat(F.lit('{"type":"Feature","geometry":'), J.to_geojson(F.col("g.kind"), F.col("g.points"), F.col("g.polygons")), F.lit(',"properties":{}}'))
        texts = F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"])
        return Scalar(J.parse(F.col("t")), each.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(texts, ","), F.lit("]}")).alias("t")))

    def centre(x):
        if isinstance(x, ids.FeatureID):
            x = feature(w.find_feature(x))
        if isinstance(x, Feature):
            v, p = x.column["points"], x.column["polygons"]
            path = F.when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(geo.path_centroid(F.coalesce(v, F.array().cast(geo.PATH))))
            got = F.when(p.isNotNull(), geo.area_centroid(F.coalesce(p, F.array().cast(geo.AREA)))).otherwise(path)
        else:
            got = geo.area_centroid(x.column) if x.kind == "area" else geo.path_centroid(x.column) if x.kind == "path" else column(x)
        return Geometry("point", got, frame_of(x))

    def hull(c: Collection):
        v = points(wrap(F.col("value"), c.types["value"]))
        # Hulls of parts first, so no task holds all points.
        p = c.df.select(F.explode(v).alias("p")).groupBy(F.pmod(F.xxhash64("p"), F.lit(256)).alias("h")).agg(F.collect_set("p").alias("ps"))
        few = p.select("ps", geo.hull_of(F.col("ps")).alias("a")).select(F.explode(F.when(F.size("a") > 0, F.flatten(F.flatten("a"))).otherwise(F.col("ps"))).alias("p"))
        return Geometry("area", F.col("a"), few.agg(F.collect_set("p").alias("ps")).select(geo.hull_of(F.col("ps")).alias("a")))

    def along(c: Collection, metres):
        v = points(wrap(F.col("value"), c.types["value"]))
        got = c.df.select(F.explode(geo.sample(v, F.lit(float(metres)))).alias("value")).distinct()
        return Collection(got.select(F.xxhash64("value").alias("key"), "value"))

    return {
        "list-feature": (1, w.list_feature), "find-area": (1, lambda id: feature(w.find_area(id))), "find-relation": (1, lambda id: feature(w.find_relation(id))), "find-collection": (1, lambda id: feature(w.find_collection(id))), "find-feature": (1, lambda id: feature(w.find_feature(id))),
        "containing-areas": (2, lambda c, q: as_features(w.find_areas(q, False).join(A.containing(values(c), w.find_areas(q, False)).select(*KEY).distinct(), KEY, "left_semi"))),
        "intersecting": (1, constant_geometry), "within": (1, lambda a: constant_geometry(a, "area")), "within-cap": (2, lambda p, r: Q.IntersectsCap(*(p if isinstance(p, tuple) else value_of(at(p))), float(r))), "intersecting-cap": (2, lambda p, r: Q.IntersectsCap(*(p if isinstance(p, tuple) else value_of(at(p))), float(r))),
        "type-point": (0, lambda: Q.Typed("point", Q.All())), "type-path": (0, lambda: Q.Typed("path", Q.All())), "type-area": (0, lambda: Q.Typed("area", Q.All())),
        "all-tags": (1, on(lambda f: listed(f.column["tags"]))), "count-tag-value": (2, on(lambda f, k: F.transform(F.filter(f.column["tags"], lambda t: t["key"] == k), lambda t: F.struct(t["value"].alias("key"), F.lit(1).alias("value"))))),
        "debug-tokens": (1, on(lambda f: listed(Q.tokens(f.column["tags"])))), "debug-all-query": (1, lambda token: Collection(w.with_tokens().where(F.col("token") == token).select(F.struct(*KEY).alias("key"), F.struct(*KEY).alias("value")))),
        "degree": join(1, degree), "point-features": join(1, points_of), "point-paths": join(1, paths_of),
        "points": (1, on(lambda g: listed(points(g)))), "sample-points": (2, on(lambda g, m: listed(geo.sample(points(g), F.lit(float(m)))))), "sample-points-along-paths": (2, along),
        "join": (2, on(lambda a, b: geo.join(points(a), points(b)), "path")), "ordered-join": (2, on(lambda a, b: geo.ordered_join(points(a), points(b)), "path")), "get-centroid": (1, centre), "centroid": (1, centre),
        "s2-points": (3, on(lambda a, lo, hi: listed(cells.covering_tokens(polygons(a), lo, hi)))), "s2-covering": (3, on(lambda a, lo, hi: listed(cells.covering_tokens(polygons(a), lo, hi)))), "s2-grid": (2, on(lambda a, level: listed(cells.grid_tokens(polygons(a), level)))),
        "s2-center": (1, on(lambda t: cells.token_center(column(t)), "point")), "s2-polygon": (1, on(lambda t: cells.token_polygon(column(t)), "area")), "count-valid-ids": (1, lambda c: c.count_valid_ids()),
        "reachable": join(4, reachable), "reachable-area": join(3, reachable_area), "closest": join(4, closest), "closest-distance": join(4, closest_distance), "paths-to-reach": join(4, paths_to_reach), "accessible-routes": join(4, routes),
        "accessible-all": (4, accessible_all), "filter-accessible": (2, lambda c, q: c.keep_values_in(w.find(q, order=False))), "building-access": (3, building_access),
        "connect": (2, lambda a, b: Cn.connect_points(w, G.segments(w), id_of(a), id_of(b))), "connect-to-network": (1, lambda f: connect_all(f.frame)), "connect-to-network-all": (1, lambda c: connect_all(values(c))),
        "collect-areas": (1, lambda c: Geometry("area", F.col("a"), c.df.agg(geo.collect_areas(polygons(wrap(F.col("value"), c.types["value"]))).alias("a")))), "convex-hull": (1, hull),
        "distance-to-point-meters": (2, on(lambda p, x: geo.distance_to_point(points(p), at(x)))), "interpolate": (2, on(lambda p, t: geo.interpolate(points(p), F.lit(float(t))), "point")), "area": (1, on(lambda a: geo.area(polygons(a)))), "length": (1, on(lambda p: geo.length(points(p)))),
        "distance-meters": (2, on(lambda a, b: geo.distance(at(a), at(b)))), "ll": (2, on(lambda a, b: geo.ll(column(a), column(b)), "point")), "rectangle-polygon": (2, on(lambda a, b: geo.rectangle_polygon(at(a), at(b)), "area")), "cap-polygon": (2, on(lambda c, r: geo.cap_polygon(at(c), float(r)), "area")),
        "sightline": join(2, sightline), "entrance-approach": join(1, approach), "snap-area-edges": join(3, snapped),
        "tile-ids": join(1, lambda f: T.tile_ids(f).withColumnRenamed("tile_id", "v")), "tile-ids-hex": join(1, lambda f: T.tile_ids_hex(f).withColumnRenamed("tile_id", "v")),
        "tile-paths": join(2, lambda f, zoom: T.tile_paths(f.withColumn("_all", geo.vertices(F.col("points"), F.col("polygons"))), F.col("_all"), zoom, KEY).withColumnRenamed("tile", "v")),
        "parse-geojson": (1, lambda t: Scalar(J.parse(F.col("t")), spark.createDataFrame([(t,)], "t string")) if isinstance(t, str) else Scalar(J.parse(column(t)), frame_of(t))), "parse-geojson-file": (1, lambda p: doc(file_doc(p))),
        "to-geojson": (1, on(drawn)), "to-geojson-collection": (1, drawn_all), "import-geojson": (2, imported), "import-geojson-file": (2, lambda p, ns: J.import_features(file_doc(p), "geojson", ns)),
        "geojson-areas": (1, lambda d: Collection(J.areas(d.frame.select(d.column.alias("g")), "g").select(F.monotonically_increasing_id().alias("key"), F.col("polygons").alias("value")))),
        "apply-to-point": (1, applied("point")), "apply-to-path": (1, applied("path")), "apply-to-area": (1, applied("area")), "map-geometries": (2, mapped), "id-to-relation-id": (2, relation_id),
        "add-tag": (2, lambda f, t: W.add_tag(spark, id_of(f), *value_of(t))), "add-tags": (1, lambda c: W.add_tags(tag_rows(c, True))), "remove-tag": (2, lambda f, k: W.remove_tag(spark, id_of(f), k)), "remove-tags": (1, lambda c: W.remove_tags(tag_rows(c, False))),
        "add-point": (3, lambda p, id, t: W.add_point(spark, *(p if isinstance(p, tuple) else value_of(p)), id, tags_of(t))), "add-collection": (3, lambda id, t, c: W.add_collection(id, tags_of(t), c)),
        "add-relation": (3, lambda id, t, m: W.add_relation(spark, id, tags_of(t), [(ids.FeatureID(*r["key"]), r["value"]) for r in m.df.collect()])), "add-expression": (3, lambda id, t, e: W.add_expression(spark, id, tags_of(t), e if isinstance(e, str) else ev.text_of(e))),
        "merge-changes": (1, lambda cs: W.merge_changes(w, *[c for _, c in cs])), "with-change": (2, with_change), "add-world-with-change": (2, world_with_change), "changes-to-file": (1, changes_to_file), "changes-from-file": (1, lambda p: W.changes_from_file(spark, p)),
        "materialise": (2, materialise), "materialise-map": (3, materialise_map), "export-world": (1, lambda p: W.export_world(w, p)),
        "histogram": (1, lambda c: bars(False)(c, UNNAMED)), "histogram-with-id": (2, bars(False)), "histogram-swatch": (1, lambda c: bars(True)(c, UNNAMED)), "histogram-swatch-with-id": (2, bars(True)),
    }
