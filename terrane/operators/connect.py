"""Connecting features to the street network, as changes.

Every unconnected point, and every polygon of an area none of whose corners is on
the network, is led to the nearest path of the network within a distance: a point
from itself; a polygon from each corner tagged ``entrance``, or else from the side
whose middle is nearest. What is added depends on the strategy:

* ``existing``: paths to the two points of the network's path on either side of
  the place that is nearest; from a side, its end that is nearer to both.
* ``insert``: a new point at that place, and one path to it. Places less than
  4 metres from one before them on the path become one at their running mean, and
  those that are as near to a point of the path become that point. A side's own
  place is where the side begins, a point that is there.

Defined results: features of other types, without geometry or out of reach add
nothing. A path between the same two points is added once. Points of a path
without ids can't be led to. Repeated features count once.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane import ids
from terrane.functions import geo
from terrane.ids import ID
from terrane.operators.graph import CONNECTION, connect_nearest, text
from terrane.plans.lineage import cut
from terrane.query import first_value
from terrane.world import KEY, Change, World

#: Metres: how far features are connected, and which places on a path are one.
REACH, CLUSTER = 500.0, 4.0
ACCESS_PATHS, ACCESS_POINTS = "network/access-paths", "network/access-points"


def _hash(*parts: Column) -> Column:
    """A value from ids: what it is does not matter, but that it is the same each time."""
    return F.xxhash64(*parts)


def _struct(c: str) -> list[Column]:
    return [F.col(f"{c}.{k}").alias(k) for k in KEY]


def _rows(df: DataFrame, type: str, ns: Column, value: Column, tags: Column, points: Column, refs: Column) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(type).alias("type"), ns.alias("ns"), value.cast("bigint").alias("value"), tags.cast("array<struct<key:string,value:string>>").alias("tags"), points.cast(geo.PATH).alias("points"),
        none.cast(geo.AREA).alias("polygons"), refs.cast(f"array<{ID}>").alias("refs"), F.array().cast(f"array<struct<id:{ID},role:string>>").alias("members"),
    )


def places(world: World, features: DataFrame, network: DataFrame) -> DataFrame:
    """``(feature, place, at, entrance, first, second)``: where features may be led from. ``entrance`` is a point's id; of a side it is null and ``first`` and ``second`` are its ends ``(id, at)``."""
    id = F.struct(*KEY)
    on = world.references().where("type = 'path'").select(text(id).alias("path"), F.col("target")).join(network, "path", "left_semi").select("target").distinct()
    end = "struct<id:" + ID + ",at:" + geo.POINT + ">"
    none = F.lit(None).cast(end)
    alone = features.where("type = 'point'").dropDuplicates(KEY).select(id.alias("feature"), F.lit(0).alias("place"), F.get("points", F.lit(0)).alias("at"), id.alias("entrance"))
    alone = alone.join(on.select(F.col("target").alias("entrance")), "entrance", "left_anti").where("at IS NOT NULL")
    points = alone.select("feature", "place", "at", "entrance", none.alias("first"), none.alias("second"))
    # A polygon's boundary is the path that the area refers to.
    areas = features.where("type = 'area'").dropDuplicates(KEY).select(id.alias("feature"), F.posexplode("refs").alias("polygon", "path"))
    rings = world.features.where("type = 'path'").select(id.alias("path"), F.arrays_zip(F.col("refs").alias("id"), F.col("points").alias("at")).alias("ring"))
    rings = cut(areas.join(rings, "path").select("feature", "polygon", "ring"))
    corners = rings.select("feature", "polygon", F.posexplode("ring").alias("i", "c")).select("feature", "polygon", "i", "c.id", "c.at")
    joined = corners.join(on.select(F.col("target").alias("id")), "id", "left_semi").select("feature", "polygon").distinct()
    corners = corners.join(joined, ["feature", "polygon"], "left_anti")
    doors = world.features.where("type = 'point'").where(first_value("entrance").isNotNull()).select(id.alias("id"))
    doors = corners.join(doors, "id").groupBy("feature", "polygon", "id").agg(F.min("i").alias("i"), F.first("at").alias("at"))
    entered = doors.select("feature", "polygon").distinct()
    # A number for each place, in order of polygons and corners.
    by_door = doors.select("feature", (F.col("polygon").cast("bigint") * (1 << 32) + F.col("i")).alias("place"), "at", F.col("id").alias("entrance"), none.alias("first"), none.alias("second"))
    two = lambda i: F.struct(F.get("ring", i)["id"].alias("id"), F.get("ring", i)["at"].alias("at"))
    sides = rings.join(joined, ["feature", "polygon"], "left_anti").join(entered, ["feature", "polygon"], "left_anti").where(F.size("ring") > 1)
    sides = sides.select("feature", "polygon", F.explode(F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(i.alias("i"), two(i).alias("a"), two(i + 1).alias("b")))).alias("s"))
    middle = geo.ll((F.col("s.a.at.lat") + F.col("s.b.at.lat")) / 2, (F.col("s.a.at.lng") + F.col("s.b.at.lng")) / 2)
    by_side = sides.select("feature", (F.col("polygon").cast("bigint") * (1 << 32) + F.col("s.i")).alias("place"), middle.alias("at"), F.lit(None).cast(ID).alias("entrance"), F.col("s.a").cast(end).alias("first"), F.col("s.b").cast(end).alias("second"))
    return points.withColumn("place", F.col("place").cast("bigint")).unionByName(by_door).unionByName(by_side)


def accesses(world: World, features: DataFrame, network: DataFrame, reach: float = REACH) -> DataFrame:
    """``places`` with the nearest place on a path of ``network`` ``(path)`` within ``reach``: ``(…, path, leg, foot, metres)``; of a polygon without entrances only its nearest side."""
    from_ = cut(places(world, features, network).withColumn("id", F.concat_ws("#", text(F.col("feature")), F.col("place").cast("string"))))
    paths = world.features.where("type = 'path'").select(text(F.struct(*KEY)).alias("path"), "points").join(network, "path", "left_semi")
    near = connect_nearest(from_.select("id", "at"), paths, reach).where(F.col("metres") < reach).select("id", "path", "leg", F.col("at").alias("foot"), "metres")
    met = from_.join(near, "id").withColumn("polygon", F.floor(F.col("place") / (1 << 32)))
    best = met.where("entrance IS NULL").groupBy("feature", "polygon").agg(F.min(F.struct("metres", "place", "id")).alias("m")).select("m.id")
    return met.where("entrance IS NOT NULL").unionByName(met.join(best, "id", "left_semi"))


def _joins(pairs: DataFrame) -> DataFrame:
    """Added paths of ``pairs`` ``(a, b)`` of ``(id, at)``."""
    one = pairs.where("a.id IS NOT NULL AND b.id IS NOT NULL").select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.col("a.at").alias("p"), F.col("b.at").alias("q"))
    one = one.groupBy("u", "v").agg(F.first("p").alias("p"), F.first("q").alias("q"))
    tag = F.array(F.struct(F.lit(CONNECTION[0]).alias("key"), F.lit(CONNECTION[1]).alias("value")))
    return _rows(one, "path", F.lit(ACCESS_PATHS), _hash(text(F.col("u")), text(F.col("v"))), tag, F.array("p", "q"), F.array("u", "v"))


def connect_features(world: World, features: DataFrame, network: DataFrame, strategy: str = "existing", reach: float = REACH, cluster: float = CLUSTER) -> Change:
    """The change that connects ``features`` (rows of the world) to the ``network`` ``(path)``, as ``graph.network`` gives it."""
    met = cut(accesses(world, features, network, reach))
    rings = world.features.where("type = 'path'").select(text(F.struct(*KEY)).alias("path"), F.struct(*KEY).alias("id"), "tags", "refs", "points")
    own = F.struct(F.col("entrance").alias("id"), F.col("at").alias("at"))
    if strategy == "existing":
        whole = met.join(rings.drop("id", "tags"), "path")
        at = lambda i: F.struct(F.get("refs", i).alias("id"), F.get("points", i).alias("at"))
        whole = whole.select("entrance", "at", "first", "second", at(F.col("leg")).alias("before"), at(F.col("leg") + 1).alias("after"))
        both = lambda c: geo.distance(F.col(f"{c}.at"), F.col("before.at")) + geo.distance(F.col(f"{c}.at"), F.col("after.at"))
        start = F.when(F.col("entrance").isNotNull(), own).when(both("first") < both("second"), F.col("first")).otherwise(F.col("second"))
        return Change(added=_joins(whole.select(start.alias("a"), F.explode(F.array("before", "after")).alias("b"))))
    if strategy != "insert":
        raise ValueError(f"unknown strategy {strategy!r}")
    new = F.struct(F.lit("point").alias("type"), F.concat(F.lit(ACCESS_POINTS + "/"), F.col("feature.ns")).alias("ns"), _hash(text(F.col("feature")), F.col("place")).alias("value"))
    legs = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1), geo.distance)
    far = rings.withColumn("legs", legs).withColumn("far", F.transform(F.sequence(F.lit(0), F.size("points") - 1), lambda i: F.aggregate(F.slice("legs", F.lit(1), i), F.lit(0.0), lambda s, x: s + x))).drop("legs")
    far = cut(far.join(met.select("path").distinct(), "path", "left_semi"))
    along = met.join(far.select("path", "points", "far"), "path")
    along = cut(along.select("path", new.alias("point"), (F.get("far", F.col("leg")) + geo.distance(F.get("points", F.col("leg")), F.col("foot"))).alias("d"), F.when(F.col("entrance").isNotNull(), own).otherwise(F.col("first")).alias("a")))
    # A gap of the threshold always parts clusters, so runs without one are folded on their own.
    w = Window.partitionBy("path").orderBy("d", "point")
    runs = along.withColumn("cut", F.coalesce((F.col("d") - F.lag("d").over(w) >= cluster).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("path", "run", "d", "point")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=[(p["type"], p["ns"], p["value"]) for p in pdf["point"]]).sort_values(["d", "order"])
        rows, mean, head = [], None, None
        for d, p in zip(pdf["d"], pdf["point"]):
            if mean is not None and d - mean < cluster:
                mean = (mean + d) / 2
            else:
                if head is not None:
                    rows += [(x, head, mean) for x in members]
                mean, head, members = d, p, []
            members.append(p)
        rows += [(x, head, mean) for x in members]
        return pd.DataFrame([(pdf["path"].iloc[0], *r) for r in rows], columns=["path", "point", "head", "d"])

    heads = cut(runs.groupBy("path", "run").applyInPandas(fold, f"path string, point {ID}, head {ID}, d double"))
    # The place of each cluster, on a point of the path where one is near.
    spot = heads.select("path", "head", "d").distinct().join(far, "path")
    near = F.array_min(F.transform(F.arrays_zip(F.col("far").alias("f"), F.col("refs").alias("id"), F.col("points").alias("at")), lambda x: F.struct(F.abs(x["f"] - F.col("d")).alias("gap"), x["id"].alias("id"), x["at"].alias("at"))))
    leg = F.greatest(F.size(F.filter("far", lambda f: f <= F.col("d"))) - 1, F.lit(0))
    spot = spot.withColumn("near", near).withColumn("leg", F.least(leg, F.size("points") - 2))
    t = F.try_divide(F.col("d") - F.get("far", F.col("leg")), F.get("far", F.col("leg") + 1) - F.get("far", F.col("leg")))
    a, b = F.get("points", F.col("leg")), F.get("points", F.col("leg") + 1)
    there = geo.ll(a["lat"] + F.coalesce(t, F.lit(0.0)) * (b["lat"] - a["lat"]), a["lng"] + F.coalesce(t, F.lit(0.0)) * (b["lng"] - a["lng"]))
    onto = (F.col("near.gap") < cluster) & F.col("near.id").isNotNull()
    spot = cut(spot.select("path", "head", "d", F.when(onto, F.struct("near.id", "near.at")).otherwise(F.struct(F.col("head").alias("id"), there.alias("at"))).alias("to"), onto.alias("old")))
    made = spot.where("NOT old")
    points = _rows(made, "point", F.col("to.id.ns"), F.col("to.id.value"), F.array(), F.array("to.at"), F.array())
    # Paths with what is inserted, in order along them.
    insert = made.groupBy("path").agg(F.collect_list(F.struct("d", F.lit(1).alias("new"), F.col("to.id").alias("id"), F.col("to.at").alias("at"))).alias("more"))
    base = F.transform(F.arrays_zip(F.col("far").alias("d"), F.col("refs").alias("id"), F.col("points").alias("at")), lambda x: F.struct(x["d"].alias("d"), F.lit(0).alias("new"), x["id"].alias("id"), x["at"].alias("at")))
    # Ids have an order that does not matter: no two places of a path are equal in distance and kind but for points that fall together, which keep theirs.
    base = F.transform(base, lambda x, i: F.struct(x["d"].alias("d"), x["new"].alias("new"), i.alias("i"), x["id"].alias("id"), x["at"].alias("at")))
    more = F.transform("more", lambda x: F.struct(x["d"].alias("d"), x["new"].alias("new"), F.lit(0).alias("i"), x["id"].alias("id"), x["at"].alias("at")))
    grown = insert.join(far, "path").withColumn("all", F.array_sort(F.concat(base, more)))
    paths = _rows(grown, "path", F.col("id.ns"), F.col("id.value"), F.col("tags"), F.transform("all", lambda x: x["at"]), F.transform("all", lambda x: x["id"]))
    ways = along.join(heads.select("path", "point", "head"), ["path", "point"]).join(spot.select("path", "head", "to"), ["path", "head"])
    return Change(added=paths.unionByName(points).unionByName(_joins(ways.select("a", F.col("to").alias("b")))))


def connect_points(world: World, segments: DataFrame, a: ids.FeatureID, b: ids.FeatureID) -> Change:
    """The change that adds a path between two points unless a segment joins them already; its id has the value 1."""
    one = lambda id, n: world._at(world.features, id).select(F.struct(*KEY).alias(n), F.get("points", F.lit(0)).alias(f"{n}_at"))
    key = lambda id: f"{id.type}/{id.ns}/{ids.signed(id.value)}"
    direct = segments.where((F.col("first_node") == key(a)) & (F.col("last_node") == key(b))).groupBy().agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("_k"))
    both = one(a, "u").withColumn("_k", F.lit(1)).join(one(b, "v").withColumn("_k", F.lit(1)), "_k").join(direct, "_k")
    tag = F.array(F.struct(F.lit(CONNECTION[0]).alias("key"), F.lit(CONNECTION[1]).alias("value")))
    return Change(added=_rows(both, "path", F.lit(ACCESS_PATHS), F.lit(1), tag, F.array("u_at", "v_at"), F.array("u", "v")))
