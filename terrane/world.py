"""Worlds: features as DataFrames, overlays over them, and the changes that make overlays.

A world is lazy: looking things up filters its DataFrames, and a change gives a
new world whose features are the base's without the changed ones, and the
changed ones. The base is never touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane import ids
from terrane.functions import geo
from terrane.ids import ID, FeatureID
from terrane.operators.collections import Collection
from terrane.query import Query, indexed, tokens

TAGS = "array<struct<key:string,value:string>>"
FEATURE = f"type string, ns string, value bigint, tags {TAGS}, points {geo.PATH}, polygons {geo.AREA}, refs array<{ID}>, members array<struct<id:{ID},role:string>>"
ITEM = "type string, ns string, value bigint, ord bigint, k string, v string"
TAG_OP = "type string, ns string, value bigint, seq bigint, op string, k string, v string"
KEY = ["type", "ns", "value"]


def feature_rows(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    names = [c.split(" ")[0] for c in ("type", "ns", "value", "tags", "points", "polygons", "refs", "members")]
    return spark.createDataFrame([tuple(r.get(n, [] if n in ("tags", "refs", "members") else None) for n in names) for r in rows], FEATURE)


def only(df: DataFrame, what: str) -> DataFrame:
    """One row, or an error when it is evaluated."""
    return df.groupBy().agg(F.first(F.struct(*df.columns)).alias("r")).select(F.coalesce("r", F.raise_error(F.lit(what)).cast(df.schema)).alias("r")).select("r.*")


def id_column(df: DataFrame | None = None) -> Column:
    return F.struct(*KEY)


@dataclass(frozen=True)
class World:
    features: DataFrame
    items: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.features.sparkSession

    # Lookup

    @classmethod
    def merged(cls, *worlds: World) -> World:
        """All features of several worlds, each id once: that of the first world that has it, with its items."""
        union = lambda dfs: reduce(DataFrame.unionByName, [df.withColumn("_w", F.lit(i)) for i, df in dfs])
        every = union([(i, w.features) for i, w in enumerate(worlds)])
        first = Window.partitionBy(*KEY)
        features = every.withColumn("_r", F.row_number().over(first.orderBy("_w"))).where("_r = 1").drop("_w", "_r")
        with_items = [(i, w.items) for i, w in enumerate(worlds) if w.items is not None]
        items = union(with_items).withColumn("_m", F.min("_w").over(first)).where("_w = _m").drop("_w", "_m") if with_items else None
        return cls(features, items)

    def _at(self, df: DataFrame, id: FeatureID) -> DataFrame:
        return df.where((F.col("type") == id.type) & (F.col("ns") == id.ns) & (F.col("value") == ids.signed(id.value)))

    def find_feature(self, id: FeatureID, type: str | None = None) -> DataFrame:
        """The feature of an id; a missing one, or one of another type, is an error."""
        if type and id.type != type:
            raise TypeError(f"{id} is not of type {type}")
        return only(self._at(self.features, id), f"no feature {id}")

    def has_feature(self, id: FeatureID) -> DataFrame:
        return self._at(self.features, id).agg((F.count("*") > 0).alias("value"))

    def find_area(self, id: FeatureID) -> DataFrame:
        return self.find_feature(id, "area")

    def find_relation(self, id: FeatureID) -> DataFrame:
        return self.find_feature(id, "relation")

    def find_collection(self, id: FeatureID) -> DataFrame:
        return self.find_feature(id, "collection")

    def find(self, query: Query, type: str | None = None, order: bool = True) -> DataFrame:
        """Indexed features that match, each once, in the order of ids."""
        hit = self.features.where(indexed() & query.simplify().column("find"))
        hit = hit.where(F.col("type") == type) if type else hit
        return hit.orderBy(*ids.id_sort()) if order else hit

    def find_areas(self, query: Query, order: bool = True) -> DataFrame:
        return self.find(query, "area", order)

    def find_relations(self, query: Query, order: bool = True) -> DataFrame:
        return self.find(query, "relation", order)

    def matches(self, query: Query) -> Column:
        return query.simplify().column("matches")

    def list_feature(self, id: FeatureID) -> Collection:
        """Items of a collection feature in order."""
        return Collection(self._at(self.items, id).select("ord", F.col("k").alias("key"), F.col("v").alias("value")))

    def with_tokens(self) -> DataFrame:
        """The search index as rows ``(token, type, ns, value)``."""
        return self.features.where(indexed()).select(F.explode(tokens()).alias("token"), *KEY)

    # References

    def references(self) -> DataFrame:
        """``(type, ns, value, ord, target)``: every reference of every feature."""
        own = self.features.select(*KEY, F.posexplode("refs").alias("ord", "target"))
        members = self.features.where("type = 'relation'").select(*KEY, F.posexplode("members").alias("ord", "m")).select(*KEY, "ord", F.col("m.id").alias("target"))
        return own.unionByName(members)

    def find_references(self, targets: DataFrame, types: Sequence[str] = ()) -> DataFrame:
        """Features that refer to any of ``targets`` (``type, ns, value``)."""
        r = self.references()
        r = r.where(F.col("type").isin(*types)) if types else r
        t = targets.select(F.struct(*KEY).alias("target")).distinct()
        return r.join(t, "target").select("target", *KEY).distinct()

    def point_paths(self, points: DataFrame) -> DataFrame:
        return self.find_references(points, ["path"])

    def area_points(self) -> DataFrame:
        """``(type, ns, value, target)``: the points of areas, through their paths."""
        paths = self.references().where("type = 'path'").select(F.struct(*KEY).alias("path"), F.col("target").alias("point"))
        areas = self.references().where("type = 'area'").select(*KEY, F.col("target").alias("path"))
        return areas.join(paths, "path").select(*KEY, F.col("point").alias("target")).distinct()

    def point_features(self, features: DataFrame) -> DataFrame:
        """The points that features refer to: of a point itself, of a path its points, of an area its paths' points."""
        own = features.select(*KEY)
        selves = own.where("type = 'point'").select(*KEY, F.struct(*KEY).alias("target"))
        paths = self.references().where("type = 'path'").join(own.where("type = 'path'"), KEY, "left_semi").select(*KEY, "target")
        areas = self.area_points().join(own.where("type = 'area'"), KEY, "left_semi").select(*KEY, "target")
        return selves.unionByName(paths).unionByName(areas).distinct()

    # Changes

    def with_change(self, change: Change, f: Callable[[World], Any] | None = None) -> Any:
        """This world with a change, or what ``f`` gives in it; this world stays as it is."""
        world = change.over(self)
        return f(world) if f else world


def changed_tags(tags: Column, ops: Column) -> Column:
    """Tags after ``ops`` (map of key to value, null to remove): the first tag of a key is set, others of a removed key go, new ones follow in order of their key's operation."""
    keys = F.transform(tags, lambda t: t["key"])
    kept = F.filter(tags, lambda t: ~F.coalesce(F.exists(ops, lambda o: (o["k"] == t["key"]) & (o["op"] == "remove")), F.lit(False)))
    set_ = lambda key: F.get(F.filter(ops, lambda o: (o["k"] == key) & (o["op"] == "set")), F.lit(0))
    kept_keys = F.transform(kept, lambda t: t["key"])
    done = F.transform(kept, lambda t, i: F.struct(t["key"].alias("key"), F.when(set_(t["key"]).isNotNull() & (F.array_position(kept_keys, t["key"]) == i + 1), set_(t["key"])["v"]).otherwise(t["value"]).alias("value")))
    new = F.transform(F.filter(ops, lambda o: (o["op"] == "set") & ~F.array_contains(keys, o["k"])), lambda o: F.struct(o["k"].alias("key"), o["v"].alias("value")))
    return F.concat(done, new)


@dataclass(frozen=True)
class Change:
    """Features and collection items to add, and operations on tags, each in sequence."""

    added: DataFrame | None = None
    ops: DataFrame | None = None
    items: DataFrame | None = None

    def over(self, world: World) -> World:
        features = world.features
        if self.added is not None:
            features = features.join(self.added.select(*KEY), KEY, "left_anti").unionByName(self.added)
        if self.ops is not None:
            last = self.ops.groupBy(*KEY, "k").agg(F.max_by(F.struct("seq", "k", "op", "v"), "seq").alias("o"))
            folded = last.groupBy(*KEY).agg(F.array_sort(F.collect_list("o")).alias("_ops"))
            features = features.join(folded, KEY, "left").withColumn("tags", F.when(F.col("_ops").isNotNull(), changed_tags(F.col("tags"), F.col("_ops"))).otherwise(F.col("tags"))).drop("_ops")
        items = world.items
        if self.items is not None:
            items = self.items if items is None else items.join(self.items.select(*KEY).distinct(), KEY, "left_anti").unionByName(self.items)
        return World(features, items)

    def missing(self, world: World) -> DataFrame:
        """Ids whose tags are changed but that are neither in the world nor added."""
        if self.ops is None:
            return world.features.select(*KEY).limit(0)
        known = world.features.select(*KEY)
        known = known.unionByName(self.added.select(*KEY)) if self.added is not None else known
        return self.ops.select(*KEY).distinct().join(known, KEY, "left_anti")

    def modified_tags(self) -> DataFrame:
        return self.ops

    def modified_features(self) -> DataFrame:
        return self.added


def add_tags(tags: DataFrame) -> Change:
    """``tags``: ``(type, ns, value, k, v)``, and ``seq`` where order matters."""
    seq = F.col("seq") if "seq" in tags.columns else F.lit(0)
    return Change(ops=tags.select(*KEY, seq.cast("bigint").alias("seq"), F.lit("set").alias("op"), "k", "v"))


def remove_tags(keys: DataFrame) -> Change:
    seq = F.col("seq") if "seq" in keys.columns else F.lit(0)
    return Change(ops=keys.select(*KEY, seq.cast("bigint").alias("seq"), F.lit("remove").alias("op"), "k", F.lit(None).cast("string").alias("v")))


def add_tag(spark: SparkSession, id: FeatureID, key: str, value: str) -> Change:
    return add_tags(spark.createDataFrame([(id.type, id.ns, ids.signed(id.value), key, value)], "type string, ns string, value bigint, k string, v string"))


def remove_tag(spark: SparkSession, id: FeatureID, key: str) -> Change:
    return remove_tags(spark.createDataFrame([(id.type, id.ns, ids.signed(id.value), key)], "type string, ns string, value bigint, k string"))


def add_feature(spark: SparkSession, id: FeatureID, **row) -> Change:
    return Change(added=feature_rows(spark, [{"type": id.type, "ns": id.ns, "value": ids.signed(id.value), **row}]))


def add_point(spark: SparkSession, lat: float, lng: float, id: FeatureID, tags: Sequence[tuple[str, str]] = ()) -> Change:
    return add_feature(spark, id, points=[(float(lat), float(lng))], tags=list(tags))


def add_relation(spark: SparkSession, id: FeatureID, tags: Sequence[tuple[str, str]], members: Sequence[tuple[FeatureID, str]]) -> Change:
    return add_feature(spark, id, tags=list(tags), members=[((m.type, m.ns, ids.signed(m.value)), role) for m, role in members])


def add_collection(id: FeatureID, tags: Sequence[tuple[str, str]], collection: Collection) -> Change:
    """A collection feature with its items in order."""
    spark = collection.df.sparkSession
    text = lambda c: ids.id_text(F.col(c)) if collection.types[c] == ID else F.col(c).cast("string")
    ord = F.col("ord").cast("bigint") if collection.types.get("ord") in ("bigint", "int") else F.monotonically_increasing_id()
    items = collection.df.select(F.lit(id.type).alias("type"), F.lit(id.ns).alias("ns"), F.lit(ids.signed(id.value)).cast("bigint").alias("value"), ord.alias("ord"), text("key").alias("k"), text("value").alias("v"))
    return replace(add_feature(spark, id, tags=list(tags)), items=items)


def add_expression(spark: SparkSession, id: FeatureID, tags: Sequence[tuple[str, str]], text: str) -> Change:
    return add_feature(spark, id, tags=[*tags, ("expression", text)])


def merge_changes(world: World | None, *changes: Change) -> Change:
    """All changes as one, in sequence; against a world they are tried first, and a tag on a feature that is nowhere is an error."""
    union = lambda dfs: reduce(DataFrame.unionByName, dfs) if dfs else None
    ops = union([c.ops.withColumn("seq", F.col("seq") + (i << 40)) for i, c in enumerate(changes) if c.ops is not None])
    added = [c.added.withColumn("_i", F.lit(i)) for i, c in enumerate(changes) if c.added is not None]
    if added:
        rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("_i")))
        added = union(added).withColumn("_r", rank).where("_r = 1").drop("_i", "_r")
    merged = Change(added or None, ops, union([c.items for c in changes if c.items is not None]))
    if world is not None and (bad := merged.missing(world).first()) is not None:
        raise KeyError(f"no feature {FeatureID(*bad)}")
    return merged


class Worlds:
    """Named worlds over one base; each is made an overlay when it is first asked for."""

    def __init__(self, base: World):
        self.base, self.named = base, {}

    def find_or_create(self, id: FeatureID) -> World:
        return self.named.setdefault(id, self.base)

    def list(self) -> list[FeatureID]:
        return sorted(self.named)

    def delete(self, id: FeatureID) -> None:
        self.named.pop(id, None)

    def apply(self, id: FeatureID, change: Change) -> World:
        self.named[id] = change.over(self.find_or_create(id))
        return self.named[id]

    def add_world_with_change(self, id: FeatureID, change: Change) -> World:
        """Starts the world anew from the base."""
        self.delete(id)
        return self.apply(id, change)


def export_world(world: World, path: str) -> int:
    """Writes a world as tables: features by type, clustered by id, and items. Returns the number of features."""
    world.features.repartitionByRange(*ids.id_sort()).sortWithinPartitions(*ids.id_sort()).write.mode("overwrite").partitionBy("type").parquet(f"{path}/features")
    if world.items is not None:
        world.items.write.mode("overwrite").parquet(f"{path}/items")
    return world.spark.read.parquet(f"{path}/features").count()


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def read_world(spark: SparkSession, path: str) -> World:
    """What ``export_world`` wrote. A world without collections has no items; anything else that can't be read is an error."""
    features = spark.read.schema(FEATURE).parquet(f"{path}/features")
    items = f"{path}/items"
    return World(features, spark.read.schema(ITEM).parquet(items) if exists(spark, items) else None)


def changes_to_file(change: Change, path: str) -> str:
    """Writes a change as JSON lines, a folder to a part; a change without parts is an error."""
    if change.added is None and change.ops is None and change.items is None:
        raise ValueError("an empty change")
    for name, df in (("added", change.added), ("ops", change.ops), ("items", change.items)):
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")
    return path


def changes_from_file(spark: SparkSession, path: str) -> Change:
    """What ``changes_to_file`` wrote; a part that wasn't written is none, a line that is no change is an error."""

    def read(name: str, schema: str):
        at = f"{path}/{name}"
        return spark.read.schema(schema).option("mode", "FAILFAST").json(at) if exists(spark, at) else None

    if not exists(spark, path):
        raise FileNotFoundError(path)
    return Change(read("added", FEATURE), read("ops", TAG_OP), read("items", ITEM))


def materialise(id: FeatureID, expression: str, result: Collection) -> Change:
    """A collection of an expression's result, and an expression feature that holds its text."""
    spark = result.df.sparkSession
    text = add_expression(spark, FeatureID("expression", id.ns, id.value), [], expression)
    return merge_changes(None, add_collection(id, [], result), text)


def materialise_map(features: DataFrame, id: FeatureID, f: Callable[[DataFrame], DataFrame], old: DataFrame | None = None) -> DataFrame:
    """``(type, ns, value, ord, k, v)`` of ``f`` for every feature at once, keyed by feature; rows of ``old`` for other features are kept."""
    new = f(features).select(*KEY, "ord", "k", "v")
    if old is None:
        return new
    return old.join(features.select(*KEY).distinct(), KEY, "left_anti").select(*new.columns).unionByName(new)
