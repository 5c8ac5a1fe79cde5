"""GeoJSON text to geometry columns and back, native but for polygon validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.world import Change

#: Coordinates stay text until the kind of geometry says how deep they are nested.
SCHEMA = "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>, features array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>, coordinates string"


def parse(text: Column) -> Column:
    """A parsed document; what is not JSON gives null fields."""
    return F.from_json(text, SCHEMA)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(parse(F.col("value")).alias("geojson"))


def features(doc: Column) -> Column:
    """The features of a collection, a lone feature or a bare geometry, as one array."""
    one = F.array(F.struct(doc["type"].alias("type"), doc["geometry"].alias("geometry"), doc["properties"].alias("properties")))
    bare = F.array(F.struct(F.lit("Feature").alias("type"), F.struct(doc["type"].alias("type"), doc["coordinates"].alias("coordinates")).alias("geometry"), F.lit(None).cast("map<string,string>").alias("properties")))
    return F.when(doc["type"] == "FeatureCollection", doc["features"]).when(doc["type"] == "Feature", one).otherwise(bare)


def _point(c: Column) -> Column:
    return geo.ll(c[1], c[0])


def _ring(r: Column) -> Column:
    pts = F.transform(r, _point)
    return F.when((F.size(pts) > 1) & (pts[0] == F.element_at(pts, -1)), F.slice(pts, F.lit(1), F.size(pts) - 1)).otherwise(pts)


def geometry(g: Column) -> Column:
    """``struct<kind, points, polygons>`` of a geometry."""
    t, c = g["type"], g["coordinates"]
    read = lambda depth: F.from_json(c, "array<" * depth + "double" + ">" * depth)
    kind = F.when(t == "Point", "point").when(t == "LineString", "path").when(t.isin("Polygon", "MultiPolygon"), "area").otherwise("invalid")
    points = F.when(t == "Point", F.array(_point(read(1)))).when(t == "LineString", F.transform(read(2), _point))
    polygons = F.when(t == "Polygon", F.array(F.transform(read(3), _ring))).when(t == "MultiPolygon", F.transform(read(4), lambda p: F.transform(p, _ring)))
    return F.struct(kind.alias("kind"), points.alias("points"), polygons.alias("polygons"))


def to_geojson(kind: Column, points: Column, polygons: Column) -> Column:
    """A geometry's text; none gives an empty collection."""
    at = lambda p: F.array(p["lng"], p["lat"])
    ring = lambda r: F.transform(F.concat(r, F.slice(r, F.lit(1), F.lit(1))), at)
    poly = F.transform(polygons, lambda p: F.transform(p, ring))
    text = lambda type, c: F.to_json(F.struct(F.lit(type).alias("type"), c.alias("coordinates")))
    return (
        F.when(kind == "point", text("Point", at(points[0])))
        .when(kind == "path", text("LineString", F.transform(points, at)))
        .when((kind == "area") & (F.size(polygons) == 1), text("Polygon", poly[0]))
        .when(kind == "area", text("MultiPolygon", poly))
        .otherwise('{"type":"FeatureCollection","features":[]}')
    )


def to_collection(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """All geometries (as text) of a DataFrame as one FeatureCollection. The document is one value, so it must fit in a row."""
    each = F.concat(F.lit('{"type":"Feature","geometry":'), F.col(text), F.lit(',"properties":{}}'))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, each.alias("_f")))), lambda x: x["_f"]), ",")
    return df.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("value"))


def apply_to(kind: str, f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``f`` on geometries of one kind, others as they are."""
    return lambda g: F.when(g["kind"] == kind, f(g)).otherwise(g)


def map_geometries(doc: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` over every geometry of a document, as an array of geometries."""
    return F.transform(features(doc), lambda x: f(geometry(x["geometry"])))


def import_features(docs: DataFrame, doc: str, namespace: str) -> Change:
    """A change that adds a document's features; an id is the feature's place in it, its tags are its properties."""
    df = docs.select(F.posexplode(features(F.col(doc))).alias("i", "f")).select("i", "f.properties", geometry(F.col("f.geometry")).alias("g"))
    tags = F.coalesce(F.transform(F.map_entries("properties"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))), F.array().cast("array<struct<key:string,value:string>>"))
    id = "struct<type:string,ns:string,value:bigint>"
    return Change(
        added=df.where("g.kind <> 'invalid'").select(
            F.col("g.kind").alias("type"), F.lit(namespace).alias("ns"), F.col("i").cast("bigint").alias("value"), tags.alias("tags"), F.col("g.points").alias("points"),
            F.col("g.polygons").alias("polygons"), F.array().cast(f"array<{id}>").alias("refs"), F.array().cast(f"array<struct<id:{id},role:string>>").alias("members"),
        )
    )


def areas(docs: DataFrame, doc: str) -> DataFrame:
    """``(key, polygons)`` of the valid areas: every loop of three corners or more."""
    df = docs.select(F.explode(map_geometries(F.col(doc), lambda g: g)).alias("g")).where("g.kind = 'area'")
    valid = F.forall("g.polygons", lambda p: F.forall(p, lambda r: F.size(r) > 2) & (F.size(p) > 0))
    return df.where(valid).select(F.col("g.polygons").alias("polygons"))
