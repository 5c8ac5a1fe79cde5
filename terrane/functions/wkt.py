"""Well-known text to geometry columns and back, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import geojson as J

#: The kinds that are read, with the name of each in GeoJSON.
NAMES = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon"}


def parse(text: Column) -> Column:
    """``struct<kind, points, polygons>`` of a point, line string, polygon or multipolygon; ``invalid`` for anything else. A third coordinate is ignored."""
    t = F.upper(F.trim(text))
    name = F.regexp_extract(t, r"\A([A-Z]+)\s*\(", 1)
    number = r"[-+]?[0-9]+(?:\.[0-9]*)?(?:E[-+]?[0-9]+)?"
    pairs = F.regexp_replace(F.regexp_replace(t, r"\A[A-Z]+\s*", ""), rf"({number})\s+({number})(?:\s+{number})*", "[$1,$2]")
    nested = F.translate(pairs, "()", "[]")
    # A point's pair is in one bracket too many.
    nested = F.when(name == "POINT", F.regexp_extract(nested, r"\A\[\s*(\[.*\])\s*\]\z", 1)).otherwise(nested)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), name)
    return J.geometry(F.struct(F.when(name.isin(*NAMES), kind).otherwise("").alias("type"), nested.alias("coordinates")))


def to_wkt(kind: Column, points: Column, polygons: Column) -> Column:
    """The text of a geometry, loops closed; null for none."""
    pair = lambda p: F.concat_ws(" ", p["lng"].cast("string"), p["lat"].cast("string"))
    line = lambda ps: F.concat(F.lit("("), F.array_join(F.transform(ps, pair), ", "), F.lit(")"))
    ring = lambda r: line(F.concat(r, F.slice(r, F.lit(1), F.lit(1))))
    poly = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))
    polys = F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(polygons, poly), ", "), F.lit(")"))
    return (
        F.when(kind == "point", F.concat(F.lit("POINT ("), pair(F.get(points, F.lit(0))), F.lit(")"))).when(kind == "path", F.concat(F.lit("LINESTRING "), line(points)))
        .when((kind == "area") & (F.size(polygons) == 1), F.concat(F.lit("POLYGON "), poly(F.get(polygons, F.lit(0))))).when(kind == "area", polys)
    )


