"""Web-Mercator tiles and feature tile ids, native but for the hash."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane import ids


def tile_x(lng: Column, zoom) -> Column:
    return F.floor((lng + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))).cast("bigint")


def tile_y(lat: Column, zoom) -> Column:
    s = F.sin(F.radians(lat))
    e = F.pow(F.lit(2.0), (zoom if isinstance(zoom, Column) else F.lit(zoom)) - 1)
    return F.floor(e - e / math.pi * 0.5 * F.log((1 + s) / (1 - s))).cast("bigint")


def tile_id(zoom: Column, x: Column, y: Column) -> Column:
    """Zoom in the top five bits, then y above ``zoom`` bits of x."""
    return F.call_function("shiftleft", zoom.cast("bigint"), F.lit(59)).bitwiseOR(F.call_function("shiftleft", y.cast("bigint"), zoom.cast("int"))).bitwiseOR(x.cast("bigint"))


def tile_path(zoom, x: Column, y: Column) -> Column:
    z = zoom if isinstance(zoom, Column) else F.lit(zoom)
    return F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string"))


def parent(x: Column) -> Column:
    return F.call_function("shiftright", x, F.lit(1))


def tile_paths(features: DataFrame, points: Column, zoom: int, keep: list[str]) -> DataFrame:
    """The tiles that a geometry's vertices and the box between each two neighbours touch, each once."""
    v = F.transform(points, lambda p: F.struct(tile_x(p["lng"], zoom).alias("x"), tile_y(p["lat"], zoom).alias("y")))
    legs = F.when(F.size(v) < 2, F.transform(v, lambda p: F.struct(p.alias("first"), p.alias("second")))).otherwise(F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("first"), b.alias("second"))))
    df = features.select(*keep, F.explode(legs).alias("l"))
    span = lambda k: F.sequence(F.least(f"l.first.{k}", f"l.second.{k}"), F.greatest(f"l.first.{k}", f"l.second.{k}"))
    df = df.select(*keep, F.explode(span("x")).alias("x"), "l").select(*keep, "x", F.explode(span("y")).alias("y")).distinct()
    return df.select(*keep, tile_path(zoom, F.col("x"), F.col("y")).alias("tile"))


def children_to_parents(tiles: DataFrame, zooms: int) -> DataFrame:
    """Tiles ``(zoom, x, y)`` with all their parents up to ``zooms`` levels, each once."""
    df = tiles.select("zoom", "x", "y", F.explode(F.sequence(F.lit(0), F.least(F.col("zoom"), F.lit(zooms)))).alias("up"))
    return df.select((F.col("zoom") - F.col("up")).alias("zoom"), F.call_function("shiftright", F.col("x"), F.col("up")).alias("x"), F.call_function("shiftright", F.col("y"), F.col("up")).alias("y")).distinct()


@F.pandas_udf(T.LongType())
def fnv1_id(type: pd.Series, ns: pd.Series, value: pd.Series, polygon: pd.Series) -> pd.Series:
    """FNV-1 of type, namespace and value, and of the polygon's index where it is not negative."""

    def one(t, n, v, p):
        data = bytes([ids.TYPE_ORDER[t]]) + n.encode() + (int(v) % (1 << 64)).to_bytes(8, "little")
        return ids.signed(ids.fnv1(data + (int(p).to_bytes(8, "little") if p >= 0 else b"")))

    return pd.Series([one(*x) for x in zip(type, ns, value, polygon)], dtype="int64")


@F.pandas_udf(T.LongType())
def fnv1a_text(text: pd.Series) -> pd.Series:
    return pd.Series([ids.signed(ids.fnv1a(t.encode())) for t in text], dtype="int64")


def tile_ids(features: DataFrame) -> DataFrame:
    """One id per feature, or per polygon of an area; keyed by the feature."""
    n = F.when(F.col("type") == "area", F.sequence(F.lit(0), F.greatest(F.size("polygons"), F.lit(1)) - 1)).otherwise(F.array(F.lit(-1)))
    df = features.select("type", "ns", "value", F.explode(n).alias("p"))
    return df.select("type", "ns", "value", fnv1_id("type", "ns", "value", "p").alias("tile_id"))


def tile_ids_hex(features: DataFrame) -> DataFrame:
    return tile_ids(features).withColumn("tile_id", F.lower(F.hex("tile_id")))
