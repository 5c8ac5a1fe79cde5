"""What map tiles are drawn from, as rows: rule layers, query layers, histogram and collection layers, drawing order and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane import ids
from terrane.query import first_value
from terrane.world import KEY

#: A tile's query layer shows no more features than this: a limit of the feature itself.
MOST_FEATURES = 10_000


def basemap(features: DataFrame, rules: Sequence[tuple[str, str | None, int, int, str]], zoom: int) -> DataFrame:
    """Features with the ``layer`` of the first rule ``(key, value or None, min zoom, max zoom, layer)`` that takes them at a zoom."""
    spark = features.sparkSession
    r = F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(rules)], "rule int, k string, v string, low int, high int, layer string").where((F.col("low") <= zoom) & (F.col("high") >= zoom)))
    tags = features.select(*KEY, F.explode("tags").alias("t"))
    met = tags.join(r, (F.col("t.key") == F.col("k")) & (F.col("v").isNull() | (F.col("t.value") == F.col("v"))))
    first = met.groupBy(*KEY).agg(F.min(F.struct("rule", "layer")).alias("m")).select(*KEY, F.col("m.layer").alias("layer"))
    return features.join(first, KEY)


def drawing_order() -> list[Column]:
    """By the ``layer`` tag as a number, 0 where it is none, then by id."""
    return [F.coalesce(first_value("layer").try_cast("int"), F.lit(0)), *ids.id_sort()]


def query_layer(hits: DataFrame, value: Column | None = None) -> DataFrame:
    """The first features of a tile in order of id, with a value for each."""
    df = hits.orderBy(*ids.id_sort()).limit(MOST_FEATURES)
    return df.withColumn("v", value) if value is not None else df


def histogram_layer(features: DataFrame, assigned: DataFrame) -> DataFrame:
    """Features with the bucket that ``assigned`` (``key`` an id, ``bucket``) puts them in."""
    return features.join(assigned.select(F.col("key.type").alias("type"), F.col("key.ns").alias("ns"), F.col("key.value").alias("value"), "bucket"), KEY)


def collection_layer(features: DataFrame, items: DataFrame) -> DataFrame:
    """Features that are keys or values of a collection of ids, each once."""
    used = items.select("key").unionByName(items.select(F.col("value").alias("key"))).where("key IS NOT NULL").distinct().select("key.*")
    return features.join(used, KEY, "left_semi")


def gradient(x: Column, stops: Sequence[tuple[float, tuple[int, int, int]]]) -> Column:
    """``#rrggbb`` of a value between colour stops; the ends hold beyond them."""
    hexed = lambda cs: F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.round(c).cast("int")), 2, "0")) for c in cs])
    fixed = lambda c: F.lit("#%02x%02x%02x" % c)
    out = F.when(x <= stops[0][0], fixed(stops[0][1]))
    for (a, ca), (b, cb) in zip(stops, stops[1:]):
        t = (x - a) / (b - a)
        out = out.when(x < b, hexed([u + t * (v - u) for u, v in zip(ca, cb)]))
    return out.otherwise(fixed(stops[-1][1]))
