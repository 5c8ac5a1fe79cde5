"""Timetables to stops and timed connections between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrane import ids
from terrane.functions import geo
from terrane.functions.text import latitude, longitude
from terrane.ids import ID
from terrane.world import World


def read(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """A table of text columns by header, missing ones null."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{name}.txt")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def seconds(t: Column) -> Column:
    """``HH:MM:SS`` as seconds of the day; hours past 24 wrap, anything else is null."""
    p = F.split(F.btrim(t), ":")
    s = F.pmod(p[0].try_cast("int"), F.lit(24)) * 3600 + p[1].try_cast("int") * 60 + p[2].try_cast("int")
    return F.when(F.btrim(t).rlike(r"\A[0-9]{1,2}:[0-9]{2}:[0-9]{2}\z"), s)


def is_peak(t: Column) -> Column:
    """From 8 to 10 and from 16 to 18, ends included."""
    return t.between(8 * 3600, 10 * 3600) | t.between(16 * 3600, 18 * 3600)


def hops(stop_times: DataFrame) -> DataFrame:
    """``(from_stop, to_stop, departs, arrives, seconds, peak)`` of each trip's consecutive stops; a hop over midnight takes a day less."""
    w = Window.partitionBy("trip_id").orderBy(F.col("stop_sequence").try_cast("int"))
    df = stop_times.select(
        F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(w).alias("to_stop"), seconds(F.col("departure_time")).alias("departs"), seconds(F.lead("arrival_time").over(w)).alias("arrives")
    ).where("to_stop IS NOT NULL AND departs IS NOT NULL AND arrives IS NOT NULL")
    d = F.col("arrives") - F.col("departs")
    return df.withColumn("seconds", F.when(d < 0, d + 86400).otherwise(d)).withColumn("peak", is_peak(F.col("departs")) | is_peak(F.col("arrives")))


def connections(hopped: DataFrame) -> DataFrame:
    """Mean seconds of hops between two stops in and off peak, in whole minutes rounded up; null where there are none."""
    mean = lambda c: F.ceil(F.avg(F.when(c, F.col("seconds"))) / 60) * 60
    return hopped.groupBy("from_stop", "to_stop").agg(mean(F.col("peak")).alias("peak"), mean(~F.col("peak")).alias("off_peak"))


def world(stops: DataFrame, stop_times: DataFrame, operator: str = "") -> World:
    """Stops as points and connections as paths between them, tagged with their seconds in and off peak.

    Stops without a readable place, and connections of such stops, are left out; of
    a stop given twice the smallest place counts. Values are hashes of stop ids.
    """
    ns = ids.GTFS + operator
    at = geo.ll(latitude(F.col("stop_lat")), longitude(F.col("stop_lon")))
    one = stops.select("stop_id", at.alias("at")).where("stop_id IS NOT NULL AND at.lat IS NOT NULL AND at.lng IS NOT NULL").groupBy("stop_id").agg(F.min("at").alias("at"))
    one = one.withColumn("value", F.xxhash64("stop_id"))
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
    id = lambda v: F.struct(F.lit("point").alias("type"), F.lit(ns).alias("ns"), F.col(v).alias("value"))

    def rows(df, type, value, tags, points, refs):
        return df.select(
            F.lit(type).alias("type"), F.lit(ns).alias("ns"), value.alias("value"), tags.cast("array<struct<key:string,value:string>>").alias("tags"), points.cast(geo.PATH).alias("points"),
            F.lit(None).cast(geo.AREA).alias("polygons"), refs.cast(f"array<{ID}>").alias("refs"), F.array().cast(f"array<struct<id:{ID},role:string>>").alias("members"),
        )

    points = rows(one, "point", F.col("value"), F.array(tag("#gtfs", F.lit("stop")), tag("gtfs:stop_id", F.col("stop_id"))), F.array("at"), F.array())
    end = lambda x: one.select(F.col("stop_id").alias(f"{x}_stop"), F.col("at").alias(f"{x}_at"), F.col("value").alias(f"{x}_value"))
    met = connections(hops(stop_times)).join(end("from"), "from_stop").join(end("to"), "to_stop")
    timed = F.array_compact(F.array(tag("#gtfs", F.lit("connection")), F.when(F.col("peak").isNotNull(), tag("gtfs:peak", F.col("peak").cast("int"))), F.when(F.col("off_peak").isNotNull(), tag("gtfs:off-peak", F.col("off_peak").cast("int")))))
    paths = rows(met, "path", F.xxhash64("from_stop", "to_stop"), timed, F.array("from_at", "to_at"), F.array(id("from_value"), id("to_value")))
    return World(points.unionByName(paths))
