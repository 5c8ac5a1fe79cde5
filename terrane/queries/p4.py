"""Problem 4: points near other points or regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import latitude, longitude
from terrane.operators import proximity as op
from terrane.sources.tables import table

RADIUS = 25.0


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every location once, in 1e-7 degrees and in degrees."""
    points = table(spark, sf_dir, "features").where("feature_type = 'point'").select(F.concat(F.lit("p/"), F.col("feature_value").cast("string")).alias("loc"), (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lng_e7") / 1e7).alias("lng"))
    stops = table(spark, sf_dir, "stops").select(F.concat(F.lit("s/"), "stop_id").alias("loc"), latitude(F.col("stop_lat")).alias("lat"), longitude(F.col("stop_lon")).alias("lng"))
    return points.unionByName(stops).where("loc IS NOT NULL AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0)")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.near(_locations(spark, sf_dir), RADIUS)


def p4_districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _locations(spark, sf_dir).groupBy("loc").agg(F.min(F.struct("lat", "lng")).alias("at"))
    points = one.select("loc", F.round(F.col("at.lat") * 1e7).cast("int").alias("lat_e7"), F.round(F.col("at.lng") * 1e7).cast("int").alias("lng_e7"))
    regions = table(spark, sf_dir, "districts").select(F.col("district_id").alias("region"), "ring")
    inside = op.within(points, regions, ["loc"])
    return points.join(inside, "loc", "left").select("loc", F.col("region").alias("district_id"))


_LOC = """
WITH raw AS (
  SELECT 'p/' || feature_value AS loc, lat_e7 / 1e7 AS lat, lng_e7 / 1e7 AS lng FROM features WHERE feature_type = 'point'
  UNION ALL
  SELECT 's/' || stop_id, CASE WHEN regexp_full_match(trim(stop_lat), '[+-]?[0-9]+(\\.[0-9]+)?') THEN try_cast(trim(stop_lat) AS DOUBLE) END,
    CASE WHEN regexp_full_match(trim(stop_lon), '[+-]?[0-9]+(\\.[0-9]+)?') THEN try_cast(trim(stop_lon) AS DOUBLE) END FROM stops
), l AS (
  SELECT loc, min((lat, lng))[1] AS lat, min((lat, lng))[2] AS lng FROM raw
  WHERE loc IS NOT NULL AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND NOT (lat = 0 AND lng = 0) GROUP BY loc
)"""
QUERIES = {"p4_found": p4_found, "p4_districts": p4_districts}
SQL = {
    "p4_found": _LOC
    + """, b AS (SELECT *, CAST(floor(lat * 4000) AS BIGINT) AS r FROM l), p AS (SELECT loc, lat, lng, r + d AS r FROM b, (VALUES (-1), (0), (1)) t(d))
SELECT b.loc AS loc_a, p.loc AS loc_b FROM b JOIN p ON b.r = p.r AND b.loc < p.loc
WHERE 2 * 6371010 * asin(least(1, sqrt(pow(sin(radians(p.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lng - b.lng) / 2), 2)))) < 25""",
    "p4_districts": _LOC
    + """, i AS (SELECT loc, CAST(round(lat * 1e7) AS BIGINT) AS y, CAST(round(lng * 1e7) AS BIGINT) AS x FROM l),
s AS (SELECT district_id, CAST(ring[i].lng_e7 AS BIGINT) AS ax, CAST(ring[i].lat_e7 AS BIGINT) AS ay, CAST(ring[i % len(ring) + 1].lng_e7 AS BIGINT) AS bx, CAST(ring[i % len(ring) + 1].lat_e7 AS BIGINT) AS byy FROM districts, range(1, len(ring) + 1) t(i)),
h AS (SELECT loc, district_id FROM i JOIN s ON (ay > y) <> (byy > y) AND CASE WHEN byy > ay THEN CAST(x - ax AS HUGEINT) * (byy - ay) < CAST(y - ay AS HUGEINT) * (bx - ax) ELSE CAST(x - ax AS HUGEINT) * (byy - ay) > CAST(y - ay AS HUGEINT) * (bx - ax) END GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT i.loc, h.district_id FROM i LEFT JOIN h USING (loc)""",
}
