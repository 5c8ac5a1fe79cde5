"""Other inputs as features: map data, lists of addresses and postcodes, tag tables, spot heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane import ids
from terrane.functions import geo
from terrane.operators.proximity import Grid, cell_of, cover_box
from terrane.world import KEY

#: Keys that get a mark when map data is read.
MARKED = {k: "#" + k for k in ("amenity", "barrier", "boundary", "bridge", "building", "highway", "landuse", "leisure", "natural", "network", "place", "railway", "route", "shop", "tourism", "water", "waterway")} | {k: "@" + k for k in ("fhrs:id", "wikidata", "wikipedia")}


def marked_key(key: Column) -> Column:
    """``key`` with its search mark, if it has one."""
    m = F.create_map(*[F.lit(x) for kv in MARKED.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), key)


def marked_tags(tags: Column) -> Column:
    return F.transform(tags, lambda t: F.struct(marked_key(t["key"]).alias("key"), t["value"].alias("value")))


def way_features(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(type, value, tags, refs)`` of ways ``(id, nodes, tags)``: a path, and an area too where a way is closed. Ways with a node that is not there, or fewer than two, are left out."""
    steps = ways.select("id", F.posexplode("nodes").alias("i", "n")).join(nodes.select(F.col("id").alias("n")).distinct(), "n", "left_anti").select("id").distinct()
    good = ways.where(F.size("nodes") > 1).join(steps, "id", "left_anti")
    closed = (F.size("nodes") > 3) & (F.col("nodes")[0] == F.element_at("nodes", -1))
    kinds = F.when(closed, F.array(F.lit("path"), F.lit("area"))).otherwise(F.array(F.lit("path")))
    return good.select(F.explode(kinds).alias("type"), F.col("id").alias("value"), marked_tags(F.col("tags")).alias("tags"), F.col("nodes").alias("refs"))


def multipolygons(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """``(value, polygons)``: the way ids of multipolygon relations ``(id, tags, members)``; outer or roleless members begin a polygon, others are holes of the last. One way that is not closed leaves the relation out."""
    r = relations.where(F.exists("tags", lambda t: (t["key"] == "type") & (t["value"] == "multipolygon")))
    m = r.select("id", F.posexplode("members").alias("i", "m")).select("id", "i", F.col("m.id").alias("way"), F.col("m.role").alias("role"))
    closed = ways.where((F.size("nodes") > 3) & (F.col("nodes")[0] == F.element_at("nodes", -1))).select(F.col("id").alias("way"), F.lit(True).alias("closed"))
    bad = m.join(closed, "way", "left").where("closed IS NULL").select("id").distinct()
    w = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    part = m.join(bad, "id", "left_anti").withColumn("p", F.sum(F.col("role").isin("outer", "").cast("int")).over(w)).where("p > 0")
    rings = part.groupBy("id", "p").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "way"))), lambda x: x["way"]).alias("ways"))
    return rings.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "ways"))), lambda x: x["ways"]).alias("polygons")).withColumnRenamed("id", "value")


def addresses(rows: DataFrame) -> DataFrame:
    """Points of rows ``(UPRN, LATITUDE, LONGITUDE)`` of text; a byte order mark before the first header is tolerated, unreadable rows are left out."""
    named = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return named.select(F.lit("point").alias("type"), F.lit(ids.GB_UPRN).alias("ns"), F.col("UPRN").try_cast("bigint").alias("value"), geo.ll(F.col("LATITUDE").try_cast("double"), F.col("LONGITUDE").try_cast("double")).alias("at")).where("value IS NOT NULL AND at.lat IS NOT NULL AND at.lng IS NOT NULL")


def clusters(points: DataFrame, degrees: float = 3e-6) -> DataFrame:
    """Addresses that share a cell of about a third of a metre, with their number."""
    cell = lambda c: F.floor(F.col(c) / degrees).cast("bigint")
    return points.groupBy(cell("at.lat").alias("y"), cell("at.lng").alias("x")).agg(F.count("*").alias("n"), F.min("value").alias("value"))


def postcode_number(text: Column) -> Column:
    """A postcode as the number of its id, natively: capitals and digits in base 36 after a leading one; null for anything else."""
    clean = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    digit = lambda c: F.call_function("instr", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    value = F.aggregate(F.split(clean, ""), F.lit(1).cast("bigint"), lambda v, c: F.when(c == "", v).otherwise(v * 36 + digit(c)))
    return F.when(clean.rlike(r"\A[A-Z0-9]{1,11}\z"), value)


def join_tags(features: DataFrame, rows: DataFrame, id: str = "id") -> DataFrame:
    """Features with the columns of ``rows`` as further tags, by id as text; empty cells are skipped, rows of one id append in order of their values."""
    names = [c for c in rows.columns if c != id]
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]), lambda t: t["value"].isNotNull() & (t["value"] != ""))
    more = rows.select(F.col(id).alias("_id"), cells.alias("_t")).groupBy("_id").agg(F.flatten(F.array_sort(F.collect_list("_t"))).alias("_t"))
    named = features.withColumn("_id", ids.id_text(F.struct(*KEY)))
    return named.join(more, "_id", "left").withColumn("tags", F.when(F.col("_t").isNotNull(), F.concat("tags", "_t")).otherwise(F.col("tags"))).drop("_id", "_t")


def elevation(points: DataFrame, heights: DataFrame, radius: float = 25.0) -> DataFrame:
    """``(id, ele)``: the mean of spot heights ``(at, ele)`` within ``radius`` metres of points ``(id, at)``, weighted by one over the distance."""
    grid = Grid(radius)
    a = cell_of(points, grid, "at")
    b = cover_box(heights.select(F.col("at").alias("spot"), "ele"), grid, radius, F.array("spot"))
    d = geo.distance(F.col("at"), F.col("spot"))
    met = a.join(b, ["row", "col"]).withColumn("d", d).where(F.col("d") <= radius).withColumn("w", 1 / F.greatest(F.col("d"), F.lit(1e-6)))
    return met.groupBy("id").agg((F.sum(F.col("w") * F.col("ele")) / F.sum("w")).alias("ele"))
