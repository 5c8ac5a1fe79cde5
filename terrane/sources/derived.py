"""The driver's tables as a world of features, so that every operator has an independent check.

Coordinates are whole numbers of 1e-7 degrees made from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.ids import ID
from terrane.sources.tables import table
from terrane.world import World

LAT0, LNG0 = 515000000, -1300000
STREET = 20


def _row(df: DataFrame, type: str, ns: str, value: Column, tags: Column | None = None, points: Column | None = None, polygons: Column | None = None, refs: Column | None = None, members: Column | None = None) -> DataFrame:
    empty = F.array()
    return df.select(
        F.lit(type).alias("type"), F.lit(f"tables/{ns}").alias("ns"), value.cast("bigint").alias("value"),
        (tags if tags is not None else empty).cast("array<struct<key:string,value:string>>").alias("tags"),
        (points if points is not None else F.lit(None)).cast(geo.PATH).alias("points"),
        (polygons if polygons is not None else F.lit(None)).cast(geo.AREA).alias("polygons"),
        (refs if refs is not None else empty).cast(f"array<{ID}>").alias("refs"),
        (members if members is not None else empty).cast(f"array<struct<id:{ID},role:string>>").alias("members"),
    )


def tags(**pairs: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])


def id_of(type: str, ns: str, value: Column) -> Column:
    return F.struct(F.lit(type).alias("type"), F.lit(f"tables/{ns}").alias("ns"), value.cast("bigint").alias("value"))


def _ll(lat: Column, lng: Column) -> Column:
    return geo.ll(lat / 1e7, lng / 1e7)


def customers(spark, d):
    c = F.col("c_custkey")
    at = _ll(LAT0 + (c * 7919) % 200000, LNG0 + (c * 104729) % 300000)
    return _row(table(spark, d, "customer"), "point", "customer", c, tags(**{"#segment": F.col("c_mktsegment"), "#nation": F.col("c_nationkey"), "acctbal": F.round("c_acctbal", 2), "name": F.col("c_name")}), F.array(at))


def suppliers(spark, d):
    c = F.col("s_suppkey")
    at = _ll(LAT0 + (c * 6007) % 200000, LNG0 + (c * 15013) % 300000)
    return _row(table(spark, d, "supplier"), "point", "supplier", c, tags(**{"#supplier": F.lit("yes"), "#nation": F.col("s_nationkey")}), F.array(at))


def _part_at(p: Column) -> Column:
    return _ll(LAT0 + F.floor(p / STREET) * 10000, LNG0 + (p % STREET) * 15000)


def parts(spark, d):
    p = F.col("p_partkey")
    return _row(table(spark, d, "part"), "point", "part", p, tags(**{"#brand": F.col("p_brand"), "@type": F.col("p_type"), "size": F.col("p_size")}), F.array(_part_at(p)))


def streets(spark, d):
    p = F.col("p_partkey")
    df = table(spark, d, "part").select(p.alias("p"), F.floor(p / STREET).cast("bigint").alias("row"), (p % STREET).alias("col"))
    out = None
    for ns, kind in (("row", "residential"), ("col", "primary")):
        got = df.groupBy(ns).agg(F.array_sort(F.collect_list("p")).alias("ps"))
        got = _row(got, "path", ns, F.col(ns), tags(**{"#highway": F.lit(kind)}), F.transform("ps", _part_at), None, F.transform("ps", lambda x: id_of("point", "part", x)))
        out = got if out is None else out.unionByName(got)
    return out


def _rect(k: Column) -> Column:
    i, j = F.floor(k / 5), k % 5
    s, w = LAT0 + i * 40000, LNG0 + j * 60000
    return F.array(F.array(_ll(s, w), _ll(s, w + 60000), _ll(s + 40000, w + 60000), _ll(s + 40000, w)))


def areas(spark, d):
    n = table(spark, d, "nation")
    nations = _row(n, "area", "nation", F.col("n_nationkey"), tags(**{"#boundary": F.lit("nation"), "name": F.col("n_name")}), None, F.array(_rect(F.col("n_nationkey"))))
    grouped = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ks"))
    return nations.unionByName(_row(grouped, "area", "region", F.col("n_regionkey"), tags(**{"#boundary": F.lit("region")}), None, F.transform("ks", _rect)))


def buildings(spark, d):
    """Areas between four junctions, and their boundaries; every seventh block."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("k"))
    last = p.agg(F.max("k").alias("last"))
    block = p.where("k % 7 = 0 AND k % 20 < 19").join(F.broadcast(last), F.lit(True)).where("k + 21 <= last")
    ring = F.array(F.col("k"), F.col("k") + 1, F.col("k") + 21, F.col("k") + 20, F.col("k"))
    edge = _row(block, "path", "block", F.col("k"), None, F.transform(ring, _part_at), None, F.transform(ring, lambda x: id_of("point", "part", x)))
    inside = _row(block, "area", "block", F.col("k"), tags(**{"#building": F.lit("yes")}), None, F.array(F.array(F.transform(F.slice(ring, 1, 4), _part_at))), F.array(id_of("path", "block", F.col("k"))))
    return edge.unionByName(inside)


def relations(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("ls"))
    df = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    members = F.coalesce(F.transform("ls", lambda x: F.struct(id_of("point", "part", x["l_partkey"]).alias("id"), x["l_returnflag"].alias("role"))), F.array().cast(f"array<struct<id:{ID},role:string>>"))
    return _row(df, "relation", "order", F.col("o_orderkey"), tags(**{"#status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}), members=members)


def od_items(spark, d):
    """Distinct (customer id, supplier id) through orders and their lines."""
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return df.select(id_of("point", "customer", F.col("o_custkey")).alias("key"), id_of("point", "supplier", F.col("l_suppkey")).alias("value")).distinct()


PARTS = {"customer": customers, "supplier": suppliers, "part": parts, "street": streets, "area": areas, "order": relations}


def world(spark: SparkSession, d: str, *which: str) -> World:
    """The derived world, or only some of its kinds."""
    out = None
    for k in which or PARTS:
        df = PARTS[k](spark, d)
        out = df if out is None else out.unionByName(df)
    return World(out)
