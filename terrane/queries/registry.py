"""One query for each function of collections, search, tags, arithmetic, ranking and changes, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane import ids, query as Q, world as W
from terrane.functions import geo, numbers as N
from terrane.operators import areas as A, collections as C, histogram as H
from terrane.operators.collections import Collection
from terrane.plans.lineage import fresh
from terrane.sources import derived as D
from terrane.sources.tables import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def q(sql: str | None = None, name: str | None = None):
    def add(f):
        n = name or f.__name__.rstrip("_")
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


# Collections over plain columns


def lines(s, d) -> Collection:
    return Collection.from_columns(table(s, d, "lineitem"), F.col("l_returnflag"), F.col("l_quantity"))


def line_numbers(s, d) -> Collection:
    return Collection.from_columns(table(s, d, "lineitem"), F.col("l_returnflag"), F.col("l_linenumber").cast("bigint"))


def orders(s, d) -> Collection:
    return Collection.from_columns(table(s, d, "orders"), F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderkey"))


def od(s, d) -> Collection:
    return Collection(D.od_items(s, d))





@q("SELECT o_orderkey AS key, o_totalprice * 2 AS value FROM orders", "map")
def map_(s, d):
    return orders(s, d).map(lambda v: v * 2).df.select("key", "value")


@q("SELECT o_orderkey + 1 AS key, o_orderkey AS value FROM orders")
def map_items(s, d):
    return orders(s, d).map_items(lambda p: C.pair(p["first"] + 1, p["first"])).df.select("key", "value")


@q("SELECT o_orderkey AS key, o_totalprice + 1 AS value FROM orders")
def map_parallel(s, d):
    return orders(s, d).map_parallel(lambda v: v + 1).df.select("key", "value")


@q("SELECT c_custkey AS first, c_mktsegment AS second FROM customer")
def pair(s, d):
    return table(s, d, "customer").select(C.pair(F.col("c_custkey"), F.col("c_mktsegment")).alias("p")).select("p.*")


@q("SELECT c_custkey AS value FROM customer")
def first(s, d):
    return table(s, d, "customer").select(C.first(C.pair(F.col("c_custkey"), F.col("c_mktsegment"))).alias("value"))


@q("SELECT c_mktsegment AS value FROM customer")
def second(s, d):
    return table(s, d, "customer").select(C.second(C.pair(F.col("c_custkey"), F.col("c_mktsegment"))).alias("value"))


@q("SELECT p_partkey AS key, p_size * 3 + 1 AS value FROM part")
def call(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("key"), C.call(lambda x, k: x * k + 1, F.col("p_size"), 3).alias("value"))


@q("SELECT * FROM (VALUES ('total', 100), ('children', 50), ('total', 200)) t(key, value)")
def collection(s, d):
    return Collection.of(s, [("total", 100), ("children", 50), ("total", 200)], "key string, value bigint").df.select("key", F.col("value").cast("int").alias("value"))


@q("SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_totalprice > 100000", "filter")
def filter_(s, d):
    return orders(s, d).filter(lambda v: v > 100000).df.select("key", "value")


@q("SELECT l_partkey AS key, l_quantity AS value FROM lineitem")
def flatten(s, d):
    nested = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("value"))).alias("value"))
    return Collection(nested.select(F.col("l_orderkey").alias("ord"), "value")).flatten().df.select("key", "value")


@q("SELECT o_orderkey AS key, o_totalprice AS value FROM orders ORDER BY o_orderkey LIMIT 100")
def take(s, d):
    return orders(s, d).take(100).df.select("key", "value")


@q("SELECT o_orderkey AS key, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top(s, d):
    return orders(s, d).top(100).df.select("key", "value")


@q("SELECT l_linenumber AS key, count(*) AS value FROM lineitem GROUP BY 1")
def count_values(s, d):
    return line_numbers(s, d).count_values().df


@q("SELECT l_returnflag AS key, count(*) AS value FROM lineitem GROUP BY 1")
def count_keys(s, d):
    return lines(s, d).count_keys().df


_OD = "SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _half_invalid(s, d) -> Collection:
    """Destinations with odd keys are made invalid."""
    df = D.od_items(s, d)
    return Collection(df.withColumn("value", F.when(F.col("value.value") % 2 == 0, F.col("value")).otherwise(ids.INVALID.column())))


@q(f"SELECT c AS key, count(*) FILTER (s % 2 = 0) AS value FROM ({_OD}) GROUP BY 1")
def count_valid_keys(s, d):
    return _half_invalid(s, d).count_valid_keys().df.select("key.value", F.col("value").alias("n")).toDF("key", "value")


@q("SELECT l_returnflag AS key, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def sum_by_key(s, d):
    return line_numbers(s, d).sum_by_key().df


@q("SELECT count(*) AS value FROM lineitem")
def count(s, d):
    return lines(s, d).count()


@q(f"SELECT count(*) FILTER (s % 2 = 0) AS value FROM ({_OD})")
def count_valid_ids(s, d):
    return _half_invalid(s, d).count_valid_ids()


@q("SELECT CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem", "sum")
def sum_(s, d):
    return line_numbers(s, d).sum()


_TWO = "SELECT o_orderkey AS key, o_totalprice AS value FROM orders WHERE o_orderkey % 3 = 0"


@q(f"WITH a AS ({_TWO}) SELECT * FROM a UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT key FROM a)")
def join_missing(s, d):
    o = orders(s, d)
    base = Collection(o.df.where("key % 3 = 0"))
    return base.join_missing(o.map(lambda v: -v)).df


@q("SELECT o_orderkey AS key, (rank() OVER (ORDER BY o_totalprice) - 1) / CAST(count(*) OVER () AS DOUBLE) AS value FROM orders")
def percentiles(s, d):
    return orders(s, d).percentiles().df.select("key", "value")


@q("SELECT key, value FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) t(key, value)")
def list_feature(s, d):
    id = ids.FeatureID("collection", "tables/list", 1)
    c = Collection.from_list(s, ["a", "b", "c"], "string")
    return W.World(D.world(s, d, "area").features).with_change(W.add_collection(id, [], c)).list_feature(id).df.select(F.col("key").cast("int").alias("key"), "value")


_CATEGORICAL = """
WITH c AS (SELECT p_brand AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS r, count(*) OVER () AS k FROM part GROUP BY 1)
SELECT CAST(CASE WHEN k > 6 AND r >= 5 THEN 5 ELSE r END AS INTEGER) AS bucket, CASE WHEN k > 6 AND r >= 5 THEN 'other' ELSE v END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL"""
_UNIFORM = """
WITH v AS (SELECT p_size AS v, count(*) AS n, row_number() OVER (ORDER BY p_size) - 1 AS r, count(*) OVER () AS k FROM part GROUP BY 1),
s AS (SELECT k, [0, k // 6, k // 6 + (k - k // 6) // 5] AS a FROM v LIMIT 1), s2 AS (SELECT k, list_append(a, a[3] + (k - a[3]) // 4) AS a FROM s),
s3 AS (SELECT k, list_append(a, a[4] + (k - a[4]) // 3) AS a FROM s2), s4 AS (SELECT k, list_append(a, a[5] + (k - a[5]) // 2) AS a FROM s3),
b AS (SELECT v.*, len(list_filter(a, lambda x: x <= r)) - 1 AS b FROM v, s4),
l AS (SELECT b, min(v) AS low, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY b), h AS (SELECT *, lead(low) OVER (ORDER BY b) AS high FROM l)
SELECT CAST(b AS INTEGER) AS bucket, CASE WHEN high IS NULL THEN low || '-' WHEN high - low <= 1 THEN CAST(low AS VARCHAR) ELSE low || '-' || (high - 1) END AS label, n FROM h"""


def _brands(s, d):
    return Collection.from_columns(table(s, d, "part"), F.col("p_partkey"), F.col("p_brand"))


def _sizes(s, d):
    return Collection.from_columns(table(s, d, "part"), F.col("p_partkey"), F.col("p_size"))


@q(_CATEGORICAL)
def histogram(s, d):
    return H.histogram(_brands(s, d))


def _changed_bars(s, d, c, swatch):
    """Bars counted from the collection that the change adds, with what it says of itself."""
    id = ids.FeatureID("collection", "tables/histogram", 1)
    w = W.World(D.world(s, d, "area").features).with_change(H.histogram_change(c, id, "histogram", swatch))
    bars = w.list_feature(id).df.groupBy(F.col("value").cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    said = w.find_collection(id).select(Q.first_value("#histogram").alias("kind"))
    text = w.find_feature(ids.FeatureID("expression", "tables/histogram", 1)).select(Q.first_value("expression").alias("text"))
    return bars.join(F.broadcast(said), F.lit(True)).join(F.broadcast(text), F.lit(True))


def _bars_sql(sql: str, kind: str) -> str:
    return f"SELECT bucket, n, '{kind}' AS kind, 'histogram' AS text FROM ({sql})"


@q(_bars_sql(_UNIFORM, "bars"))
def histogram_with_id(s, d):
    return _changed_bars(s, d, _sizes(s, d), False)


@q(_CATEGORICAL.replace("p_brand", "p_type"))
def histogram_swatch(s, d):
    return H.histogram(Collection.from_columns(table(s, d, "part"), F.col("p_partkey"), F.col("p_type")))


@q(_bars_sql(_UNIFORM.replace("p_size", "l_linenumber").replace("FROM part", "FROM lineitem"), "swatch"))
def histogram_swatch_with_id(s, d):
    return _changed_bars(s, d, line_numbers(s, d), True)


@q(f"""WITH n AS (SELECT c, count(*) FILTER (s % 2 = 0) AS v FROM ({_OD}) GROUP BY 1),
v AS (SELECT v, count(*) AS n, row_number() OVER (ORDER BY v) - 1 AS r, count(*) OVER () AS k FROM n GROUP BY 1),""" + _UNIFORM.split("GROUP BY 1),", 1)[1])
def histogram_origin_destination(s, d):
    return H.histogram(H.origin_destination(_half_invalid(s, d)))


@q("""WITH b AS (SELECT o_orderpriority AS v, 1 AS a, 0 AS z FROM orders UNION ALL SELECT o_orderpriority, 0, 1 FROM orders WHERE o_orderstatus = 'F')
SELECT v AS label, CAST(sum(a) AS BIGINT) AS n_base, CAST(sum(z) AS BIGINT) AS n_scenario FROM b GROUP BY 1""")
def compare(s, d):
    o = table(s, d, "orders")
    c = lambda df: Collection.from_columns(df, F.col("o_orderkey"), F.col("o_orderpriority"))
    return H.compare(c(o), c(o.where("o_orderstatus = 'F'"))).select("label", "n_base", "n_scenario")


# Search


def _ids(df: DataFrame) -> DataFrame:
    return df.select("type", "ns", "value")


def _sql_ids(type: str, ns: str, value: str, rest: str) -> str:
    return f"SELECT '{type}' AS type, 'tables/{ns}' AS ns, CAST({value} AS BIGINT) AS value FROM {rest}"


_LAT, _LNG = "(515000000 + (c_custkey * 7919) % 200000)", "(-1300000 + (c_custkey * 104729) % 300000)"


@q("SELECT c_mktsegment AS key, count(*) AS value FROM customer GROUP BY 1")
def find_count_values(s, d):
    hits = D.world(s, d, "customer").find(Q.Keyed("#segment"), order=False)
    return Collection(hits.select(F.struct("type", "ns", "value").alias("key"), Q.first_value("#segment").alias("value"))).count_values().df


@q(_sql_ids("point", "customer", "c_custkey", "customer WHERE c_mktsegment = 'BUILDING'"))
def find(s, d):
    return _ids(D.world(s, d).find(Q.Tagged("#segment", "BUILDING")))


@q("SELECT 'name' AS key, n_name AS value FROM nation WHERE n_nationkey = 7")
def find_feature(s, d):
    f = D.world(s, d, "area", "customer").find_feature(ids.FeatureID("area", "tables/nation", 7))
    return f.select(F.lit("name").alias("key"), Q.first_value("name").alias("value"))


@q("SELECT r_regionkey AS value, CAST(count(*) AS INTEGER) AS n_polygons FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey = 1 GROUP BY 1")
def find_area(s, d):
    return D.world(s, d, "area").find_area(ids.FeatureID("area", "tables/region", 1)).select(F.col("value").cast("int").alias("value"), F.size("polygons").alias("n_polygons"))


@q("SELECT CAST(l_linenumber AS INTEGER) AS n, l_partkey AS part, l_returnflag AS role FROM lineitem WHERE l_orderkey = 5")
def find_relation(s, d):
    r = D.world(s, d, "order").find_relation(ids.FeatureID("relation", "tables/order", 5)).select(F.explode("members").alias("m"))
    keyed = table(s, d, "lineitem").where("l_orderkey = 5").select(F.col("l_linenumber").alias("n"), "l_partkey", "l_returnflag")
    return r.select(F.col("m.id.value").alias("part"), F.col("m.role").alias("role")).join(keyed, (F.col("part") == F.col("l_partkey")) & (F.col("role") == F.col("l_returnflag"))).select("n", "part", "role")


@q("SELECT 'collection' AS type, 'tables/list' AS ns, CAST(1 AS BIGINT) AS value")
def find_collection(s, d):
    id = ids.FeatureID("collection", "tables/list", 1)
    w = D.world(s, d, "area").with_change(W.add_collection(id, [("name", "x")], Collection.from_list(s, ["a"], "string")))
    return _ids(w.find_collection(id))


@q(_sql_ids("area", "nation", "n_nationkey", "nation"))
def find_areas(s, d):
    return _ids(D.world(s, d).find_areas(Q.Tagged("#boundary", "nation")))


@q(_sql_ids("relation", "order", "o_orderkey", "orders WHERE o_orderstatus = 'F'"))
def find_relations(s, d):
    return _ids(D.world(s, d).find_relations(Q.Tagged("#status", "F")))


@q(_sql_ids("point", "part", "p_partkey", "part") + " UNION ALL " + _sql_ids("point", "customer", "c_custkey", "customer WHERE c_nationkey = 3"))
def or_(s, d):
    return _ids(D.world(s, d, "customer", "part", "area").find(Q.Keyed("#brand") | Q.Tagged("#nation", "3")))


@q(_sql_ids("point", "customer", "c_custkey", "customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY'"))
def and_(s, d):
    return _ids(D.world(s, d).find(Q.Tagged("#nation", "3") & Q.Tagged("#segment", "MACHINERY")))


@q(_sql_ids("point", "supplier", "s_suppkey", "supplier WHERE s_nationkey = 4") + " UNION ALL " + _sql_ids("point", "customer", "c_custkey", "customer WHERE c_nationkey = 4"))
def tagged(s, d):
    return _ids(D.world(s, d, "customer", "supplier").find(Q.Tagged("#nation", "4")))


@q(_sql_ids("point", "part", "p_partkey", "part"))
def keyed(s, d):
    return _ids(D.world(s, d, "customer", "part").find(Q.Keyed("@type")))


@q("SELECT 'point' AS type, count(*) AS n FROM part")
def typed(s, d):
    return D.world(s, d, "part", "street", "area").find(Q.Typed("point", Q.All()), order=False).groupBy("type").agg(F.count("*").alias("n"))


@q("SELECT type, count(*) AS n FROM (SELECT 'point' AS type FROM part UNION ALL SELECT 'area' FROM nation UNION ALL SELECT 'area' FROM region) GROUP BY 1", "all")
def all_(s, d):
    return D.world(s, d, "part", "area").find(Q.All(), order=False).groupBy("type").agg(F.count("*").alias("n"))


@q("SELECT 0 AS found, count(*) AS matching FROM part")
def is_valid(s, d):
    w = D.world(s, d, "part")
    found = w.find(Q.IsValid(), order=False).count()
    return w.features.agg(F.lit(found).alias("found"), F.count_if(w.matches(Q.IsValid())).alias("matching"))


def _typed_count(kind, parts, sql):
    def f(s, d):
        return D.world(s, d, *parts).find(Q.Typed(kind, Q.All()), order=False).agg(F.count("*").alias("n"))

    q(sql, f"type_{kind}")(f)


_typed_count("point", ("part", "area"), "SELECT count(*) AS n FROM part")
_typed_count("path", ("street", "area"), "SELECT count(DISTINCT p_partkey // 20) + count(DISTINCT p_partkey % 20) AS n FROM part")
_typed_count("area", ("part", "area"), "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n")


@q("SELECT p_partkey AS value, p_brand = 'Brand#12' AS hit FROM part")
def matches(s, d):
    w = D.world(s, d, "part")
    return w.features.select("value", w.matches(Q.Tagged("#brand", "Brand#12")).alias("hit"))


_CAP = "2 * 6371010 * asin(least(1, sqrt(pow(sin(radians({lat} / 1e7 - 51.508) / 2), 2) + cos(radians({lat} / 1e7)) * cos(radians(51.508)) * pow(sin(radians({lng} / 1e7 + 0.118) / 2), 2))))"


@q(_sql_ids("point", "customer", "c_custkey", f"customer WHERE {_CAP.format(lat=_LAT, lng=_LNG)} <= 500"))
def intersecting_cap(s, d):
    return _ids(D.world(s, d, "customer").find(Q.Typed("point", Q.Keyed("#segment")) & Q.IntersectsCap(51.508, -0.118, 500)))


@q(_sql_ids("point", "supplier", "s_suppkey", f"supplier WHERE {_CAP.format(lat='(515000000 + (s_suppkey * 6007) % 200000)', lng='(-1300000 + (s_suppkey * 15013) % 300000)')} <= 700"))
def within_cap(s, d):
    return _ids(D.world(s, d, "supplier").find(Q.Keyed("#supplier") & Q.IntersectsCap(51.508, -0.118, 700)))


#: Edges lie between the whole units of 1e-7 degrees that places have; the bulge of the northern and southern one is 0.4 units.
_BOX = ((51.50000005, -0.13000005), (51.50000005, -0.12400005), (51.50400055, -0.12400005), (51.50400055, -0.13000005))


@q(_sql_ids("point", "customer", "c_custkey", f"customer WHERE {_LAT} BETWEEN 515000001 AND 515040005 AND {_LNG} BETWEEN -1300000 AND -1240001"))
def intersecting(s, d):
    return _ids(D.world(s, d, "customer").find(Q.Keyed("#segment") & Q.intersecting("area", ((_BOX,),)), order=False))


@q("SELECT 'path' AS type, 'tables/' || kind AS ns, CAST(k AS BIGINT) AS value FROM (SELECT 'row' AS kind, p_partkey // 20 AS k FROM part WHERE p_partkey // 20 BETWEEN 1 AND 4 AND p_partkey % 20 <= 3 UNION SELECT 'col', p_partkey % 20 FROM part WHERE p_partkey // 20 BETWEEN 1 AND 4 AND p_partkey % 20 <= 3)")
def within(s, d):
    """Streets with a junction in the box."""
    return _ids(D.world(s, d, "street").find(Q.Keyed("#highway") & Q.intersecting("area", ((_BOX,),)), order=False))


_AREA_CTE = f"""WITH c AS (SELECT {_LAT} AS lat, {_LNG} AS lng FROM customer), n AS (SELECT n_nationkey AS k, n_regionkey AS r, 515000000 + (n_nationkey // 5) * 40000 AS s, -1300000 + (n_nationkey % 5) * 60000 AS w FROM nation)"""


@q(_AREA_CTE + """
SELECT DISTINCT 'area' AS type, CASE g WHEN 0 THEN 'tables/nation' ELSE 'tables/region' END AS ns, CAST(CASE g WHEN 0 THEN k ELSE r END AS BIGINT) AS value
FROM n JOIN c ON lat > s AND lat <= s + 40000 AND lng > w AND lng <= w + 60000, (VALUES (0), (1)) t(g)""")
def containing_areas(s, d):
    areas = D.world(s, d, "area").find_areas(Q.Keyed("#boundary"), order=False)
    return _ids(A.containing(D.customers(s, d), areas).select("type", "ns", "value").distinct())


@q("SELECT 'point' AS type, CAST(p_partkey AS BIGINT) AS value, ['*', 'brand=' || p_brand, 'type'] AS tokens FROM part")
def debug_tokens(s, d):
    return D.parts(s, d).select("type", "value", Q.tokens().alias("tokens"))


@q("SELECT CAST(p_partkey AS BIGINT) AS value FROM part WHERE p_brand = 'Brand#12'")
def debug_all_query(s, d):
    return D.world(s, d, "part", "customer").with_tokens().where("token = 'brand=Brand#12'").select("value")


# Tags


@q("SELECT 'k' AS key, c_name AS value FROM customer")
def tag(s, d):
    return table(s, d, "customer").select(F.struct(F.lit("k").alias("key"), F.col("c_name").alias("value")).alias("t")).select("t.*")


@q("SELECT c_name AS value FROM customer")
def value(s, d):
    return D.customers(s, d).select(F.element_at("tags", -1)["value"].alias("value"))


@q("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS value FROM part")
def int_value(s, d):
    return D.parts(s, d).select(F.col("value").alias("id"), F.element_at("tags", -1)["value"].cast("bigint").alias("value"))


@q("SELECT CAST(c_custkey AS BIGINT) AS id, round(c_acctbal, 2) AS value FROM customer")
def float_value(s, d):
    return D.customers(s, d).select(F.col("value").alias("id"), F.col("tags")[2]["value"].cast("double").alias("value"))


@q("SELECT CAST(c_custkey AS BIGINT) AS id, '' AS key, '' AS value FROM customer")
def get(s, d):
    hit = F.get(F.filter("tags", lambda t: t["key"] == "absent"), F.lit(0))
    none = F.struct(F.lit("").alias("key"), F.lit("").alias("value"))
    return D.customers(s, d).select(F.col("value").alias("id"), F.coalesce(hit, none).alias("t")).select("id", "t.*")


@q("SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS value FROM customer")
def get_string(s, d):
    return D.customers(s, d).select(F.col("value").alias("id"), F.coalesce(Q.first_value("#segment"), F.lit("")).alias("value"))


@q("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS BIGINT) AS value FROM part")
def get_int(s, d):
    v = F.coalesce(Q.first_value("size"), F.raise_error(F.lit("no such tag")).cast("string"))
    return D.parts(s, d).select(F.col("value").alias("id"), v.cast("bigint").alias("value"))


@q("SELECT CAST(c_custkey AS BIGINT) AS id, round(c_acctbal, 2) AS value FROM customer")
def get_float(s, d):
    v = F.coalesce(Q.first_value("acctbal"), F.raise_error(F.lit("no such tag")).cast("string"))
    return D.customers(s, d).select(F.col("value").alias("id"), v.cast("double").alias("value"))


@q("SELECT CAST(s_suppkey AS BIGINT) AS id, 0 AS ord, '#supplier' AS key, 'yes' AS value FROM supplier UNION ALL SELECT s_suppkey, 1, '#nation', CAST(s_nationkey AS VARCHAR) FROM supplier")
def all_tags(s, d):
    return D.suppliers(s, d).select(F.col("value").alias("id"), F.posexplode("tags").alias("ord", "t")).select("id", "ord", "t.*")


@q("SELECT '#segment' AS key, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL")
def count_tag_value(s, d):
    v = Q.first_value("#segment")
    return D.customers(s, d).where(v.isNotNull()).select(F.lit("#segment").alias("key"), v.alias("value")).groupBy("key", "value").agg(F.count("*").alias("n"))


@q("SELECT CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def to_str(s, d):
    return table(s, d, "orders").select(N.to_str(F.col("o_orderkey")).alias("value"))


# Arithmetic


def _scalar(name, table_name, expr, sql):
    def f(s, d):
        return table(s, d, table_name).select(expr().alias("value"))

    q(sql, name)(f)


_scalar("gt", "lineitem", lambda: N.gt(F.col("l_quantity"), F.col("l_linenumber"), N.FLOAT, N.INT), "SELECT l_quantity > l_linenumber AS value FROM lineitem")
_scalar("divide", "lineitem", lambda: N.divide(F.col("l_partkey"), F.col("l_linenumber")), "SELECT l_partkey // l_linenumber AS value FROM lineitem")
_scalar("divide_int", "lineitem", lambda: N.divide_int(F.col("l_linenumber"), F.col("l_quantity")), "SELECT CAST(l_linenumber AS DOUBLE) / l_quantity AS value FROM lineitem")
_scalar("add", "lineitem", lambda: N.add(F.col("l_linenumber"), F.col("l_quantity"), N.INT, N.FLOAT), "SELECT l_linenumber + CAST(l_quantity AS DOUBLE) AS value FROM lineitem")
_scalar("add_ints", "lineitem", lambda: N.add_ints(F.col("l_linenumber"), F.col("l_partkey")), "SELECT l_linenumber + l_partkey AS value FROM lineitem")
_scalar("clamp", "part", lambda: N.clamp(F.col("p_size"), F.lit(10), F.lit(40)), "SELECT CASE WHEN p_size < 10 THEN 10 WHEN p_size > 40 THEN 40 ELSE p_size END AS value FROM part")


# Changes and worlds


def _nation_tags(s, d):
    return D.world(s, d, "area").features.where("ns = 'tables/nation'")


@q("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey = 3 THEN 'changed' ELSE n_name END AS value FROM nation")
def add_tag(s, d):
    w = W.World(_nation_tags(s, d)).with_change(W.add_tag(s, ids.FeatureID("area", "tables/nation", 3), "name", "changed"))
    return w.features.select(F.col("value").alias("id"), Q.first_value("name").alias("value"))


@q("SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_nationkey = 3 THEN 'yes' END AS value, CASE WHEN c_nationkey = 3 THEN 5 ELSE 4 END AS n FROM customer")
def add_tags(s, d):
    w = D.world(s, d, "customer")
    to = w.find(Q.Tagged("#nation", "3"), order=False).select("type", "ns", "value", F.lit("#picked").alias("k"), F.lit("yes").alias("v"))
    return w.with_change(W.add_tags(to)).features.select(F.col("value").alias("id"), Q.first_value("#picked").alias("value"), F.size("tags").alias("n")).select("id", "value", "n")


@q("SELECT CAST(c_custkey AS BIGINT) AS value FROM customer")
def search_modified(s, d):
    """A search after every hit has been tagged in an overlay."""
    w = D.world(s, d, "customer")
    hits = w.find(Q.Keyed("#segment"), order=False).select("type", "ns", "value", F.lit("#picked").alias("k"), F.lit("yes").alias("v"))
    return w.with_change(W.add_tags(hits)).find(Q.Keyed("#segment") & Q.Tagged("#picked", "yes"), order=False).select("value")


@q("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey <> 3 THEN n_name END AS value FROM nation")
def remove_tag(s, d):
    w = W.World(_nation_tags(s, d)).with_change(W.remove_tag(s, ids.FeatureID("area", "tables/nation", 3), "name"))
    return w.features.select(F.col("value").alias("id"), Q.first_value("name").alias("value"))


@q(_sql_ids("point", "customer", "c_custkey", "customer WHERE c_mktsegment <> 'BUILDING'"))
def remove_tags(s, d):
    w = D.world(s, d, "customer")
    out = w.find(Q.Tagged("#segment", "BUILDING"), order=False).select("type", "ns", "value", F.lit("#segment").alias("k"))
    return _ids(w.with_change(W.remove_tags(out)).find(Q.Keyed("#segment"), order=False))


@q("SELECT 'supplier' AS kind, count(*) AS n FROM supplier UNION ALL SELECT 'new', 1")
def add_point(s, d):
    w = D.world(s, d, "supplier").with_change(W.add_point(s, 51.5, -0.1, ids.FeatureID("point", "tables/new", 1), [("#supplier", "no")]))
    return w.find(Q.Keyed("#supplier"), order=False).groupBy(F.element_at(F.split("ns", "/"), 2).alias("kind")).agg(F.count("*").alias("n"))


@q("SELECT 'part' AS role, CAST(7 AS BIGINT) AS member")
def add_relation(s, d):
    id = ids.FeatureID("relation", "tables/new", 1)
    w = D.world(s, d, "area").with_change(W.add_relation(s, id, [("#kind", "x")], [(ids.FeatureID("point", "tables/part", 7), "part")]))
    return w.find_relation(id).select(F.explode("members").alias("m")).select("m.role", F.col("m.id.value").alias("member"))


@q("SELECT c_mktsegment AS key, CAST(count(*) AS VARCHAR) AS value FROM customer GROUP BY 1")
def add_collection(s, d):
    id = ids.FeatureID("collection", "tables/new", 1)
    return D.world(s, d, "area").with_change(W.add_collection(id, [], Collection(find_count_values(s, d)))).list_feature(id).df.select("key", "value")


@q("SELECT 'find [#segment]' AS text")
def add_expression(s, d):
    id = ids.FeatureID("expression", "tables/new", 1)
    return D.world(s, d, "area").with_change(W.add_expression(s, id, [], "find [#segment]")).find_feature(id).select(Q.first_value("expression").alias("text"))


@q("SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_nationkey WHEN 3 THEN 'b' WHEN 4 THEN 'c' ELSE n_name END AS value FROM nation")
def merge_changes(s, d):
    w = W.World(_nation_tags(s, d))
    at = lambda k, v: W.add_tag(s, ids.FeatureID("area", "tables/nation", k), "name", v)
    return w.with_change(W.merge_changes(w, at(3, "a"), at(4, "c"), at(3, "b"))).features.select(F.col("value").alias("id"), Q.first_value("name").alias("value"))


@q("SELECT count(*) + 1 AS changed, count(*) AS base FROM supplier")
def with_change(s, d):
    w = D.world(s, d, "supplier")
    n = w.with_change(W.add_point(s, 51.5, -0.1, ids.FeatureID("point", "tables/new", 1), [("#supplier", "no")]), lambda x: x.find(Q.Keyed("#supplier"), order=False).count())
    return w.find(Q.Keyed("#supplier"), order=False).agg(F.lit(n).cast("bigint").alias("changed"), F.count("*").alias("base"))


@q("SELECT count(*) + 1 AS n FROM supplier")
def add_world_with_change(s, d):
    ws = W.Worlds(D.world(s, d, "supplier"))
    id = ids.FeatureID("collection", ids.WORLDS, 1)
    w = ws.add_world_with_change(id, W.add_point(s, 51.5, -0.1, ids.FeatureID("point", "tables/new", 1), [("#supplier", "no")]))
    return w.find(Q.Keyed("#supplier"), order=False).agg(F.count("*").alias("n"))


@q(_sql_ids("point", "customer", "c_custkey", "customer WHERE c_nationkey = 5"))
def changes_to_file(s, d):
    w = D.world(s, d, "customer")
    change = W.add_tags(w.find(Q.Tagged("#nation", "5"), order=False).select("type", "ns", "value", F.lit("#picked").alias("k"), F.lit("yes").alias("v")))
    path = W.changes_to_file(change, fresh(s))
    return _ids(w.with_change(W.changes_from_file(s, path)).find(Q.Keyed("#picked"), order=False))


@q("SELECT CAST(s_suppkey AS BIGINT) AS value, 'yes' AS moved, 'a' AS item FROM supplier WHERE s_nationkey = 4 UNION ALL SELECT 1, 'new', 'a'")
def changes_from_file(s, d):
    """Features, tags and collections of a change all come back."""
    w = D.world(s, d, "supplier")
    tags = W.add_tags(w.find(Q.Tagged("#nation", "4"), order=False).select("type", "ns", "value", F.lit("#moved").alias("k"), F.lit("yes").alias("v")))
    id = ids.FeatureID("collection", "tables/list", 1)
    both = W.merge_changes(None, tags, W.add_point(s, 51.5, -0.1, ids.FeatureID("point", "tables/new", 1), [("#moved", "new")]), W.add_collection(id, [], Collection.from_list(s, ["a"], "string")))
    back = w.with_change(W.changes_from_file(s, W.changes_to_file(both, fresh(s))))
    items = back.list_feature(id).df.select(F.col("value").alias("item"))
    return back.find(Q.Keyed("#moved"), order=False).select("value", Q.first_value("#moved").alias("moved")).join(F.broadcast(items), F.lit(True))


@q("SELECT c_mktsegment AS key, CAST(count(*) AS VARCHAR) AS value FROM customer GROUP BY 1")
def materialise(s, d):
    id = ids.FeatureID("collection", "tables/m", 1)
    change = W.materialise(id, "find [#segment] | map (get-string '#segment') | count-values", Collection(find_count_values(s, d)))
    return D.world(s, d, "area").with_change(change).list_feature(id).df.select("key", "value")


@q("SELECT CAST(o_orderkey AS BIGINT) AS value, CAST(l_partkey AS VARCHAR) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def materialise_map(s, d):
    f = lambda fs: fs.select("type", "ns", "value", F.posexplode("members").alias("ord", "m")).select("type", "ns", "value", "ord", F.col("m.role").alias("k"), F.col("m.id.value").cast("string").alias("v"))
    return W.materialise_map(D.relations(s, d), ids.FeatureID("collection", "tables/m", 2), f).select("value", "v")


@q("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS back")
def export_world(s, d):
    path = fresh(s)
    n = W.export_world(D.world(s, d, "area"), path)
    return W.read_world(s, path).features.agg(F.lit(n).cast("bigint").alias("n"), F.count("*").alias("back"))


#: The two hashes over a list of bytes ``b``; a feature's bytes are its type's number, its namespace and its value, the lowest byte first.
_SIGNED = "CAST(CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END AS BIGINT)"
_FNV1A = "list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda h, x: xor(h, x) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT)"
_FNV1 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda h, x: xor(h * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT, x))"


def _bytes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: ord(c)::HUGEINT)"


def _le(value: str) -> str:
    return f"list_transform(range(0, 8), lambda i: (({value} >> (8 * i)) & 255)::HUGEINT)"


@q(f"WITH t AS (SELECT {_bytes("'/point/tables/customer/' || c_custkey")} AS b FROM customer), x AS (SELECT {_FNV1A} AS h FROM t) SELECT 'relation' AS type, 'tables/made' AS ns, {_SIGNED} AS value FROM x")
def id_to_relation_id(s, d):
    from terrane.functions.tiles import fnv1a_text

    return D.customers(s, d).select(F.lit("relation").alias("type"), F.lit("tables/made").alias("ns"), fnv1a_text(ids.id_text(F.struct("type", "ns", "value"))).alias("value"))


# References


@q("SELECT CAST(p_partkey AS BIGINT) AS point, 'row' AS kind, CAST(p_partkey // 20 AS BIGINT) AS path FROM part UNION ALL SELECT p_partkey, 'col', p_partkey % 20 FROM part")
def point_paths(s, d):
    w = D.world(s, d, "part", "street")
    return w.point_paths(w.features.where("type = 'point'")).select(F.col("target.value").alias("point"), F.element_at(F.split("ns", "/"), 2).alias("kind"), F.col("value").alias("path"))


@q("SELECT CAST(p_partkey AS BIGINT) AS point, 'row' AS kind, CAST(p_partkey // 20 AS BIGINT) AS feature FROM part UNION ALL SELECT p_partkey, 'col', p_partkey % 20 FROM part UNION ALL SELECT p_partkey, 'part', p_partkey FROM part")
def point_features(s, d):
    w = D.world(s, d, "part", "street")
    return w.point_features(w.features).select(F.col("target.value").alias("point"), F.element_at(F.split("ns", "/"), 2).alias("kind"), F.col("value").alias("feature"))


@q("SELECT CAST(l_partkey AS BIGINT) AS part, CAST(l_orderkey AS BIGINT) AS relation FROM lineitem GROUP BY ALL")
def find_references(s, d):
    w = D.world(s, d, "order")
    return w.find_references(D.parts(s, d), ["relation"]).select(F.col("target.value").alias("part"), F.col("value").alias("relation"))
