"""Problem 7: attribute-value rows into wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import wide as op
from terrane.sources.tables import table

ENTITY = ("feature_type", "feature_value")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = op.column_types(table(spark, sf_dir, "tag_types"))
    maps = op.attribute_maps(table(spark, sf_dir, "feature_tags"), ENTITY, "tag_key", "tag_value", "tag_ord", list(types))
    return op.widen(maps, ENTITY, types)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cast_failures(_wide(spark, sf_dir), ENTITY).select(*ENTITY, "tag_key")


def p7_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    return wide.select(*[F.col(f"`{c}`").alias(c.replace(":", "_")) for c in wide.columns if c != "failed"], F.map_keys("failed").alias("failed")).withColumn("failed", F.array_join(F.array_sort("failed"), ","))


_KINDS = {"int": "INTEGER", "double": "DOUBLE", "bool": "BOOLEAN", "date": "DATE", "string": "VARCHAR"}
_GOOD = """CASE value_type
  WHEN 'int' THEN regexp_full_match(v, '[+-]?[0-9]{1,9}')
  WHEN 'double' THEN regexp_full_match(v, '[+-]?[0-9]+(\\.[0-9]+)?')
  WHEN 'bool' THEN lower(v) IN ('yes', 'no', 'true', 'false', '1', '0')
  WHEN 'date' THEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(v AS DATE) IS NOT NULL
  ELSE true END"""
_SQL = f"""
WITH f AS (
  SELECT feature_type, feature_value, tag_key, value_type, min_by(tag_value, (tag_ord, tag_value)) AS raw
  FROM feature_tags JOIN tag_types USING (tag_key) WHERE tag_value IS NOT NULL GROUP BY ALL
), g AS (SELECT *, trim(raw) AS v, {_GOOD} AS good FROM f)
"""
#: The keys and types of the test table, for the SQL side only.
_TYPES = {"building:levels": "int", "maxspeed": "int", "capacity": "int", "height": "double", "width": "double", "ele": "double", "oneway": "bool", "lit": "bool", "covered": "bool", "start_date": "date", "check_date": "date", "name": "string", "surface": "string", "operator": "string"}


def _project(k: str, t: str) -> str:
    v = "lower(v) IN ('yes', 'true', '1')" if t == "bool" else "raw" if t == "string" else f"try_cast(v AS {_KINDS[t]})"
    return f"any_value({v}) FILTER (good AND tag_key = '{k}') AS \"{k.replace(':', '_')}\""


QUERIES = {"p7_found": p7_found, "p7_wide": p7_wide}
SQL = {
    "p7_found": _SQL + "SELECT feature_type, feature_value, tag_key FROM g WHERE NOT good",
    "p7_wide": _SQL
    + f"SELECT feature_type, feature_value, {', '.join(_project(k, t) for k, t in _TYPES.items())}, coalesce(string_agg(tag_key, ',' ORDER BY tag_key) FILTER (NOT good), '') AS failed FROM (SELECT DISTINCT feature_type, feature_value FROM feature_tags) LEFT JOIN g USING (feature_type, feature_value) GROUP BY ALL",
}
