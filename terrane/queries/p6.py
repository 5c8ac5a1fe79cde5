"""Problem 6: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import latitude, longitude
from terrane.plans.spread import spread
from terrane.sources import delimited as op
from terrane.sources.tables import table


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.read_lines(spread(table(spark, sf_dir, "raw_lines"), "raw_id"), op.FEEDS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.failures(_read(spark, sf_dir)).select("raw_id")


def p6_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.failures(_read(spark, sf_dir)).select("raw_id", "feed", "file_name", "line_no", "line", "reason")


def p6_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.good_rows(_read(spark, sf_dir), "stops", op.STOPS, ["raw_id"], {"stop_lat": latitude, "stop_lon": longitude})


def p6_postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = {c: (lambda x: x.try_cast("int")) for c in ("quality", "eastings", "northings")}
    return op.good_rows(_read(spark, sf_dir), "codepoint", op.CODEPOINT, ["raw_id"], number)


# RE2 has no backtracking: one pattern per shape, with all cells captured by position in the checks.
_CELL = '(?:"(?:[^"]|"")*"|[^",]*)'
_SQL = f"""
WITH t AS (SELECT raw_id, feed, regexp_replace(line, '[\\r\\n]+\\z', '') AS l FROM raw_lines),
s AS (
  SELECT raw_id, feed, l,
    regexp_full_match(l, '(?s){_CELL}(,{_CELL})*') AS quoted,
    len(regexp_extract_all(',' || l, '(?s),{_CELL}')) AS n,
    [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN regexp_extract_all(',' || l, '(?s),({_CELL})', 1)] AS c
  FROM t
), f AS (
  SELECT raw_id, CASE
    WHEN l IS NULL THEN 'null' WHEN NOT quoted THEN 'quoting' WHEN feed IS NULL OR feed NOT IN ('stops', 'codepoint') THEN 'feed'
    WHEN n <> CASE feed WHEN 'stops' THEN 14 ELSE 6 END THEN 'columns'
    WHEN feed = 'stops' AND NOT (trim(c[5]) = '' AND trim(c[9]) IN ('3', '4')) AND NOT coalesce(regexp_full_match(trim(c[5]), '[+-]?[0-9]+(\\.[0-9]+)?') AND abs(try_cast(trim(c[5]) AS DOUBLE)) <= 90, false) THEN 'stop_lat'
    WHEN feed = 'stops' AND NOT (trim(c[6]) = '' AND trim(c[9]) IN ('3', '4')) AND NOT coalesce(regexp_full_match(trim(c[6]), '[+-]?[0-9]+(\\.[0-9]+)?') AND abs(try_cast(trim(c[6]) AS DOUBLE)) <= 180, false) THEN 'stop_lon'
    WHEN feed = 'codepoint' AND NOT regexp_full_match(replace(c[1], ' ', ''), '[A-Za-z0-9]{{5,7}}') THEN 'postcode' END AS reason, c
  FROM s
)
"""
QUERIES = {"p6_found": p6_found, "p6_failures": p6_failures, "p6_stops": p6_stops, "p6_postcodes": p6_postcodes}
SQL = {
    "p6_found": _SQL + "SELECT raw_id FROM f WHERE reason IS NOT NULL",
    "p6_failures": _SQL + "SELECT f.raw_id, feed, file_name, line_no, line, reason FROM f JOIN raw_lines USING (raw_id) WHERE reason IS NOT NULL",
    "p6_stops": _SQL
    + "SELECT f.raw_id, "
    + ", ".join((f"try_cast(nullif(trim(c[{i}]), '') AS DOUBLE)" if c in ("stop_lat", "stop_lon") else f"c[{i}]") + f" AS {c}" for i, c in enumerate(op.STOPS.columns, 1))
    + " FROM f JOIN raw_lines USING (raw_id) WHERE reason IS NULL AND feed = 'stops'",
    "p6_postcodes": _SQL
    + "SELECT f.raw_id, "
    + ", ".join((f"try_cast(c[{i}] AS INTEGER)" if 2 <= i <= 4 else f"c[{i}]") + f" AS {c}" for i, c in enumerate(op.CODEPOINT.columns, 1))
    + " FROM f JOIN raw_lines USING (raw_id) WHERE reason IS NULL AND feed = 'codepoint'",
}
