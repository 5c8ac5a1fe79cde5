"""Problem 1: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators import orphans as op
from terrane.plans.lineage import cut
from terrane.sources.tables import table


def deliveries(spark: SparkSession, sf_dir: str, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """``(references, records)`` of the tables, or of the rows of each that ``keep`` keeps."""
    c = F.col
    t = lambda name: keep(table(spark, sf_dir, name))
    points = op.references(t("path_points"), "path_points", c("path_value"), c("point_ord"), op.feature_key(F.lit("point"), F.lit("demo/node"), c("point_value")))
    members = op.references(t("relation_members"), "relation_members", c("relation_value"), c("member_ord"), op.feature_key(c("member_type"), c("member_ns"), c("member_value")))
    # A colon can't occur in a feature type, so routes and features share one key space.
    trips = op.references(t("trips"), "trips", c("trip_id"), F.lit(0), F.when(c("route_id") != "", F.concat(F.lit("route:"), c("route_id"))))
    features = op.records(t("features"), op.feature_key(c("feature_type"), c("feature_ns"), c("feature_value")))
    routes = op.records(t("routes"), F.concat(F.lit("route:"), c("route_id")))
    return points.unionByName(members).unionByName(trips), features.unionByName(routes)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, recs = deliveries(spark, sf_dir)
    # Used for the state and again for the references of suspect keys.
    return op.orphans(*op.advance(cut(refs), recs))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("ref_table", "owner_id", "ref_ord").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.orphan_report(found(spark, sf_dir))


_SQL = """
WITH refs AS (
  SELECT 'path_points' AS ref_table, CAST(path_value AS VARCHAR) AS owner_id, CAST(point_ord AS BIGINT) AS ref_ord,
         'point/demo/node/' || point_value AS key, min(loaded_at) AS since
  FROM path_points WHERE point_value IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'relation_members', CAST(relation_value AS VARCHAR), member_ord, member_type || '/' || member_ns || '/' || member_value, min(loaded_at)
  FROM relation_members WHERE member_type IS NOT NULL AND member_ns IS NOT NULL AND member_value IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'trips', trip_id, 0, 'route:' || route_id, min(loaded_at) FROM trips WHERE route_id <> '' GROUP BY ALL
), recs AS (
  SELECT feature_type || '/' || feature_ns || '/' || feature_value AS key, min(loaded_at) AS seen, count(deleted_at) > 0 AS gone FROM features GROUP BY 1
  UNION ALL
  SELECT 'route:' || route_id, min(loaded_at), count(deleted_at) > 0 FROM routes GROUP BY 1
), found AS (
  SELECT r.*, CASE WHEN e.key IS NULL THEN 'missing' WHEN e.gone THEN 'deleted' WHEN e.seen > r.since THEN 'late' END AS reason
  FROM refs r LEFT JOIN recs e ON r.key = e.key
)
"""
QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": _SQL + "SELECT DISTINCT ref_table, owner_id, ref_ord FROM found WHERE reason IS NOT NULL",
    "p1_report": _SQL + "SELECT ref_table, strftime(since, '%Y-%m') AS month, reason, count(*) AS n_refs FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
