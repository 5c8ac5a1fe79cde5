"""Problem 3: parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.text import bare
from terrane.operators import hierarchy as op
from terrane.sources.tables import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both hierarchies in one graph: ids are prefixed with the hierarchy."""
    c = F.col
    members = table(spark, sf_dir, "relation_members").where((c("member_type") == "relation") & (F.lower(bare(c("member_role"))) == "subarea"))
    stops = table(spark, sf_dir, "stops").where(c("parent_station") != "")
    named = lambda h, x: F.concat(F.lit(h + "/"), c(x).cast("string"))
    return op.links(members, named("relation", "member_value"), named("relation", "relation_value")).unionByName(op.links(stops, named("stop", "stop_id"), named("stop", "parent_station")))


def _split(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.substring_index("node", "/", 1).alias("hierarchy"), *[(F.expr(f"substring({x}, instr({x}, '/') + 1)")).alias({"node": "node_id"}.get(x, x)) for x in ("node", *columns)], *[x for x in df.columns if x not in ("node", "path", *columns)])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(op.cyclic_nodes(_links(spark, sf_dir)))


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = op.paths(_links(spark, sf_dir))
    ids = F.transform("path", lambda x: F.regexp_replace(x, r"\A[^/]*/", ""))
    return _split(solved.withColumn("full_path", F.array_join(ids, " > ")), "parent", "root")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(op.below(_links(spark, sf_dir)), "descendant")


_EDGES = """
e AS (
  SELECT DISTINCT 'relation' AS hierarchy, CAST(member_value AS VARCHAR) AS child, CAST(relation_value AS VARCHAR) AS parent
  FROM relation_members WHERE member_type = 'relation' AND lower(trim(member_role)) = 'subarea'
  UNION ALL
  SELECT DISTINCT 'stop', stop_id, parent_station FROM stops WHERE stop_id IS NOT NULL AND parent_station <> ''
)"""


def _paths_sql(rounds: int = 4) -> str:
    """First parents; then, as often as needed, the first parent with a path for those without one that have such a parent."""
    out = f"""
WITH RECURSIVE {_EDGES},
u0 AS (SELECT hierarchy, child, min(parent) AS parent FROM e GROUP BY ALL),
roots AS (SELECT DISTINCT hierarchy, parent AS node_id FROM e ANTI JOIN u0 ON u0.hierarchy = e.hierarchy AND u0.child = e.parent)"""
    for k in range(rounds):
        out += f""",
w{k} AS (SELECT hierarchy, node_id, node_id AS root, 0 AS depth, [node_id] AS p FROM roots
  UNION ALL SELECT u.hierarchy, u.child, w.root, w.depth + 1, list_append(w.p, u.child) FROM w{k} w JOIN u{k} u ON u.hierarchy = w.hierarchy AND u.parent = w.node_id),
o{k} AS (SELECT e.hierarchy, e.child, min(e.parent) AS parent FROM e JOIN w{k} w ON w.hierarchy = e.hierarchy AND w.node_id = e.parent
  ANTI JOIN w{k} x ON x.hierarchy = e.hierarchy AND x.node_id = e.child GROUP BY ALL),
u{k + 1} AS (SELECT u.hierarchy, u.child, coalesce(o.parent, u.parent) AS parent FROM u{k} u LEFT JOIN o{k} o USING (hierarchy, child))"""
    return out + f"""
SELECT n.hierarchy, n.node_id, n.parent, w.root, w.depth, array_to_string(w.p, ' > ') AS full_path
FROM (SELECT hierarchy, child AS node_id, parent FROM u{rounds} UNION ALL SELECT hierarchy, node_id, CAST(NULL AS VARCHAR) FROM roots) n LEFT JOIN w{rounds - 1} w USING (hierarchy, node_id)"""


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants}
SQL = {
    "p3_found": f"""
WITH RECURSIVE {_EDGES},
r AS (SELECT hierarchy, child AS a, parent AS b FROM e UNION SELECT r.hierarchy, r.a, e.parent FROM r JOIN e ON r.hierarchy = e.hierarchy AND r.b = e.child)
SELECT DISTINCT hierarchy, a AS node_id FROM r WHERE a = b""",
    "p3_paths": _paths_sql(),
    "p3_descendants": f"""
WITH RECURSIVE {_EDGES},
r AS (SELECT hierarchy, parent AS node_id, child AS descendant, 1 AS distance, [child] AS seen FROM e
  UNION ALL SELECT r.hierarchy, r.node_id, e.child, r.distance + 1, list_append(r.seen, e.child) FROM r JOIN e ON e.hierarchy = r.hierarchy AND e.parent = r.descendant WHERE NOT list_contains(r.seen, e.child))
SELECT hierarchy, node_id, descendant, min(distance) AS distance FROM r GROUP BY ALL""",
}
