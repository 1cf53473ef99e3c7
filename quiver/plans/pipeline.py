"""Queries of the general data-pipeline operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators import hierarchy as tree
from quiver.operators import incremental, orphans
from quiver.session import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_all(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "nodes"), table(spark, d, "edges"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_all(spark, d).drop("t")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(p1_all(spark, d))


def _pending(spark: SparkSession, d: str, limits: list[int | None]) -> DataFrame:
    """The work list by a job that has run up to each of `limits` before, the last one being open."""
    hashes, runs, log = table(spark, d, "file_hashes"), table(spark, d, "sync_runs"), table(spark, d, "sync_log")
    job = incremental.IncrementalJob(spark, f"{shared_folder(spark)}/p3-{uuid.uuid4().hex}", "place")
    upper = hashes.agg(F.max("indexed_at")).first()[0]
    for limit in limits:
        settled = incremental.settled_state(job, runs, log, limit)
    return incremental.pending_files(hashes, settled, upper)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """A job of its own, so its first run: everything up to the limit is above the watermark."""
    return _pending(spark, d, [None])


def p3_resumed(spark: SparkSession, d: str) -> DataFrame:
    """The same by a job that has committed a third and two thirds of the runs before, and now reads the rest."""
    places = table(spark, d, "sync_runs").select(F.unix_micros("started_at").alias("p")).where("p is not null").approxQuantile("p", [1 / 3, 2 / 3], 0.01)
    return _pending(spark, d, [*(int(p) for p in places), None])


def _links(spark: SparkSession, d: str) -> DataFrame:
    return tree.parent_links(table(spark, d, "edges"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return tree.hierarchy(_links(spark, d))


def p7_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.hierarchy_paths(_links(spark, d))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return tree.descendant_counts(tree.descendants(p7_paths(spark, d)))


def p7_further_parents(spark: SparkSession, d: str) -> DataFrame:
    return tree.further_parents(table(spark, d, "edges"))


_P1 = """
WITH e AS (
  SELECT graph_id, coalesce(source, '') AS source, coalesce(target, '') AS target, rel_type, min(loaded_at) AS t
  FROM edges GROUP BY ALL),
u AS (
  SELECT *, 'source' AS side, source AS key FROM e WHERE source <> ''
  UNION ALL SELECT *, 'target', target FROM e WHERE target <> ''),
j AS (
  SELECT u.graph_id, u.source, u.target, u.rel_type, u.side, u.t,
    count(n.id) AS parents,
    count(*) FILTER (WHERE n.id IS NOT NULL AND n.loaded_at <= u.t) AS before,
    count(*) FILTER (WHERE n.id IS NOT NULL AND n.loaded_at <= u.t AND (n.deleted_at IS NULL OR n.deleted_at > u.t)) AS live
  FROM u LEFT JOIN nodes n ON n.graph_id = u.graph_id AND n.id = u.key GROUP BY ALL),
f AS (
  SELECT graph_id, source, target, rel_type, side,
    CASE WHEN parents = 0 THEN 'missing' WHEN before = 0 THEN 'late' ELSE 'deleted' END AS state, t
  FROM j WHERE live = 0)
"""

_P7 = """
WITH RECURSIVE l AS (
  SELECT graph_id, target AS id, min(source) AS parent FROM edges
  WHERE rel_type IN ('CONTAINS', 'DEFINES') AND source <> '' AND target <> '' GROUP BY ALL),
ids AS (SELECT graph_id, id FROM l UNION SELECT graph_id, parent FROM l),
t AS (
  SELECT graph_id, id AS node_id, id AS root_id, 0 AS depth, [id] AS path FROM ids
  WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.graph_id = ids.graph_id AND l.id = ids.id)
  UNION ALL
  SELECT t.graph_id, l.id, t.root_id, t.depth + 1, list_append(t.path, l.id)
  FROM t JOIN l ON l.graph_id = t.graph_id AND l.parent = t.node_id)
"""

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p3_found": p3_found,
    "p3_resumed": p3_resumed,
    "p7_found": p7_found,
    "p7_paths": p7_paths,
    "p7_descendants": p7_descendants,
    "p7_further_parents": p7_further_parents,
}

SQL: dict[str, str] = {
    "p1_found": _P1 + "SELECT graph_id, source, target, rel_type, side, state FROM f",
    "p1_counts": _P1
    + "SELECT graph_id, rel_type, side, state, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM f GROUP BY ALL",
    "p3_found": """
WITH now AS (
  SELECT graph_id, file_path, arg_max(content_hash, (indexed_at, content_hash)) AS content_hash FROM file_hashes
  WHERE content_hash IS NOT NULL AND content_hash NOT LIKE 'error:%' GROUP BY ALL),
done AS (
  SELECT g.graph_id, g.file_path, g.content_hash AS settled FROM sync_log g JOIN sync_runs r USING (run_id)
  WHERE r.status = 'ok'
  QUALIFY row_number() OVER (PARTITION BY g.graph_id, g.file_path
    ORDER BY r.started_at DESC, r.run_id DESC, g.processed_at DESC, g.content_hash DESC) = 1)
SELECT graph_id, file_path, content_hash FROM now LEFT JOIN done USING (graph_id, file_path)
WHERE settled IS DISTINCT FROM content_hash""",
    "p7_found": _P7 + """
SELECT ids.graph_id, ids.id AS node_id, coalesce(t.root_id, '') AS root_id, coalesce(t.depth, -1)::INTEGER AS depth
FROM ids LEFT JOIN t ON t.graph_id = ids.graph_id AND t.node_id = ids.id""",
    "p7_paths": _P7 + "SELECT graph_id, node_id, root_id, depth::INTEGER AS depth, path FROM t",
    "p7_further_parents": """SELECT DISTINCT graph_id, source AS parent, target AS id FROM edges WHERE rel_type IN ('CONTAINS', 'DEFINES') AND source <> '' AND target <> ''
QUALIFY source <> min(source) OVER (PARTITION BY graph_id, target)""",
    "p7_descendants": _P7 + """,
d AS (
  SELECT graph_id, depth, unnest(path[1:-2]) AS ancestor_id, unnest(range(len(path) - 1)) AS pos FROM t WHERE depth > 0)
SELECT graph_id, ancestor_id, count(*) AS descendants, max(depth - pos)::INTEGER AS height FROM d GROUP BY ALL""",
}
SQL["p3_resumed"] = SQL["p3_found"]
