"""Views of the input tables that the queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiver.operators.dependencies import FileDependencies
from quiver.operators.graph import current_edges, current_nodes
from quiver.session import table


def nodes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_nodes(table(spark, d, "nodes"), *columns)


def edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_edges(table(spark, d, "edges"), *columns)


def files(spark: SparkSession, d: str, keep: bool = False) -> FileDependencies:
    return FileDependencies(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "projects"), keep)


#: Current nodes `n` and edges `e`.
GRAPH = """
n AS (
  SELECT * REPLACE (nullif(file_path, '') AS file_path) FROM (
    SELECT * FROM nodes WHERE graph_id IS NOT NULL AND id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY graph_id, id ORDER BY loaded_at DESC NULLS LAST) = 1) WHERE deleted_at IS NULL),
e AS (
  SELECT * FROM edges WHERE source <> '' AND target <> ''
  QUALIFY row_number() OVER (PARTITION BY graph_id, source, target, rel_type ORDER BY loaded_at NULLS FIRST) = 1)"""

#: File dependencies `deps` (graph_id, sf, tf), their counted `pairs`, and indexed files `f`.
FILES = GRAPH + """,
nf AS (
  SELECT n.* REPLACE (CASE WHEN starts_with(file_path, rtrim(repo_path, '/') || '/') THEN substr(file_path, length(rtrim(repo_path, '/')) + 2)
    WHEN starts_with(file_path, '/') THEN '(external)' || file_path ELSE file_path END AS file_path)
  FROM n LEFT JOIN projects p USING (graph_id)),
f AS (SELECT DISTINCT graph_id, file_path FROM nf WHERE list_contains(labels, 'CodeFile') AND file_path IS NOT NULL),
precise AS (
  SELECT e.graph_id, s.file_path AS sf, t.file_path AS tf FROM e
  JOIN nf s ON s.graph_id = e.graph_id AND s.id = e.source JOIN nf t ON t.graph_id = e.graph_id AND t.id = e.target
  WHERE (rel_type = 'REFERENCES' OR (rel_type = 'CALLS' AND resolved_by = 'scip-python')) AND s.file_path <> t.file_path),
covered AS (SELECT DISTINCT graph_id, sf AS file_path FROM precise),
imported AS (
  SELECT e.graph_id, s.file_path AS sf, t.resolved_source AS tf FROM e
  JOIN nf s ON s.graph_id = e.graph_id AND s.id = e.source JOIN nf t ON t.graph_id = e.graph_id AND t.id = e.target
  JOIN f ON f.graph_id = e.graph_id AND f.file_path = t.resolved_source
  WHERE rel_type IN ('IMPORTS', 'IMPORTS_SYMBOL') AND s.file_path <> t.resolved_source),
deps AS (
  SELECT * FROM precise UNION ALL
  SELECT i.* FROM imported i WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.graph_id = i.graph_id AND c.file_path = i.sf)),
pairs AS (SELECT graph_id, sf, tf, count(*) AS n FROM deps GROUP BY ALL)"""


def folder(p: str) -> str:
    return f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def organ(p: str) -> str:
    return f"split_part({folder(p)}, '/', 1)"


def peripheral(p: str) -> str:
    return (
        f"(split_part({p}, '/', 1) IN ('tests','test','__tests__','spec','specs','e2e','scripts','script')"
        f" OR regexp_matches(split_part({p}, '/', -1), '[._](test|spec)\\.[jt]sx?$')"
        f" OR list_has_any(string_split({p}, '/'), ['__tests__','__mocks__','tests','test','spec','e2e']))"
    )


def entry(p: str) -> str:
    name = f"split_part({p}, '/', -1)"
    stem = f"CASE WHEN contains({name}, '.') THEN regexp_extract({name}, '^(.*)\\.[^.]*$', 1) ELSE {name} END"
    return f"({stem} IN ('__main__','__init__','cli','conftest','main','setup') OR regexp_matches({name}, '^(App|index|main)\\.[jt]sx?$|\\.config\\.[mc]?[jt]s$'))"


def reason(s: str, t: str) -> str:
    return (
        f"CASE WHEN {organ(s)} = '' OR {organ(t)} = '' THEN 'top_level' WHEN {peripheral(s)} THEN 'peripheral_source'"
        f" WHEN {organ(s)} = {organ(t)} THEN 'same_organ' WHEN contains({folder(t)}, '/') THEN 'cross_organ_internal' ELSE 'front_door' END"
    )


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().strip(",") for p in parts) + "\n"
