"""Queries of the lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators import graph
from quiver.operators import lookups as L
from quiver.plans.tables import GRAPH, edges, nodes, peripheral, with_
from quiver.session import table


def _targets(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("graph_id", F.col("target").alias("id"))


def node_by_id(spark: SparkSession, d: str) -> DataFrame:
    return L.nodes_by_id(nodes(spark, d, "name"), _targets(spark, d))


def node_by_name(spark: SparkSession, d: str) -> DataFrame:
    every = nodes(spark, d, "name", "labels")
    return L.nodes_by_name(every, every.where(graph.has_label("CodeClass"))).select("graph_id", "id", "name")


def node_name_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return L.nodes_matching(nodes(spark, d, "name", "qualname"), "Store").select("graph_id", "id")


def nodes_by_label(spark: SparkSession, d: str) -> DataFrame:
    return L.nodes_by_label(nodes(spark, d, "labels", "name"), "CodeClass").select("graph_id", "id", "name")


def nodes_by_file(spark: SparkSession, d: str) -> DataFrame:
    return L.nodes_by_file(nodes(spark, d, "file_path"), table(spark, d, "file_hashes")).select("graph_id", "id", "file_path")


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbours(edges(spark, d), nodes(spark, d))


def incoming(spark: SparkSession, d: str) -> DataFrame:
    return L.incoming(edges(spark, d), nodes(spark, d))


def outgoing(spark: SparkSession, d: str) -> DataFrame:
    return L.outgoing(edges(spark, d), nodes(spark, d))


def node_edges(spark: SparkSession, d: str) -> DataFrame:
    return L.node_edges(edges(spark, d), nodes(spark, d))


def count_files(spark: SparkSession, d: str) -> DataFrame:
    return L.count_files(nodes(spark, d, "file_path"))


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    from quiver.operators.incremental import current_hashes

    return current_hashes(table(spark, d, "file_hashes"))


def stored_file_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_hashes").select("graph_id", "file_path").distinct()


def hashed_graphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_hashes").select("graph_id").distinct()


def index_metadata(spark: SparkSession, d: str) -> DataFrame:
    return L.index_metadata(table(spark, d, "projects"))


def unknown_query(spark: SparkSession, d: str) -> DataFrame:
    return L.unknown_query(nodes(spark, d, "name"))


def symbol_resolve(spark: SparkSession, d: str) -> DataFrame:
    every = nodes(spark, d, "labels", "name", "qualname")
    return L.resolve_symbols(every, every.select("graph_id", F.col("name").alias("symbol")))


def file_resolve(spark: SparkSession, d: str) -> DataFrame:
    every = nodes(spark, d, "labels", "file_path")
    names = every.where(F.col("file_path").isNotNull()).select("graph_id", F.substring_index("file_path", "/", -1).alias("query"))
    return L.resolve_files(every, names)


def inspect_file(spark: SparkSession, d: str) -> DataFrame:
    return L.inspect_files(nodes(spark, d, "file_path"), edges(spark, d, "owner_file_path"))


def list_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    found = L.diagnostics(nodes(spark, d, "labels", "file_path", "level", "rule", "message"), production=True)
    return found.select("graph_id", "id", "file_path", "level", "rule", "message")


def diagnostic_page(spark: SparkSession, d: str) -> DataFrame:
    found = L.diagnostics(nodes(spark, d, "labels", "file_path", "level", "rule"), level="warning")
    return L.page(found.select("graph_id", "id", "rule"), ["graph_id", "id"], 20, 25)


def diagnostic_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.diagnostic_counts(L.diagnostics(nodes(spark, d, "labels", "file_path", "level", "rule")))


def node_language(spark: SparkSession, d: str) -> DataFrame:
    return L.language(nodes(spark, d, "language", "file_path")).groupBy("graph_id", "language").agg(F.count(F.lit(1)).alias("n"))


def current_graph(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges(spark, d).groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "graph_id", "full_outer").na.fill(0)


def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "nodes")
    stored = raw.where("loaded_at < timestamp '2025-07-01'")
    return graph.upsert_nodes(stored, raw.where("loaded_at >= timestamp '2025-07-01'")).select("graph_id", "id", "labels", "file_path", "is_external", "properties")


def edge_insert(spark: SparkSession, d: str) -> DataFrame:
    """Everything comes in again over what was there; the mark tells which row stays."""
    every = edges(spark, d, "loaded_at")
    old = every.where("loaded_at < timestamp '2025-07-01'").withColumn("mark", F.lit("stored"))
    return graph.insert_edges(old, every.withColumn("mark", F.lit("incoming"))).select("graph_id", "source", "target", "rel_type", "mark")


def delete_graph(spark: SparkSession, d: str) -> DataFrame:
    off = table(spark, d, "projects").where("not sync_enabled")
    return graph.delete_graphs(nodes(spark, d), off).groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))


def delete_file_facts(spark: SparkSession, d: str) -> DataFrame:
    n, e = nodes(spark, d, "file_path"), edges(spark, d, "owner_file_path")
    gone = table(spark, d, "file_hashes").where("content_hash like 'error:%'").select("graph_id", "file_path")
    left = graph.delete_file_edges(e, n, gone).select("graph_id", F.lit("edge").alias("part"), F.concat_ws(" ", "source", "rel_type", "target").alias("value"))
    return left.unionByName(graph.delete_file_nodes(n, gone).select("graph_id", F.lit("node").alias("part"), F.col("id").alias("value")))


def register_project(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "projects")
    new = p.where("sync_enabled").withColumn("created_at", F.lit("2026-01-01").cast("timestamp")).withColumn("file_count", F.col("file_count") + 1)
    return graph.register_projects(p, new)


def graph_list(spark: SparkSession, d: str) -> DataFrame:
    counts = L.count_files(nodes(spark, d, "file_path")).where("files > 0")
    return table(spark, d, "projects").join(counts, "graph_id").select("graph_id", "repo_path", "files")


QUERIES = {
    f.__name__: f
    for f in (
        node_by_id, node_by_name, node_name_fuzzy, nodes_by_label, nodes_by_file, neighbors, incoming, outgoing, node_edges,
        count_files, file_hashes, stored_file_paths, hashed_graphs, index_metadata, unknown_query, symbol_resolve, file_resolve,
        inspect_file, list_diagnostics, diagnostic_page, diagnostic_counts, node_language, current_graph, upsert_merge, edge_insert,
        delete_graph, delete_file_facts, register_project, graph_list,
    )
}

_G = with_(GRAPH)
_BONUS = """CASE WHEN list_has_any(labels, ['CodeClass','CodeFunction','CodeMethod','CodeInterface','CodeTypeAlias']) THEN 100
 WHEN list_has_any(labels, ['CodeModule','CodeFile']) THEN 90 WHEN list_contains(labels, 'CodeImport') THEN 10
 WHEN list_contains(labels, 'CodeDiagnostic') THEN 0 ELSE 50 END"""
_TEST = f"coalesce({peripheral('file_path')}, false)"

SQL = {
    "node_by_id": _G + "SELECT graph_id, id, name FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.graph_id = n.graph_id AND e.target = n.id)",
    "node_by_name": _G + "SELECT graph_id, id, name FROM n WHERE (graph_id, name) IN (SELECT graph_id, name FROM n WHERE list_contains(labels, 'CodeClass'))",
    "node_name_fuzzy": _G + "SELECT graph_id, id FROM n WHERE id ILIKE '%store%' OR name ILIKE '%store%' OR qualname ILIKE '%store%'",
    "nodes_by_label": _G + "SELECT graph_id, id, name FROM n WHERE list_contains(labels, 'CodeClass')",
    "nodes_by_file": _G + "SELECT graph_id, id, file_path FROM n WHERE (graph_id, file_path) IN (SELECT graph_id, file_path FROM file_hashes)",
    "neighbors": _G
    + """SELECT DISTINCT a.graph_id, a.id, a.other FROM (
  SELECT graph_id, source AS id, target AS other FROM e UNION ALL SELECT graph_id, target, source FROM e) a
JOIN n ON n.graph_id = a.graph_id AND n.id = a.other""",
    "incoming": _G + "SELECT graph_id, source, target, rel_type FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.graph_id = e.graph_id AND n.id = e.target)",
    "outgoing": _G + "SELECT graph_id, source, target, rel_type FROM e WHERE EXISTS (SELECT 1 FROM n WHERE n.graph_id = e.graph_id AND n.id = e.source)",
    "node_edges": _G
    + """SELECT a.* FROM (
  SELECT graph_id, source AS id, target AS other, 'outgoing' AS direction, rel_type FROM e
  UNION ALL SELECT graph_id, target, source, 'incoming', rel_type FROM e WHERE source <> target) a
JOIN n ON n.graph_id = a.graph_id AND n.id = a.id""",
    "count_files": _G + "SELECT graph_id, count(DISTINCT file_path) AS files FROM n GROUP BY graph_id",
    "file_hashes": """SELECT graph_id, file_path, arg_max(content_hash, (indexed_at, content_hash)) AS content_hash FROM file_hashes
WHERE content_hash IS NOT NULL AND content_hash NOT LIKE 'error:%' GROUP BY ALL""",
    "stored_file_paths": "SELECT DISTINCT graph_id, file_path FROM file_hashes",
    "hashed_graphs": "SELECT DISTINCT graph_id FROM file_hashes",
    "index_metadata": "SELECT graph_id, repo_path, created_at, last_indexed, file_count, coalesce(sync_enabled, true) AS sync_enabled FROM projects",
    "unknown_query": "SELECT graph_id, id, name FROM nodes WHERE false",
    "symbol_resolve": _G
    + f""", k AS (
  SELECT graph_id, id, name, qualname, {_BONUS} AS bonus FROM n),
s AS (SELECT DISTINCT graph_id, name AS symbol FROM n WHERE name <> ''),
c AS (
  SELECT s.graph_id, s.symbol, k.id, bonus + CASE WHEN k.id = symbol THEN 1000
    WHEN ends_with(k.id, '.' || symbol) OR ends_with(k.id, ':' || symbol) THEN 800
    WHEN qualname = symbol THEN 700 WHEN name = symbol THEN 600 END AS score
  FROM s JOIN k ON k.graph_id = s.graph_id AND (k.id = symbol OR ends_with(k.id, '.' || symbol) OR ends_with(k.id, ':' || symbol) OR qualname = symbol OR name = symbol))
SELECT graph_id, symbol, id, score FROM c QUALIFY row_number() OVER (PARTITION BY graph_id, symbol ORDER BY score DESC, id) = 1""",
    "file_resolve": _G
    + """, p AS (
  SELECT graph_id, file_path, id FROM n WHERE file_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY graph_id, file_path
    ORDER BY CASE WHEN list_contains(labels, 'CodeFile') THEN 0 WHEN list_contains(labels, 'CodeModule') THEN 1 ELSE 2 END, id) = 1),
q AS (SELECT DISTINCT graph_id, split_part(file_path, '/', -1) AS query FROM p),
h AS (SELECT q.graph_id, q.query, p.file_path, p.id FROM q JOIN p ON p.graph_id = q.graph_id AND (p.file_path = q.query OR ends_with(p.file_path, '/' || q.query)))
SELECT *, count(*) OVER (PARTITION BY graph_id, query) AS candidates FROM h""",
    "inspect_file": _G
    + """, a AS (SELECT graph_id, file_path, count(*) AS nodes FROM n WHERE file_path IS NOT NULL GROUP BY ALL),
b AS (SELECT graph_id, owner_file_path AS file_path, count(*) AS edges FROM e WHERE owner_file_path <> '' GROUP BY ALL)
SELECT graph_id, file_path, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM a FULL JOIN b USING (graph_id, file_path)""",
    "list_diagnostics": _G + f"SELECT graph_id, id, file_path, level, rule, message FROM n WHERE list_contains(labels, 'CodeDiagnostic') AND NOT {_TEST}",
    "diagnostic_page": _G
    + """, w AS (SELECT graph_id, id, rule FROM n WHERE list_contains(labels, 'CodeDiagnostic') AND level = 'warning' ORDER BY graph_id, id LIMIT 26 OFFSET 20)
SELECT graph_id, id, rule, place, (SELECT count(*) FROM w) > 25 AS has_more
FROM (SELECT *, row_number() OVER (ORDER BY graph_id, id)::INTEGER AS place FROM w) WHERE place <= 25""",
    "diagnostic_counts": _G + f"SELECT graph_id, rule, level, {_TEST} AS is_test, count(*) AS n FROM n WHERE list_contains(labels, 'CodeDiagnostic') GROUP BY ALL",
    "node_language": _G
    + """, g AS (SELECT graph_id, regexp_extract(file_path, '\\.(\\w+)$', 1) AS x, nullif(language, '') AS l FROM n)
SELECT graph_id, coalesce(l, CASE WHEN x = 'py' THEN 'python' WHEN x IN ('ts', 'tsx') THEN 'typescript' WHEN x IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript' END) AS language, count(*) AS n
FROM g GROUP BY ALL""",
    "current_graph": _G
    + """SELECT graph_id, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM (SELECT graph_id, count(*) AS nodes FROM n GROUP BY ALL)
FULL JOIN (SELECT graph_id, count(*) AS edges FROM e GROUP BY ALL) USING (graph_id)""",
    "upsert_merge": """WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY graph_id, id ORDER BY loaded_at DESC, file_path DESC NULLS LAST, is_external DESC NULLS LAST, properties DESC NULLS LAST) AS k FROM nodes),
g AS (
  SELECT graph_id, id, bool_or(list_has_any(labels, ['CodeFile','CodeModule'])) AND bool_or(list_contains(labels, 'CodeImport')) AS hit,
    max(file_path) AS known, list_sort(list_distinct(flatten(list(labels)))) AS united, bool_and(is_external) AS outside,
    arg_max(properties, (coalesce(length(properties), 0), properties)) AS richest FROM nodes GROUP BY ALL)
SELECT graph_id, id, CASE WHEN hit THEN united ELSE list_sort(labels) END AS labels, CASE WHEN hit THEN known ELSE file_path END AS file_path,
  CASE WHEN hit THEN outside ELSE is_external END AS is_external, CASE WHEN hit THEN richest ELSE properties END AS properties
FROM r JOIN g USING (graph_id, id) WHERE k = 1""",
    "edge_insert": _G + "SELECT graph_id, source, target, rel_type, CASE WHEN loaded_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' THEN 'stored' ELSE 'incoming' END AS mark FROM e",
    "delete_graph": _G + "SELECT graph_id, count(*) AS nodes FROM n WHERE graph_id NOT IN (SELECT graph_id FROM projects WHERE NOT sync_enabled) GROUP BY ALL",
    "delete_file_facts": _G
    + """, g AS (SELECT DISTINCT graph_id, file_path FROM file_hashes WHERE content_hash LIKE 'error:%'),
i AS (SELECT n.graph_id, n.id FROM n JOIN g USING (graph_id, file_path))
SELECT graph_id, 'edge' AS part, source || ' ' || rel_type || ' ' || target AS value FROM e WHERE CASE WHEN owner_file_path IS NOT NULL
  THEN (graph_id, owner_file_path) NOT IN (SELECT graph_id, file_path FROM g)
  ELSE (graph_id, source) NOT IN (SELECT graph_id, id FROM i) AND (graph_id, target) NOT IN (SELECT graph_id, id FROM i) END
UNION ALL SELECT graph_id, 'node', id FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.graph_id = n.graph_id AND g.file_path = n.file_path)""",
    "register_project": "SELECT graph_id, repo_path, created_at, last_indexed, (file_count + CASE WHEN sync_enabled THEN 1 ELSE 0 END)::INTEGER AS file_count, sync_enabled FROM projects",
    "graph_list": _G + "SELECT graph_id, repo_path, count(DISTINCT n.file_path) AS files FROM projects JOIN n USING (graph_id) GROUP BY ALL HAVING count(DISTINCT n.file_path) > 0",
}
