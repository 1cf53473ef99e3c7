"""Queries of traversal and graph analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import paths
from quiver.operators import analytics as A
from quiver.operators import traverse as T
from quiver.operators.graph import DEFINITIONS
from quiver.plans.tables import GRAPH, edges, nodes, organ, peripheral, with_
from quiver.session import table


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """The id of each graph that most edges start from: what a trace is asked for here."""
    fan = A.fan(edges(spark, d), "source")
    best = F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("b")
    return fan.groupBy("graph_id").agg(best).select("graph_id", F.col("b.id").alias("seed"))


def _trace(spark: SparkSession, d: str, direction: str) -> DataFrame:
    return T.reach(T.steps(edges(spark, d), direction), _seeds(spark, d), 5, known=nodes(spark, d))


def trace_down(spark: SparkSession, d: str) -> DataFrame:
    return _trace(spark, d, "downstream")


def trace_up(spark: SparkSession, d: str) -> DataFrame:
    return _trace(spark, d, "upstream")


def trace_both(spark: SparkSession, d: str) -> DataFrame:
    return _trace(spark, d, "both")


def trace_paths(spark: SparkSession, d: str) -> DataFrame:
    return T.reach(T.steps(edges(spark, d), "down"), _seeds(spark, d), 3, known=nodes(spark, d), with_path=True)


def trace_canonical(spark: SparkSession, d: str) -> DataFrame:
    led = T.canonical_edges(edges(spark, d), T.canonical_ids(nodes(spark, d, "name", "file_path", "is_external")))
    return T.reach(T.steps(led, "down"), _seeds(spark, d), 5)


def impact(spark: SparkSession, d: str) -> DataFrame:
    return T.impact(edges(spark, d), _seeds(spark, d), 10)


def fallback_impact(spark: SparkSession, d: str) -> DataFrame:
    return T.fallback_impact(edges(spark, d), _seeds(spark, d), 3)


def fallback_trace(spark: SparkSession, d: str) -> DataFrame:
    return T.all_paths(T.steps(edges(spark, d), "down"), _seeds(spark, d), 3)


def expand_k(spark: SparkSession, d: str) -> DataFrame:
    return T.expand(edges(spark, d), _seeds(spark, d), 2)


def components(spark: SparkSession, d: str) -> DataFrame:
    return T.components(edges(spark, d), nodes(spark, d))


def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    return T.canonical_ids(nodes(spark, d, "name", "file_path", "is_external"))


def format_context(spark: SparkSession, d: str) -> DataFrame:
    return T.describe(nodes(spark, d, "name", "labels", "file_path"), edges(spark, d))


def fan_in(spark: SparkSession, d: str) -> DataFrame:
    return A.fan(edges(spark, d), "target")


def fan_out(spark: SparkSession, d: str) -> DataFrame:
    return A.fan(edges(spark, d), "source")


def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.edge_counts(edges(spark, d))


def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return A.degree_centrality(edges(spark, d), nodes(spark, d))


def hotspots(spark: SparkSession, d: str) -> DataFrame:
    return A.hotspots(degree_centrality(spark, d), nodes(spark, d, "file_path"), 10)


def hotspot_detail(spark: SparkSession, d: str) -> DataFrame:
    return A.hotspot_detail(edges(spark, d), nodes(spark, d, "file_path"))


def file_projection(spark: SparkSession, d: str) -> DataFrame:
    return A.file_projection(edges(spark, d), nodes(spark, d, "file_path", "is_external"))


def _organ_labels(spark: SparkSession, d: str) -> DataFrame:
    """Given labels: the organ of a node's file, its first id segment without one."""
    n = nodes(spark, d, "file_path")
    label = F.coalesce(F.nullif(paths.organ(paths.folder(F.col("file_path"))), F.lit("")), F.substring_index("id", ".", 1))
    return n.select("graph_id", "id", label.alias("community"))


def modularity(spark: SparkSession, d: str) -> DataFrame:
    return A.modularity(A.known_only(edges(spark, d), nodes(spark, d)), _organ_labels(spark, d))


def community_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.community_stats(edges(spark, d), nodes(spark, d, "file_path"), _organ_labels(spark, d))


def external_coupling(spark: SparkSession, d: str) -> DataFrame:
    return A.external_coupling(edges(spark, d), _organ_labels(spark, d))


def representatives(spark: SparkSession, d: str) -> DataFrame:
    return A.representatives(edges(spark, d), _organ_labels(spark, d))


def file_rank(spark: SparkSession, d: str) -> DataFrame:
    return A.rank_files(edge_counts(spark, d).select("graph_id", "id", "coupling"), nodes(spark, d, "file_path"), "coupling")


def _file_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, d, "file_path", "is_external")
    inside = n.where(F.col("file_path").isNotNull() & ~F.coalesce("is_external", F.lit(False)))
    return A.file_projection(edges(spark, d), n), inside.select("graph_id", F.col("file_path").alias("id")).distinct()


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return A.betweenness(*_file_graph(spark, d))


def louvain(spark: SparkSession, d: str) -> DataFrame:
    return A.louvain(*_file_graph(spark, d))


def louvain_modularity(spark: SparkSession, d: str) -> DataFrame:
    e, n = _file_graph(spark, d)
    return A.modularity(e, A.louvain(e, n))


def embedding_status(spark: SparkSession, d: str) -> DataFrame:
    wanted = nodes(spark, d, "labels").where(F.arrays_overlap("labels", F.array(*map(F.lit, DEFINITIONS))))
    return A.embedding_status(table(spark, d, "node_embeddings"), wanted, table(spark, d, "analyzer_config"))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.graph_summary(nodes(spark, d, "file_path"), _organ_labels(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        trace_down, trace_up, trace_both, trace_paths, trace_canonical, impact, fallback_impact, fallback_trace, expand_k, components,
        canonical_ids, format_context, fan_in, fan_out, edge_counts, degree_centrality, hotspots, hotspot_detail, file_projection,
        modularity, community_stats, external_coupling, representatives, file_rank, betweenness, louvain, louvain_modularity,
        embedding_status, graph_summary,
    )
}

_BASE = GRAPH + """,
pair AS (SELECT DISTINCT graph_id, source, target FROM e),
seed AS (SELECT graph_id, source AS seed FROM (SELECT graph_id, source, count(*) AS n FROM pair GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY n DESC, source) = 1),
both_ AS (SELECT graph_id, source AS id, target AS next FROM pair UNION SELECT graph_id, target, source FROM pair)"""
_G = with_(_BASE)
_R = "WITH RECURSIVE " + _BASE.strip() + "\n"
_DOWN = "(SELECT graph_id, source AS id, target AS next FROM pair)"
_UP = "(SELECT graph_id, target AS id, source AS next FROM pair)"
_ORGANS = f", lab AS (SELECT graph_id, id, coalesce(nullif({organ('file_path')}, ''), split_part(id, '.', 1)) AS community FROM n)\n"
_CANON = """, canon AS (
  SELECT x.graph_id, x.id, CASE WHEN x.file_path IS NOT NULL THEN NULL WHEN x.name IS NULL THEN x.id WHEN c.k = 1 THEN c.only_id END AS canonical
  FROM n x LEFT JOIN (SELECT graph_id, name, count(*) AS k, min(id) AS only_id FROM n WHERE NOT coalesce(is_external, false) AND file_path IS NOT NULL AND name IS NOT NULL GROUP BY ALL) c
    ON c.graph_id = x.graph_id AND c.name = x.name WHERE coalesce(x.is_external, false))
"""


def _walk(name: str, step: str, depth: int, known: bool) -> str:
    exists = "JOIN n ON n.graph_id = s.graph_id AND n.id = s.next" if known else ""
    start = "WHERE (graph_id, seed) IN (SELECT graph_id, id FROM n)" if known else ""
    return f""", {name}_w AS (
  SELECT graph_id, seed, seed AS id, 0 AS depth FROM seed {start}
  UNION SELECT w.graph_id, w.seed, s.next, w.depth + 1 FROM {name}_w w JOIN {step} s ON s.graph_id = w.graph_id AND s.id = w.id {exists} WHERE w.depth < {depth}),
{name} AS (SELECT graph_id, seed, id, min(depth)::INTEGER AS depth FROM {name}_w GROUP BY ALL)
"""


def _comm(body: str) -> str:
    return _G + _ORGANS + body


SQL = {
    "trace_down": _R + _walk("t", _DOWN, 5, True) + "SELECT * FROM t",
    "trace_up": _R + _walk("t", _UP, 5, True) + "SELECT * FROM t",
    "trace_both": _R + _walk("t", "both_", 5, True) + "SELECT * FROM t",
    "trace_paths": _R
    + f""", t AS (
  SELECT graph_id, seed, seed AS id, 0 AS depth, [seed] AS path FROM seed WHERE (graph_id, seed) IN (SELECT graph_id, id FROM n)
  UNION ALL SELECT t.graph_id, t.seed, s.next, t.depth + 1, list_append(t.path, s.next) FROM t JOIN {_DOWN} s ON s.graph_id = t.graph_id AND s.id = t.id
    JOIN n ON n.graph_id = s.graph_id AND n.id = s.next WHERE t.depth < 3)
SELECT graph_id, seed, id, depth::INTEGER AS depth, path FROM t QUALIFY row_number() OVER (PARTITION BY graph_id, seed, id ORDER BY depth, path) = 1""",
    "trace_canonical": _R
    + _CANON
    + """, led AS (
  SELECT DISTINCT p.graph_id, CASE WHEN a.id IS NULL THEN p.source ELSE a.canonical END AS id, CASE WHEN b.id IS NULL THEN p.target ELSE b.canonical END AS next
  FROM pair p LEFT JOIN canon a ON a.graph_id = p.graph_id AND a.id = p.source LEFT JOIN canon b ON b.graph_id = p.graph_id AND b.id = p.target),
st AS (SELECT * FROM led WHERE id IS NOT NULL AND next IS NOT NULL)
"""
    + _walk("t", "st", 5, False)
    + "SELECT * FROM t",
    "impact": _R
    + _walk("a", _DOWN, 10, False)
    + _walk("b", _UP, 10, False)
    + """SELECT graph_id, seed, id, a.depth AS depth_down, b.depth AS depth_up, (coalesce(a.depth, 0) + coalesce(b.depth, 0))::DOUBLE AS coupling, coalesce(a.depth, 0) = 1 AS direct
FROM a FULL JOIN b USING (graph_id, seed, id) WHERE id <> seed""",
    "fallback_impact": _R
    + ", nb AS (SELECT * FROM both_ WHERE id <> next)\n"
    + _walk("t", "nb", 3, False)
    + """, sh AS (SELECT s.graph_id, s.seed, y.id, count(*) AS shared FROM seed s JOIN nb x ON x.graph_id = s.graph_id AND x.id = s.seed JOIN nb y ON y.graph_id = x.graph_id AND y.next = x.next GROUP BY ALL)
SELECT graph_id, seed, id, depth, (coalesce(shared, 0) + 1)::DOUBLE AS score FROM t LEFT JOIN sh USING (graph_id, seed, id) WHERE id <> seed""",
    "fallback_trace": _R
    + f""", t AS (
  SELECT graph_id, seed, seed AS id, [seed] AS path FROM seed
  UNION ALL SELECT t.graph_id, t.seed, s.next, list_append(t.path, s.next) FROM t JOIN {_DOWN} s ON s.graph_id = t.graph_id AND s.id = t.id
  WHERE len(t.path) <= 3 AND NOT list_contains(t.path, s.next))
SELECT * FROM t WHERE len(path) > 1""",
    "expand_k": _R + _walk("t", "both_", 2, False) + "SELECT * FROM t",
    "components": _R
    + """, r AS (SELECT graph_id, id, next FROM both_ UNION SELECT r.graph_id, r.id, b.next FROM r JOIN both_ b ON b.graph_id = r.graph_id AND b.id = r.next),
i AS (SELECT graph_id, id FROM n UNION SELECT graph_id, id FROM both_),
m AS (SELECT graph_id, id, min(next) AS low FROM r GROUP BY ALL)
SELECT graph_id, id, least(id, coalesce(low, id)) AS component FROM i LEFT JOIN m USING (graph_id, id)""",
    "canonical_ids": _G + _CANON + "SELECT * FROM canon",
    "fan_in": _G + "SELECT graph_id, target AS id, count(*) AS n FROM pair GROUP BY ALL",
    "fan_out": _G + "SELECT graph_id, source AS id, count(*) AS n FROM pair GROUP BY ALL",
    "edge_counts": _G
    + """SELECT graph_id, id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, count(DISTINCT other) AS coupling FROM (
  SELECT graph_id, source AS id, target AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT graph_id, target, source, 0, 1 FROM e) GROUP BY ALL""",
    "hotspot_detail": _G
    + f"""SELECT p.graph_id, t.id, count(*) FILTER (coalesce(s.file_path = t.file_path, false)) AS internal_refs,
  count(*) FILTER (NOT coalesce(s.file_path = t.file_path, false)) AS external_refs, count(*) FILTER (coalesce({peripheral('s.file_path')}, false)) AS test_refs,
  count(DISTINCT s.file_path) FILTER (NOT coalesce(s.file_path = t.file_path, false)) AS importing_files
FROM pair p JOIN n s ON s.graph_id = p.graph_id AND s.id = p.source JOIN n t ON t.graph_id = p.graph_id AND t.id = p.target GROUP BY ALL""",
    "file_projection": _G
    + """, i AS (SELECT * FROM n WHERE file_path IS NOT NULL AND NOT coalesce(is_external, false))
SELECT DISTINCT p.graph_id, s.file_path AS source, t.file_path AS target FROM pair p
JOIN i s ON s.graph_id = p.graph_id AND s.id = p.source JOIN i t ON t.graph_id = p.graph_id AND t.id = p.target WHERE s.file_path <> t.file_path""",
    "community_stats": _comm(
        f""", fl AS (SELECT p.graph_id, a.community AS cs, b.community AS ct, count(*) AS k FROM pair p JOIN lab a ON a.graph_id = p.graph_id AND a.id = p.source
  JOIN lab b ON b.graph_id = p.graph_id AND b.id = p.target GROUP BY ALL),
x AS (SELECT graph_id, cs AS community, sum(CASE WHEN cs = ct THEN k ELSE 0 END) AS i, sum(CASE WHEN cs <> ct THEN k ELSE 0 END) AS o, count(*) FILTER (cs <> ct) AS c FROM fl GROUP BY ALL),
g AS (SELECT l.graph_id, l.community, {organ('n.file_path')} AS organ, count(*) AS k FROM lab l JOIN n USING (graph_id, id) GROUP BY ALL),
m AS (SELECT graph_id, community, sum(k) AS members FROM g GROUP BY ALL),
top AS (SELECT graph_id, community, organ FROM g WHERE organ <> '' QUALIFY row_number() OVER (PARTITION BY graph_id, community ORDER BY k DESC, organ) = 1)
SELECT graph_id, community, members::BIGINT AS members, coalesce(i, 0)::BIGINT AS internal_edges, coalesce(o, 0)::BIGINT AS external_edges, coalesce(c, 0) AS coupled_communities,
  round(coalesce(i, 0)::DOUBLE / greatest(members * (members - 1), 1), 4) AS density, organ
FROM m LEFT JOIN x USING (graph_id, community) LEFT JOIN top USING (graph_id, community)"""
    ),
    "external_coupling": _comm(
        """SELECT p.graph_id, a.community, b.community AS other, count(*) AS n FROM pair p JOIN lab a ON a.graph_id = p.graph_id AND a.id = p.source
JOIN lab b ON b.graph_id = p.graph_id AND b.id = p.target WHERE a.community <> b.community GROUP BY ALL"""
    ),
    "representatives": _comm(
        """, dg AS (SELECT graph_id, id, count(*) AS degree FROM (SELECT graph_id, source AS id FROM pair UNION ALL SELECT graph_id, target FROM pair) GROUP BY ALL)
SELECT graph_id, community, id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY graph_id, community ORDER BY coalesce(degree, 0) DESC, id)::INTEGER AS place
FROM lab LEFT JOIN dg USING (graph_id, id) QUALIFY place <= 5"""
    ),
    "file_rank": _G
    + """, c AS (SELECT graph_id, id, count(DISTINCT next) AS coupling FROM both_ GROUP BY ALL),
b AS (SELECT graph_id, file_path, max(coupling) AS coupling FROM n JOIN c USING (graph_id, id) WHERE file_path IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY coupling DESC, file_path) AS rank FROM b""",
    "degree_centrality": _G
    + """, u AS (SELECT DISTINCT graph_id, least(source, target) AS a, greatest(source, target) AS b FROM pair
  WHERE (graph_id, source) IN (SELECT graph_id, id FROM n) AND (graph_id, target) IN (SELECT graph_id, id FROM n)),
dg AS (SELECT graph_id, id, count(*) AS k FROM (SELECT graph_id, a AS id FROM u UNION ALL SELECT graph_id, b FROM u) GROUP BY ALL),
z AS (SELECT graph_id, count(*) AS c FROM n GROUP BY ALL)
SELECT graph_id, id, CASE WHEN c = 1 THEN 1.0 ELSE round(coalesce(k, 0)::DOUBLE / (c - 1), 6) END AS centrality FROM n LEFT JOIN dg USING (graph_id, id) JOIN z USING (graph_id)""",
    "modularity": _comm(
        """, u AS (SELECT * FROM both_ WHERE id <> next AND (graph_id, id) IN (SELECT graph_id, id FROM n) AND (graph_id, next) IN (SELECT graph_id, id FROM n)),
x AS (SELECT u.graph_id, a.community, count(*) AS d, count(*) FILTER (a.community = b.community) AS i FROM u JOIN lab a ON a.graph_id = u.graph_id AND a.id = u.id
  JOIN lab b ON b.graph_id = u.graph_id AND b.id = u.next GROUP BY ALL),
m AS (SELECT graph_id, sum(d)::DOUBLE AS m2 FROM x GROUP BY ALL)
SELECT graph_id, modularity FROM (SELECT DISTINCT graph_id FROM lab) LEFT JOIN (
  SELECT graph_id, round(sum(i / m2 - (d / m2) * (d / m2)), 6) AS modularity FROM x JOIN m USING (graph_id) GROUP BY ALL) USING (graph_id)"""
    ),
    "embedding_status": _G
    + """, w AS (SELECT graph_id, id FROM n WHERE list_has_any(labels, ['CodeFunction','CodeMethod','CodeClass','CodeVariable','CodeInterface','CodeTypeAlias','CodeHook','CodeReactComponent'])),
el AS (SELECT graph_id, count(*) AS eligible FROM w GROUP BY ALL),
dn AS (SELECT v.graph_id, v.model, count(DISTINCT v.node_id) AS embedded FROM node_embeddings v JOIN w ON w.graph_id = v.graph_id AND w.id = v.node_id WHERE len(vector) > 0 GROUP BY ALL)
SELECT graph_id, model, embedded, eligible, round(embedded::DOUBLE / eligible, 3) AS coverage, TRY_CAST(nullif(regexp_extract(model, '#v(\\d+)$', 1), '') AS INTEGER) AS version,
  model IS DISTINCT FROM embedding_model AS stale FROM dn JOIN el USING (graph_id) LEFT JOIN analyzer_config USING (graph_id)""",
    "graph_summary": _comm(
        """SELECT * FROM (SELECT graph_id, count(DISTINCT file_path) AS files, count(*) AS entities FROM n GROUP BY ALL)
LEFT JOIN (SELECT graph_id, count(DISTINCT community) AS communities FROM lab GROUP BY ALL) USING (graph_id)"""
    ),
}
SQL["format_context"] = (
    _G
    + """, b AS (SELECT graph_id, id, next FROM both_ QUALIFY row_number() OVER (PARTITION BY graph_id, id ORDER BY next) <= 5),
l AS (SELECT graph_id, id, string_agg(next, ', ' ORDER BY next) AS near FROM b GROUP BY ALL)
SELECT graph_id, id, concat_ws(chr(10), concat_ws(' ', coalesce(name, id), '[' || labels[-1] || ']'), 'file: ' || file_path, 'near: ' || near) AS text FROM n LEFT JOIN l USING (graph_id, id)"""
)
SQL["hotspots"] = (
    SQL["degree_centrality"].replace("SELECT graph_id, id, CASE WHEN c = 1", ", dc AS (SELECT graph_id, id, file_path, CASE WHEN c = 1")
    + f""")
SELECT graph_id, id, centrality, row_number() OVER (PARTITION BY graph_id ORDER BY centrality DESC, id)::INTEGER AS place FROM dc
WHERE NOT coalesce({peripheral('file_path')}, false) QUALIFY place <= 10"""
)
