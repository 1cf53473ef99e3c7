"""Queries over file dependencies: matrices, rules and folder trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import paths
from quiver.operators import dependencies as D
from quiver.operators import lookups, rules, traverse
from quiver.operators.graph import relative
from quiver.plans.tables import FILES, entry, files, folder, nodes, organ, peripheral, reason, with_
from quiver.session import table


def covered_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).covered()


def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).indexed()


def dep_edges(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).edges_of_files()


def dep_pairs(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).pairs()


def resolution_coverage(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).coverage()


def import_statements(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).import_statements()


def dep_matrix_file(spark: SparkSession, d: str) -> DataFrame:
    return D.dependency_matrix(files(spark, d).pairs(), "file")


def dep_matrix_directory(spark: SparkSession, d: str) -> DataFrame:
    return D.dependency_matrix(files(spark, d).pairs(), "directory")


def dep_matrix_module(spark: SparkSession, d: str) -> DataFrame:
    return D.dependency_matrix(files(spark, d).pairs(), "module")


def dep_matrix_nodes(spark: SparkSession, d: str) -> DataFrame:
    return D.matrix_nodes(files(spark, d).indexed(), "directory")


def explain_edges(spark: SparkSession, d: str) -> DataFrame:
    return D.explained_edges(files(spark, d).pairs())


def deep_import(spark: SparkSession, d: str) -> DataFrame:
    return rules.deep_imports(files(spark, d).pairs())


def upward_import(spark: SparkSession, d: str) -> DataFrame:
    return rules.upward_imports(files(spark, d).pairs())


def orphan_module(spark: SparkSession, d: str) -> DataFrame:
    view = files(spark, d)
    return rules.orphan_modules(view.indexed(), view.pairs())


def _components(spark: SparkSession, d: str) -> DataFrame:
    return _components_of(files(spark, d).pairs())


def _components_of(pairs: DataFrame) -> DataFrame:
    return traverse.strong_components(pairs.select("graph_id", F.col("sf").alias("source"), F.col("tf").alias("target")))


def dependency_cycle(spark: SparkSession, d: str) -> DataFrame:
    return rules.dependency_cycles(_components(spark, d))


#: A declared architecture, as a person would write it.
MODULES = [
    (0, "glue", ["*archive/*", "*scratch/*", "*legacy/*"], None, ["*"]),
    (1, "sources", ["src/*"], ["*_test.*"], ["sources"]),
    (2, "library", ["*.py"], None, ["sources"]),
    (3, "scripts", ["*.js", "*.ts", "*.tsx"], None, []),
]
EXCEPTIONS = [("scripts", "library", "2099-01-01"), ("scripts", "sources", "2001-01-01")]


def _architecture(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    modules = spark.createDataFrame(MODULES, "ordinal int, module string, paths array<string>, exclude array<string>, may_depend_on array<string>")
    exceptions = spark.createDataFrame(EXCEPTIONS, "from_module string, to_module string, expires string")
    return modules, exceptions.withColumn("expires", F.to_date("expires"))


def module_of_file(spark: SparkSession, d: str) -> DataFrame:
    return rules.assign_modules(files(spark, d).indexed(), _architecture(spark)[0])


def layer_violation(spark: SparkSession, d: str) -> DataFrame:
    return rules.layer_violations(files(spark, d).pairs(), *_architecture(spark), today=F.to_date(F.lit("2026-01-01")))


def findings(spark: SparkSession, d: str) -> DataFrame:
    view = files(spark, d, keep=True)
    found = rules.analyse(view.indexed(), view.pairs(), _components_of(view.pairs()))
    return rules.finding_ids(found, table(spark, d, "projects"))


def finding_counts(spark: SparkSession, d: str) -> DataFrame:
    view = files(spark, d, keep=True)
    found = rules.deep_imports(view.pairs()).unionByName(rules.upward_imports(view.pairs())).unionByName(rules.orphan_modules(view.indexed(), view.pairs()))
    return found.groupBy("graph_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def public_surface(spark: SparkSession, d: str) -> DataFrame:
    view = files(spark, d)
    return rules.public_surface(view.pairs(), view.indexed())


def hygiene_rollup(spark: SparkSession, d: str) -> DataFrame:
    found = lookups.diagnostics(nodes(spark, d, "labels", "file_path", "level", "rule"))
    return rules.rollup_levels(files(spark, d).indexed(), relative(found, table(spark, d, "projects")))


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    return rules.tree_edges(files(spark, d).indexed())


def web_weights(spark: SparkSession, d: str) -> DataFrame:
    pairs = files(spark, d).pairs().where(~paths.is_peripheral(F.col("sf")))
    violation = paths.edge_reason(F.col("sf"), F.col("tf")) == "cross_organ_internal"
    return pairs.select("graph_id", "sf", "tf", "n", violation.alias("violation"))


def placement_rank(spark: SparkSession, d: str) -> DataFrame:
    view = files(spark, d, keep=True)
    known = rules.assign_modules(view.indexed(), _architecture(spark)[0])
    imports = view.pairs().select("graph_id", F.col("sf"), F.col("tf").alias("file_path"))
    refs = imports.join(known, ["graph_id", "file_path"], "left").select(F.concat_ws("/", "graph_id", "sf").alias("item"), "module")
    modules = _architecture(spark)[0]
    allowed = modules.select("module", F.explode("may_depend_on").alias("target"))
    return rules.placement_ranking(refs, modules, allowed).select("item", "module", "violations", "unknowns", "co_located", "score", "place")


def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    config = table(spark, d, "analyzer_config").select("graph_id", "ignore_patterns", "max_file_size")
    found = table(spark, d, "documents").select("doc_id", "graph_id", "file_path", "n_chars").join(config, "graph_id", "left")
    ignored = paths.is_ignored(F.col("file_path"), F.col("ignore_patterns"))
    return found.select("doc_id", ignored.alias("ignored"), F.coalesce(F.col("n_chars") > F.col("max_file_size"), F.lit(False)).alias("too_large"))


QUERIES = {
    f.__name__: f
    for f in (
        covered_files, indexed_files, dep_edges, dep_pairs, resolution_coverage, import_statements, dep_matrix_file, dep_matrix_directory,
        dep_matrix_module, dep_matrix_nodes, explain_edges, deep_import, upward_import, orphan_module, dependency_cycle, module_of_file,
        layer_violation, findings, finding_counts, public_surface, hygiene_rollup, tree_edges, web_weights, placement_rank, ignored_files,
    )
}

_F = with_(FILES)
_DEEP = f"{reason('sf', 'tf')} = 'cross_organ_internal'"
_UP = f"{organ('sf')} <> '' AND {organ('sf')} = {organ('tf')} AND {folder('tf')} <> '' AND starts_with({folder('sf')}, {folder('tf')} || '/')"
_ORPHAN = f"""SELECT f.graph_id, f.file_path FROM f WHERE NOT {peripheral('file_path')} AND NOT {entry('file_path')}
 AND graph_id IN (SELECT graph_id FROM pairs) AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.graph_id = f.graph_id AND p.tf = f.file_path)"""
_REACH = """, r AS (
  SELECT DISTINCT graph_id, sf AS a, tf AS b FROM pairs UNION SELECT r.graph_id, r.a, p.tf FROM r JOIN pairs p ON p.graph_id = r.graph_id AND p.sf = r.b),
scc AS (
  SELECT x.graph_id, x.a AS id, min(x.b) AS component, count(DISTINCT x.b) AS n FROM r x JOIN r y ON y.graph_id = x.graph_id AND y.a = x.b AND y.b = x.a GROUP BY ALL)
"""
_F_R = _F.replace("WITH", "WITH RECURSIVE", 1)
_MODULE = """CASE WHEN regexp_matches({p}, '^.*archive/.*$|^.*scratch/.*$|^.*legacy/.*$') THEN 'glue'
 WHEN regexp_matches({p}, '^src/.*$') AND NOT regexp_matches({p}, '^.*_test\\..*$') THEN 'sources'
 WHEN regexp_matches({p}, '^.*\\.py$') THEN 'library' WHEN regexp_matches({p}, '^.*\\.(js|ts|tsx)$') THEN 'scripts' END"""


def _matrix(s: str, t: str) -> str:
    return _F + f"""SELECT graph_id, {s} AS source, {t} AS target, sum(n)::BIGINT AS import_count, sum(CASE WHEN {_DEEP} THEN n ELSE 0 END)::BIGINT AS violation_count
FROM pairs WHERE {s} <> {t} GROUP BY ALL"""


def _rule(name: str, level: str, where: str) -> str:
    return _F + f"SELECT graph_id, sf AS file_path, '{name}' AS rule, '{level}' AS level, tf AS target, n FROM pairs WHERE {where}"


_HUBS = f"""t AS (SELECT DISTINCT graph_id, file_path, string_split({folder('file_path')}, '/') AS parts FROM f WHERE {folder('file_path')} <> ''),
h AS (SELECT graph_id, file_path, array_to_string(parts[1:k], '/') AS directory FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM t))"""

SQL = {
    "covered_files": _F + "SELECT * FROM covered",
    "indexed_files": _F + "SELECT * FROM f",
    "dep_edges": _F + "SELECT * FROM deps",
    "dep_pairs": _F + "SELECT * FROM pairs",
    "resolution_coverage": _F
    + """, i AS (SELECT DISTINCT graph_id, sf AS file_path FROM imported),
c AS (SELECT graph_id, count(*) AS covered_files FROM covered GROUP BY ALL),
j AS (SELECT graph_id, count(*) AS import_files FROM i WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.graph_id = i.graph_id AND c.file_path = i.file_path) GROUP BY ALL)
SELECT graph_id, coalesce(covered_files, 0) AS covered_files, coalesce(import_files, 0) AS import_files,
  CASE WHEN coalesce(covered_files, 0) > 0 THEN 'scip' WHEN coalesce(import_files, 0) > 0 THEN 'tree-sitter-imports' ELSE 'none' END AS resolution
FROM (SELECT DISTINCT graph_id FROM n) LEFT JOIN c USING (graph_id) LEFT JOIN j USING (graph_id)""",
    "import_statements": _F
    + "SELECT e.graph_id, s.file_path, e.from_module FROM e JOIN nf s ON s.graph_id = e.graph_id AND s.id = e.source WHERE rel_type = 'IMPORTS_SYMBOL' AND e.from_module <> '' AND s.file_path IS NOT NULL",
    "dep_matrix_file": _matrix("sf", "tf"),
    "dep_matrix_directory": _matrix(folder("sf"), folder("tf")),
    "dep_matrix_module": _matrix(organ("sf"), organ("tf")),
    "dep_matrix_nodes": _F
    + f"SELECT graph_id, {folder('file_path')} AS key, split_part({folder('file_path')}, '/', 1) AS module, count(*) AS files, NOT {peripheral(folder('file_path'))} AS production FROM f GROUP BY ALL",
    "explain_edges": _F
    + f"SELECT graph_id, sf, tf, {organ('sf')} AS src_organ, {organ('tf')} AS dst_organ, {reason('sf', 'tf')} AS reason, {reason('sf', 'tf')} <> 'cross_organ_internal' AS allowed FROM pairs",
    "deep_import": _rule("deep_import", "warning", _DEEP),
    "upward_import": _rule("upward_import", "warning", _UP),
    "orphan_module": _F + f"SELECT graph_id, file_path, 'orphan_module' AS rule, 'info' AS level, NULL::VARCHAR AS target, 0::BIGINT AS n FROM ({_ORPHAN})",
    "dependency_cycle": _F_R + _REACH + "SELECT graph_id, id AS file_path, 'dependency_cycle' AS rule, 'error' AS level, component AS target, n FROM scc WHERE n > 1",
    "module_of_file": _F + f"SELECT graph_id, file_path, {_MODULE.format(p='file_path')} AS module FROM f",
    "layer_violation": _F
    + f""", q AS (SELECT *, {_MODULE.format(p='sf')} AS sm, {_MODULE.format(p='tf')} AS tm FROM pairs WHERE NOT {peripheral('sf')}),
a AS (SELECT * FROM (VALUES ('glue','glue'),('glue','sources'),('glue','library'),('glue','scripts'),('sources','sources'),('library','library'),('library','sources'),('scripts','scripts'),('scripts','library')) v(sm, tm))
SELECT graph_id, sf AS file_path, CASE WHEN sm IS NULL OR tm IS NULL THEN 'deep_import' ELSE 'layer_violation' END AS rule, 'warning' AS level, tf AS target, n FROM q
WHERE CASE WHEN sm IS NULL OR tm IS NULL THEN {_DEEP} ELSE (sm, tm) NOT IN (SELECT sm, tm FROM a) END""",
    "findings": _F_R
    + _REACH
    + f""", u AS (
  SELECT graph_id, sf AS file_path, 'deep_import' AS rule, 'warning' AS level, tf AS target, n FROM pairs WHERE {_DEEP}
  UNION ALL SELECT graph_id, sf, 'upward_import', 'warning', tf, n FROM pairs WHERE {_UP}
  UNION ALL SELECT graph_id, file_path, 'orphan_module', 'info', NULL, 0 FROM ({_ORPHAN})
  UNION ALL SELECT graph_id, id, 'dependency_cycle', 'error', component, n FROM scc WHERE n > 1),
k AS (SELECT u.*, repo_path || '/' || file_path || ':arch:' || rule AS base, row_number() OVER (PARTITION BY u.graph_id, file_path, rule ORDER BY target NULLS FIRST) AS k FROM u JOIN projects USING (graph_id))
SELECT graph_id, CASE WHEN k = 1 THEN base ELSE base || ':' || (k - 1) END AS id, file_path, rule, level, target, n FROM k""",
    "finding_counts": _F
    + f"""SELECT graph_id, rule, count(*) AS n FROM (
  SELECT graph_id, 'deep_import' AS rule FROM pairs WHERE {_DEEP} UNION ALL SELECT graph_id, 'upward_import' FROM pairs WHERE {_UP}
  UNION ALL SELECT graph_id, 'orphan_module' FROM ({_ORPHAN})) GROUP BY ALL""",
    "public_surface": _F
    + f""", o AS (SELECT graph_id, {organ('tf')} AS organ, sf, tf, contains({folder('tf')}, '/') AS deep FROM pairs WHERE {organ('tf')} <> '' AND {organ('tf')} <> {organ('sf')} AND NOT {peripheral('sf')}),
c AS (SELECT graph_id, tf, count(*) AS consumers FROM o GROUP BY ALL),
x AS (SELECT f.graph_id, {organ('f.file_path')} AS organ, NOT contains({folder('f.file_path')}, '/') AS surface, consumers FROM f LEFT JOIN c ON c.graph_id = f.graph_id AND c.tf = f.file_path WHERE {organ('f.file_path')} <> ''),
y AS (SELECT graph_id, organ, count(*) FILTER (surface) AS surface_files, count(*) FILTER (surface AND consumers IS NULL) AS unused_surface, count(*) FILTER (NOT surface AND consumers >= 2) AS leaked_internals FROM x GROUP BY ALL),
z AS (SELECT graph_id, organ, count(DISTINCT sf) FILTER (NOT deep) AS via_surface, count(DISTINCT sf) FILTER (deep) AS deep_consumers FROM o GROUP BY ALL)
SELECT y.*, coalesce(via_surface, 0) AS via_surface, coalesce(deep_consumers, 0) AS deep_consumers FROM y LEFT JOIN z USING (graph_id, organ)""",
    "hygiene_rollup": _F
    + f""", g AS (
  SELECT graph_id, file_path, count(*) AS n, max(CASE level WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END) AS worst
  FROM nf WHERE list_contains(labels, 'CodeDiagnostic') GROUP BY ALL), {_HUBS}
SELECT h.graph_id, h.directory, sum(coalesce(n, 0))::BIGINT AS n, [NULL, 'info', 'warning', 'error'][max(coalesce(worst, 0)) + 1] AS worst_level
FROM h LEFT JOIN g ON g.graph_id = h.graph_id AND g.file_path = h.file_path GROUP BY ALL""",
    "tree_edges": _F
    + f""", {_HUBS},
a AS (SELECT DISTINCT graph_id, directory AS child, 'directory' AS kind FROM h UNION ALL SELECT graph_id, file_path, 'file' FROM f)
SELECT graph_id, child, {folder('child')} AS parent, kind, (len(string_split(child, '/')) - 1)::INTEGER AS depth FROM a""",
    "web_weights": _F + f"SELECT graph_id, sf, tf, n, {_DEEP} AS violation FROM pairs WHERE NOT {peripheral('sf')}",
    "placement_rank": _F
    + f""", k AS (SELECT p.graph_id || '/' || sf AS item, {_MODULE.format(p='f.file_path')} AS rm FROM pairs p LEFT JOIN f ON f.graph_id = p.graph_id AND f.file_path = p.tf),
c AS (SELECT * FROM (VALUES ('glue'), ('sources'), ('library'), ('scripts')) v(module)),
a AS (SELECT * FROM (VALUES ('glue', '*'), ('sources', 'sources'), ('library', 'sources')) v(module, target)),
s AS (SELECT item, c.module, count(*) FILTER (rm IS NOT NULL AND rm <> c.module AND a.module IS NULL) AS violations, count(*) FILTER (rm IS NULL) AS unknowns, count(*) FILTER (rm = c.module) AS co_located
  FROM k CROSS JOIN c LEFT JOIN a ON a.module = c.module AND a.target = rm GROUP BY ALL),
q AS (SELECT *, round(-violations - 0.4::DOUBLE * unknowns + 0.25::DOUBLE * co_located, 6) AS score FROM s)
SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, violations, unknowns, module)::INTEGER AS place FROM q""",
    "ignored_files": """SELECT doc_id, coalesce(len(list_filter(ignore_patterns, lambda p: list_contains(string_split(file_path, '/'), p) AND NOT starts_with(p, '*')
   OR regexp_matches(split_part(file_path, '/', -1), '^' || replace(replace(p, '.', '\\.'), '*', '.*') || '$'))) > 0, false) AS ignored,
  coalesce(n_chars > max_file_size, false) AS too_large FROM documents LEFT JOIN analyzer_config USING (graph_id)""",
}
