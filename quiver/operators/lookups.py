"""Named lookups over the graph, each for a whole table of keys at once.

A single lookup is the same call with a one-row table of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions import paths
from quiver.operators.graph import has_label

SYMBOL_LABELS = ("CodeClass", "CodeFunction", "CodeMethod", "CodeInterface", "CodeTypeAlias")


def nodes_by_id(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Nodes of the given (graph_id, id)."""
    return nodes.join(keys.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi")


def nodes_by_name(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Nodes of exactly the given (graph_id, name)."""
    return nodes.join(keys.select("graph_id", "name").distinct(), ["graph_id", "name"], "left_semi")


def nodes_matching(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes with `text` in id, name or qualified name, in any case; `%` and `_` in it stand for themselves."""
    if not text:
        return nodes.limit(0)
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return nodes.where(F.col("id").ilike(pattern) | F.col("name").ilike(pattern) | F.col("qualname").ilike(pattern))


def nodes_by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(has_label(label))


def nodes_by_file(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """Nodes of the given (graph_id, file_path)."""
    return nodes.join(keys.select("graph_id", "file_path").distinct(), ["graph_id", "file_path"], "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: ``graph_id, id, other, direction, rel_type``."""
    out = edges.select("graph_id", F.col("source").alias("id"), F.col("target").alias("other"), F.lit("outgoing").alias("direction"), "rel_type")
    back = edges.select("graph_id", F.col("target").alias("id"), F.col("source").alias("other"), F.lit("incoming").alias("direction"), "rel_type")
    return out.unionByName(back)


def node_edges(edges: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Edges at each node with their direction as seen from it; a loop counts once, as outgoing."""
    rows = both_ways(edges).where((F.col("id") != F.col("other")) | (F.col("direction") == "outgoing"))
    return rows if keys is None else rows.join(keys.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct adjacent nodes, in either direction, that exist."""
    pairs = both_ways(edges).select("graph_id", "id", "other").distinct()
    known = nodes.select("graph_id", F.col("id").alias("other"))
    return pairs.join(known, ["graph_id", "other"], "left_semi").select("graph_id", "id", "other")


def incoming(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("graph_id", F.col("id").alias("target")).distinct(), ["graph_id", "target"], "left_semi")


def outgoing(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("graph_id", F.col("id").alias("source")).distinct(), ["graph_id", "source"], "left_semi")


def count_files(nodes: DataFrame) -> DataFrame:
    """Distinct file paths per graph; empty ones don't count."""
    return nodes.groupBy("graph_id").agg(F.count_distinct("file_path").alias("files"))


def index_metadata(projects: DataFrame) -> DataFrame:
    """Catalog rows; an unknown switch counts as on."""
    return projects.select("graph_id", "repo_path", "created_at", "last_indexed", "file_count", F.coalesce("sync_enabled", F.lit(True)).alias("sync_enabled"))


def unknown_query(nodes: DataFrame) -> DataFrame:
    """What a query name nobody knows gives: no rows, with the columns of a node."""
    return nodes.limit(0)


def label_bonus() -> Column:
    """Definitions before files and modules, then other nodes, imports and diagnostics."""
    return (
        F.when(F.arrays_overlap("labels", F.array(*map(F.lit, SYMBOL_LABELS))), 100)
        .when(has_label("CodeModule") | has_label("CodeFile"), 90)
        .when(has_label("CodeImport"), 10)
        .when(has_label("CodeDiagnostic"), 0)
        .otherwise(50)
    )


def resolve_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """The node each (graph_id, symbol) means: the id itself, a suffix of it, a qualified name, a name, in this order.

    Among equals definitions win over files, other nodes, imports and diagnostics, then the least id. A suffix starts
    after a dot or a colon; all suffixes of the ids are one side of an equi-join.
    """
    n = nodes.select("graph_id", "id", "name", "qualname", label_bonus().alias("bonus"))
    parts = F.split("id", r"(?<=[.:])")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 20), ""))
    tails = n.where(F.size(parts) > 1).select("graph_id", "id", "bonus", F.explode(suffixes).alias("symbol"), F.lit(800).alias("score"))
    keys = (
        n.select("graph_id", "id", "bonus", F.col("id").alias("symbol"), F.lit(1000).alias("score"))
        .unionByName(tails)
        .unionByName(n.select("graph_id", "id", "bonus", F.col("qualname").alias("symbol"), F.lit(700).alias("score")))
        .unionByName(n.select("graph_id", "id", "bonus", F.col("name").alias("symbol"), F.lit(600).alias("score")))
        .where(F.col("symbol") != "")
    )
    hits = symbols.select("graph_id", "symbol").distinct().join(keys, ["graph_id", "symbol"])
    best = F.min(F.struct((-(F.col("score") + F.col("bonus"))).alias("score"), "id")).alias("b")
    return hits.groupBy("graph_id", "symbol").agg(best).select("graph_id", "symbol", F.col("b.id").alias("id"), (-F.col("b.score")).alias("score"))


def resolve_files(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Files that each (graph_id, query) names by its whole path or a suffix of it, with one node for each.

    ``graph_id, query, file_path, id, candidates``: the file node is taken before the module and other nodes of a file;
    with more than one candidate the name is ambiguous.
    """
    order = F.when(has_label("CodeFile"), 0).when(has_label("CodeModule"), 1).otherwise(2)
    per_file = nodes.where(F.col("file_path").isNotNull()).groupBy("graph_id", "file_path").agg(F.min(F.struct(order.alias("o"), "id")).alias("n"))
    parts = F.split("file_path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1 << 20), "/"))
    keys = per_file.select("graph_id", "file_path", F.col("n.id").alias("id"), F.explode(suffixes).alias("query"))
    hits = names.select("graph_id", "query").distinct().join(keys, ["graph_id", "query"])
    n = hits.groupBy("graph_id", "query").agg(F.count(F.lit(1)).alias("candidates"))
    return hits.join(n, ["graph_id", "query"]).select("graph_id", "query", "file_path", "id", "candidates")


def inspect_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: nodes in it, and edges it owns."""
    n = nodes.where(F.col("file_path").isNotNull()).groupBy("graph_id", "file_path").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.where(F.col("owner_file_path") != "").groupBy("graph_id", F.col("owner_file_path").alias("file_path")).agg(F.count(F.lit(1)).alias("edges"))
    both = n.join(e, ["graph_id", "file_path"], "full_outer")
    return both.select("graph_id", "file_path", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page of an ordered result, with a mark whether there is more after it."""
    cut = rows.orderBy(*order).offset(offset).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # over limit + 1 rows at most
    return cut.withColumn("place", place).withColumn("has_more", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


def diagnostics(nodes: DataFrame, level: str | None = None, rule: str | None = None, production: bool | None = None) -> DataFrame:
    """Diagnostic nodes, filtered by level, rule and whether their file is production code."""
    rows = nodes.where(has_label("CodeDiagnostic")).withColumn("is_test", F.coalesce(paths.is_peripheral(F.col("file_path")), F.lit(False)))
    for column, wanted in (("level", level), ("rule", rule)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    return rows if production is None else rows.where(F.col("is_test") != F.lit(production))


def diagnostic_counts(found: DataFrame) -> DataFrame:
    """Diagnostics by rule, level and kind of file."""
    return found.groupBy("graph_id", "rule", "level", "is_test").agg(F.count(F.lit(1)).alias("n"))


def language(rows: DataFrame) -> DataFrame:
    """`language`, where it is missing by the file's ending."""
    ending = F.regexp_extract("file_path", r"\.(\w+)$", 1)
    guess = F.when(ending == "py", "python").when(ending.isin("ts", "tsx"), "typescript").when(ending.isin("js", "jsx", "mjs", "cjs"), "javascript")
    return rows.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), guess))
