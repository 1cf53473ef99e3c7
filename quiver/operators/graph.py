"""The property graph kept in two tables: its current state, and the ways rows get in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions import paths

NODE_KEY = ["graph_id", "id"]
EDGE_KEY = ["graph_id", "source", "target", "rel_type"]
#: Labels of definitions: what a search for a symbol is after.
DEFINITIONS = ("CodeFunction", "CodeMethod", "CodeClass", "CodeVariable", "CodeInterface", "CodeTypeAlias", "CodeHook", "CodeReactComponent")


def latest(rows: DataFrame, key: list[str], time: str, columns: list[str]) -> DataFrame:
    """The row of each key with the greatest `time`, then the greatest other columns.

    An aggregate rather than a window, so repeated rows of a key are combined before the shuffle.
    """
    rest = [c for c in columns if c not in key and c != time]
    best = F.max(F.struct(time, *rest)).alias("row")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"row.{c}").alias(c) for c in columns if c not in key])


def current_nodes(nodes: DataFrame, *columns: str) -> DataFrame:
    """Nodes as they are now: per key the row loaded last, without those deleted; empty paths become null.

    `columns` beside the key are all that is read; null keys are dropped.
    """
    wanted = [*dict.fromkeys([*NODE_KEY, "loaded_at", "deleted_at", *columns])]
    rows = nodes.where(F.col("graph_id").isNotNull() & F.col("id").isNotNull())
    out = latest(rows, NODE_KEY, "loaded_at", wanted).where(F.col("deleted_at").isNull())
    if "file_path" in columns:
        out = out.withColumn("file_path", F.nullif("file_path", F.lit("")))
    return out.select(*dict.fromkeys([*NODE_KEY, *columns]))


def current_edges(edges: DataFrame, *columns: str) -> DataFrame:
    """Distinct edges, the row loaded first deciding further columns; edges with a null or empty end are left out."""
    usable = (F.col("source") != "") & (F.col("target") != "") & F.col("graph_id").isNotNull()
    rows = edges.where(usable)
    extra = [c for c in columns if c not in EDGE_KEY]
    if not extra:
        return rows.select(*EDGE_KEY).distinct()
    first = F.min(F.struct("loaded_at", *[c for c in extra if c != "loaded_at"])).alias("row")
    return rows.groupBy(*EDGE_KEY).agg(first).select(*EDGE_KEY, *[F.col(f"row.{c}").alias(c) for c in extra])


def has_label(label: str) -> Column:
    return F.array_contains("labels", label)


def relative(rows: DataFrame, projects: DataFrame, column: str = "file_path") -> DataFrame:
    """`column` below its graph's repository root."""
    roots = projects.groupBy("graph_id").agg(F.min("repo_path").alias("repo_path"))
    return rows.join(roots, "graph_id", "left").withColumn(column, paths.relative_path(F.col(column), F.col("repo_path"))).drop("repo_path")


def upsert_nodes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge nodes (key, labels, file_path, is_external, properties, loaded_at).

    The last row wins; but if an import stub meets the anchor of a file under one id, in either order, the labels are
    united, the properties of the row with more of them win, and a path once known stays. Null properties count as
    none. With an empty side the other comes out as it is.
    """
    both = stored.select(*_NODE).unionByName(incoming.select(*_NODE))
    anchor = F.array_contains("labels", "CodeFile") | F.array_contains("labels", "CodeModule")
    stub = F.array_contains("labels", "CodeImport")
    merged = both.groupBy(*NODE_KEY).agg(
        F.max(F.struct("loaded_at", "file_path", "is_external", "properties", "labels")).alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("united"),
        (F.bool_or(anchor) & F.bool_or(stub)).alias("collision"),
        F.max(F.struct(F.coalesce(F.length("properties"), F.lit(0)).alias("size"), "properties")).alias("richest"),
        F.max("file_path").alias("known_path"),
        F.bool_and("is_external").alias("all_external"),
    )
    return merged.select(
        *NODE_KEY,
        F.when(F.col("collision"), F.col("united")).otherwise(F.array_sort("last.labels")).alias("labels"),
        F.when(F.col("collision"), F.col("known_path")).otherwise(F.col("last.file_path")).alias("file_path"),
        F.when(F.col("collision"), F.col("all_external")).otherwise(F.col("last.is_external")).alias("is_external"),
        F.when(F.col("collision"), F.col("richest.properties")).otherwise(F.col("last.properties")).alias("properties"),
        F.col("last.loaded_at").alias("loaded_at"),
    )


_NODE = [*NODE_KEY, "labels", "file_path", "is_external", "properties", "loaded_at"]


def insert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append the edges that aren't stored yet; of repeated incoming ones one stays."""
    new = incoming.dropDuplicates(EDGE_KEY).join(stored.select(*EDGE_KEY).distinct(), EDGE_KEY, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def delete_graphs(rows: DataFrame, graph_ids: DataFrame) -> DataFrame:
    """Any table of the graph without the rows of the given graphs."""
    return rows.join(graph_ids.select("graph_id").distinct(), "graph_id", "left_anti")


def delete_file_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes without those of the given (graph_id, file_path)."""
    return nodes.join(files.select("graph_id", "file_path").distinct(), ["graph_id", "file_path"], "left_anti")


def delete_file_edges(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges without those the given files own; ownerless ones go if an end lies in such a file.

    Edges that another file owns stay, also where they end in a deleted file.
    """
    gone = files.select("graph_id", F.col("file_path").alias("owner_file_path")).distinct()
    owned = edges.where(F.col("owner_file_path").isNotNull()).join(gone, ["graph_id", "owner_file_path"], "left_anti")
    ids = nodes.join(files.select("graph_id", "file_path").distinct(), ["graph_id", "file_path"], "left_semi").select("graph_id", "id").distinct()
    free = edges.where(F.col("owner_file_path").isNull())
    for end in ("source", "target"):
        free = free.join(ids.withColumnRenamed("id", end), ["graph_id", end], "left_anti")
    return owned.unionByName(free.select(*owned.columns))


def register_projects(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Catalog upsert: the incoming row wins, `created_at` stays what it was."""
    s, i = stored.alias("s"), incoming.alias("i")
    joined = s.join(i, "graph_id", "full_outer")
    return joined.select(
        "graph_id",
        F.coalesce("i.repo_path", "s.repo_path").alias("repo_path"),
        F.coalesce("s.created_at", "i.created_at").alias("created_at"),
        F.coalesce("i.last_indexed", "s.last_indexed").alias("last_indexed"),
        F.coalesce("i.file_count", "s.file_count").alias("file_count"),
        F.coalesce("i.sync_enabled", "s.sync_enabled").alias("sync_enabled"),
    )
