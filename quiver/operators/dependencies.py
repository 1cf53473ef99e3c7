"""Dependencies between files, derived from facts about their symbols."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.functions import paths
from quiver.operators.graph import current_edges, current_nodes, has_label, relative
from quiver.session import checkpointed


def is_precise() -> Column:
    """Edges that a compiler resolved: references, and calls that say so."""
    return (F.col("rel_type") == "REFERENCES") | (
        (F.col("rel_type") == "CALLS") & F.coalesce(F.col("resolved_by") == "scip-python", F.lit(False))
    )


def is_import() -> Column:
    return F.col("rel_type").isin("IMPORTS", "IMPORTS_SYMBOL")


def _ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Precise edges with the files of both ends, where both have one and they differ."""
    located = nodes.where(F.col("file_path").isNotNull()).select("graph_id", "id", "file_path")
    s = located.select("graph_id", F.col("id").alias("source"), F.col("file_path").alias("sf"))
    t = located.select("graph_id", F.col("id").alias("target"), F.col("file_path").alias("tf"))
    precise = edges.where(is_precise()).select("graph_id", "source", "target", "rel_type")
    return precise.join(s, ["graph_id", "source"]).join(t, ["graph_id", "target"]).where("sf <> tf")


class FileDependencies:
    """Views over one state of a graph.

    `nodes` and `edges` are the raw tables, `projects` gives the repository roots. Views are lazy plans; what a plan reads
    several times it shuffles once. With `keep`, the current nodes and the edges that can make a dependency are worked
    out once and kept in the shared folder, for callers that run several views.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, projects: DataFrame, keep: bool = False) -> None:
        self._raw_nodes, self._raw_edges, self.projects, self._keep = nodes, edges, projects, keep

    @cached_property
    def nodes(self) -> DataFrame:
        return self._kept(relative(current_nodes(self._raw_nodes, "labels", "file_path", "resolved_source"), self.projects))

    @cached_property
    def edges(self) -> DataFrame:
        telling = F.col("rel_type").isin("REFERENCES", "CALLS", "IMPORTS", "IMPORTS_SYMBOL")
        return self._kept(current_edges(self._raw_edges.where(telling), "resolved_by", "from_module"))

    def _kept(self, rows: DataFrame) -> DataFrame:
        return checkpointed(rows) if self._keep else rows

    def precise(self) -> DataFrame:
        """Pairs of files from compiler-resolved edges, one row for each edge."""
        return _ends(self.edges, self.nodes).select("graph_id", "sf", "tf")

    def covered(self) -> DataFrame:
        """Files with at least one precise edge into another file."""
        return self.precise().select("graph_id", F.col("sf").alias("file_path")).distinct()

    def indexed(self) -> DataFrame:
        """Files that have a file node."""
        return self.nodes.where(has_label("CodeFile") & F.col("file_path").isNotNull()).select("graph_id", "file_path").distinct()

    def imported(self) -> DataFrame:
        """Pairs of files from imports whose source resolves to an indexed file."""
        located = self.nodes.where(F.col("file_path").isNotNull()).select("graph_id", F.col("id").alias("source"), F.col("file_path").alias("sf"))
        importing = self.nodes.where(F.col("resolved_source").isNotNull()).select("graph_id", F.col("id").alias("target"), F.col("resolved_source").alias("tf"))
        known = self.indexed().withColumnRenamed("file_path", "tf")
        return (
            self.edges.where(is_import())
            .select("graph_id", "source", "target", "rel_type")
            .join(importing, ["graph_id", "target"])
            .join(relative(known, self.projects, "tf"), ["graph_id", "tf"], "left_semi")
            .join(located, ["graph_id", "source"])
            .where("sf <> tf")
            .select("graph_id", "sf", "tf")
        )

    def edges_of_files(self) -> DataFrame:
        """The dependency edges ``graph_id, sf, tf``: precise ones, and imports of files without any.

        Each symbol edge gives a row, so pairs repeat; pairs within a file and ends without a file give none.
        """
        covered = self.covered().withColumnRenamed("file_path", "sf")
        return self.precise().unionByName(self.imported().join(covered, ["graph_id", "sf"], "left_anti"))

    def pairs(self) -> DataFrame:
        """Distinct pairs with their number of edges."""
        return self.edges_of_files().groupBy("graph_id", "sf", "tf").agg(F.count(F.lit(1)).alias("n"))

    def coverage(self) -> DataFrame:
        """Per graph: covered files, files that only have imports, and how dependencies were resolved."""
        covered = self.covered().withColumn("kind", F.lit("scip"))
        importing = self.imported().select("graph_id", F.col("sf").alias("file_path")).distinct()
        rest = importing.join(self.covered(), ["graph_id", "file_path"], "left_anti").withColumn("kind", F.lit("imports"))
        counts = covered.unionByName(rest).groupBy("graph_id").agg(
            F.count_if(F.col("kind") == "scip").alias("covered_files"), F.count_if(F.col("kind") == "imports").alias("import_files")
        )
        graphs = self.nodes.select("graph_id").distinct()
        c, i = F.coalesce("covered_files", F.lit(0)), F.coalesce("import_files", F.lit(0))
        label = F.when(c > 0, "scip").when(i > 0, "tree-sitter-imports").otherwise("none")
        return graphs.join(counts, "graph_id", "left").select(
            "graph_id", c.cast("bigint").alias("covered_files"), i.cast("bigint").alias("import_files"), label.alias("resolution")
        )

    def import_statements(self) -> DataFrame:
        """File and module of every symbol import that names its module."""
        located = self.nodes.where(F.col("file_path").isNotNull()).select("graph_id", F.col("id").alias("source"), "file_path")
        return (
            self.edges.where((F.col("rel_type") == "IMPORTS_SYMBOL") & (F.col("from_module") != ""))
            .join(located, ["graph_id", "source"])
            .select("graph_id", "file_path", "from_module")
        )


def group_key(path: Column, by: str) -> Column:
    """Key of a file in a matrix by `file`, `directory` or `module` (its organ)."""
    if by not in ("file", "directory", "module"):
        raise ValueError(f"no grouping by {by!r}")
    return path if by == "file" else paths.folder(path) if by == "directory" else paths.organ(paths.folder(path))


def dependency_matrix(pairs: DataFrame, by: str) -> DataFrame:
    """Edges of the matrix: imports and deep imports between groups of files; within a group none are counted."""
    violation = (F.col("reason") == "cross_organ_internal").cast("bigint") * F.col("n")
    return (
        pairs.withColumn("reason", paths.edge_reason(F.col("sf"), F.col("tf")))
        .select("graph_id", group_key(F.col("sf"), by).alias("source"), group_key(F.col("tf"), by).alias("target"), "n", violation.alias("v"))
        .where("source <> target")
        .groupBy("graph_id", "source", "target")
        .agg(F.sum("n").alias("import_count"), F.sum("v").alias("violation_count"))
    )


def matrix_nodes(files: DataFrame, by: str) -> DataFrame:
    """Nodes of the matrix with their module, and whether they are production code."""
    key = F.col("key")
    production = ~paths.is_peripheral(key)
    if by == "file":
        production = production & ~paths.stem(key).isin(*paths.ENTRY_STEMS)
    module = {"file": paths.organ(paths.folder(key)), "directory": paths.organ(key), "module": key}[by]
    return files.groupBy("graph_id", group_key(F.col("file_path"), by).alias("key")).agg(F.count(F.lit(1)).alias("files")).select(
        "graph_id", "key", module.alias("module"), "files", production.alias("production")
    )


def explained_edges(pairs: DataFrame) -> DataFrame:
    """Every pair of files with the reason that allows or forbids it."""
    reason = paths.edge_reason(F.col("sf"), F.col("tf"))
    return pairs.select(
        "graph_id",
        "sf",
        "tf",
        paths.organ(paths.folder(F.col("sf"))).alias("src_organ"),
        paths.organ(paths.folder(F.col("tf"))).alias("dst_organ"),
        reason.alias("reason"),
        (reason != "cross_organ_internal").alias("allowed"),
    )
