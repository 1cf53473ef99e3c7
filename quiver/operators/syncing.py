"""Sync runs: facts of changed files replaced, those of deleted files removed, hashes brought up to date.

A run is a function of tables to tables. `extracted` are the facts read from the files that are synced, nodes with
(graph_id, id, file_path, ...) and edges with (graph_id, source, target, rel_type, owner_file_path, ...).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from quiver.operators.graph import EDGE_KEY, NODE_KEY, delete_file_edges, insert_edges
from quiver.operators.stores import upsert
from quiver.operators.sync import change_report


@dataclass
class State:
    """A graph's tables; `hashes` are (graph_id, file_path, content_hash)."""

    nodes: DataFrame
    edges: DataFrame
    hashes: DataFrame


_FILE = ["graph_id", "file_path"]


def _without(state: State, files: DataFrame) -> State:
    """The state without the facts of the given files; nodes without a file stay."""
    gone = files.select(*_FILE).distinct()
    return State(
        state.nodes.join(gone, _FILE, "left_anti"),
        delete_file_edges(state.edges, state.nodes, gone),
        state.hashes.join(gone, _FILE, "left_anti"),
    )


def sync_files(state: State, files: DataFrame, extracted_nodes: DataFrame, extracted_edges: DataFrame) -> State:
    """The given files (graph_id, file_path, content_hash) synced: their facts deleted, the extracted ones put in, and
    their hashes stored. Facts of other files are neither read from `extracted` nor touched; a node that another file
    holds under the same id stays as it is."""
    cleared = _without(state, files)
    mine = files.select(*_FILE).distinct()
    nodes = extracted_nodes.join(mine, _FILE, "left_semi").select(*state.nodes.columns).dropDuplicates(NODE_KEY)
    fresh = nodes.join(cleared.nodes.select(*NODE_KEY), NODE_KEY, "left_anti")
    owned = extracted_edges.join(mine.withColumnRenamed("file_path", "owner_file_path"), ["graph_id", "owner_file_path"], "left_semi")
    edges = insert_edges(cleared.edges, owned.select(*state.edges.columns).dropDuplicates(EDGE_KEY))
    return State(cleared.nodes.unionByName(fresh), edges, upsert(cleared.hashes, files.select(*state.hashes.columns), _FILE, "content_hash"))


def sync_targeted(state: State, targets: DataFrame, current: DataFrame, extracted_nodes: DataFrame, extracted_edges: DataFrame) -> State:
    """Only the files of `targets` (graph_id, file_path): those that `current` (with content_hash) still has are synced if
    their hash changed, the others are removed. Files that aren't targets stay, whatever became of them."""
    mine = targets.select(*_FILE).distinct()
    stored, now = state.hashes.join(mine, _FILE, "left_semi"), current.join(mine, _FILE, "left_semi")
    report = change_report(stored, now)
    changed = now.join(report.where("status in ('added', 'modified')"), _FILE, "left_semi")
    return sync_files(_without(state, report.where("status = 'deleted'")), changed, extracted_nodes, extracted_edges)


def sync_full(state: State, current: DataFrame, extracted_nodes: DataFrame, extracted_edges: DataFrame) -> State:
    """All files: what changed is synced, what is gone is removed, what is unchanged isn't read."""
    every = state.hashes.select(*_FILE).union(current.select(*_FILE))
    return sync_targeted(state, every, current, extracted_nodes, extracted_edges)
