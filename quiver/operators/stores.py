"""Tables beside the graph: embeddings, snippets, community assignments, and how they get in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_KEY = ["graph_id", "node_id", "model"]


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """The incoming row of each key if there is one, else the stored one; of several the one with the greatest `order`.

    Null keys equal each other. Both sides have the same columns. An aggregate, so repeated rows of a hot key are
    combined before the shuffle.
    """
    rest = [c for c in stored.columns if c not in key and c != order]
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct(order, *rest), F.struct("_new", order)).alias("r")
    return both.groupBy(*key).agg(best).select(*key, *[F.col(f"r.{c}").alias(c) for c in (order, *rest)]).select(*stored.columns)


def upsert_embeddings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Embeddings (vec_id, graph_id, node_id, model, vector, ...): one for each node and model tag, the incoming one first."""
    return upsert(stored, incoming, VECTOR_KEY, "vec_id")


def snippet_of(properties: Column) -> Column:
    """The source that a node's properties hold; null if they can't be read or it is blank."""
    text = F.get_json_object(properties, "$.snippet")
    return F.when(F.call_function("try_parse_json", properties).isNotNull() & (F.length(F.trim(text)) > 0), text)


def lookup(store: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Stored rows of the given keys."""
    return store.join(keys.select(*on).distinct(), on, "left_semi")


def set_communities(stored: DataFrame, assignment: DataFrame) -> DataFrame:
    """Assignments (graph_id, id, community) with those of every graph that `assignment` has replaced by it."""
    columns = ["graph_id", "id", "community"]
    kept = stored.join(assignment.select("graph_id").distinct(), "graph_id", "left_anti")
    return kept.select(*columns).unionByName(assignment.select(*columns))


def community_members(assignment: DataFrame) -> DataFrame:
    """Communities with their number of members; a community may hold most nodes, so members stay rows."""
    size = assignment.groupBy("graph_id", "community").agg(F.count(F.lit(1)).alias("members"))
    return assignment.join(size, ["graph_id", "community"]).select("graph_id", "community", "id", "members")


def cached_communities(stored: DataFrame, graphs: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored assignments of the given graphs; `detect` is asked for the graphs that have none."""
    wanted = graphs.select("graph_id").distinct()
    known = stored.join(wanted, "graph_id", "left_semi").select("graph_id", "id", "community")
    missing = wanted.join(stored.select("graph_id").distinct(), "graph_id", "left_anti")
    return known.unionByName(detect(missing).select("graph_id", "id", "community"))


def as_json(rows: DataFrame) -> DataFrame:
    """Every row as one JSON text, nulls left out: what a web view is sent."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
