"""Answers put together from lookups, traversals and rules; each is a table for all that is asked at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions import paths
from quiver.operators.lookups import node_edges
from quiver.operators.search import top
from quiver.operators.stores import snippet_of


def retrieve(nodes: DataFrame, edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """What is known of each (graph_id, symbol, id): its node with snippet, and its edges either way.

    ``graph_id, symbol, part`` (``node``, ``outgoing``, ``incoming``)``, id, rel_type, snippet``; `id` of an edge is its
    other end. Symbols that were not resolved give no rows. `nodes` have `properties`.
    """
    keys = resolved.select("graph_id", "symbol", "id")
    found = keys.join(nodes.select("graph_id", "id", snippet_of(F.col("properties")).alias("snippet")), ["graph_id", "id"])
    own = found.select("graph_id", "symbol", F.lit("node").alias("part"), "id", F.lit(None).cast("string").alias("rel_type"), "snippet")
    at = node_edges(edges).join(found.select("graph_id", "symbol", "id"), ["graph_id", "id"])
    return own.unionByName(at.select("graph_id", "symbol", F.col("direction").alias("part"), F.col("other").alias("id"), "rel_type", F.lit(None).cast("string").alias("snippet")))


def fallback_retrieve(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """For each (graph_id, query) what stores without a resolver can tell: the node of that id, its distinct neighbours, and
    the files of that name: ``graph_id, query, part`` (``node``, ``neighbour``, ``file``)``, value``."""
    q = asked.select("graph_id", "query").distinct()
    own = nodes.select("graph_id", F.col("id").alias("query")).join(q, ["graph_id", "query"], "left_semi").select("graph_id", "query", F.lit("node").alias("part"), F.col("query").alias("value"))
    near = node_edges(edges).select("graph_id", F.col("id").alias("query"), F.col("other").alias("value")).distinct().join(own.select("graph_id", "query"), ["graph_id", "query"], "left_semi")
    name = F.element_at(F.split("file_path", "/"), -1)
    files = nodes.where(F.col("file_path").isNotNull()).select("graph_id", name.alias("query"), F.col("file_path").alias("value")).distinct().join(q, ["graph_id", "query"], "left_semi")
    return own.unionByName(near.select("graph_id", "query", F.lit("neighbour").alias("part"), "value")).unionByName(files.select("graph_id", "query", F.lit("file").alias("part"), "value"))


def inspect_pages(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The first `limit` nodes and, on their own, the first `limit` edges of each file: ``graph_id, file_path, part, value,
    place``. Nodes are in order of their ids; an edge's value is its source, relation and target."""
    n = nodes.where(F.col("file_path").isNotNull()).select("graph_id", "file_path", F.col("id").alias("value"))
    e = edges.where(F.col("owner_file_path") != "").select("graph_id", F.col("owner_file_path").alias("file_path"), F.concat_ws(" ", "source", "rel_type", "target").alias("value"))
    both = n.withColumn("part", F.lit("node")).unionByName(e.withColumn("part", F.lit("edge")))
    return top(both, ["graph_id", "file_path", "part"], [F.col("value")], limit, "value").select("graph_id", "file_path", "part", "value", "place")


def hotspot_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node: other files it refers to, and references to it from production code: ``graph_id, id, imported_files,
    production_refs``."""
    files = nodes.select("graph_id", "id", "file_path")
    s = files.select("graph_id", F.col("id").alias("source"), F.col("file_path").alias("sf"))
    t = files.select("graph_id", F.col("id").alias("target"), F.col("file_path").alias("tf"))
    refs = edges.select("graph_id", "source", "target").distinct().join(s, ["graph_id", "source"]).join(t, ["graph_id", "target"])
    out = refs.where("sf <> tf").select("graph_id", F.col("source").alias("id"), "tf").distinct().groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("imported_files"))
    production = refs.where(~F.coalesce(paths.is_peripheral(F.col("sf")), F.lit(False))).groupBy("graph_id", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("production_refs"))
    both = out.join(production, ["graph_id", "id"], "full_outer")
    return both.select("graph_id", "id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("imported_files", "production_refs")])


def cycle_rings(components: DataFrame) -> DataFrame:
    """Members of each strong component of two or more, numbered by path: ``graph_id, component, file_path, place, n``.

    A ring may hold most files of a graph, so places are counted by the path's first segments and within them.
    """
    size = components.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = components.join(size, ["graph_id", "component"]).withColumn("start", F.substring("id", 1, 24))
    starts = rows.groupBy("graph_id", "component", "start").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("graph_id", "component").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = starts.select("graph_id", "component", "start", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("graph_id", "component", "start").orderBy("id"))
    placed = rows.join(base, ["graph_id", "component", "start"]).withColumn("place", F.col("base") + within)
    return placed.select("graph_id", "component", F.col("id").alias("file_path"), "place", "n")


def index_status(projects: DataFrame, freshness: DataFrame, files: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row a graph: catalog entry, indexed files, dirty files, staleness, and embeddings of the current model.

    `freshness` as of `sync.freshness`, `files` (graph_id, files), `embeddings` (graph_id, embedded, coverage).
    """
    rows = projects.select("graph_id", "repo_path", "last_indexed").join(freshness.select("graph_id", "dirty", "stale", "sync_enabled"), "graph_id", "left")
    rows = rows.join(files.select("graph_id", "files"), "graph_id", "left").join(embeddings.select("graph_id", "embedded", "coverage"), "graph_id", "left")
    return rows.select("graph_id", "repo_path", "last_indexed", "sync_enabled", F.coalesce("files", F.lit(0)).alias("files"), "dirty", "stale", F.coalesce("embedded", F.lit(0)).alias("embedded"), "coverage")


def change_briefing(callers: DataFrame, modules: DataFrame, rings: DataFrame, surfaces: DataFrame, ranks: DataFrame, findings: DataFrame) -> DataFrame:
    """What to know before a seed is changed, per module of its callers: ``graph_id, seed, module, callers, nearest,
    in_ring, on_surface, best_rank, findings``.

    `callers` (graph_id, seed, id, depth, file_path) are those that depend on the seed, `modules` (graph_id, file_path,
    module), `rings` and `surfaces` (graph_id, file_path), `ranks` (graph_id, file_path, rank), `findings` (graph_id,
    file_path, rule). Callers of no module are together under a null.
    """
    files = callers.where(F.col("file_path").isNotNull()).groupBy("graph_id", "seed", "file_path").agg(F.count(F.lit(1)).alias("callers"), F.min("depth").alias("nearest"))
    mark = lambda df, name: df.select("graph_id", "file_path").distinct().withColumn(name, F.lit(1))
    f = findings.groupBy("graph_id", "file_path").agg(F.count(F.lit(1)).alias("findings"))
    r = ranks.groupBy("graph_id", "file_path").agg(F.min("rank").alias("rank"))
    on = ["graph_id", "file_path"]
    rows = files.join(modules, on, "left").join(mark(rings, "ring"), on, "left").join(mark(surfaces, "surface"), on, "left").join(r, on, "left").join(f, on, "left")
    return rows.groupBy("graph_id", "seed", "module").agg(
        F.sum("callers").alias("callers"), F.min("nearest").alias("nearest"), F.count("ring").alias("in_ring"), F.count("surface").alias("on_surface"),
        F.min("rank").alias("best_rank"), F.sum(F.coalesce("findings", F.lit(0))).alias("findings"),
    )


def declared_surfaces(pairs: DataFrame, files: DataFrame, modules: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Per declared module, use of its declared surface: ``graph_id, module, file_path, surface, barrel, consumers``.

    `modules` (graph_id, file_path, module), `surfaces` (module, pattern) as a person declares them. Consumers are the
    distinct production files of other modules; a barrel is a surface file that itself depends on files of its module.
    A surface file without consumers is an unused export, another file with two or more a leaked internal.
    """
    declared = surfaces.groupBy("module").agg(F.collect_set("pattern").alias("patterns"))  # what a person typed
    known = files.join(modules.where(F.col("module").isNotNull()), ["graph_id", "file_path"]).join(declared, "module", "left")
    fits = F.exists(F.coalesce("patterns", F.array().cast("array<string>")), lambda g: F.regexp_like(F.col("file_path"), paths.glob_pattern(g)))
    own = known.select("graph_id", "module", "file_path", fits.alias("surface"))
    s = modules.select("graph_id", F.col("file_path").alias("sf"), F.col("module").alias("sm"))
    t = modules.select("graph_id", F.col("file_path").alias("tf"), F.col("module").alias("tm"))
    ends = pairs.select("graph_id", "sf", "tf").distinct().join(s, ["graph_id", "sf"], "left").join(t, ["graph_id", "tf"])
    used = ends.where(~F.col("sm").eqNullSafe(F.col("tm")) & ~paths.is_peripheral(F.col("sf"))).groupBy("graph_id", F.col("tf").alias("file_path")).agg(F.count(F.lit(1)).alias("consumers"))
    inner = ends.where(F.col("sm") == F.col("tm")).select("graph_id", F.col("sf").alias("file_path")).distinct().withColumn("inner", F.lit(True))
    rows = own.join(used, ["graph_id", "file_path"], "left").join(inner, ["graph_id", "file_path"], "left")
    return rows.select("graph_id", "module", "file_path", "surface", (F.col("surface") & F.coalesce("inner", F.lit(False))).alias("barrel"), F.coalesce("consumers", F.lit(0)).alias("consumers"))
