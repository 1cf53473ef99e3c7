"""Queries of stores, sync runs and composed answers, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators import compositions as C
from quiver.operators import dependencies as D
from quiver.operators import incremental, lookups, rules, stores, syncing, traverse
from quiver.operators import search as S
from quiver.operators import sync as Y
from quiver.plans import analytics, hygiene, search
from quiver.plans import lookups as named
from quiver.plans import sync as feeds
from quiver.plans.tables import FILES, GRAPH, edges, files, folder, nodes, organ, peripheral, with_
from quiver.session import shared_folder, table
from quiver.sources import files as sources
from quiver.streaming import debounce

# -- stores


def embedding_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with even ids are stored, those with odd ids come in."""
    rows = table(spark, d, "node_embeddings").select("vec_id", "graph_id", "node_id", "model", "dimensions", F.size("vector").alias("elements"))
    return stores.upsert_embeddings(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"))


def snippet_lookup(spark: SparkSession, d: str) -> DataFrame:
    every = nodes(spark, d, "properties", "labels")
    store = every.select("graph_id", "id", stores.snippet_of(F.col("properties")).alias("snippet")).where("snippet is not null")
    return stores.lookup(store, every.where(F.array_contains("labels", "CodeFunction")), ["graph_id", "id"])


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("graph_id", "id", F.substring_index("id", ".", 1).alias("community"))


def community_store(spark: SparkSession, d: str) -> DataFrame:
    synced = table(spark, d, "projects").where("sync_enabled").select("graph_id")
    incoming = _segments(spark, d).join(synced, "graph_id", "left_semi")
    return stores.community_members(stores.set_communities(analytics._organ_labels(spark, d), incoming))


def community_cache(spark: SparkSession, d: str) -> DataFrame:
    projects = table(spark, d, "projects")
    stored = analytics._organ_labels(spark, d).join(projects.where("sync_enabled").select("graph_id"), "graph_id", "left_semi")
    detect = lambda missing: _segments(spark, d).join(missing, "graph_id", "left_semi")
    return stores.cached_communities(stored, projects, detect)


def graph_json(spark: SparkSession, d: str) -> DataFrame:
    return stores.as_json(named.graph_list(spark, d))


# -- sync runs


def _state(spark: SparkSession, d: str) -> tuple[syncing.State, DataFrame, DataFrame, DataFrame]:
    """The stored state, current hashes, and the facts that reading all files would give: here those of the tables."""
    n, e = nodes(spark, d, "file_path"), edges(spark, d, "owner_file_path")
    old = n.withColumn("fresh", F.lit(False)), e.withColumn("fresh", F.lit(False))
    stored = feeds._stored(spark, d)
    state = syncing.State(*old, stored)
    return state, feeds._current(spark, d), n.withColumn("fresh", F.lit(True)), e.withColumn("fresh", F.lit(True))


def _synced(spark: SparkSession, d: str, targets: DataFrame | None) -> syncing.State:
    state, current, n, e = _state(spark, d)
    return syncing.sync_full(state, current, n, e) if targets is None else syncing.sync_targeted(state, targets, current, n, e)


def sync_full_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d, None).nodes.select("graph_id", "id", "file_path", "fresh")


def sync_full_edges(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d, None).edges.select("graph_id", "source", "target", "rel_type", "owner_file_path", "fresh")


def sync_full_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _synced(spark, d, None).hashes


def sync_targeted_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Targets: the Python files."""
    targets = table(spark, d, "file_hashes").where("file_path like '%.py'").select("graph_id", "file_path")
    return _synced(spark, d, targets).nodes.select("graph_id", "id", "file_path", "fresh")


def freshness_prefilter(spark: SparkSession, d: str) -> DataFrame:
    crawled = table(spark, d, "documents").groupBy("graph_id", "file_path").agg(F.max("crawled_at").alias("modified"))
    return sources.changed_since(crawled, table(spark, d, "file_hashes")).select("graph_id", "file_path")


def hash_stream(spark: SparkSession, d: str) -> DataFrame:
    """The last hash of each file, kept by a stream over the history."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    table(spark, d, "file_hashes").where("content_hash is not null").repartition(4).write.parquet(f"{root}/feed")
    feed = debounce.change_feed(spark, f"{root}/feed", table(spark, d, "file_hashes").schema, 2)
    debounce.run_batches(feed, debounce.merge_latest(f"{root}/state"), f"{root}/checkpoint")
    return debounce.latest_state(spark, f"{root}/state").select("graph_id", "file_path", "content_hash")


def distinct_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events without repetitions, by a stream."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    feeds._events(spark, d).write.parquet(f"{root}/feed")
    feed = debounce.change_feed(spark, f"{root}/feed", "key bigint, ts timestamp", 1000)
    return debounce.run_available(debounce.distinct_changes(feed, ["key", "ts"]), f"{root}/out", f"{root}/checkpoint")


# -- composed answers


def retrieve(spark: SparkSession, d: str) -> DataFrame:
    return C.retrieve(nodes(spark, d, "properties"), edges(spark, d), named.symbol_resolve(spark, d))


def fallback_retrieve(spark: SparkSession, d: str) -> DataFrame:
    every = nodes(spark, d, "labels", "file_path")
    classes = every.where(F.array_contains("labels", "CodeClass")).select("graph_id", F.col("id").alias("query"))
    names = table(spark, d, "documents").select("graph_id", F.element_at(F.split("file_path", "/"), -1).alias("query"))
    return C.fallback_retrieve(every, edges(spark, d), classes.unionByName(names))


def inspect_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.inspect_pages(nodes(spark, d, "file_path"), edges(spark, d, "owner_file_path"), 5)


def hotspot_files(spark: SparkSession, d: str) -> DataFrame:
    return C.hotspot_files(edges(spark, d), nodes(spark, d, "file_path"))


def cycle_ring(spark: SparkSession, d: str) -> DataFrame:
    return C.cycle_rings(hygiene._components(spark, d))


def index_status(spark: SparkSession, d: str) -> DataFrame:
    config = table(spark, d, "analyzer_config")
    done = analytics.embedding_status(spark, d).where("not stale").join(config.select("graph_id", F.col("embedding_model").alias("model")), ["graph_id", "model"], "left_semi")
    counts = lookups.count_files(nodes(spark, d, "file_path"))
    return C.index_status(table(spark, d, "projects"), feeds.freshness(spark, d), counts, done)


#: Surfaces as a person would declare them for the modules of the architecture.
SURFACES = [("sources", "src/*/__init__.py"), ("sources", "src/*/index.*"), ("library", "*__init__.py"), ("library", "*/api*"), ("scripts", "*index.*"), ("scripts", "*main.*")]


def declared_surface(spark: SparkSession, d: str) -> DataFrame:
    view = files(spark, d, keep=True)
    modules = rules.assign_modules(view.indexed(), hygiene._architecture(spark)[0])
    return C.declared_surfaces(view.pairs(), view.indexed(), modules, spark.createDataFrame(SURFACES, "module string, pattern string"))


def change_briefing(spark: SparkSession, d: str) -> DataFrame:
    """Of the hub of each graph, callers up to five steps away, by the files they are in."""
    view = files(spark, d, keep=True)
    found = traverse.reach(traverse.steps(edges(spark, d), "up"), analytics._seeds(spark, d), 5, known=nodes(spark, d)).where("id <> seed")
    callers = found.join(view.nodes.select("graph_id", "id", "file_path"), ["graph_id", "id"])
    modules = rules.assign_modules(view.indexed(), hygiene._architecture(spark)[0])
    rings = view.pairs().where("sf <= tf").join(view.pairs().select("graph_id", F.col("sf").alias("tf"), F.col("tf").alias("sf")), ["graph_id", "sf", "tf"], "left_semi")
    rings = rings.select("graph_id", F.col("sf").alias("file_path")).union(rings.select("graph_id", "tf"))
    surfaces = view.indexed().where(~F.contains(D.paths.folder(F.col("file_path")), F.lit("/")))
    ranks = view.pairs().groupBy("graph_id", F.col("tf").alias("file_path")).agg(F.count(F.lit(1)).alias("rank"))
    findings = rules.deep_imports(view.pairs()).unionByName(rules.upward_imports(view.pairs()))
    return C.change_briefing(callers, modules, rings, surfaces, ranks, findings)


# -- search


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors of nodes, and of those whose id is divisible by 100 the vector and the name of their node as queries."""
    rows = table(spark, d, "node_embeddings").where("model = 'loom-mini#v3' and size(vector) = 48")
    v = rows.select("vec_id", "graph_id", F.col("node_id").alias("id"), F.col("vector").cast("array<double>").alias("v")).where(F.forall("v", lambda x: ~F.isnan(x)))
    asked = v.where("vec_id % 100 = 0")
    texts = asked.join(nodes(spark, d, "name"), ["graph_id", "id"]).select(F.col("vec_id").alias("query_id"), F.col("name").alias("text"))
    return v, asked.select(F.col("vec_id").alias("query_id"), "v"), texts


def _places(ranking: DataFrame) -> DataFrame:
    return ranking.select(F.col("query_id").alias("query"), F.concat_ws(" ", "graph_id", "id").alias("node"), "place")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by the fusion of a vector ranking and a keyword ranking of the same queries."""
    v, asked, texts = _asked(spark, d)
    known = v.join(nodes(spark, d), ["graph_id", "id"], "left_semi").groupBy("graph_id", "id").agg(F.max_by("v", "vec_id").alias("v"))
    return S.rrf(_places(S.best_cosines(known, asked, ["graph_id", "id"], 20)), _places(S.word_ranking(nodes(spark, d, "name"), texts, 20)), "node", 20)


def word_search(spark: SparkSession, d: str) -> DataFrame:
    return S.word_ranking(nodes(spark, d, "name"), _asked(spark, d)[2], 20)


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods of all graphs nearest to each query, the kind filtered before the best are taken."""
    v, asked, _ = _asked(spark, d)
    wanted = nodes(spark, d, "labels").where(F.arrays_overlap("labels", F.array(F.lit("CodeFunction"), F.lit("CodeMethod"))))
    rows = v.join(wanted.select("graph_id", "id"), ["graph_id", "id"], "left_semi").groupBy("graph_id", "id").agg(F.max_by("v", "vec_id").alias("v"))
    return S.best_cosines(rows, asked, ["graph_id", "id"], 10)


def distance_search(spark: SparkSession, d: str) -> DataFrame:
    v = search._vectors(spark, d)
    return S.nearest_by_distance(v, v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def embed_batch(spark: SparkSession, d: str) -> DataFrame:
    out = S.embed(search.embedding_text(spark, d))
    return out.select("graph_id", "id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def dispatched_search(spark: SparkSession, d: str) -> DataFrame:
    """What an unknown kind of search gives: the hybrid."""
    return S.search("no such kind", hybrid=lambda: hybrid_search(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        embedding_store, snippet_lookup, community_store, community_cache, graph_json, sync_full_nodes, sync_full_edges, sync_full_hashes,
        sync_targeted_nodes, freshness_prefilter, hash_stream, distinct_stream, retrieve, fallback_retrieve, inspect_pages, hotspot_files,
        cycle_ring, index_status, declared_surface, change_briefing, hybrid_search, word_search, semantic_search, dispatched_search,
        distance_search, embed_batch,
    )
}

_G = with_(GRAPH)
_F = with_(FILES)
_SNIPPET = "CASE WHEN json_valid(properties) THEN nullif(json_extract_string(properties, '$.snippet'), '') END"
_ORGAN = f"SELECT graph_id, id, coalesce(nullif({organ('file_path')}, ''), split_part(id, '.', 1)) AS community FROM n"
_SEGMENT = "SELECT graph_id, id, split_part(id, '.', 1) AS community FROM n"
_SYNCED = "graph_id IN (SELECT graph_id FROM projects WHERE sync_enabled)"
_REPORT = feeds._C.replace("WITH c AS", ", c AS", 1).rsplit("f AS (SELECT", 1)[0].rstrip().rstrip(",")


def _run(where: str) -> str:
    """The graph, the files that a run with these targets touches, and the nodes that are left of the old state."""
    return (
        GRAPH
        + _REPORT
        + f""",
touched AS (SELECT graph_id, file_path, status FROM r WHERE status <> 'unchanged' AND {where}),
again AS (SELECT graph_id, file_path FROM touched WHERE status <> 'deleted'),
old_n AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.graph_id = n.graph_id AND t.file_path = n.file_path)),
new_n AS (SELECT * FROM n WHERE EXISTS (SELECT 1 FROM again t WHERE t.graph_id = n.graph_id AND t.file_path = n.file_path)),
gone AS (SELECT n.graph_id, n.id FROM n JOIN touched t ON t.graph_id = n.graph_id AND t.file_path = n.file_path),
old_e AS (SELECT * FROM e WHERE CASE WHEN owner_file_path IS NOT NULL
  THEN NOT EXISTS (SELECT 1 FROM touched t WHERE t.graph_id = e.graph_id AND t.file_path = e.owner_file_path)
  ELSE NOT EXISTS (SELECT 1 FROM gone g WHERE g.graph_id = e.graph_id AND (g.id = e.source OR g.id = e.target)) END),
new_e AS (SELECT * FROM e WHERE EXISTS (SELECT 1 FROM again t WHERE t.graph_id = e.graph_id AND t.file_path = e.owner_file_path))
"""
    )


_NODES = "SELECT graph_id, id, file_path, false AS fresh FROM old_n UNION ALL SELECT graph_id, id, file_path, true FROM new_n"
_VECTORS = f"""v AS (SELECT vec_id, graph_id, node_id AS id, vector::DOUBLE[] AS v FROM node_embeddings
  WHERE model = 'loom-mini#v3' AND len(vector) = 48 AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
one AS (SELECT * FROM v WHERE (graph_id, id) IN (SELECT graph_id, id FROM n) QUALIFY row_number() OVER (PARTITION BY graph_id, id ORDER BY vec_id DESC) = 1)"""
_WORDS = """tx AS (SELECT a.vec_id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(n.name, '')), '[a-z0-9]+')) AS w
  FROM node_embeddings a JOIN n ON n.graph_id = a.graph_id AND n.id = a.node_id
  WHERE model = 'loom-mini#v3' AND len(vector) = 48 AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND vec_id % 100 = 0),
tw AS (SELECT query_id, len(w) AS words, unnest(w) AS word FROM tx),
nw AS (SELECT graph_id, id, unnest(list_distinct(regexp_extract_all(lower(coalesce(name, '')), '[a-z0-9]+'))) AS word FROM n),
wr AS (SELECT query_id, graph_id, id, round(count(*)::DOUBLE / words, 6) AS score FROM nw JOIN tw USING (word) GROUP BY query_id, words, graph_id, id),
wp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, graph_id, id)::INTEGER AS place FROM wr QUALIFY place <= 20)"""
_HYBRID = (
    _G.rstrip()
    + f""", {_VECTORS}, {_WORDS},
s AS (SELECT q.vec_id AS query_id, one.graph_id, one.id, round(list_cosine_similarity(one.v, q.v), 6) AS score FROM one JOIN v q ON q.vec_id % 100 = 0),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, graph_id, id)::INTEGER AS place FROM s QUALIFY place <= 20),
u AS (SELECT query_id, graph_id || ' ' || id AS node, round(coalesce(1.0::DOUBLE / (60 + sp.place), 0) + coalesce(1.0::DOUBLE / (60 + wp.place), 0), 6) AS score, coalesce(sp.place, 1 << 30) AS ps
  FROM sp FULL JOIN wp USING (query_id, graph_id, id))
SELECT query_id AS query, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ps, node)::INTEGER AS place FROM u QUALIFY place <= 20"""
)
_GLOBS = "CASE {m} WHEN 'sources' THEN regexp_matches({p}, '^src/.*/__init__\\.py$|^src/.*/index\\..*$') WHEN 'library' THEN regexp_matches({p}, '^.*__init__\\.py$|^.*/api.*$') WHEN 'scripts' THEN regexp_matches({p}, '^.*index\\..*$|^.*main\\..*$') ELSE false END"
_MODULE = hygiene._MODULE

SQL = {
    "embedding_store": """SELECT vec_id, graph_id, node_id, model, dimensions, len(vector)::INTEGER AS elements FROM node_embeddings
QUALIFY row_number() OVER (PARTITION BY graph_id, node_id, model ORDER BY vec_id % 2 DESC, vec_id DESC) = 1""",
    "snippet_lookup": _G + f"SELECT graph_id, id, {_SNIPPET} AS snippet FROM n WHERE list_contains(labels, 'CodeFunction') AND length(trim({_SNIPPET})) > 0",
    "community_store": _G.rstrip()
    + f", a AS (SELECT * FROM ({_ORGAN}) WHERE NOT coalesce({_SYNCED}, false) UNION ALL SELECT * FROM ({_SEGMENT}) WHERE {_SYNCED}) SELECT graph_id, community, id, count(*) OVER (PARTITION BY graph_id, community) AS members FROM a",
    "community_cache": _G
    + f"SELECT * FROM ({_ORGAN}) WHERE {_SYNCED} UNION ALL SELECT * FROM ({_SEGMENT}) WHERE graph_id IN (SELECT graph_id FROM projects WHERE NOT coalesce(sync_enabled, false) OR graph_id NOT IN (SELECT graph_id FROM n))",
    "sync_full_nodes": "WITH " + _run("true").strip() + "\n" + _NODES,
    "sync_targeted_nodes": "WITH " + _run("file_path LIKE '%.py' AND (graph_id, file_path) IN (SELECT graph_id, file_path FROM file_hashes)").strip() + "\n" + _NODES,
    "sync_full_edges": "WITH "
    + _run("true").strip()
    + """
SELECT graph_id, source, target, rel_type, owner_file_path, false AS fresh FROM old_e UNION ALL SELECT graph_id, source, target, rel_type, owner_file_path, true FROM new_e x
WHERE NOT EXISTS (SELECT 1 FROM old_e o WHERE o.graph_id = x.graph_id AND o.source = x.source AND o.target = x.target AND o.rel_type = x.rel_type)""",
    "sync_full_hashes": "WITH " + (_REPORT.lstrip(", \n") + " SELECT graph_id, file_path, ch AS content_hash FROM c"),
    "freshness_prefilter": """SELECT graph_id, file_path FROM (SELECT graph_id, file_path, max(crawled_at) AS modified FROM documents GROUP BY ALL)
LEFT JOIN (SELECT graph_id, file_path, max(indexed_at) AS indexed_at FROM file_hashes GROUP BY ALL) USING (graph_id, file_path) WHERE indexed_at IS NULL OR modified >= indexed_at""",
    "hash_stream": "SELECT graph_id, file_path, arg_max(content_hash, (indexed_at, content_hash)) AS content_hash FROM file_hashes WHERE content_hash IS NOT NULL GROUP BY ALL",
    "distinct_stream": "SELECT DISTINCT user_id AS key, ts AT TIME ZONE 'UTC' AS ts FROM events",
    "retrieve": "WITH res AS (" + named.SQL["symbol_resolve"] + "),\n" + GRAPH.strip()
    + f""",
nd AS (SELECT r.graph_id, r.symbol, n.id, {_SNIPPET} AS snippet FROM res r JOIN n ON n.graph_id = r.graph_id AND n.id = r.id)
SELECT graph_id, symbol, 'node' AS part, id, NULL::VARCHAR AS rel_type, CASE WHEN length(trim(snippet)) > 0 THEN snippet END AS snippet FROM nd
UNION ALL SELECT nd.graph_id, symbol, 'outgoing', e.target, rel_type, NULL FROM nd JOIN e ON e.graph_id = nd.graph_id AND e.source = nd.id
UNION ALL SELECT nd.graph_id, symbol, 'incoming', e.source, rel_type, NULL FROM nd JOIN e ON e.graph_id = nd.graph_id AND e.target = nd.id WHERE e.source <> e.target""",
    "fallback_retrieve": _G.rstrip()
    + """, q AS (SELECT graph_id, id AS query FROM n WHERE list_contains(labels, 'CodeClass') UNION SELECT graph_id, split_part(file_path, '/', -1) FROM documents),
own AS (SELECT graph_id, id AS query FROM n WHERE (graph_id, id) IN (SELECT graph_id, query FROM q))
SELECT graph_id, query, 'node' AS part, query AS value FROM own
UNION ALL SELECT DISTINCT o.graph_id, query, 'neighbour', x.other FROM own o JOIN (SELECT graph_id, source AS id, target AS other FROM e UNION SELECT graph_id, target, source FROM e) x ON x.graph_id = o.graph_id AND x.id = o.query
UNION ALL SELECT DISTINCT n.graph_id, split_part(file_path, '/', -1), 'file', file_path FROM n JOIN q ON q.graph_id = n.graph_id AND q.query = split_part(file_path, '/', -1) WHERE file_path IS NOT NULL""",
    "inspect_pages": _G.rstrip()
    + """, b AS (SELECT graph_id, file_path, 'node' AS part, id AS value FROM n WHERE file_path IS NOT NULL
  UNION ALL SELECT graph_id, owner_file_path, 'edge', source || ' ' || rel_type || ' ' || target FROM e WHERE owner_file_path <> '')
SELECT *, row_number() OVER (PARTITION BY graph_id, file_path, part ORDER BY value)::INTEGER AS place FROM b QUALIFY place <= 5""",
    "hotspot_files": _G.rstrip()
    + f""", x AS (SELECT DISTINCT e.graph_id, e.source, e.target, s.file_path AS sf, t.file_path AS tf FROM e JOIN n s ON s.graph_id = e.graph_id AND s.id = e.source JOIN n t ON t.graph_id = e.graph_id AND t.id = e.target),
i AS (SELECT graph_id, source AS id, count(DISTINCT tf) AS imported_files FROM x WHERE sf <> tf GROUP BY ALL),
p AS (SELECT graph_id, target AS id, count(*) AS production_refs FROM x WHERE NOT coalesce({peripheral('sf')}, false) GROUP BY ALL)
SELECT graph_id, id, coalesce(imported_files, 0) AS imported_files, coalesce(production_refs, 0) AS production_refs FROM i FULL JOIN p USING (graph_id, id)""",
    "cycle_ring": hygiene._F_R + hygiene._REACH + "SELECT graph_id, component, id AS file_path, row_number() OVER (PARTITION BY graph_id, component ORDER BY id) AS place, n FROM scc WHERE n > 1",
    "index_status": "WITH es AS (" + analytics.SQL["embedding_status"] + "), fr AS (" + feeds.SQL["freshness"] + "),\n" + GRAPH.strip()
    + """,
fc AS (SELECT graph_id, count(DISTINCT file_path) AS files FROM n GROUP BY ALL)
SELECT graph_id, repo_path, p.last_indexed, fr.sync_enabled, coalesce(files, 0) AS files, dirty, fr.stale, coalesce(embedded, 0) AS embedded, coverage
FROM projects p LEFT JOIN fr USING (graph_id) LEFT JOIN fc USING (graph_id) LEFT JOIN (SELECT graph_id, embedded, coverage FROM es WHERE NOT stale) USING (graph_id)""",
    "declared_surface": _F.rstrip()
    + f""", m AS (SELECT graph_id, file_path, {_MODULE.format(p='file_path')} AS module FROM f),
x AS (SELECT DISTINCT p.graph_id, p.sf, p.tf, a.module AS sm, b.module AS tm FROM pairs p LEFT JOIN m a ON a.graph_id = p.graph_id AND a.file_path = p.sf JOIN m b ON b.graph_id = p.graph_id AND b.file_path = p.tf),
u AS (SELECT graph_id, tf AS file_path, count(*) AS consumers FROM x WHERE sm IS DISTINCT FROM tm AND NOT {peripheral('sf')} GROUP BY ALL),
i AS (SELECT DISTINCT graph_id, sf AS file_path, true AS inner_ FROM x WHERE sm = tm)
SELECT graph_id, module, file_path, {_GLOBS.format(m='module', p='file_path')} AS surface, {_GLOBS.format(m='module', p='file_path')} AND coalesce(inner_, false) AS barrel, coalesce(consumers, 0) AS consumers
FROM m LEFT JOIN u USING (graph_id, file_path) LEFT JOIN i USING (graph_id, file_path) WHERE module IS NOT NULL""",
    "change_briefing": "WITH RECURSIVE " + FILES.strip()
    + analytics._BASE[len(GRAPH) :]
    + "\n"
    + analytics._walk("t", analytics._UP, 5, True)
    + f""", cl AS (SELECT t.graph_id, seed, nf.file_path, count(*) AS callers, min(depth) AS nearest FROM t JOIN nf ON nf.graph_id = t.graph_id AND nf.id = t.id WHERE t.id <> seed AND nf.file_path IS NOT NULL GROUP BY ALL),
m AS (SELECT graph_id, file_path, {_MODULE.format(p='file_path')} AS module FROM f),
rg AS (SELECT DISTINCT p.graph_id, p.sf AS file_path, 1 AS ring FROM pairs p JOIN pairs o ON o.graph_id = p.graph_id AND o.sf = p.tf AND o.tf = p.sf),
sf AS (SELECT graph_id, file_path, 1 AS surface FROM f WHERE NOT contains({folder('file_path')}, '/')),
rk AS (SELECT graph_id, tf AS file_path, count(*) AS rank FROM pairs GROUP BY ALL),
fd AS (SELECT graph_id, sf AS file_path, count(*) AS findings FROM (SELECT * FROM pairs WHERE {hygiene._DEEP} UNION ALL SELECT * FROM pairs WHERE {hygiene._UP}) GROUP BY ALL)
SELECT graph_id, seed, module, sum(callers)::BIGINT AS callers, min(nearest) AS nearest, count(ring) AS in_ring, count(surface) AS on_surface, min(rank) AS best_rank, sum(coalesce(findings, 0))::BIGINT AS findings
FROM cl LEFT JOIN m USING (graph_id, file_path) LEFT JOIN rg USING (graph_id, file_path) LEFT JOIN sf USING (graph_id, file_path) LEFT JOIN rk USING (graph_id, file_path) LEFT JOIN fd USING (graph_id, file_path) GROUP BY ALL""",
    "hybrid_search": _HYBRID,
    "dispatched_search": _HYBRID,
    "word_search": _G.rstrip() + f", {_WORDS}\nSELECT * FROM wp",
    "semantic_search": _G.rstrip()
    + f""", {_VECTORS},
k AS (SELECT one.* FROM one JOIN n USING (graph_id, id) WHERE list_has_any(labels, ['CodeFunction', 'CodeMethod'])),
s AS (SELECT q.vec_id AS query_id, k.graph_id, k.id, round(list_cosine_similarity(k.v, q.v), 6) AS score FROM k JOIN v q ON q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, graph_id, id)::INTEGER AS place FROM s QUALIFY place <= 10""",
}
SQL["distance_search"] = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(1 / (1 + list_distance(v.v, q.v)), 6) AS score FROM v JOIN v q ON q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS place FROM s QUALIFY place <= 10"""
SQL["embed_batch"] = (
    "WITH tx AS (" + search.SQL["embedding_text"] + """),
b AS (SELECT graph_id, id, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 64) AS p FROM tx),
c AS (SELECT graph_id, id, list_transform(range(64), lambda i: len(list_filter(p, lambda x: x = i))::DOUBLE) AS c FROM b),
z AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM c)
SELECT graph_id, id, list_transform(c, lambda x: CASE WHEN norm > 0 THEN round(x / norm, 6) ELSE 0.0::DOUBLE END) AS vector FROM z"""
)
