"""Stores, sync runs, composed answers and searches on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiver.operators import compositions, search, stores, syncing
from quiver.sources import files
from quiver.streaming import debounce

N = "graph_id string, id string, file_path string, tag string"
E = "graph_id string, source string, target string, rel_type string, owner_file_path string, tag string"
H = "graph_id string, file_path string, content_hash string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def state(spark):
    nodes = [("g", "a1", "a.py", "old"), ("g", "b1", "b.py", "old"), ("g", "c1", "c.py", "old"), ("g", "ext", None, "old")]
    edges = [("g", "a1", "b1", "CALLS", "a.py", "old"), ("g", "b1", "a1", "CALLS", "b.py", "old"), ("g", "c1", "ext", "CALLS", None, "old"), ("g", "ext", "b1", "CALLS", None, "old")]
    hashes = [("g", "a.py", "1"), ("g", "b.py", "1"), ("g", "c.py", "1")]
    return syncing.State(spark.createDataFrame(nodes, N), spark.createDataFrame(edges, E), spark.createDataFrame(hashes, H))


def read(spark):
    """What reading all files gives now: a.py changed, b.py as it was, c.py gone, d.py new."""
    nodes = spark.createDataFrame([("g", "a2", "a.py", "new"), ("g", "b1", "b.py", "new"), ("g", "d1", "d.py", "new")], N)
    edges = spark.createDataFrame([("g", "a2", "b1", "CALLS", "a.py", "new"), ("g", "d1", "a2", "CALLS", "d.py", "new"), ("g", "d1", "a2", "CALLS", "d.py", "new")], E)
    return spark.createDataFrame([("g", "a.py", "2"), ("g", "b.py", "1"), ("g", "d.py", "1")], H), nodes, edges


def test_full_sync_reads_what_changed_and_drops_what_is_gone(spark):
    out = syncing.sync_full(state(spark), *read(spark))
    assert rows(out.nodes, "id", "tag") == [("a2", "new"), ("b1", "old"), ("d1", "new"), ("ext", "old")]
    # an edge that another file owns stays, also where it ends in a file that was read again; ownerless ones go with an end
    assert rows(out.edges, "source", "target", "tag") == [("a2", "b1", "new"), ("b1", "a1", "old"), ("d1", "a2", "new"), ("ext", "b1", "old")]
    assert rows(out.hashes, "file_path", "content_hash") == [("a.py", "2"), ("b.py", "1"), ("d.py", "1")]
    again = syncing.sync_full(out, *read(spark))
    assert rows(again.nodes, "id", "tag") == rows(out.nodes, "id", "tag") and rows(again.hashes, *H.replace(" string", "").split(", ")) == rows(out.hashes, *H.replace(" string", "").split(", "))


def test_targeted_sync_touches_the_targets_alone(spark):
    targets = spark.createDataFrame([("g", "d.py"), ("g", "c.py"), ("g", "nowhere.py")], "graph_id string, file_path string")
    out = syncing.sync_targeted(state(spark), targets, *read(spark))
    assert rows(out.nodes, "id", "tag") == [("a1", "old"), ("b1", "old"), ("d1", "new"), ("ext", "old")]
    assert rows(out.hashes, "file_path", "content_hash") == [("a.py", "1"), ("b.py", "1"), ("d.py", "1")]
    none = syncing.sync_targeted(state(spark), targets.limit(0), *read(spark))
    assert none.nodes.count() == 4 and none.edges.count() == 4


def test_upsert_and_communities(spark):
    schema = "graph_id string, node_id string, model string, vec_id bigint, extra string"
    stored = spark.createDataFrame([("g", "a", "m", 1, "s"), ("g", "b", "m", 9, "s"), (None, "c", None, 1, "s")], schema)
    new = spark.createDataFrame([("g", "b", "m", 2, "n"), ("g", "b", "m", 3, None), (None, "c", None, 5, "n")], schema)
    assert rows(stores.upsert_embeddings(stored, new), "node_id", "vec_id", "extra") == [("a", 1, "s"), ("b", 3, None), ("c", 5, "n")]
    assert rows(stores.upsert_embeddings(stored, new.limit(0)), "vec_id") == [(1,), (1,), (9,)]
    c = "graph_id string, id string, community string"
    old, fresh = spark.createDataFrame([("g", "a", "1"), ("h", "a", "1"), ("h", "b", "1")], c), spark.createDataFrame([("g", "a", "2"), ("g", "z", "2")], c)
    assert rows(stores.community_members(stores.set_communities(old, fresh)), "graph_id", "id", "community", "members") == [("g", "a", "2", 2), ("g", "z", "2", 2), ("h", "a", "1", 2), ("h", "b", "1", 2)]
    asked = []
    got = stores.cached_communities(old, spark.createDataFrame([("g",), ("i",)], "graph_id string"), lambda m: asked.append(rows(m, "graph_id")) or m.select("graph_id", F.lit("n").alias("id"), F.lit("new").alias("community")))
    assert rows(got, "graph_id", "community") == [("g", "1"), ("i", "new")] and asked == [[("i",)]]
    assert stores.as_json(old.limit(0)).count() == 0


def test_retrieve_and_fallback(spark):
    n = spark.createDataFrame([("g", "m.f", "x/m.py", '{"snippet": "def f(): 1"}'), ("g", "m.g", "x/m.py", "{broken"), ("g", "m", "x/m.py", None)], "graph_id string, id string, file_path string, properties string")
    e = spark.createDataFrame([("g", "m.f", "m.g", "CALLS"), ("g", "m.f", "m.f", "CALLS"), ("g", "m", "m.f", "DEFINES"), ("h", "m", "m.f", "DEFINES")], "graph_id string, source string, target string, rel_type string")
    keys = spark.createDataFrame([("g", "f", "m.f"), ("g", "g", "m.g"), ("g", "none", None)], "graph_id string, symbol string, id string")
    got = rows(compositions.retrieve(n, e, keys), "symbol", "part", "id", "snippet")
    assert got == sorted([("f", "node", "m.f", "def f(): 1"), ("f", "outgoing", "m.g", None), ("f", "outgoing", "m.f", None), ("f", "incoming", "m", None), ("g", "node", "m.g", None), ("g", "incoming", "m.f", None)], key=str)
    q = spark.createDataFrame([("g", "m.f"), ("g", "m.py"), ("g", "nothing"), ("g", None)], "graph_id string, query string")
    assert rows(compositions.fallback_retrieve(n, e, q), "query", "part", "value") == sorted([("m.f", "node", "m.f"), ("m.f", "neighbour", "m.g"), ("m.f", "neighbour", "m.f"), ("m.f", "neighbour", "m"), ("m.py", "file", "x/m.py")], key=str)


def test_rings_are_numbered_in_order_of_path(spark):
    c = spark.createDataFrame([("g", f"src/{i:03}", "src/000") for i in range(50)] + [("g", "alone", "alone")], "graph_id string, id string, component string")
    got = {r.file_path: (r.place, r.n) for r in compositions.cycle_rings(c).collect()}
    assert got == {f"src/{i:03}": (i + 1, 50) for i in range(50)}


def test_declared_surfaces(spark):
    modules = spark.createDataFrame([("g", "core/api.py", "core"), ("g", "core/x.py", "core"), ("g", "app/a.py", "app"), ("g", "app/b.py", "app"), ("g", "loose.py", None)], "graph_id string, file_path string, module string")
    pairs = spark.createDataFrame([("g", "app/a.py", "core/api.py"), ("g", "app/a.py", "core/x.py"), ("g", "app/b.py", "core/x.py"), ("g", "core/api.py", "core/x.py"), ("g", "tests/t.py", "core/x.py")], "graph_id string, sf string, tf string")
    surfaces = spark.createDataFrame([("core", "*/api.py"), ("app", "app/b.*")], "module string, pattern string")
    got = {r.file_path: (r.surface, r.barrel, r.consumers) for r in compositions.declared_surfaces(pairs, modules.select("graph_id", "file_path"), modules, surfaces).collect()}
    assert got == {"core/api.py": (True, True, 1), "core/x.py": (False, False, 2), "app/a.py": (False, False, 0), "app/b.py": (True, False, 0)}


def test_vectors_in_blocks_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 6)), 2)
    x[50:150] = x[50]  # a third alike: ties
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [0.0] * 6), (901, [1.0] * 5), (902, None)]
    v = spark.createDataFrame(data, "vec_id bigint, v array<double>").repartition(3)
    monkeypatch.setattr(search, "HELD_QUERIES", 7)
    asked = v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in search.vector_topk(v, asked, 4).collect():
        got.setdefault(r.query_id, []).append((r.place, r.vec_id))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    assert set(got) == set(range(0, 300, 10))
    for q, found in got.items():
        assert [i for _, i in sorted(found)] == np.argsort(-s[q], kind="stable")[:4].tolist()
    assert search.vector_topk(v, asked.limit(0), 4).count() == 0


def test_specifiers_take_the_first_candidate(spark):
    there = spark.createDataFrame([("g", f) for f in ("src/a.d.ts", "src/a.js", "src/b/index.jsx", "src/c/index.d.ts", "lib/x.ts")], "graph_id string, file_path string")
    imports = spark.createDataFrame([("g", "src/m.ts", s) for s in ("./a", "./b", "./c", "@lib/x", "react", "../../out")], "graph_id string, file_path string, specifier string")
    aliases = spark.createDataFrame([("g", "@lib/*", "lib/*")], "graph_id string, pattern string, replacement string")
    got = {r.specifier: r.target for r in files.resolve_specifiers(imports, there, aliases).collect()}
    assert got == {"./a": "src/a.js", "./b": "src/b/index.jsx", "./c": "src/c/index.d.ts", "@lib/x": "lib/x.ts", "react": None, "../../out": None}


def test_hash_stream_keeps_two_versions(spark, tmp_path):
    schema = "graph_id string, file_path string, content_hash string, indexed_at timestamp"
    for i in range(4):
        spark.createDataFrame([("g", "a", str(i))], "graph_id string, file_path string, content_hash string").withColumn("indexed_at", F.make_timestamp(F.lit(2025), F.lit(1), F.lit(1 + i), F.lit(0), F.lit(0), F.lit(0))).select("graph_id", "file_path", "content_hash", "indexed_at").write.mode("append").parquet(str(tmp_path / "feed"))
        feed = debounce.change_feed(spark, str(tmp_path / "feed"), schema, 1)
        debounce.run_batches(feed, debounce.merge_latest(str(tmp_path / "state")), str(tmp_path / "checkpoint"))
    assert rows(debounce.latest_state(spark, str(tmp_path / "state")), "content_hash") == [("3",)]
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("v")]) == 2


def test_unknown_kinds_of_search_are_hybrid():
    assert search.search("hybrid", hybrid=lambda: "h") == search.search("?", hybrid=lambda: "h") == "h"
    assert search.search("symbol", symbol=lambda: "s", hybrid=lambda: "h") == "s"
    with pytest.raises(TypeError):
        search.search("semantic")
