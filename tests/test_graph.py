"""Graph state, dependencies, rules, traversal, analytics, search and sync on small cases."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quiver.functions import paths
from quiver.operators import analytics, dependencies, graph, lookups, rules, search, sync, traverse, whole

T = datetime(2025, 1, 1)
N = "graph_id string, id string, labels array<string>, name string, file_path string, resolved_source string, is_external boolean, loaded_at timestamp, deleted_at timestamp"
E = "graph_id string, source string, target string, rel_type string, resolved_by string, from_module string, owner_file_path string, loaded_at timestamp"


def nodes(spark, rows):
    return spark.createDataFrame([("g", i, [lab], i, f, r, x, T, None) for i, lab, f, r, x in rows], N)


def edges(spark, rows):
    return spark.createDataFrame([("g", s, t, r, by, None, None, T) for s, t, r, by in rows], E)


def pairs(spark, rows, n=1):
    return spark.createDataFrame([("g", s, t, n) for s, t in rows], "graph_id string, sf string, tf string, n bigint")


def files(spark, names):
    return spark.createDataFrame([("g", f) for f in names], "graph_id string, file_path string")


FILES = [(f"F{x}", "CodeFile", f"{x}.py", None, False) for x in "abc"]
SYMBOLS = [(f"{x}.s", "CodeFunction", f"{x}.py", None, False) for x in "abc"] + [("a.t", "CodeFunction", "a.py", None, False)]
IMPORTS = [(f"imp{x}", "CodeImport", "a.py", f"{x}.py", True) for x in "bcz"]


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([("a.s", "b.s", "REFERENCES", None), ("a.s", "impc", "IMPORTS", None)], [("a.py", "b.py")]),
        ([("a.s", "impc", "IMPORTS", None), ("a.s", "impz", "IMPORTS", None)], [("a.py", "c.py")]),
        ([("a.s", "b.s", "CALLS", "scip-python"), ("a.s", "c.s", "CALLS", None)], [("a.py", "b.py")]),
        ([("a.s", "a.t", "REFERENCES", None), ("a.s", "impb", "IMPORTS", None)], [("a.py", "b.py")]),
        ([("a.s", "b.s", "REFERENCES", None), ("a.t", "b.s", "REFERENCES", None)], [("a.py", "b.py")] * 2),
        ([], []),
    ],
)
def test_dependency_edges(spark, rows, expected):
    projects = spark.createDataFrame([("g", "/r")], "graph_id string, repo_path string")
    view = dependencies.FileDependencies(nodes(spark, FILES + SYMBOLS + IMPORTS), edges(spark, rows), projects)
    assert sorted((r.sf, r.tf) for r in view.edges_of_files().collect()) == expected


def test_rules(spark):
    got = lambda df: sorted((r.file_path, r.n) for r in df.collect())
    assert got(rules.deep_imports(pairs(spark, [("src/x.py", "lib/deep/y.py"), ("src/x.py", "lib/y.py"), ("tests/x.py", "lib/deep/y.py"), ("src/a/x.py", "src/b/y.py")], 3))) == [("src/x.py", 3)]
    assert got(rules.upward_imports(pairs(spark, [("pkg/sub/leaf.py", "pkg/core.py"), ("pkg/a/x.py", "pkg/b/y.py"), ("pkg/x.py", "pkg/a/y.py")]))) == [("pkg/sub/leaf.py", 1)]
    some = files(spark, ["src/cli.py", "src/util.py", "src/helper.py", "App.tsx", "a/foo.test.ts"])
    assert [r[0] for r in got(rules.orphan_modules(some, pairs(spark, [("src/cli.py", "src/util.py"), ("src/util.py", "src/helper.py")])))] == []
    assert [r[0] for r in got(rules.orphan_modules(some, pairs(spark, [("src/util.py", "src/helper.py")])))] == ["src/util.py"]
    assert got(rules.orphan_modules(some, pairs(spark, []))) == []


def test_layers_and_modules(spark):
    modules = spark.createDataFrame([(0, "core", ["src/core/*"], None, []), (1, "api", ["src/api/*"], ["*gen*"], ["core"])], "ordinal int, module string, paths array<string>, exclude array<string>, may_depend_on array<string>")
    none = spark.createDataFrame([], "from_module string, to_module string, expires date")
    p = pairs(spark, [("src/core/a.py", "src/api/b.py"), ("src/api/b.py", "src/core/a.py"), ("src/api/gen.py", "src/core/a.py")])
    assert [(r.file_path, r.rule) for r in rules.layer_violations(p, modules, none).collect()] == [("src/core/a.py", "layer_violation")]


def test_paths(spark):
    rows = ["src/a/cli.py", "contest.ts", "server/routes/foo.test.ts", "server/__tests__/x.ts", "scripts"]
    got = spark.createDataFrame([(r,) for r in rows], "p string").select("p", paths.is_peripheral(F.col("p")).alias("q"), paths.stem(F.col("p")).alias("s")).collect()
    assert {r.p: r.q for r in got} == dict(zip(rows, [False, False, True, True, True]))
    assert got[0].s == "cli"


def _reach(rows, seed, depth):
    out, front = {seed: 0}, [seed]
    for d in range(1, depth + 1):
        front = [t for s, t in rows if s in front and t not in out]
        out |= {t: d for t in front}
    return out


RING = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "d"), ("d", "missing")]


def test_traversal(spark):
    e = edges(spark, [(s, t, "CALLS", None) for s, t in RING])
    seeds = spark.createDataFrame([("g", "a")], "graph_id string, seed string")
    got = {r.id: r.depth for r in traverse.reach(traverse.steps(e, "down"), seeds, 9).collect()}
    assert got == _reach(RING, "a", 9)
    known = spark.createDataFrame([("g", x) for x in "abcde"], "graph_id string, id string")
    assert "missing" not in {r.id for r in traverse.reach(traverse.steps(e, "downstream"), seeds, 9, known=known).collect()}
    impact = {r.id: (r.depth_down, r.depth_up, r.coupling) for r in traverse.impact(e, seeds).collect()}
    assert impact["b"] == (1, 2, 3.0) and impact["missing"] == (4, None, 4.0)
    strong = {r.id: r.component for r in traverse.strong_components(e).collect()}
    assert {k for k, v in strong.items() if v == "a"} == {"a", "b", "c"} and strong["d"] == "d"
    parts = {r.id: r.component for r in traverse.components(e, known.union(spark.createDataFrame([("g", "z")], known.schema))).collect()}
    assert parts["missing"] == "a" and parts["z"] == "z"
    with pytest.raises(ValueError):
        traverse.steps(e, "sideways")


def test_canonical_ids(spark):
    n = nodes(spark, [("stub", "CodeFunction", None, None, True), ("real", "CodeFunction", "a.py", None, False), ("lib", "CodeFunction", "node_modules/x", None, True)])
    n = n.withColumn("name", F.lit("f"))
    assert {r.id: r.canonical for r in traverse.canonical_ids(n).collect()} == {"stub": "real", "lib": None}


def test_analytics(spark):
    e = edges(spark, [(s, t, "CALLS", None) for s, t in [("l1", "hub"), ("l2", "hub"), ("hub", "l1")]])
    n = nodes(spark, [(x, "CodeFunction", f"{x}.py", None, False) for x in ("hub", "l1", "l2")])
    assert {r.id: r.centrality for r in analytics.degree_centrality(e, n).collect()} == {"hub": 1.0, "l1": 0.5, "l2": 0.5}
    assert {r.id: r.betweenness for r in analytics.betweenness(e, n).collect()} == {"hub": 1.0, "l1": 0.0, "l2": 0.0}
    assert analytics.hotspots(analytics.degree_centrality(e, n), n, 1).first().id == "hub"


def test_louvain_finds_two_groups(spark):
    rows = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("a", "w")]
    e = edges(spark, [(s, t, "CALLS", None) for s, t in rows])
    n = nodes(spark, [(x, "CodeFunction", "f", None, False) for x in "abcdwxyz"])
    got = analytics.louvain(e, n)
    assert {r.id: r.community for r in got.collect()} == {x: "a" if x in "abcd" else "w" for x in "abcdwxyz"}
    assert analytics.modularity(e, got).first().modularity > 0.4
    alone = analytics.louvain(edges(spark, []), n)
    assert {r.community for r in alone.collect()} == {"a"}


def test_louvain_leaves_no_move_that_raises_modularity(spark):
    dice = random.Random(5)
    linked = {tuple(sorted(dice.sample(range(120), 2))) for _ in range(300)}
    n = nodes(spark, [(f"n{x}", "CodeFunction", "f", None, False) for x in range(120)])
    found = analytics.louvain(edges(spark, [(f"n{a}", f"n{b}", "CALLS", None) for a, b in linked]), n)
    of = {int(r.id[1:]): r.community for r in found.collect()}
    near = {x: [b if a == x else a for a, b in linked if x in (a, b)] for x in range(120)}
    m2 = 2 * len(linked)

    def raised(some, to):
        """4 m^2 times what modularity gains if `some`, all of one community, go to the community `to`."""
        k = sum(len(near[x]) for x in some)
        rest = {c: [x for x in of if of[x] == c and x not in some] for c in (of[some[0]], to)}
        links = {c: sum(y in rest[c] for x in some for y in near[x]) for c in rest}
        return (links[to] - links[of[some[0]]]) * m2 - k * sum(len(near[x]) for x in rest[to]) + k * sum(len(near[x]) for x in rest[of[some[0]]])

    names = set(of.values())
    moves = [([x], to) for x in of if near[x] for to in {*names, "alone"} - {of[x]}]
    mergers = [([x for x in of if of[x] == c], to) for c in names for to in names - {c}]
    assert 2 < len(names) < 40
    assert not [(some, to) for some, to in moves + mergers if raised(some, to) > 0]


def _jobs(spark, name, run):
    """What `run` gives, and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _in_graphs(spark, rows):
    return spark.createDataFrame([(g, s, t, "CALLS", None, None, None, T) for g, s, t in rows], E)


def test_louvain_takes_few_jobs(spark):
    dice = random.Random(7)
    rows = [(f"g{g}", f"n{a}", f"n{b}") for g in range(3) for a, b in (dice.sample(range(60), 2) for _ in range(150))]
    n = spark.createDataFrame([(f"g{g}", f"n{x}") for g in range(3) for x in range(60)], "graph_id string, id string")
    e = _in_graphs(spark, rows)
    got, jobs = _jobs(spark, "louvain", lambda: analytics.modularity(e, analytics.louvain(e, n)).collect())
    assert len(got) == 3 and all(r.modularity > 0.3 for r in got) and jobs < 40


def test_louvain_of_many_graphs_takes_few_jobs(spark):
    e = _in_graphs(spark, [(f"g{g}", a, b) for g in range(30) for a, b in ("ab", "bc", "ca", "xy", "yz", "zx", "ax")])
    n = spark.createDataFrame([(f"g{g}", x) for g in range(30) for x in "abcxyz"], "graph_id string, id string")
    got, jobs = _jobs(spark, "louvain of many", lambda: analytics.louvain(e, n).collect())
    assert len(got) == 180 and {(r.id, r.community) for r in got} == {(x, "a" if x in "abc" else "x") for x in "abcxyz"} and jobs < 25


@pytest.mark.parametrize("limit", [0, 20, 1000])
def test_louvain_of_large_and_small_graphs(spark, monkeypatch, limit):
    monkeypatch.setattr(whole, "TASK_LINKS", limit)
    cliques = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("a", "w")]
    e = _in_graphs(spark, [("g", a, b) for a, b in cliques] + [("h", "p", "q"), ("h", "q", "outside"), (None, "p", "q")])
    n = spark.createDataFrame([("g", x) for x in "abcdwxyz"] + [("h", x) for x in "pq1"] + [("i", x) for x in "12"], "graph_id string, id string")
    got = {(r.graph_id, r.id): r.community for r in analytics.louvain(e, n).collect()}
    assert got == {("g", x): "a" if x in "abcd" else "w" for x in "abcdwxyz"} | {("h", "p"): "p", ("h", "q"): "p", ("h", "1"): "1", ("i", "1"): "1", ("i", "2"): "1"}


@pytest.mark.parametrize("limit", [0, 12, 1000])
def test_strong_components_of_large_and_small_graphs(spark, monkeypatch, limit):
    monkeypatch.setattr(whole, "TASK_LINKS", limit)
    dice = random.Random(3)
    rows = [(g, f"n{dice.randrange(9)}", f"n{dice.randrange(9)}") for g, k in (("g", 14), ("h", 9), ("i", 5)) for _ in range(k)] + [(None, "x", "y"), (None, "y", "x")]
    got = {(r.graph_id, r.id): r.component for r in traverse.strong_components(_in_graphs(spark, rows)).collect()}
    expected = {(None, "x"): "x", (None, "y"): "y"}
    for g in "ghi":
        of = [(s, t) for h, s, t in rows if h == g]
        far = {x: set(_reach(of, x, 9)) for x in {y for r in of for y in r}}
        expected |= {(g, x): min(y for y in far if y in far[x] and x in far[y]) for x in far}
    assert got == expected


def test_strong_components_take_few_jobs(spark):
    chain = [(f"n{x:02}", f"n{x + 1:02}") for x in range(30)] + [("n20", "n10")]
    e = edges(spark, [(s, t, "CALLS", None) for s, t in chain])
    got, jobs = _jobs(spark, "strong", lambda: traverse.strong_components(e).collect())
    assert {r.id for r in got if r.component == "n10"} == {f"n{x}" for x in range(10, 21)} and len(got) == 31 and jobs < 15


@pytest.mark.parametrize("limit", [0, 20, 1000])
def test_components_of_large_and_small_graphs(spark, monkeypatch, limit):
    monkeypatch.setattr(whole, "TASK_LINKS", limit)
    dice = random.Random(11)
    rows = [(g, f"n{dice.randrange(30):02}", f"n{dice.randrange(30):02}") for g, k in (("g", 22), ("h", 12)) for _ in range(k)] + [(None, "x", "y"), ("i", "a", "a")]
    n = spark.createDataFrame([(g, f"n{x:02}") for g in "gh" for x in range(0, 35, 5)] + [(None, "x")], "graph_id string, id string")
    got = {(r.graph_id, r.id): r.component for r in traverse.components(_in_graphs(spark, rows), n).collect()}
    expected = {(None, "x"): "x", (None, "y"): "y"}
    for g in "gh":
        of = [p for h, s, t in rows if h == g and s != t for p in ((s, t), (t, s))]
        expected |= {(g, x): min(_reach(of, x, 30)) for x in {s for s, _ in of} | {f"n{y:02}" for y in range(0, 35, 5)}}
    assert got == expected


def test_components_shuffle_the_links_once(spark):
    chain = edges(spark, [(f"n{x:03}", f"n{x + 1:03}", "CALLS", None) for x in range(200)])
    n = spark.createDataFrame([("g", "n000")], "graph_id string, id string")
    got, jobs = _jobs(spark, "components", lambda: traverse.components(chain, n).collect())
    assert {r.component for r in got} == {"n000"} and len(got) == 201 and jobs < 12


def test_search(spark):
    docs = spark.createDataFrame([(1, "The settings file, the settings FILE."), (2, "settings of a file"), (3, None), (4, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([("settings file",), (" ",)], "query string")
    assert [r.doc_id for r in search.bm25(docs, q, 5).collect()] == [1]
    ranks = lambda rows: spark.createDataFrame([("q", k, p) for p, k in enumerate(rows, 1)], "query string, id string, place int")
    fused = search.rrf(ranks("ab"), ranks("bc"), "id", 5).orderBy("place").collect()
    assert [r.id for r in fused] == ["b", "a", "c"]
    n = nodes(spark, [("m.save", "CodeFunction", "a.py", None, False), ("m:import:save", "CodeImport", "b.py", None, True)]).withColumns({"name": F.lit("save"), "qualname": F.lit(None).cast("string")})
    hit = lookups.resolve_symbols(n, spark.createDataFrame([("g", "save")], "graph_id string, symbol string")).first()
    assert (hit.id, hit.score) == ("m.save", 900)


def test_find_equivalent_scores_every_wanted_node(spark):
    # 60 files are nearer than any function, and the functions of the hint's module are the farthest
    rows = [(f"file{x}", ["CodeFile"], "m.file", [1.0, x / 1000]) for x in range(60)]
    rows += [(f"f{x:02}", ["CodeFunction"], "pkg.near" if x < 60 else "pkg.hinted", [1.0, 0.1 + x / 1000]) for x in range(80)]
    n = spark.createDataFrame([("g", i, labels, module) for i, labels, module, _ in rows], "graph_id string, id string, labels array<string>, module string")
    v = spark.createDataFrame([("g", i, x) for i, _, _, x in rows], "graph_id string, id string, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, v array<double>")
    score = {i: round(round(1 / math.hypot(*x), 6) + 0.1 * (module == "pkg.hinted"), 6) for i, labels, module, x in rows if "CodeFunction" in labels}
    want = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:25]
    got = search.find_equivalent(v, q, n, ("CodeFunction",), "pkg.hinted", 25).orderBy("place").collect()
    assert [(r.id, r.score) for r in got] == want and {i for i, _ in want} > {f"f{x}" for x in range(60, 80)}


def test_store(spark):
    schema = "graph_id string, id string, labels array<string>, file_path string, is_external boolean, properties string, loaded_at timestamp"
    stub = spark.createDataFrame([("g", "x", ["CodeImport"], None, True, "{}", T)], schema)
    anchor = spark.createDataFrame([("g", "x", ["CodeModule"], "x.py", False, '{"a": 1}', T)], schema)
    for a, b in ((stub, anchor), (anchor, stub)):
        r = graph.upsert_nodes(a, b).first()
        assert r.labels == ["CodeImport", "CodeModule"] and r.file_path == "x.py" and r.properties == '{"a": 1}'
    plain = anchor.withColumns({"properties": F.lit("{}"), "loaded_at": F.lit(datetime(2025, 2, 1))})
    assert graph.upsert_nodes(anchor, plain).first().properties == "{}"
    e = spark.createDataFrame([("g", "x", "y", "CALLS", None, None, "other.py", T), ("g", "x", "z", "CALLS", None, None, "x.py", T)], E)
    gone = files(spark, ["x.py"])
    left = graph.delete_file_edges(e, anchor, gone)
    assert [r.target for r in left.collect()] == ["y"]


def test_sync(spark):
    f = lambda rows: spark.createDataFrame([("g", p, h) for p, h in rows], "graph_id string, file_path string, content_hash string")
    report = sync.change_report(f([("a", "1"), ("b", "1"), ("c", "1"), ("e", "error: x")]), f([("a", "1"), ("b", "2"), ("d", "1"), ("e", "error: x")]))
    assert {r.file_path: r.status for r in report.collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added", "e": "modified"}
    git = spark.createDataFrame([("g", "new", "R", "a"), ("g", "b", "M", None), ("g", "q", "D", None)], "graph_id string, file_path string, letter string, old_path string")
    got = {(r.file_path, r.status) for r in sync.git_status(f([("new", ""), ("b", "")]), git, f([("a", "1")])).collect()}
    assert got == {("new", "added"), ("a", "deleted"), ("b", "modified")}
    h = f([("a", "1"), ("b", None)])
    assert sync.source_fingerprint(h).first() == sync.source_fingerprint(h.orderBy(F.desc("file_path"))).first()


def test_traversal_moves_the_edges_once(spark):
    edges = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}", "CALLS") for i in range(6)], "graph_id string, source string, target string, rel_type string")
    with traverse.held(traverse.steps(edges, "down"), "graph_id", "id") as ways:
        frontier = spark.createDataFrame([("g", "n0", "n0")], "graph_id string, seed string, id string")
        plan = ways.join(frontier.hint("shuffle_hash"), ["graph_id", "id"])._jdf.queryExecution().executedPlan().toString()
        before = plan.split("InMemoryTableScan")[0]
        assert "ShuffledHashJoin" in plan and before.count("Exchange hashpartitioning") <= 1
    seeds = spark.createDataFrame([("g", "n2")], "graph_id string, seed string")
    got = {(r.id, r.depth_down, r.depth_up, r.direct) for r in traverse.impact(edges, seeds, 2).collect()}
    assert got == {("n3", 1, None, True), ("n4", 2, None, False), ("n1", None, 1, False), ("n0", None, 2, False)}
