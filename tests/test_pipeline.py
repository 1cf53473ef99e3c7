"""Orphans, incremental work and hierarchies, against brute force and in odd cases."""

import random
from datetime import datetime, timedelta
from datetime import timedelta as _timedelta

import pytest
from pyspark.sql import functions as F

from quiver.operators import hierarchy, incremental, orphans

T0 = datetime(2025, 1, 1)
NODES = "graph_id string, id string, loaded_at timestamp, deleted_at timestamp, source string"
EDGES = "graph_id string, source string, target string, rel_type string, loaded_at timestamp, id string"


def _orphans(nodes, edges):
    """Brute force of the definition."""
    first = {}
    for g, s, t, r, at, _ in edges:
        key = (g, s or "", t or "", r)
        first[key] = min(first.get(key, at), at)
    out = set()
    for (g, s, t, r), at in first.items():
        for side, end in (("source", s), ("target", t)):
            rows = [n for n in nodes if n[0] == g and n[1] == end]
            before = [n for n in rows if n[2] <= at]
            if end and not any(n[3] is None or n[3] > at for n in before):
                out.add((g, s, t, r, side, "missing" if not rows else "late" if not before else "deleted"))
    return out


@pytest.mark.parametrize("unit", [3600, 60, 7])
def test_orphans_match_brute_force(spark, unit):
    rnd = random.Random(5)
    timedelta = lambda hours: _timedelta(seconds=hours * unit)
    when = lambda: T0 + timedelta(hours=rnd.randrange(72))
    nodes = []
    for _ in range(150):
        at = when()
        nodes.append((rnd.choice("ab"), f"n{rnd.randrange(25)}", at, rnd.choice([None, at + timedelta(hours=rnd.randrange(-5, 30))]), "x"))
    ends = [None, "", "hub", *[f"n{i}" for i in range(30)]]
    edges = [(rnd.choice("ab"), rnd.choice(ends), rnd.choice(["hub", rnd.choice(ends)]), rnd.choice("rs"), when(), "x") for _ in range(600)]
    found = orphans.orphan_references(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))
    got = [tuple(r)[:6] for r in found.select("graph_id", "source", "target", "rel_type", "side", "state").collect()]
    assert len(got) == len(set(got)) and set(got) == _orphans(nodes, edges)
    counts = orphans.orphan_counts(found)
    assert sum(r.n for r in counts.collect()) == len(got)


def test_orphans_of_empty_tables_and_nulls(spark):
    none, some = spark.createDataFrame([], NODES), spark.createDataFrame([(None, "s", "t", None, None, "x")], EDGES)
    assert orphans.orphan_references(none, spark.createDataFrame([], EDGES)).count() == 0
    assert {r.state for r in orphans.orphan_references(none, some).collect()} == {"missing"}
    known = spark.createDataFrame([(None, "s", None, None, "x"), ("g", None, T0, None, "x")], NODES)
    assert [r.side for r in orphans.orphan_references(known, some).collect()] == ["target"]


def test_orphans_of_a_hot_parent_that_is_sent_again_every_day(spark):
    days = [T0 + timedelta(days=i) for i in range(4)]
    nodes = [("g", "hub", at, at + timedelta(hours=12), "x") for at in days] + [("g", "n", T0, None, "x")]
    edges = spark.range(40_000).select(
        F.lit("g").alias("graph_id"), F.lit("n").alias("source"), F.when(F.col("id") % 3 == 0, "hub").when(F.col("id") % 3 == 1, "gone").otherwise("n").alias("target"),
        F.concat(F.lit("r"), "id").alias("rel_type"), (F.lit(T0) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * 8)).alias("loaded_at"), F.lit("x").alias("id"),
    )
    got = {(r.target, r.state): r.n for r in orphans.orphan_references(spark.createDataFrame(nodes, NODES), edges).groupBy("target", "state").agg(F.count("*").alias("n")).collect()}
    late_half = sum(1 for i in range(0, 40_000, 3) if (i * 8) % 86_400 >= 43_200)
    assert got == {("hub", "deleted"): late_half, ("gone", "missing"): 13_333}


def test_pending_files(spark):
    at = lambda h: T0 + timedelta(hours=h)
    hashes = spark.createDataFrame(
        [("g", "a", "1", at(0)), ("g", "a", "2", at(5)), ("g", "a", "2", at(5)), ("g", "a", None, at(9)), ("g", "b", "1", at(1)), ("g", "c", "error: x", at(1)), ("g", "d", "7", at(2)), ("g", "e", "A", at(2))],
        "graph_id string, file_path string, content_hash string, indexed_at timestamp",
    )
    runs = spark.createDataFrame([(1, "g", at(1), "ok"), (2, "g", at(6), "failed"), (3, "g", at(7), "ok")], "run_id bigint, graph_id string, started_at timestamp, status string")
    log = spark.createDataFrame(
        [(1, "g", "a", "1", at(1)), (2, "g", "a", "2", at(6)), (1, "g", "b", "1", at(1)), (3, "g", "e", "a", at(7))],
        "run_id bigint, graph_id string, file_path string, content_hash string, processed_at timestamp",
    )
    settled = incremental.settled_hashes(runs, log)
    got = {(r.file_path, r.content_hash) for r in incremental.pending_files(hashes, settled).collect()}
    assert got == {("a", "2"), ("d", "7"), ("e", "A")}
    assert {r.file_path for r in incremental.pending_files(hashes, settled, upper=at(3)).collect()} == {"d", "e"}
    assert incremental.pending_files(hashes.limit(0), settled).count() == 0


def test_settled_state_waits_for_open_runs_and_reads_only_what_is_new(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    runs_of = lambda *rows: spark.createDataFrame(rows, "run_id bigint, graph_id string, started_at timestamp, status string")
    log_of = lambda *rows: spark.createDataFrame([(r, "g", f, h, at(r)) for r, f, h in rows], "run_id bigint, graph_id string, file_path string, content_hash string, processed_at timestamp")
    state = lambda job, *tables: {r.file_path: r.settled for r in incremental.settled_state(job, *tables).collect()}
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"), "place")
    log = log_of((1, "a", "1"), (2, "a", "2"), (2, "b", "1"), (3, "a", "3"), (4, "c", "1"))
    runs = [(1, "g", at(1), "ok"), (2, "g", at(2), "running"), (3, "g", at(3), "ok"), (4, "g", at(4), "failed")]
    assert state(job, runs_of(*runs), log) == {"a": "3"}
    first = job.last()
    # run 2 succeeds late: it started before run 3, so a stays, and b must not be missed
    runs[1] = (2, "g", at(2), "ok")
    assert state(job, runs_of(*runs), log) == {"a": "3", "b": "1"}
    assert job.last()["low"] == first["high"]
    # what is committed isn't read again
    assert state(job, runs_of(*runs), log.where("run_id > 3")) == {"a": "3", "b": "1"}
    for n in range(5, 5 + incremental.MOST_OUTPUTS + 3):
        runs.append((n, "g", at(n), "ok"))
        assert state(job, runs_of(*runs), log_of((n, "a", str(n))))["a"] == str(n)
    assert len(job.last()["outputs"]) <= incremental.MOST_OUTPUTS + 1


def test_two_jobs_at_once_commit_once(spark, tmp_path):
    one, other = (incremental.IncrementalJob(spark, str(tmp_path / "job"), "seq") for _ in range(2))
    rows = spark.range(5).withColumnRenamed("id", "seq")

    def overtaken(d):
        other.run(rows, lambda x: x)
        return d

    with pytest.raises(RuntimeError, match="another run"):
        one.run(rows, overtaken)
    assert sorted(r.seq for r in one.output().collect()) == list(range(5))
    assert one.run(rows.withColumn("seq", F.col("seq") + 3), lambda d: d)["low"] == 4
    assert sorted(r.seq for r in other.output().collect()) == list(range(8))
    with pytest.raises(ValueError):
        one.run(rows.select(F.lit(None).cast("bigint").alias("seq")), lambda d: d)


def test_incremental_job_is_exactly_once(spark, tmp_path):
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"), "seq")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "seq")
    assert job.run(rows(0), lambda d: d) is None
    assert job.run(rows(5), lambda d: d)["high"] == 4

    def dies(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        job.run(rows(9), dies)
    assert job.run(rows(9), lambda d: d)["low"] == 4
    assert job.run(rows(9), lambda d: d) is None
    assert sorted(r.seq for r in job.output().collect()) == list(range(9))


def _tree(pairs):
    up = dict(pairs)
    out = {}
    for i in {x for p in pairs for x in p}:
        seen, at = [], i
        while at in up and at not in seen:
            seen.append(at)
            at = up[at]
        out[i] = ("", -1) if at in seen else (at, len(seen))
    return out


@pytest.mark.parametrize("rows", [7, 40, 1000])
def test_hierarchy_matches_brute_force(spark, rows):
    rnd = random.Random(rows)
    up = {}
    for i in range(200):
        up[f"n{i:03}"] = f"n{rnd.randrange(i) if i and rnd.random() < 0.95 else 200 + rnd.randrange(3):03}"
    up |= {"c0": "c1", "c1": "c2", "c2": "c0", "d": "c1", "self": "self"} | {f"x{(i * 37) % 60:02}": f"x{((i + 1) * 37) % 60:02}" for i in range(59)}
    links = spark.createDataFrame([("g", p, c) for c, p in up.items()], "graph_id string, parent string, id string")
    got = {r.node_id: (r.root_id, r.depth) for r in hierarchy.hierarchy(links, rows).collect()}
    assert got == _tree(list(up.items()))
    paths = hierarchy.hierarchy_paths(links, rows)
    for r in paths.collect():
        assert (r.root_id, r.depth) == got[r.node_id] and len(r.path) == r.depth + 1 and r.path[-1] == r.node_id
        assert all(up[c] == p for p, c in zip(r.path, r.path[1:]))
    below = hierarchy.descendants(paths)
    assert below.count() == sum(d for _, d in got.values() if d > 0)


def test_parent_links_leave_out_unusable_ends(spark):
    rows = [("g", "a", "b", "CONTAINS"), ("g", "a", "b", "CONTAINS"), ("g", "", "c", "DEFINES"), ("g", "a", None, "DEFINES"), ("g", "x", "y", "CALLS")]
    links = hierarchy.parent_links(spark.createDataFrame(rows, "graph_id string, source string, target string, rel_type string"))
    assert [tuple(r) for r in links.collect()] == [("g", "b", "a")]
    assert hierarchy.hierarchy(links.limit(0)).count() == 0


def test_hierarchy_of_a_long_chain_and_a_broad_root(spark):
    n = 1_000_000
    ids = spark.range(n).select(F.lit("g").alias("graph_id"), F.format_string("n%07d", "id").alias("parent"), F.format_string("n%07d", F.col("id") + 1).alias("id"))
    got = hierarchy.hierarchy(ids).agg(F.count("*"), F.max("depth"), F.count_distinct("root_id"), F.sum("depth")).first()
    assert tuple(got) == (n + 1, n, 1, n * (n + 1) // 2)
    # ids in no order, so that a chain crosses fragments at almost every step
    mixed = spark.range(20_000).select(F.lit("g").alias("graph_id"), F.sha2(F.col("id").cast("string"), 256).alias("parent"), F.sha2((F.col("id") + 1).cast("string"), 256).alias("id"))
    got = hierarchy.hierarchy(mixed, 3_000).agg(F.count("*"), F.max("depth"), F.count_distinct("root_id")).first()
    assert tuple(got) == (20_001, 20_000, 1)
    broad = spark.range(60_000).select(F.lit(None).cast("string").alias("graph_id"), F.when(F.col("id") % 3 == 0, "top").otherwise(F.concat(F.lit("m"), F.col("id") % 3, F.lit("-"), F.floor(F.col("id") / 30))).alias("parent"), F.concat(F.lit("x"), "id").alias("id"))
    paths = hierarchy.hierarchy_paths(broad, 5_000)
    assert paths.where("root_id = 'top' and depth = 1").count() == 20_000 and paths.where("size(path) <> depth + 1").isEmpty()


def test_quotient_is_joined_at_every_size(spark, capsys):
    links = spark.createDataFrame([("g", f"n{i // 2:04}", f"n{i:04}") for i in range(1, 2000)], "graph_id string, parent string, id string")
    hierarchy.hierarchy(links).explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and plan.count("MapInPandas") == 1  # that of the quotient; the fragments are written down


def test_further_parents_are_named(spark):
    rows = [("g", "a", "c", "CONTAINS"), ("g", "b", "c", "DEFINES"), ("g", "b", "c", "CONTAINS"), ("h", "b", "c", "DEFINES"), (None, "p", "q", "DEFINES"), (None, "o", "q", "DEFINES")]
    edges = spark.createDataFrame(rows, "graph_id string, source string, target string, rel_type string")
    assert sorted(map(str, map(tuple, hierarchy.further_parents(edges).collect()))) == sorted(map(str, [("g", "b", "c"), (None, "p", "q")]))
