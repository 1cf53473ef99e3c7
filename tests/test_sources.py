"""Discovery, specifiers, call refinement, facts, snippets and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quiver.operators import sync
from quiver.sources import facts, files, script_facts
from quiver.streaming import debounce


def test_discover(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "b.txt": "", "node_modules/c.py": "", "sub/d.py": "é", "sub/big.py": "#" * 500}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.file_path: r.text for r in files.discover(spark, str(tmp_path), (".py",), max_size=100).collect()}
    assert got == {"a.py": "x = 1", "sub/d.py": "é"}


def test_resolve_specifiers(spark):
    known = spark.createDataFrame([("g", p) for p in ("src/a.ts", "src/b/index.ts", "lib/c.tsx", "src/x.ts")], "graph_id string, file_path string")
    imports = spark.createDataFrame([("g", "src/x.ts", s) for s in ("./a", "./b", "@lib/c", "react", "../../z", "../lib/c")], "graph_id string, file_path string, specifier string")
    aliases = spark.createDataFrame([("g", "@lib/*", "lib/*"), ("g", "@*", "nowhere/*")], "graph_id string, pattern string, replacement string")
    got = {r.specifier: r.target for r in files.resolve_specifiers(imports, known, aliases).collect()}
    assert got == {"./a": "src/a.ts", "./b": "src/b/index.ts", "@lib/c": "lib/c.tsx", "react": None, "../../z": None, "../lib/c": "lib/c.tsx"}


def test_refine_calls(spark):
    calls = spark.createDataFrame([("g", "m.f", "save", "m.py", 3, 4), ("g", "m.f", "print", "m.py", 4, 4)], "graph_id string, source string, target string, file_path string, line int, col int")
    seen = spark.createDataFrame([("g", "m.py", 3, 4, "s1")], "graph_id string, file_path string, line int, col int, symbol string")
    defined = spark.createDataFrame([("g", "s1", "m.py", 9)], "graph_id string, symbol string, file_path string, line int")
    nodes = spark.createDataFrame([("g", "m.save", "m.py", 9), ("g", "o.save", "o.py", 9)], "graph_id string, id string, file_path string, line_start int")
    got = {r.line: (r.target, r.resolved_by) for r in files.refine_calls(calls, seen, defined, nodes).collect()}
    assert got == {3: ("m.save", "scip-python"), 4: ("print", None)}


def test_python_facts_and_snippets(spark):
    text = "import os\nimport re as r\n\ndef f(a, b: int):\n    if a:\n        return r.x(b)\n\nclass A(B):\n    def g(self):\n        f(1)\n"
    docs = spark.createDataFrame([(1, text, "g", "a.py", datetime(2025, 1, 1)), (2, "def (", "g", "b.py", None), (3, None, "g", "c.py", None)], "doc_id bigint, text string, graph_id string, file_path string, crawled_at timestamp")
    got = facts.python_facts(docs)
    rows = {(r.kind, r.qualname) for r in got.where("doc_id = 1").collect()}
    assert {("unused_import", "os"), ("import", "r"), ("function", "f"), ("class", "A"), ("method", "A.g")} <= rows
    assert [r.kind for r in got.where("doc_id = 2").collect()] == ["error"]
    assert {r.rule for r in facts.function_diagnostics(got).collect()} == {"missing_type_annotation", "unused_import"}
    span = spark.createDataFrame([("g", "f", "a.py", 4, 4)], "graph_id string, id string, file_path string, line_start int, line_end int")
    assert facts.snippets(docs, span, 1).first().snippet.split("\n")[1] == ">>>    4 | def f(a, b: int):"


def test_stream_agrees_with_batch_on_closed_sessions(spark, tmp_path):
    at = lambda m: datetime(2025, 1, 1) + timedelta(minutes=m)
    rows = [(k, at(m)) for k, ms in {1: [0, 10, 50, 51], 2: [5, 200], 3: [1000]}.items() for m in ms]
    events = spark.createDataFrame(rows, "key bigint, ts timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = debounce.change_feed(spark, str(tmp_path / "feed"), "key bigint, ts timestamp")
    out = debounce.run_available(debounce.debounced(feed), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = sync.sessions(events, 1800)
    closed = {(r.key, r.start, r.changes) for r in batch.where("key < 3").collect()}
    assert {(r.key, r.start, r.changes) for r in out.collect()} == closed and batch.count() == 5
    assert batch.where(F.col("key") == 3).count() == 1


def test_merge_latest_is_repeatable(spark, tmp_path):
    merge = debounce.merge_latest(str(tmp_path / "s"))
    rows = lambda h, d: spark.createDataFrame([("g", "a", h, datetime(2025, 1, d))], "graph_id string, file_path string, content_hash string, indexed_at timestamp")
    merge(rows("1", 1), 0)
    merge(rows("2", 2), 1)
    merge(rows("2", 2), 1)
    assert [r.content_hash for r in spark.read.parquet(str(tmp_path / "s" / "v1")).collect()] == ["2"]


def test_git_changes_and_aliases(spark, tmp_path):
    import subprocess

    from quiver.sources import repositories

    root = tmp_path / "r"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    with pytest.raises(repositories.NoRepository):
        repositories.tracked_files(spark, str(tmp_path), "g")
    git("init", "-q")
    (root / "a.py").write_text("x = 1\n" * 20)
    (root / "b c.py").write_text("y = 1\n")
    (root / "d.py").write_text("z = 1\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    git("mv", "a.py", "e.py")
    (root / "b c.py").write_text("y = 2\n")
    (root / "d.py").unlink()
    (root / "f.py").write_text("f")
    git("add", "f.py")
    got = {tuple(r)[1:] for r in repositories.changes_since(spark, str(root), "g", "HEAD").collect()}
    assert got == {("e.py", "R", "a.py"), ("b c.py", "M", None), ("d.py", "D", None), ("f.py", "A", None)}
    assert {r.file_path for r in repositories.tracked_files(spark, str(root), "g").collect()} == {"b c.py", "d.py", "e.py", "f.py"}
    with pytest.raises(ValueError, match="no commit"):
        repositories.changes_since(spark, str(root), "g", "nowhere")
    (root / "base.json").write_text('{ // base\n "compilerOptions": {"baseUrl": "src", "paths": {"@a/*": ["lib/*", "x/*"], "b": ["b.ts",],}, /* c */ } }')
    (root / "tsconfig.json").write_text('{"extends": "./base", "compilerOptions": {}}')
    assert {tuple(r)[1:] for r in repositories.path_aliases(spark, str(root), "g").collect()} == {("@a/*", "src/lib/*"), ("b", "src/b.ts")}
    assert repositories.path_aliases(spark, str(tmp_path), "g").count() == 0


def test_script_facts(spark):
    text = """import React, { useState as us, type Props, unused } from "react";
import * as ns from './ns';
import './side';
export interface Shape { area(): number }
export class Circle<T> extends Base implements Shape {
  constructor(private r: number, x) { super(); }
  static async make(a: string, b = 1): Promise<Circle> { if (a && b) { return new Circle(ns.f(a)); } }
}
export const add = async (a: number, b): number => { return us(a) ? b : `${{ unused: 1 }}` };
const C = (p: Props) => <div>{p.x}</div>;
"""
    docs = spark.createDataFrame([(1, text, "a.tsx"), (2, None, "b.ts"), (3, "", "c.js"), (4, "let = (", "d.ts"), (5, "x", "e.py")], "doc_id bigint, text string, file_path string")
    got = [tuple(r) for r in script_facts.script_facts(docs).collect()]
    kinds = {(r[1], r[3]): r for r in got if r[0] == 1}
    assert {k for k in kinds if "import" in k[0]} == {("import", "React"), ("import", "us"), ("import", "Props"), ("unused_import", "unused"), ("import", "ns"), ("import", "./side")}
    assert kinds["class", "Circle"][4:6] == (5, 8) and kinds["class", "Circle"][9] == "extends Base implements Shape" and ("interface", "Shape") in kinds
    assert kinds["method", "Circle.constructor"][6:9] == (2, 1, 1) and kinds["method", "Circle.make"][6:9] == (2, 1, 3)
    assert kinds["function", "add"][6:9] == (2, 1, 2) and ("function", "C") in kinds and ("call", "Circle.make.f") in kinds and ("call", "area") not in kinds
    assert {r[0] for r in got} == {1, 4} and [r[1] for r in got if r[0] == 4][0] == "error"
    rules = facts.function_diagnostics(script_facts.script_facts(docs))
    assert ("unused", "unused_import") in {(r.qualname, r.rule) for r in rules.collect()}
