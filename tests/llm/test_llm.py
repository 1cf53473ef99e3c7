"""Operators for training data: brute force, round trips, held-out accuracy, and odd cases."""

import ast
import random

import numpy as np
import pytest

pytest.importorskip("quiver.llm")

from quiver.llm import chunk_maps, handwritten, leaks, neighbours, pairs, reading, syntax, tokenizer  # noqa: E402
from quiver.sources import script_grammar  # noqa: E402

DOC = "doc_id bigint, text string, file_path string, lang string, graph_id string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, p, None, "g", "repo") for i, (p, t) in enumerate(rows)], DOC)


# -- 2


SOUND = {
    "py": ["", "  \n", "x = 1\n", "if a:\n    b\nelse:\n    c\n", "@d\ndef f(a, *, b=1) -> int:\n    '''x'''\n    return (1,\n2)\n", "s = '''\n<<<<<<< a\n'''\n", "\ufeffx = 1", "a = 1\r\nb = 2\r"],
    "js": ["", "#!/usr/bin/env node\nlet a = 1", "const f = async ({a, b: [c]}, ...r) => { await g(`x${a}${`}`}`) }", "a = b / c / d; x = /[/]}/g.test(y)", "for (const [k, v] of m) { if (k) continue; else break }", "class A extends B { #p = 1; static { } get x() { return this.#p } async *g() { yield* 1 } }", "import d, { a as b } from 'x'; export default class {}", "label: while (1) { break label }", "x = a ? (b) : c => d", "if (a) ; else b", "a\n++b", "({a, b} = c)", "let {a = 1, ...r} = b"],
    "ts": ["type A<T> = { readonly [K in keyof T]?: T[K] } | ((x: T) => void);", "function f<T extends object = {}>(this: T, x?: number, ...r: string[]): x is T { return x as any as T }", "abstract class A<T> implements B { constructor(private x: number) { super() } abstract f(): void; y!: string }", "enum E { A = 1, B }\ndeclare module 'm' { export const x: number; }", "const x = <any>y; let z = f<string>(1)!.a; const g = <T,>(a: T) => a;", "interface I { (a: number): string; new (x: any): I; m?(): void; [k: string]: any }", "let t: [a: string, b?: number, ...c: any[]] = x satisfies any"],
    "tsx": ["const a = <div className=\"x\" {...p} on={() => 1}>don't {x} <b/> </div>;", "const b = <>{/* c */}</>", "const f = <T,>(x: T) => <A.B c='1' />; const c = a < b && c > d"],
}
BROKEN = {
    "py": ["print 'x'", "def f(:\n  1", "x = (1\n", "if a:\nb\n", "s = '''\n", "<<<<<<< a\nx\n=======\n", "else:\n    1\n", "  x = 1\n"],
    "js": ["let a = ;", "function f( {", "a b", "x = `a${", "<<<<<<< ours\na\n=======", "const a: number = 1", "return 1", "let x = <div/>", "const a", "1 = 2", "class A { constructor( }", "def f():\n    pass", "a ?? b || c", "break", "}"],
    "ts": ["let x: = 1", "interface { a: b }", "type A = ", "let x = <div>a</div>", "enum { A }"],
    "tsx": ["const a = <div></span>", "const a = <div>", "const a = <div {x}/>", "let = = 1"],
}


@pytest.mark.parametrize("ending", ["py", "js", "ts", "tsx"])
def test_syntax(ending):
    assert [t for t in SOUND[ending] if syntax.judge(t, ending) is not True] == []
    assert [t for t in BROKEN[ending] if syntax.judge(t, ending) is not False] == []


@pytest.mark.parametrize(
    "text, ending",
    [(t, "js") for t in ["/(/", "/a|*/", "x = 08n", "'\\u{110000}'", "'\\xg0'", "if (a) let b", "while (a) const b = 1", "function* g(){ yield\n* x }", "super()", "new.target", "class A { constructor() {} constructor() {} }", "x = /a/gg", "/* a", "`${"]]
    + [(t, "py") for t in ["f'{a'", "f'}'", "f'{a:{b}'", "f'''{a\n", "x = f'{\"a\"'\n"]],
)
def test_broken_in_detail(text, ending):
    assert syntax.judge(text, ending) is False


@pytest.mark.parametrize(
    "text, ending",
    [(t, "js") for t in ["<!-- html comment\nx = 1", "x = 08.5", "class A extends B { constructor() { super(); const f = () => super(); new.target } }", "/(?<a>[)/(])\\k<a>/u", "`${x ? `{` : ''}`", "return_ = /[{]/.test(y)", "'\\\\u{110000}'", "if (a) let\nb"]]
    + [("class A { constructor(); constructor(a?: number) {} }", "ts"), ("const a = <p x={() => { class B { constructor() {} } }}>{`}`}</p>", "tsx")]
    + [(t, "py") for t in ["f'{x[\"a\"]}'", "f\"{x[\"a\"]}\"", "f'{a!r:>{w}}' + f'{{}}'", "rf'\\{a}'", "f'''{\n(a, # )\n b):x\n}'''", "f'\\N{EM DASH}'", "f'{d[\"{\"]}'", "x = 1\\\n+ 2\ny = '''\\\n'''\n"]],
)
def test_sound_in_detail(text, ending):
    assert syntax.judge(text, ending) is True
    if ending == "py":
        ast.parse(text)


def _whole(text, ending):
    """The file parsed as one."""
    if ending != "py":
        return script_grammar.check(text, ending, whole=True) is None
    try:
        ast.parse(text)
    except (SyntaxError, ValueError):
        return False
    return True


BITS = {
    "py": ["a(", ")", "{\n", "}\n", "[", "]\n", "'x('\n", '"""\n', "'''\n", "\n", "# (\n", "x\n", "f'{", "f'''\n", ":\n", "{{", "'\n", "}'", "\\\n", "if x:\n  y\n", "else:\n  z\n"],
    "js": ["a(", ")\n", "{\n", "}\n", "[", "]\n", "'x('\n", "/*\n", "*/\n", "\n", "// (\n", "x\n", "`\n", "${", "}`\n", "/ 2\n", "/[/]/\n", "x = y\n", ";\n"],
    "tsx": ["<p>\n", "</p>\n", "{\n", "}\n", "don't\n", "x = ", "`\n", "${", "<a b='}'\n", "/>\n", "(", ")\n", ";\n"],
}


@pytest.mark.parametrize("ending", ["py", "js", "tsx"])
def test_chunk_maps_compose_as_the_whole(ending):
    rnd = random.Random(3)
    for _ in range(1500):
        text = "".join(rnd.choice(BITS[ending]) for _ in range(rnd.randrange(2, 14)))
        pieces = [chunk_maps.Piece(c, ending) for c in syntax.chunks(text, 1)]
        begin, one = chunk_maps.start(ending), chunk_maps.read(text, ending, chunk_maps.start(ending))
        left = pieces[0]
        for p in pieces[1:]:
            left = p.after(left)
        right = pieces[-1]
        for p in reversed(pieces[:-1]):
            right = right.after(p)
        for whole in (left, right):
            e = whole.entry(begin)
            assert bool(chunk_maps.verdict(e)) == bool(chunk_maps.verdict(one)), text
            if not chunk_maps.verdict(one):
                assert (e.found, e.size) == (one.found, len(text)), text
        assert syntax.judge(text, ending, left.entry(begin)) == _whole(text, ending), text


def test_broken_files_short_and_long(spark):
    good = "def f(a):\n    return (a,\n        1)\n\n" * 40_000
    script = "function f() { return [`${1}`]; }\n" * 40_000
    rows = [("a.py", good), ("b.py", good + "x = (\n"), ("c.js", script), ("d.js", script + "}"), ("e.py", None), ("f.py", ""), ("g.md", "(("), ("h.py", "x ="), ("i.py", "x ="), ("j.js", "x = " + "(" * 30_000 + ")" * 30_000)]
    assert sorted(r.doc_id for r in syntax.broken_files(docs(spark, rows)).collect()) == [1, 3, 7, 8]
    assert [r.doc_id for r in syntax.undecided_files(docs(spark, rows)).collect()] == [9]
    assert syntax.broken_files(docs(spark, rows).limit(0)).count() == 0


def test_python_statements_rebuild_the_text():
    text = "@a\n@b\nclass A:\n    x = (\n1)\n# c\nif x:\n    1\nelif y:\n    2\nelse:\n    3\ns = '''\nz\n'''\n"
    parts = list(syntax._python_statements(text, syntax.summary(text, "py").found))
    assert "".join(parts) == text and len(parts) == 3
    for p in parts:
        ast.parse(p)


# -- 4


def test_not_handwritten(spark):
    code = "function f(a) {\n  return a + 1;\n}\n" * 10
    rows = [
        ("src/a.js", "// Code generated by x 1.0. DO NOT EDIT.\n" + code), ("src/b.js", code), ("archive/c.js", code), ("x/vendor/lib-a/d.js", code),
        ("e.js", "!function(e,n){" + "var a={b:1,c:function(t){return t}};" * 60 + "}()"), ("f.py", "X = {\n" + "".join(f'    "k_{i}": [{i * 37}, 4.{i}, "ab"],\n' for i in range(40)) + "}\n"),
        ("g.ts", 'export const A = (\n' + '  "' + "Ab3+/x9" * 11 + '" +\n' * 1 + ('  "' + "Zq7+/k2" * 11 + '" +\n') * 30 + '  "a");\n'), ("h.py", None), ("i.py", ""), ("j.js", "// not auto-generated: kept by hand\n" + code), ("vendors/k.js", code), ("l_pb2.py", "x = 1\n"), ("m.js", code + "// @generated by x from y\n"), ("n.md", "generated by x"),
    ]
    got = {r.doc_id: r.reason for r in handwritten.not_handwritten(docs(spark, rows)).collect()}
    assert got == {0: "generated", 3: "vendored", 4: "minified", 5: "data", 6: "data", 11: "generated", 12: "generated"}


# -- 5


@pytest.mark.parametrize(
    "doc, telling",
    [("Oldest channel first.", True), ("save file", False), ("The save file function.", False), ("TODO: document this", False), ("noqa: D102", False), (":param a: the a", False), ("", False), ("—", False), ("```ts\nfunction saveFile(a)\n```\nWrites it twice when asked", True), ("キーごとにまとめる", True), ("See base class.", False), ("Memoizes.", True), ("Sorts", True)],
)
def test_telling(doc, telling):
    assert pairs.is_telling(doc, "save_file", "def save_file(a)") is telling


def test_functions_of_files():
    py = '# keeps old rows\n@x(1)\ndef f(a):\n    s = "def g(): #"\n    return s\n\nclass A:\n    def g(self):\n        """Doc of g."""\n        return (1,\n2)\n'
    assert [(n, d) for n, _, d in pairs.functions_of(py, "py")] == [("f", "keeps old rows"), ("g", "Doc of g.")]
    js = '/** first */\nexport function f(a) { return "}"; }\n\n// far\n\nconst g = async (x) => { if (x) { y() } };\nclass A {\n  // near\n  m(x) { return 1; }\n}\n'
    assert [(n, d) for n, _, d in pairs.functions_of(js, "js")] == [("f", "first"), ("g", ""), ("m", "near")]


def test_functions_with_templates_and_expressions():
    js = "/** one */\nfunction a(x) { return `${x ? `{` : ''}`; }\n// two\nfunction b(y) { return /[{]/.test(y) }\n/* three */\nconst c = (z) => z / 2 / '}'.length;\n"
    assert [(n, d) for n, _, d in pairs.functions_of(js, "js")] == [("a", "one"), ("b", "two"), ("c", "three")]
    tsx = "// box\nexport function Box(p: P): JSX.Element {\n  return <div title='}'>don't {p.x}</div>;\n}\n"
    assert [(n, d, c.endswith("}")) for n, c, d in pairs.functions_of(tsx, "tsx")] == [("Box", "box", True)]
    py = 'def f(a):\r\n    """Doc of f."""\r\n    return f"{a["#"]} def g():"\r\n\r\n# of g\r\ndef g(): return 1\r\n'
    assert [(n, d) for n, _, d in pairs.functions_of(py, "py")] == [("f", "Doc of f."), ("g", "of g")]
    assert [n for n, _, _ in pairs.functions_of("function a() { return 1 }\n)) # '\nfunction b() { return 2 }", "js")] == ["a", "b"]


def test_phrases_put_to_many_names_are_placeholders(spark):
    import json

    schema = "graph_id string, id string, labels array<string>, language string, file_path string, properties string"
    rows = [("g", str(i), ["CodeFunction"], "python", None, json.dumps({"name": f"f{i}", "snippet": f"def f{i}(): pass", "docstring": "Pending editorial work." if i % 2 else f"Orders item{i}"})) for i in range(100)]
    assert {int(r.id) % 2 for r in pairs.documented_functions(spark.createDataFrame(rows, schema)).collect()} == {0}
    few = spark.createDataFrame(rows[:30], schema)
    assert pairs.documented_functions(few).count() == 30
    assert pairs.documented_functions(few.limit(0)).count() == 0


def test_documented_functions(spark):
    import json

    schema = "graph_id string, id string, labels array<string>, language string, file_path string, properties string"
    node = lambda i, p, lab="CodeFunction": ("g", i, ["KnowledgeNode", lab], "python", None, p if p is None or isinstance(p, str) else json.dumps(p))
    base = {"name": "f", "signature": "def f()", "snippet": "def f():\n    return 1"}
    rows = [
        node("a", base | {"docstring": "Counts rows twice"}), node("a", base | {"docstring": "Counts rows twice"}), node("b", base), node("c", None), node("d", "{broken"),
        node("e", base | {"snippet": "  ", "docstring": "Counts rows twice"}), node("f", base | {"documentation": ["```py\ndef f()\n```", "Counts rows twice"]}),
        node("g", base | {"docstring": "TODO", "snippet": 'def f():\n    """Counts rows twice"""\n    return 1'}), node("h", base | {"docstring": "Counts rows twice"}, "CodeClass"),
    ]
    assert sorted(r.id for r in pairs.documented_functions(spark.createDataFrame(rows, schema)).collect()) == ["a", "f", "g"]


# -- 6


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)), 10, axis=0) + rng.normal(size=(400, 8)) * 0.2
    x[100:240] = x[100]  # a third are equal
    rows = [(int(i), "m", [float(v) for v in np.float32(r)]) for i, r in enumerate(x)] + [(1000, "m", None), (1001, "m", []), (1002, "m", [0.0] * 8), (1003, "m", [float("nan")] * 8), (1004, "old", [1.0] * 8), (1005, "m", [1.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id bigint, model string, vector array<float>")
    usable = neighbours.usable_vectors(table, "m", 8)
    assert usable.count() == 400
    got = {}
    for r in neighbours.nearest_neighbours(usable, 5).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour)
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    want = {i: set(np.argsort(-s[i], kind="stable")[:5].tolist()) for i in range(400)}
    assert sum(len(got[i] & want[i]) for i in want) / 2000 > 0.99
    assert got[150] == want[150] == {100, 101, 102, 103, 104}
    assert neighbours.nearest_neighbours(usable.limit(0)).count() == 0


# -- 8


def test_tokens_match_the_library(spark):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokenizer.FOLDER}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    rnd = random.Random(2)
    alphabet = "ab's'tre 've'll  \n\t\r\x1c\x85\xa0 éß日1²٣.,'’_\u3000\x00🙂"
    texts = ["", None, "<|endoftext|>", "aaaa" * 500, "日本語" * 300, "x" * 100_000] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(500)]
    got = {r.doc_id: r.ids for r in tokenizer.encode_corpus(docs(spark, [("a.md", t) for t in texts])).collect()}
    assert [got[i] for i in range(len(texts))] == [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


# -- 9


def test_leaks(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(600)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(60), text(70) if i else None) for i in range(20)]
    table = spark.createDataFrame(items, "item_id bigint, prompt string, solution string")
    p = items[3][1].split()
    altered = " ".join("some" if i % 12 == 5 else w for i, w in enumerate(p))
    rows = [text(200), "x " + items[5][2] + " y", "# " + "\n# ".join(" ".join(p[i : i + 6]) for i in range(0, 60, 6)).upper(), altered, " ".join(p[20:55]), " ".join(p[:8]), None, "", text(3000) + " " + altered + " " + text(3000)]
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs(spark, [("a.md", t) for t in rows]), table).collect()}
    assert got == {(1, 5), (2, 3), (3, 3), (4, 3), (8, 3)}
    assert leaks.leaked_items(docs(spark, []), table).count() == 0
    assert leaks.leaked_items(docs(spark, [("a.md", "x" * 100)]), table.limit(0)).count() == 0


def _edited(text, every, rnd):
    """One edit in every `every` letters and digits: changed, left out or put in."""
    out, n = [], 0
    for c in text:
        n += c.isalnum()
        if c.isalnum() and n % every == 0:
            c = rnd.choice(["q", "", c + "q"])
        out.append(c)
    return "".join(out)


def test_leaks_at_every_rate_of_the_budget(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, text(70), None) for i in range(12)]
    table = spark.createDataFrame(items, "item_id bigint, prompt string, solution string")
    rows, want = [], set()
    for every in (9, 10, 12, 15, 20, 40):
        for i, p, _ in items[:6]:
            half = " ".join(p.split()[15:50])
            for passage in (p, half):
                want.add((len(rows), i))
                rows.append(text(60) + " " + _edited(passage, every, rnd) + " " + text(60))
    rows += [text(300) for _ in range(10)]
    got = {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs(spark, [("a.md", t) for t in rows]), table).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in leaks.leaked_items(docs(spark, [("a.md", t) for t in rows]), table, group_chars=1500).collect()} == want


def test_leaks_of_alike_items_and_usual_forms(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    one, form = text(70), text(40)
    items = [(i, one.replace(one.split()[3], f"word{i}"), None) for i in range(50)] + [(100 + i, form + " " + text(30), None) for i in range(20)] + [(200, one, None), (201, "ÄÖÜ " + text(60).upper(), None)]
    table = spark.createDataFrame(items, "item_id bigint, prompt string, solution string")
    rows = [text(50) + " " + one + " " + text(50), form + " " + text(30), items[60][1], "x " * 700_000 + items[60][1] + " y" * 700_000, items[-1][1].lower()]
    got = {}
    for r in leaks.leaked_items(docs(spark, [("a.md", t) for t in rows]), table).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    assert got == {0: {*range(50), 200}, 2: {110}, 3: {110}, 4: {201}}


# -- 10


def test_isotonic_is_monotone_and_fits():
    rng = np.random.default_rng(0)
    x = rng.random(300)
    knots, values = reading.isotonic(x, 3 * x + rng.normal(size=300) * 0.2)
    assert (np.diff(values) >= 0).all() and abs(np.interp(0.5, knots, values) - 1.5) < 0.3


def test_reading_levels(spark):
    rnd = random.Random(6)
    easy, hard = "We see a red cup . Put the box in the bag . Look at the old tree".split(" . "), "Idempotence presupposes contravariant reachability . Orchestration attenuates the epistemic provenance of linearizability . Commutativity operationalizes heterogeneity".split(" . ")
    make = lambda kind: ". ".join(rnd.choice(kind) for _ in range(6)) + "."
    texts = [make(easy if i % 2 else hard) for i in range(60)]
    quoted = "\n\n".join(["> " + make(hard), "- " + make(hard), "```\n" + make(hard) + "\n```", make(easy)])
    rows = [("a.md", t) for t in texts] + [("b.md", quoted), ("c.md", "> " + make(hard)), ("d.md", None), ("e.rst", " \n"), ("f.py", make(hard))]
    labels = spark.createDataFrame([(i, r, 1 if i % 2 else 5) for i in range(40) for r in ("r1", "r2", "r2")] + [(41, "r1", None)], "doc_id bigint, rater string, band int")
    table = docs(spark, rows)
    got = {r.doc_id: r.level for r in reading.reading_levels(table, labels).collect()}
    assert set(got) == set(range(62)) and got[61] is None and got[60] < 2
    assert all((got[i] > 3.5) == (i % 2 == 0) for i in range(40, 60))
    assert all(r.level is None for r in reading.reading_levels(table, labels.limit(0)).collect())
    assert {r.doc_id for r in reading.demanding(reading.reading_levels(table, labels)).collect()} == {i for i in range(60) if i % 2 == 0}


def test_neighbours_match_sql(spark):
    import os

    duckdb = pytest.importorskip("duckdb")
    from quiver.llm.queries import QUERIES, SQL

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW node_embeddings AS SELECT * FROM '{d}/node_embeddings.parquet'")
    for name in ("p6_found", "p6_ranked"):
        want = c.sql(SQL[name])
        got = QUERIES[name](spark, d).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_visits_follow_the_recall(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(300, 12)), 10, axis=0) + rng.normal(size=(3000, 12)) * 0.4
    rows = spark.createDataFrame([(int(i), [float(v) for v in np.float32(r)]) for i, r in enumerate(x)], "vec_id bigint, v array<float>")
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(3000) for j in np.argsort(-s[i], kind="stable")[:5]}
    for recall in (0.8, 0.95):
        found = {(r.vec_id, r.neighbour) for r in neighbours.nearest_neighbours(rows, 5, recall, 0).collect()}
        assert len(found) == 15_000 and len(found & want) / 15_000 > recall - 0.02


def test_queries_are_registered():
    from quiver.llm.queries import QUERIES

    assert {"p2_found", "p4_found", "p5_found", "p6_found", "p8_ids", "p9_found", "p10_found"} <= set(QUERIES)
    assert script_grammar.check("let a = 1", "js") is None
