"""Facts read from source text: definitions, calls and imports of Python files, rules over them, and snippets."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT = "doc_id bigint, kind string, name string, qualname string, line_start int, line_end int, parameters int, untyped int, branches int, target string"
_TYPES = [pa.int64(), *[pa.string()] * 3, *[pa.int32()] * 5, pa.string()]
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.BoolOp, ast.IfExp, ast.comprehension, ast.Assert, ast.match_case)


def _facts(doc_id: int, text: str) -> Iterator[tuple]:
    """Facts of one file; one that doesn't parse gives a single `error` fact."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        yield doc_id, "error", type(e).__name__, None, getattr(e, "lineno", None), None, None, None, None, str(getattr(e, "msg", e))
        return
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.value.id for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)}
    stack: list[tuple[ast.AST, str, str]] = [(tree, "", "module")]
    while stack:
        node, prefix, inside = stack.pop()
        for child in ast.iter_child_nodes(node):
            name, kind = prefix, inside
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name, kind = f"{prefix}{child.name}", "function"
                a = child.args
                args = [x for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.arg not in ("self", "cls")]
                branches = 1 + sum(isinstance(n, _BRANCHES) for n in ast.walk(child))
                yield doc_id, "method" if inside == "class" else "function", child.name, name, child.lineno, child.end_lineno, len(args), sum(x.annotation is None for x in args), branches, None
                name += "."
            elif isinstance(child, ast.ClassDef):
                name, kind = f"{prefix}{child.name}", "class"
                yield doc_id, "class", child.name, name, child.lineno, child.end_lineno, None, None, None, ", ".join(ast.unparse(b) for b in child.bases)
                name += "."
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                module = getattr(child, "module", None)
                for alias in child.names:
                    known = (alias.asname or alias.name).split(".")[0]
                    target = f"{module}.{alias.name}" if module else alias.name
                    yield doc_id, "import" if known in used else "unused_import", known, f"{prefix}{known}", child.lineno, child.end_lineno, None, None, None, target
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                called = child.func.id if isinstance(child.func, ast.Name) else child.func.attr
                yield doc_id, "call", called, f"{prefix}{called}", child.lineno, child.end_lineno, len(child.args) + len(child.keywords), None, None, None
            stack.append((child, name, kind))


def python_facts(documents: DataFrame) -> DataFrame:
    """Definitions, imports and calls of every Python file (.py) with a text, one fact a row.

    A file that doesn't parse gives one `error` row with the reason; null texts give none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FACT.split(", ")]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for batch in batches:
                rows = [f for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for f in _facts(i, t)]
                columns = zip(*rows) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)

    files = documents.where(F.col("file_path").endswith(".py") & F.col("text").isNotNull()).select("doc_id", "text")
    return files.mapInArrow(read, FACT)


def function_diagnostics(facts: DataFrame) -> DataFrame:
    """Rules over functions: more than 50 lines (a warning over 100), more than 7 parameters (over 14), parameters
    without a type, and imports nothing uses."""
    f = facts.withColumn("lines", F.col("line_end") - F.col("line_start") + 1)
    function = F.col("kind").isin("function", "method")
    level = lambda c, n: F.when(F.col(c) > n, "warning").otherwise("info")
    none = F.lit(None).cast("struct<rule:string,level:string>")
    rule = lambda when, name, lv: F.when(when, F.struct(F.lit(name).alias("rule"), lv.alias("level"))).otherwise(none)
    found = F.filter(
        F.array(
            rule(function & (F.col("lines") > 50), "complex_function", level("lines", 100)),
            rule(function & (F.col("parameters") > 7), "long_parameter_list", level("parameters", 14)),
            rule(function & (F.col("untyped") > 0), "missing_type_annotation", F.lit("info")),
            rule(F.col("kind") == "unused_import", "unused_import", F.lit("warning")),
        ),
        lambda x: x.isNotNull(),
    )
    return f.select("doc_id", "qualname", "line_start", F.explode(found).alias("r")).select("doc_id", "qualname", "line_start", "r.rule", "r.level")


def snippets(documents: DataFrame, spans: DataFrame, context: int = 2) -> DataFrame:
    """Numbered lines around each span (graph_id, id, file_path, line_start, line_end), the span's own marked ``>>>``.

    The text is that of the file's latest crawl; a span whose file has none gives no row.
    """
    latest = documents.where(F.col("text").isNotNull()).groupBy("graph_id", "file_path").agg(F.max(F.struct("crawled_at", "doc_id", "text")).alias("d"))
    rows = spans.join(latest, ["graph_id", "file_path"]).withColumn("lines", F.split("d.text", "\r\n|\r|\n"))
    first = F.greatest(F.col("line_start") - context, F.lit(1))
    last = F.least(F.col("line_end") + context, F.size("lines"))
    numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    line = lambda n: F.concat(
        F.when((n >= F.col("line_start")) & (n <= F.col("line_end")), ">>> ").otherwise("    "), F.lpad(n.cast("string"), 4, " "), F.lit(" | "), F.element_at("lines", n)
    )
    return rows.select("graph_id", "id", F.array_join(F.transform(numbers, line), "\n").alias("snippet"))
