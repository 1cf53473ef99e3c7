"""Files of repositories as tables: discovery, configuration, and import specifiers resolved to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.functions import paths

# What an extensionless specifier may stand for, in this order, and default patterns of ignored paths.
CANDIDATES = ("", ".ts", ".tsx", ".js", ".jsx", ".d.ts", ".mjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.d.ts")
IGNORED = (
    ".git", "__pycache__", "*.pyc", "node_modules", ".venv", "venv", ".tox", ".pytest_cache", ".mypy_cache", "*.egg-info", "dist", "build",
    ".idea", ".vscode", ".DS_Store", ".claude", "worktrees", ".worktrees", "external", ".gc", "_tmp", ".gemini", "archive",
)


def discover(spark: SparkSession, root: str, endings: tuple[str, ...], ignored: tuple[str, ...] = IGNORED, max_size: int = 1_000_000) -> DataFrame:
    """Files below `root` with one of the endings: ``file_path, size, modified, text``.

    Ignored paths and larger files are left out by name and size, before their content is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_extract(F.regexp_replace("path", r"^file:/+", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/(.*)$", 1)
    wanted = F.lit(False)
    for e in endings:
        wanted = wanted | below.endswith(e)
    kept = wanted & (F.col("length") <= max_size) & ~paths.is_ignored(below, F.array(*map(F.lit, ignored)))
    return files.where(kept).select(below.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("text"))


def changed_since(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Discovered files (with `graph_id`) that may have changed: new ones, and those not strictly older than their index.

    Only these need to be hashed.
    """
    s = stored.groupBy("graph_id", "file_path").agg(F.max("indexed_at").alias("indexed_at"))
    return files.join(s, ["graph_id", "file_path"], "left").where(F.col("indexed_at").isNull() | (F.col("modified") >= F.col("indexed_at"))).drop("indexed_at")


def normal_path(path: Column) -> Column:
    """A path without `.` and `..` segments; what leads above the root is null."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    walked = F.aggregate(
        parts,
        F.struct(start.alias("at"), F.lit(False).alias("out")),
        lambda s, p: F.when(p != "..", F.struct(F.concat(s["at"], F.array(p)).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["out"] | (F.size(s["at"]) == 0)).alias("out"))
        ),
    )
    return F.when(~walked["out"], F.array_join(walked["at"], "/"))


def resolve_specifiers(imports: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """The file each import (graph_id, file_path, specifier) means: ``graph_id, file_path, specifier, target``.

    Aliases (graph_id, pattern, replacement; patterns may end in `*`) come first, the longest winning; relative ones start
    at the importing file's folder. The first candidate that is one of `files` (graph_id, file_path) is taken; others
    have a null target.
    """
    a = aliases.select("graph_id", F.rtrim("pattern", F.lit("*")).alias("prefix"), F.rtrim("replacement", F.lit("*")).alias("to"), F.endswith("pattern", F.lit("*")).alias("open"))
    keys = [F.col(f"i.{c}") for c in ("graph_id", "file_path", "specifier")]
    fits = F.when(F.col("open"), F.startswith(F.col("specifier"), F.col("prefix"))).otherwise(F.col("specifier") == F.col("prefix"))
    led = imports.alias("i").join(a.alias("a"), (F.col("i.graph_id") == F.col("a.graph_id")) & fits, "left").groupBy(*keys).agg(
        F.max(F.struct(F.length("prefix").alias("n"), "prefix", "to")).alias("m")
    )
    by_alias = F.concat(F.col("m.to"), F.substr(F.col("specifier"), F.length("m.prefix") + 1))
    relative = F.when(F.startswith(F.col("specifier"), F.lit(".")), F.concat_ws("/", paths.folder(F.col("file_path")), F.col("specifier")))
    base = normal_path(F.coalesce(by_alias, relative))
    options = F.transform(F.array(*map(F.lit, CANDIDATES)), lambda e: F.concat(base, e))
    rows = led.select("graph_id", "file_path", "specifier", F.posexplode_outer(options).alias("place", "option"))
    known = files.select("graph_id", F.col("file_path").alias("option")).distinct().withColumn("there", F.lit(True))
    return rows.join(known, ["graph_id", "option"], "left").groupBy("graph_id", "file_path", "specifier").agg(
        F.min(F.when(F.col("there"), F.struct("place", "option"))).getField("option").alias("target")
    )


def refine_calls(calls: DataFrame, occurrences: DataFrame, definitions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls with the target that a compiler's index gives for their place, marked ``resolved_by = scip-python``.

    `calls` (graph_id, source, target, file_path, line, col), `occurrences` (graph_id, file_path, line, col, symbol),
    `definitions` (graph_id, symbol, file_path, line), `nodes` (graph_id, id, file_path, line_start). A call without an
    occurrence, definition or node keeps its target and has no mark.
    """
    d = definitions.select("graph_id", "symbol", F.col("file_path").alias("df"), F.col("line").alias("dl")).dropDuplicates(["graph_id", "symbol"])
    n = nodes.groupBy("graph_id", F.col("file_path").alias("df"), F.col("line_start").alias("dl")).agg(F.min("id").alias("to"))
    rows = (
        calls.join(occurrences.dropDuplicates(["graph_id", "file_path", "line", "col"]), ["graph_id", "file_path", "line", "col"], "left")
        .join(d, ["graph_id", "symbol"], "left")
        .join(n, ["graph_id", "df", "dl"], "left")
    )
    return rows.select("graph_id", "source", F.coalesce("to", "target").alias("target"), F.when(F.col("to").isNotNull(), "scip-python").alias("resolved_by"), "file_path", "line", "col")
