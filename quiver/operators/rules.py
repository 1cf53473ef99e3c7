"""Rules of hygiene over files and their dependencies. Findings have the columns of `FINDING`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions import paths

FINDING = "graph_id string, file_path string, rule string, level string, target string, n bigint"


def _finding(rule: str, level: str, target: Column, n: Column) -> list[Column]:
    return [
        F.col("graph_id"), F.col("sf").alias("file_path"), F.lit(rule).alias("rule"), F.lit(level).alias("level"),
        target.alias("target"), n.cast("bigint").alias("n"),
    ]


def deep_imports(pairs: DataFrame) -> DataFrame:
    """Dependencies into the inside of another organ; those of peripheral files are exempt."""
    deep = paths.edge_reason(F.col("sf"), F.col("tf")) == "cross_organ_internal"
    return pairs.where(deep).select(*_finding("deep_import", "warning", F.col("tf"), F.col("n")))


def upward_imports(pairs: DataFrame) -> DataFrame:
    """Dependencies on a folder above one's own, within an organ."""
    return pairs.where(paths.is_upward(F.col("sf"), F.col("tf"))).select(*_finding("upward_import", "warning", F.col("tf"), F.col("n")))


def orphan_modules(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files nothing depends on, without peripheral ones and entry points; none in a graph without dependencies."""
    used = pairs.select("graph_id", F.col("tf").alias("file_path")).distinct()
    alive = pairs.select("graph_id").distinct()
    path = F.col("file_path")
    return (
        files.where(~paths.is_peripheral(path) & ~paths.is_entry_point(path))
        .join(alive, "graph_id", "left_semi")
        .join(used, ["graph_id", "file_path"], "left_anti")
        .withColumnRenamed("file_path", "sf")
        .select(*_finding("orphan_module", "info", F.lit(None).cast("string"), F.lit(0)))
    )


def dependency_cycles(components: DataFrame) -> DataFrame:
    """Files in a strongly connected component of at least two: `components` are ``graph_id, id, component``.

    `target` names the component by its least file and `n` is its size; the members are the component's findings.
    """
    sizes = components.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        components.join(sizes, ["graph_id", "component"])
        .withColumnRenamed("id", "sf")
        .select(*_finding("dependency_cycle", "error", F.col("component"), F.col("n")))
    )


def assign_modules(files: DataFrame, modules: DataFrame, column: str = "file_path") -> DataFrame:
    """The declared module of each file: the first, by `ordinal`, of which a path glob matches and no exclusion does.

    `modules` is a configuration of a few rows (ordinal, module, paths, exclude) that a person wrote; it is joined as a
    whole. Files of no module have a null `module`.
    """
    f, m = files.alias("f"), modules.alias("m")
    path = F.col(f"f.{column}")
    matches = lambda globs: F.exists(globs, lambda g: F.regexp_like(path, paths.glob_pattern(g)))
    excluded = matches(F.coalesce(F.col("m.exclude"), F.array().cast("array<string>")))
    hit = f.join(m, matches(F.col("m.paths")) & ~excluded, "left")
    keys = [F.col(f"f.{c}") for c in files.columns]
    return hit.groupBy(*keys).agg(F.min_by("m.module", "m.ordinal").alias("module"))


def layer_violations(pairs: DataFrame, modules: DataFrame, exceptions: DataFrame, today: Column | None = None) -> DataFrame:
    """Dependencies between declared modules that aren't allowed; others fall back to the rule of deep imports.

    A module may depend on itself, on what its `may_depend_on` names (`*`: on all), and on what an exception that
    hasn't expired names.
    """
    files = pairs.select("graph_id", F.col("sf").alias("file_path")).union(pairs.select("graph_id", "tf")).distinct()
    known = assign_modules(files, modules)
    s = known.select("graph_id", F.col("file_path").alias("sf"), F.col("module").alias("sm"))
    t = known.select("graph_id", F.col("file_path").alias("tf"), F.col("module").alias("tm"))
    allowed = modules.select(F.col("module").alias("sm"), "may_depend_on")
    valid = exceptions.where(F.col("expires").isNull() | (F.col("expires") >= (today if today is not None else F.current_date())))
    excused = valid.select(F.col("from_module").alias("sm"), F.col("to_module").alias("tm")).distinct().withColumn("excused", F.lit(True))
    rows = (
        pairs.where(~paths.is_peripheral(F.col("sf")))
        .join(s, ["graph_id", "sf"])
        .join(t, ["graph_id", "tf"])
        .join(allowed, "sm", "left")
        .join(excused, ["sm", "tm"], "left")
    )
    declared = F.col("sm").isNotNull() & F.col("tm").isNotNull()
    may = F.coalesce(F.col("may_depend_on"), F.array().cast("array<string>"))
    fine = (F.col("sm") == F.col("tm")) | F.array_contains(may, F.col("tm")) | F.array_contains(may, "*") | F.coalesce("excused", F.lit(False))
    deep = paths.is_deep_import(paths.folder(F.col("sf")), paths.folder(F.col("tf")))
    rule = F.when(declared & ~fine, "layer_violation").when(~declared & deep, "deep_import")
    return rows.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(
        "graph_id", F.col("sf").alias("file_path"), "rule", F.lit("warning").alias("level"), F.col("tf").alias("target"), "n"
    )


def analyse(files: DataFrame, pairs: DataFrame, components: DataFrame) -> DataFrame:
    """All findings of the rules that need no configuration."""
    return (
        deep_imports(pairs)
        .unionByName(upward_imports(pairs))
        .unionByName(orphan_modules(files, pairs))
        .unionByName(dependency_cycles(components))
    )


def finding_ids(findings: DataFrame, projects: DataFrame) -> DataFrame:
    """Ids under which findings are stored: file, rule, and a number from the second of a rule in a file on."""
    roots = projects.groupBy("graph_id").agg(F.min("repo_path").alias("repo_path"))
    place = F.row_number().over(Window.partitionBy("graph_id", "file_path", "rule").orderBy("target"))
    name = F.concat(F.col("repo_path"), F.lit("/"), F.col("file_path"), F.lit(":arch:"), F.col("rule"))
    return findings.join(roots, "graph_id").withColumn("k", place).select(
        "graph_id", F.when(F.col("k") == 1, name).otherwise(F.concat(name, F.lit(":"), F.col("k") - 1)).alias("id"),
        "file_path", "rule", "level", "target", "n",
    )


def replace_findings(stored: DataFrame, findings: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Stored diagnostics with all of the given rules replaced by the findings of this run."""
    return stored.where(~F.col("rule").isin(*rules)).unionByName(findings, allowMissingColumns=True)


def rollup_levels(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Number and worst level of diagnostics for each folder, over all files below it."""
    rank = F.when(F.col("level") == "error", 3).when(F.col("level") == "warning", 2).when(F.col("level") == "info", 1).otherwise(0)
    per_file = diagnostics.groupBy("graph_id", "file_path").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("worst"))
    up = files.join(per_file, ["graph_id", "file_path"], "left").select(
        "graph_id", F.explode(paths.ancestors(paths.folder(F.col("file_path")))).alias("directory"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("worst", F.lit(0)).alias("worst")
    )
    worst = F.max("worst")
    return up.groupBy("graph_id", "directory").agg(
        F.sum("n").alias("n"), F.element_at(F.array(F.lit(None), F.lit("info"), F.lit("warning"), F.lit("error")), worst + 1).alias("worst_level")
    )


def tree_edges(files: DataFrame) -> DataFrame:
    """The folder tree: every file and folder with its parent folder and depth."""
    path = F.col("file_path")
    hubs = files.select("graph_id", F.explode(paths.ancestors(paths.folder(path))).alias("child")).distinct().withColumn("kind", F.lit("directory"))
    leaves = files.select("graph_id", path.alias("child")).distinct().withColumn("kind", F.lit("file"))
    child = F.col("child")
    return hubs.unionByName(leaves).select(
        "graph_id", "child", paths.folder(child).alias("parent"), "kind", (F.size(F.split(child, "/")) - 1).alias("depth")
    )


def public_surface(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Per organ: files at its root (its surface), consumers through it and past it, and how much of it is used.

    `unused_surface` counts surface files without an outside consumer, `leaked_internals` inner files that at least two
    outside files use.
    """
    target = paths.organ(paths.folder(F.col("tf")))
    outside = pairs.where((target != "") & (target != paths.organ(paths.folder(F.col("sf")))) & ~paths.is_peripheral(F.col("sf")))
    uses = outside.select("graph_id", target.alias("organ"), "sf", "tf", F.contains(paths.folder(F.col("tf")), F.lit("/")).alias("deep"))
    per_file = uses.groupBy("graph_id", "organ", "tf").agg(F.count(F.lit(1)).alias("consumers"))
    own = files.select("graph_id", paths.organ(paths.folder(F.col("file_path"))).alias("organ"), F.col("file_path").alias("tf")).where("organ <> ''")
    surface = ~F.contains(paths.folder(F.col("tf")), F.lit("/"))
    exports = own.join(per_file, ["graph_id", "organ", "tf"], "left").groupBy("graph_id", "organ").agg(
        F.count_if(surface).alias("surface_files"),
        F.count_if(surface & F.col("consumers").isNull()).alias("unused_surface"),
        F.count_if(~surface & (F.col("consumers") >= 2)).alias("leaked_internals"),
    )
    consumers = uses.groupBy("graph_id", "organ").agg(
        F.count_distinct(F.when(~F.col("deep"), F.col("sf"))).alias("via_surface"), F.count_distinct(F.when(F.col("deep"), F.col("sf"))).alias("deep_consumers")
    )
    return exports.join(consumers, ["graph_id", "organ"], "left").select(
        "graph_id", "organ", "surface_files", "unused_surface", "leaked_internals",
        F.coalesce("via_surface", F.lit(0)).alias("via_surface"), F.coalesce("deep_consumers", F.lit(0)).alias("deep_consumers"),
    )


def placement_ranking(references: DataFrame, candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rank candidate modules for new code that refers to others.

    `references` are ``item, module`` (null if unknown), `candidates` ``module``, `allowed` ``module, target``. A
    candidate's score is minus its violations, less 0.4 for each unknown reference, plus 0.25 for each in its own
    module; ties go to fewer violations, fewer unknowns, then the name. Candidates are the modules of a configuration.
    """
    c = candidates.select("module").distinct().alias("c")
    r = references.alias("r")
    a = allowed.select("module", "target").distinct().withColumn("ok", F.lit(True)).alias("a")
    rows = r.join(c, F.lit(True)).join(
        a, (F.col("a.module") == F.col("c.module")) & (F.col("a.target") == F.col("r.module")), "left"
    )
    same, unknown = F.col("c.module") == F.col("r.module"), F.col("r.module").isNull()
    sums = rows.groupBy(F.col("r.item").alias("item"), F.col("c.module").alias("module")).agg(
        F.count_if(~unknown & ~same & F.col("a.ok").isNull()).alias("violations"),
        F.count_if(unknown).alias("unknowns"),
        F.count_if(same).alias("co_located"),
    )
    score = F.round(-F.col("violations") - 0.4 * F.col("unknowns") + 0.25 * F.col("co_located"), 6)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "violations", "unknowns", "module")
    return sums.withColumn("score", score).withColumn("place", F.row_number().over(order))
