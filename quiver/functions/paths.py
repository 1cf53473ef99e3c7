"""Path expressions: repository-relative paths, folders, organs, and what a path says about a file's role."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The roles that names of folders and files stand for.
#: First path segments of code that exercises or wires up the rest.
PERIPHERAL_ORGANS = ("tests", "test", "__tests__", "spec", "specs", "e2e", "scripts", "script")
#: The same at any depth.
PERIPHERAL_SEGMENTS = ("__tests__", "__mocks__", "tests", "test", "spec", "e2e")
#: File names of tests beside the code they test.
TEST_FILE = r"[._](test|spec)\.[jt]sx?$"
#: File stems and names that are used without being imported.
ENTRY_STEMS = ("__main__", "__init__", "cli", "conftest", "main", "setup")
ENTRY_FILE = r"^(App|index|main)\.[jt]sx?$|\.config\.[mc]?[jt]s$"


def relative_path(path: Column, root: Column) -> Column:
    """Path below the repository root; absolute paths elsewhere fall under ``(external)``; empty becomes null."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    inside = F.startswith(path, F.coalesce(base, F.lit("\0")))
    return F.when(path == "", None).when(inside, F.substr(path, F.length(base) + 1)).when(
        F.startswith(path, F.lit("/")), F.concat(F.lit("(external)"), path)
    ).otherwise(path)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """Everything before the last slash, '' for a file at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def organ(directory: Column) -> Column:
    """First segment of a folder."""
    return F.substring_index(directory, "/", 1)


def stem(path: Column) -> Column:
    """File name without its last ending."""
    name = file_name(path)
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def is_peripheral(path: Column) -> Column:
    """Test and script code, by the first segment, the file name or any segment."""
    return (
        F.substring_index(path, "/", 1).isin(*PERIPHERAL_ORGANS)
        | file_name(path).rlike(TEST_FILE)
        | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, PERIPHERAL_SEGMENTS)))
    )


def is_entry_point(path: Column) -> Column:
    """Files that something other than an import starts."""
    return stem(path).isin(*ENTRY_STEMS) | file_name(path).rlike(ENTRY_FILE)


def is_deep_import(source_folder: Column, target_folder: Column) -> Column:
    """Into another organ, below its root."""
    a, b = organ(source_folder), organ(target_folder)
    return (a != "") & (b != "") & (a != b) & F.contains(target_folder, F.lit("/"))


def edge_reason(source: Column, target: Column) -> Column:
    """Why a dependency between two files is allowed, or ``cross_organ_internal`` if it isn't."""
    sf, tf = folder(source), folder(target)
    return (
        F.when((organ(sf) == "") | (organ(tf) == ""), "top_level")
        .when(is_peripheral(source), "peripheral_source")
        .when(organ(sf) == organ(tf), "same_organ")
        .when(is_deep_import(sf, tf), "cross_organ_internal")
        .otherwise("front_door")
    )


def is_upward(source: Column, target: Column) -> Column:
    """Within an organ, into a folder that strictly contains the source's."""
    sf, tf = folder(source), folder(target)
    return (organ(sf) != "") & (organ(sf) == organ(tf)) & (tf != "") & F.startswith(sf, F.concat(tf, F.lit("/")))


def ancestors(directory: Column) -> Column:
    """All folders on the way to a folder, itself included; an empty array for ''."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    )


def glob_pattern(glob: Column) -> Column:
    """Anchored regular expression of a glob in which `*` also crosses slashes."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*+", ".*"), r"\?", "."), F.lit("$"))


def is_ignored(path: Column, patterns: Column) -> Column:
    """Whether any pattern holds: plain ones name a whole path component, the others match the file name."""
    name, parts = file_name(path), F.split(path, "/")
    hit = F.exists(
        patterns,
        lambda p: F.when(F.startswith(p, F.lit("*")), F.regexp_like(name, glob_pattern(p))).otherwise(
            F.array_contains(parts, p) | F.regexp_like(name, glob_pattern(p))
        ),
    )
    return F.coalesce(hit, F.lit(False))
