"""What repositories say of themselves: tracked files and changes from git, path aliases from TypeScript's configuration."""

from __future__ import annotations

import json
import pathlib
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

STATUS = "graph_id string, file_path string, letter string, old_path string"


class NoRepository(Exception):
    """The folder isn't a git repository, so callers compare hashes instead."""


def _git(root: str, *arguments: str) -> str:
    run = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True)
    if run.returncode:
        raise ValueError(run.stderr.strip() or f"git {arguments[0]} failed")
    return run.stdout


def _repository(root: str) -> None:
    try:
        _git(root, "rev-parse", "--git-dir")
    except (ValueError, FileNotFoundError) as e:
        raise NoRepository(root) from e


def tracked_files(spark: SparkSession, root: str, graph_id: str) -> DataFrame:
    """Files that git tracks: ``graph_id, file_path``. `NoRepository` if the folder isn't one."""
    _repository(root)
    names = [n for n in _git(root, "ls-files", "-z").split("\0") if n]
    return spark.createDataFrame([(graph_id, n) for n in names], "graph_id string, file_path string")


def changes_since(spark: SparkSession, root: str, graph_id: str, ref: str) -> DataFrame:
    """Changes of tracked files since `ref`, the working tree included, as `sync.git_status` takes them: ``graph_id,
    file_path, letter, old_path``. An unknown `ref` is refused."""
    _repository(root)
    try:
        _git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")
    except ValueError as e:
        raise ValueError(f"{ref!r} names no commit of this repository") from e
    parts = _git(root, "diff", "--name-status", "-z", "-M", ref).split("\0")
    rows, i = [], 0
    while i + 1 < len(parts):
        letter = parts[i][:1]
        if letter in "RC":
            rows.append((graph_id, parts[i + 2], letter, parts[i + 1]))
            i += 3
        else:
            rows.append((graph_id, parts[i + 1], letter, None))
            i += 2
    return spark.createDataFrame(rows, STATUS)


_JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/|,(?=\s*(?:(?://[^\n]*|/\*.*?\*/)\s*)*[}\]])', re.S)


def relaxed_json(text: str) -> object:
    """JSON with comments and commas before closing brackets."""
    return json.loads(_JSON_PART.sub(lambda m: m.group() if m.group()[0] == '"' else "", text.removeprefix("﻿")))


def path_aliases(spark: SparkSession, root: str, graph_id: str, name: str = "tsconfig.json") -> DataFrame:
    """Aliases of a configuration and those it extends, as `files.resolve_specifiers` takes them: ``graph_id, pattern,
    replacement``, relative to `root`. The nearest configuration that has paths gives them all; of several replacements
    the first counts. A file that is missing or can't be read gives none."""
    base = pathlib.Path(root).resolve()
    at, seen = base / name, set()
    rows: list[tuple[str, str, str]] = []
    while at not in seen and at.is_file():
        seen.add(at)
        try:
            config = relaxed_json(at.read_text("utf-8"))
        except ValueError:
            break
        options = config.get("compilerOptions") or {}
        if options.get("paths"):
            start = (at.parent / options.get("baseUrl", ".")).resolve()
            for pattern, targets in options["paths"].items():
                if targets and (start / targets[0]).is_relative_to(base):
                    rows.append((graph_id, pattern, (start / targets[0]).relative_to(base).as_posix()))
            break
        further = config.get("extends")
        if not isinstance(further, str) or not further.startswith("."):
            break
        at = (at.parent / further).resolve()
        at = at if at.suffix == ".json" else at.with_name(at.name + ".json")
    return spark.createDataFrame(rows, "graph_id string, pattern string, replacement string")
