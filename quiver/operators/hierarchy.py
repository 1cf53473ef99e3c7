"""Parent-child links to full hierarchies.

Links are cut into fragments, ranges of ids, one a partition. Inside a fragment every chain of parents is followed to
the id where it leaves the fragment (its exit). Exits that are children elsewhere form a smaller quotient forest, which
is solved the same way until it fits one fragment, and the fragments' chains and paths are expanded with its result. A
chain that never leaves its fragment is a local cycle; a cycle over several fragments is one in the quotient. No group
of rows is collected by key, and a fragment holds about `FRAGMENT_ROWS` links at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.session import checkpointed, checkpointed_in_loop, width

#: Links that one task contracts at once (some 200 bytes each), and ids of paths that it hands on at once.
FRAGMENT_ROWS, PATH_IDS = 200_000, 500_000

_SCHEMA = "graph_id string, id string, exit string, steps bigint, cyclic boolean"


def _codes(links: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the children and the parents, the same for equal ids of a graph, and how many there are."""
    ids, _ = pd.factorize(pd.concat([links.id, links.parent], ignore_index=True))
    graphs, names = pd.factorize(links.graph_id, use_na_sentinel=False)
    codes, distinct = pd.factorize(np.concatenate([graphs, graphs]) + ids * np.int64(len(names)))
    return codes[: len(links)], codes[len(links) :], len(distinct)


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow all chains of one fragment to their exits by pointer doubling over arrays."""
    parts = list(batches)
    if not parts or not sum(map(len, parts)):
        return
    links = pd.concat(parts, ignore_index=True)
    child, parent, size = _codes(links)
    is_exit = np.ones(size, dtype=bool)
    is_exit[child] = False
    to, steps = np.arange(size), np.zeros(size, dtype=np.int64)
    to[child], steps[child] = parent, links.steps.to_numpy(dtype=np.int64)
    cyclic = np.zeros(size, dtype=bool)
    cyclic[child] = links.cyclic.to_numpy(dtype=bool)
    for _ in range(max(1, math.ceil(math.log2(size + 1))) + 1):
        further = to[to]
        if (further == to).all():
            break
        steps, cyclic, to = steps + steps[to], cyclic | cyclic[to], further
        steps = np.minimum(steps, np.int64(1) << 60)  # only chains on cycles come this far
    at = to[child]
    cyclic = cyclic[child] | ~is_exit[at]
    names = np.empty(size, dtype=object)
    names[child], names[parent] = links.id.to_numpy(dtype=object), links.parent.to_numpy(dtype=object)
    yield pd.DataFrame(
        {
            "graph_id": links.graph_id,
            "id": links.id,
            "exit": np.where(cyclic, "", names[at]),
            "steps": np.where(cyclic, -1, steps[child]),
            "cyclic": cyclic,
        }
    )


def _same(left: str, a: str, right: str, b: str):
    return F.col(f"{left}.graph_id").eqNullSafe(F.col(f"{right}.graph_id")) & (F.col(f"{left}.{a}") == F.col(f"{right}.{b}"))


def _doubled(links: DataFrame, rows: int) -> DataFrame:
    """Solve a quotient that local contraction no longer shrinks: log2(depth) rounds of pointer doubling."""
    done = None
    for _ in range(math.ceil(math.log2(max(2, rows))) + 1):
        nxt = links.alias("a").join(links.alias("b"), _same("a", "exit", "b", "id"), "left")
        links = checkpointed_in_loop(
            nxt.select(
                "a.graph_id",
                "a.id",
                F.coalesce("b.exit", "a.exit").alias("exit"),
                (F.col("a.steps") + F.coalesce("b.steps", F.lit(0))).alias("steps"),
                F.coalesce(F.col("a.cyclic") | F.col("b.cyclic"), F.col("a.cyclic")).alias("cyclic"),
                F.col("b.id").isNotNull().alias("moving"),
            )
        )
        ended = links.where(~F.col("moving") | F.col("cyclic")).drop("moving")
        done = ended if done is None else done.unionByName(ended)
        rest = links.where(F.col("moving") & ~F.col("cyclic")).drop("moving")
        if rest.isEmpty():
            return done
        links = links.drop("moving")
        done = None
    still = links.alias("a").join(links.select("graph_id", "id").alias("b"), _same("a", "exit", "b", "id"), "left")
    on_cycle = F.col("b.id").isNotNull() | F.col("a.cyclic")
    return still.select(
        "a.graph_id",
        "a.id",
        F.when(on_cycle, "").otherwise(F.col("a.exit")).alias("exit"),
        F.when(on_cycle, -1).otherwise(F.col("a.steps")).alias("steps"),
        on_cycle.alias("cyclic"),
    )


def _fragments(links: DataFrame, rows: int, fragment_rows: int, first: bool) -> DataFrame:
    """Links in ranges of ids: neighbours in order mostly share their first segments, hence their ancestors."""
    parts = max(math.ceil(rows / fragment_rows), width(links.sparkSession) if first else 1)
    return links.repartitionByRange(parts, "graph_id", "id") if parts > 1 else links.coalesce(1)


def _crossing(local: DataFrame, leaving: DataFrame) -> DataFrame:
    """Rows of the ids at which the chains of `leaving` arrive: the quotient."""
    exits = leaving.select("graph_id", F.col("exit").alias("id")).distinct()
    return checkpointed(local.alias("l").join(exits.alias("x"), _same("l", "id", "x", "id"), "left_semi"))


def _solve(links: DataFrame, rows: int, fragment_rows: int, first: bool = True) -> DataFrame:
    """`links` (graph_id, id, parent, steps, cyclic) to (graph_id, id, exit, steps, cyclic), exits being roots."""
    local = _fragments(links, rows, fragment_rows, first).mapInPandas(_contract, _SCHEMA)
    if not first and rows <= fragment_rows:  # the last quotient: no chain leaves it
        return local
    local = checkpointed(local)
    quotient = _crossing(local, local.where(~F.col("cyclic")))
    left = quotient.count()
    if left == 0:
        return local
    if not first and left > rows // 2:
        solved = _doubled(quotient, left)
    else:
        solved = _solve(quotient.withColumnRenamed("exit", "parent"), left, fragment_rows, False)
    joined = local.alias("l").join(solved.alias("s"), _same("l", "exit", "s", "id"), "left")
    cyclic = F.col("l.cyclic") | F.coalesce("s.cyclic", F.lit(False))
    return joined.select(
        "l.graph_id",
        "l.id",
        F.when(cyclic, "").otherwise(F.coalesce("s.exit", "l.exit")).alias("exit"),
        F.when(cyclic, -1).otherwise(F.col("l.steps") + F.coalesce("s.steps", F.lit(0))).alias("steps"),
        cyclic.alias("cyclic"),
    )


def parent_links(edges: DataFrame, relations: tuple[str, ...] = ("CONTAINS", "DEFINES")) -> DataFrame:
    """Distinct (graph_id, parent, id) of the given relations, both ends neither null nor empty.

    An id with several parents, which sound data don't have, keeps the least one; `further_parents` names the others.
    """
    usable = F.col("rel_type").isin(*relations) & (F.col("source") != "") & (F.col("target") != "")
    return (
        edges.where(usable)
        .groupBy("graph_id", F.col("target").alias("id"))
        .agg(F.min("source").alias("parent"))
    )


def further_parents(edges: DataFrame, relations: tuple[str, ...] = ("CONTAINS", "DEFINES")) -> DataFrame:
    """The links that `parent_links` leaves out, as their child has a lesser parent: ``graph_id, parent, id``."""
    usable = F.col("rel_type").isin(*relations) & (F.col("source") != "") & (F.col("target") != "")
    links = edges.where(usable).select("graph_id", F.col("target").alias("id"), F.col("source").alias("parent")).distinct()
    kept = parent_links(edges, relations)
    return links.alias("l").join(kept.alias("k"), _same("l", "id", "k", "id")).where("l.parent <> k.parent").select("l.graph_id", "l.parent", "l.id")


def hierarchy(links: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """Root and depth of every id that `links` (graph_id, parent, id) name.

    Columns ``graph_id, node_id, root_id, depth``. A root has depth 0 and itself as root; ids on a cycle or below
    one have root ``''`` and depth -1, so does a link of an id to itself. Null graph ids form one graph. Repeated
    links count once. An empty input gives no rows.
    """
    links = checkpointed(links.select("graph_id", "id", "parent"))
    solved = _solve(links.withColumns({"steps": F.lit(1).cast("bigint"), "cyclic": F.lit(False)}), links.count(), fragment_rows)
    children = links.select("graph_id", "id")
    roots = (
        links.select("graph_id", F.col("parent").alias("id")).distinct().alias("p")
        .join(children.alias("c"), _same("p", "id", "c", "id"), "left_anti")
    )
    return solved.select(
        "graph_id", F.col("id").alias("node_id"), F.col("exit").alias("root_id"), F.col("steps").cast("int").alias("depth")
    ).unionByName(
        roots.select("graph_id", F.col("id").alias("node_id"), F.col("id").alias("root_id"), F.lit(0).alias("depth"))
    )


def _fragment_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids of the way from below the fragment's exit down to each node: one walk through the fragment's trees, whose
    stack is the way of the node it stands at."""
    parts = list(batches)
    if not parts or not sum(map(len, parts)):
        return
    links = pd.concat(parts, ignore_index=True)
    child, parent, size = _codes(links)
    row_of = np.full(size, -1)
    row_of[child] = np.arange(len(links))
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(size), side="left").tolist()
    last = np.searchsorted(parent[order], np.arange(size), side="right").tolist()
    below, code, names, graphs = order.tolist(), child.tolist(), links.id.tolist(), links.graph_id.tolist()
    above = links.parent.tolist()
    out: list[tuple] = []
    held = 0
    for top in np.unique(parent[row_of[parent] < 0]).tolist():
        way: list[str] = []
        todo = [(r, 0) for r in below[first[top] : last[top]]]
        leads = above[todo[0][0]]
        while todo:
            r, depth = todo.pop()
            del way[depth:]
            way.append(names[r])
            out.append((graphs[r], names[r], leads, list(way)))
            held += len(way)
            if held >= PATH_IDS:
                yield pd.DataFrame(out, columns=["graph_id", "id", "exit", "way"])
                out, held = [], 0
            c = code[r]
            todo += [(x, depth + 1) for x in below[first[c] : last[c]]]
    if out:
        yield pd.DataFrame(out, columns=["graph_id", "id", "exit", "way"])


def hierarchy_paths(links: DataFrame, fragment_rows: int = FRAGMENT_ROWS) -> DataFrame:
    """Path of every node that has a root: ``graph_id, node_id, root_id, depth, path`` (ids, root first).

    Nodes on or below a cycle have no path and are left out; `hierarchy` names them. The result holds an id for each
    node and ancestor; nothing else grows with depth.
    """
    known = checkpointed(hierarchy(links, fragment_rows))
    sound = known.where("depth > 0").select("graph_id", "node_id")
    tree = checkpointed(
        links.select("graph_id", "id", "parent").alias("l").join(sound.alias("k"), _same("l", "id", "k", "node_id"), "left_semi")
    )
    local = checkpointed(
        _fragments(tree, tree.count(), fragment_rows, True).mapInPandas(_fragment_paths, "graph_id string, id string, exit string, way array<string>")
    )
    quotient = _crossing(local, local)
    while True:  # the ways of the quotient double in length
        nxt = quotient.alias("a").join(quotient.alias("b"), _same("a", "exit", "b", "id"), "left")
        longer = checkpointed_in_loop(
            nxt.select(
                "a.graph_id",
                "a.id",
                F.coalesce("b.exit", "a.exit").alias("exit"),
                F.concat(F.coalesce("b.way", F.array().cast("array<string>")), "a.way").alias("way"),
                F.col("b.id").isNotNull().alias("moved"),
            )
        )
        quotient = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    joined = local.alias("l").join(quotient.alias("q"), _same("l", "exit", "q", "id"), "left")
    root, way = F.coalesce("q.exit", "l.exit"), F.concat(F.coalesce("q.way", F.array().cast("array<string>")), "l.way")
    below = joined.select("l.graph_id", F.col("l.id").alias("node_id"), root.alias("root_id"), F.size(way).alias("depth"), F.concat(F.array(root), way).alias("path"))
    roots = known.where("depth = 0").withColumn("path", F.array("node_id"))
    return below.unionByName(roots)


def descendants(paths: DataFrame) -> DataFrame:
    """All pairs ``graph_id, ancestor_id, node_id, distance`` from the paths of `hierarchy_paths`."""
    return paths.select(
        "graph_id", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor_id"), "node_id", "depth"
    ).select("graph_id", "ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(pairs: DataFrame) -> DataFrame:
    """Number of descendants and greatest distance for each id that has any."""
    return pairs.groupBy("graph_id", "ancestor_id").agg(
        F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("height")
    )
