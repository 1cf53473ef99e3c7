"""Graphs that fit a task are solved in it, each as a whole, on numbered ids; the larger ones are left to rounds of joins.

Links are rows ``graph_id, id, next``. They are brought together by graph once, so a graph costs one shuffle of its links,
whatever the rounds it takes. Numbers follow the order of the ids (as bytes), so a least number is a least id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.session import checkpointed_in_loop as checkpointed
from quiver.session import width

#: Links of a graph that one task holds at once (some 300 bytes each, and about as much again while communities are sought).
TASK_LINKS = 1_000_000
#: Rows of a batch that a task hands on.
_BATCH = 20_000


def solved(links: DataFrame, solve: Callable, name: str, rounds: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``graph_id, id, name`` for every id of the links, named by an id of its set.

    `solve` (ids, from, to) gives for each number that of its set's name; `rounds` does the same as a whole for the links of
    graphs with more than `TASK_LINKS` of them. Ids without a graph are sets of their own.
    """
    links = links.select("graph_id", "id", "next")
    large = checkpointed(links.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > TASK_LINKS) & F.col("graph_id").isNotNull()).select("graph_id"))
    if large.isEmpty():
        return _in_tasks(links, solve, name)
    small = links.join(large, "graph_id", "left_anti")
    return _in_tasks(small, solve, name).unionByName(rounds(links.join(large, "graph_id", "left_semi")).select("graph_id", "id", name))


def _in_tasks(links: DataFrame, solve: Callable, name: str) -> DataFrame:
    def of_graph(key: tuple, rows: pa.Table) -> pa.Table:
        ids, a, b = _numbered(rows["id"], rows["next"])
        of = solve(len(ids), a, b) if key[0].is_valid else np.arange(len(ids))
        graph = pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(len(ids), dtype=np.int64)))
        out = pa.table({"graph_id": graph, "id": ids, name: ids.take(pa.array(of))})
        return pa.Table.from_batches(out.to_batches(max_chunksize=_BATCH), out.schema)

    # a stated number of partitions: few bytes are much work here
    together = links.repartition(width(links.sparkSession), "graph_id")
    return together.groupBy("graph_id").applyInArrow(of_graph, f"graph_id string, id string, {name} string")


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, ...]:
    """The distinct values in order, and each column as numbers of them."""
    coded = pa.chunked_array([c for x in columns for c in x.chunks], pa.string()).dictionary_encode().unify_dictionaries()
    names = coded.chunk(0).dictionary
    order = pc.sort_indices(names)
    place = np.empty(len(names), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(names))
    codes = place[np.concatenate([c.indices.to_numpy() for c in coded.chunks])]
    return names.take(order), *np.split(codes, np.cumsum([len(x) for x in columns])[:-1])


def _lists(size: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each number's neighbours begin, and the neighbours."""
    return [0, *np.cumsum(np.bincount(a, minlength=size)).tolist()], b[np.argsort(a, kind="stable")].tolist()


def connected(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each connected component: roots hook onto lesser ones, then all chains are followed to their ends."""
    to = np.arange(size)
    while True:
        x, y = to[a], to[b]
        apart = x != y
        if not apart.any():
            return to
        a, b, low = x[apart], y[apart], np.minimum(x[apart], y[apart])
        np.minimum.at(to, a, low)
        np.minimum.at(to, b, low)
        while (to != (further := to[to])).any():
            to = further


def strongly_connected(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each strongly connected component, after Tarjan, with stacks in place of calls."""
    begin, near = _lists(size, a, b)
    at = begin[:-1]  # the next way out to be looked at
    index, low, least = [-1] * size, [0] * size, [-1] * size
    count, open_ = 0, []
    for start in range(size):
        if index[start] >= 0:
            continue
        index[start] = low[start] = count
        count += 1
        open_.append(start)
        way = [start]
        while way:
            u = way[-1]
            if at[u] < begin[u + 1]:
                v = near[at[u]]
                at[u] += 1
                if index[v] < 0:
                    index[v] = low[v] = count
                    count += 1
                    open_.append(v)
                    way.append(v)
                elif least[v] < 0 and index[v] < low[u]:
                    low[u] = index[v]
                continue
            way.pop()
            if way and low[u] < low[way[-1]]:
                low[way[-1]] = low[u]
            if low[u] == index[u]:
                members = []
                while True:
                    members.append(open_.pop())
                    if members[-1] == u:
                        break
                first = min(members)
                for v in members:
                    least[v] = first
    return np.array(least, dtype=np.int64)


def _settle(near: list[dict[int, int]], k: list[int], m2: int, c: list[int]) -> bool:
    """Change the labels `c` (numbers of units) until no move of a single unit raises modularity; whether any was made.

    Gains are exact, in whole numbers: 2 m links - degrees. A unit that moves calls up its neighbours; as it changes the
    degrees of two communities for all others too, the units are gone through again until none moves.
    """
    size = len(near)
    tot, members = [0] * size, [0] * size
    for u, own in enumerate(c):
        tot[own] += k[u]
        members[own] += 1
    free = [x for x in range(size - 1, -1, -1) if not members[x]]
    any_moved = False
    while True:
        called, waits, moved = deque(range(size)), [True] * size, False
        while called:
            u = called.popleft()
            waits[u] = False
            own, ku = c[u], k[u]
            links: dict[int, int] = {}
            for v, w in near[u].items():
                links[c[v]] = links.get(c[v], 0) + w
            stay = links.pop(own, 0) * m2 - (tot[own] - ku) * ku
            best, to = stay, own
            for x, w in links.items():
                gain = w * m2 - tot[x] * ku
                if gain > best or gain == best > stay and x < to:
                    best, to = gain, x
            if best < 0 and members[own] > 1:  # alone it has 0
                to = free.pop()
            if to == own:
                continue
            c[u], moved = to, True
            tot[own] -= ku
            members[own] -= 1
            if not members[own]:
                free.append(own)
            tot[to] += ku
            members[to] += 1
            for v in near[u]:
                if c[v] != to and not waits[v]:
                    waits[v] = True
                    called.append(v)
        if not moved:
            return any_moved
        any_moved = True


def communities(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each community, by moves that raise modularity, then of the communities, as in `analytics.louvain`.

    Links are distinct and in both directions.
    """
    begin, to = _lists(size, a, b)
    base = [dict.fromkeys(to[begin[u] : begin[u + 1]], 1) for u in range(size)]
    degree, m2 = [len(x) for x in base], len(a)
    unit = list(range(size))
    _settle(base, degree, m2, unit)
    while True:
        merged = False
        while True:
            names = {x: i for i, x in enumerate(dict.fromkeys(unit))}
            unit = [names[x] for x in unit]
            near: list[dict[int, int]] = [{} for _ in names]
            k = [0] * len(names)
            for u, x in enumerate(unit):
                k[x] += degree[u]
                for v in base[u]:
                    if (y := unit[v]) != x:
                        near[x][y] = near[x].get(y, 0) + 1
            c = list(range(len(names)))
            if not _settle(near, k, m2, c):
                break
            unit, merged = [c[x] for x in unit], True
        if not merged or not _settle(base, degree, m2, unit):
            break
    least = np.full(size, size)
    of = np.array(unit, dtype=np.int64)
    np.minimum.at(least, of, np.arange(size))
    return least[of]
