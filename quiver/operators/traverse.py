"""Traversal: every level is one join of the frontier with the edges, for all starts and graphs at once.

The edges are brought into partitions by (graph_id, id) once and held there on the executors' disks; a level moves the
frontier to them, and nothing else. An executor that is lost is made up for from the edges' source.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.operators import whole
from quiver.operators.lookups import both_ways
from quiver.session import checkpointed_in_loop as checkpointed
from quiver.session import width

_KEY = ["graph_id", "seed", "id"]


def canonical_ids(nodes: DataFrame) -> DataFrame:
    """Where an edge that ends at an external node leads: ``graph_id, id, canonical``.

    A stub without a file leads to the one concrete node of its name, if there is exactly one, else nowhere (null);
    an external node with a file leads nowhere; a stub without a name stays what it is. Other nodes aren't listed.
    """
    external = F.coalesce("is_external", F.lit(False))
    concrete = (
        nodes.where(~external & F.col("file_path").isNotNull() & F.col("name").isNotNull())
        .groupBy("graph_id", "name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    )
    outside = nodes.where(external).select("graph_id", "id", "name", "file_path")
    known = outside.join(concrete, ["graph_id", "name"], "left")
    canonical = (
        F.when(F.col("file_path").isNotNull(), None).when(F.col("name").isNull(), F.col("id")).when(F.col("n") == 1, F.col("only"))
    )
    return known.select("graph_id", "id", canonical.alias("canonical"))


def canonical_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges with both ends led on by `canonical`; those that lead nowhere are left out."""
    out = edges.select("graph_id", "source", "target").distinct()
    for end in ("source", "target"):
        names = canonical.select("graph_id", F.col("id").alias(end), F.col("canonical"), F.lit(True).alias("listed"))
        joined = out.join(names, ["graph_id", end], "left")
        to = F.when(F.col("listed"), F.col("canonical")).otherwise(F.col(end))
        out = joined.select("graph_id", *[to.alias(c) if c == end else c for c in ("source", "target")]).where(F.col(end).isNotNull())
    return out.distinct()


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """``graph_id, id, next`` for `down` (or `downstream`), `up` (or `upstream`) or `both`."""
    down = edges.select("graph_id", F.col("source").alias("id"), F.col("target").alias("next"))
    up = edges.select("graph_id", F.col("target").alias("id"), F.col("source").alias("next"))
    if direction in ("down", "downstream"):
        return down.distinct()
    if direction in ("up", "upstream"):
        return up.distinct()
    if direction == "both":
        return down.union(up).distinct()
    raise ValueError(f"no direction {direction!r}")


@contextmanager
def held(rows: DataFrame, *keys: str):
    """`rows` in partitions by `keys`, on the executors' disks while the context lasts; joins by these keys don't move them."""
    kept = rows.repartition(width(rows.sparkSession), *keys).persist(StorageLevel.DISK_ONLY)
    try:
        kept.count()  # only a cached table that is there has its partitioning known
        yield kept
    finally:
        kept.unpersist()


def _levels(ways: DataFrame, seeds: DataFrame, depth: int, more: list[str], with_path: bool = False) -> DataFrame:
    """Ids within `depth` steps of each seed with their least depth. `ways` (graph_id, id, next, *more) hold the columns
    `more` on which seeds and steps must agree."""
    key = ["graph_id", *more, "seed", "id"]
    frontier = seeds.select(*[c for c in key if c != "id"], F.col("seed").alias("id"), F.lit(0).alias("depth"), *([F.array("seed").alias("path")] if with_path else [])).distinct()
    seen = frontier = checkpointed(frontier)
    with held(ways, "graph_id", "id", *more) as steps:
        for _ in range(depth):
            moved = steps.join(frontier.hint("shuffle_hash"), ["graph_id", "id", *more])
            # the depth comes from the rows: a literal would be compiled into new code at each level
            new = moved.groupBy("graph_id", *more, "seed", F.col("next").alias("id")).agg(
                (F.max("depth") + 1).alias("depth"), *([F.min(F.concat("path", F.array("next"))).alias("path")] if with_path else [])
            )
            frontier = checkpointed(new.join(seen.select(*key), key, "left_anti").select(*seen.columns))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    return seen


def reach(steps: DataFrame, seeds: DataFrame, depth: int, known: DataFrame | None = None, with_path: bool = False) -> DataFrame:
    """Least depth of all ids within `depth` steps of each seed: ``graph_id, seed, id, depth`` (and `path`).

    Seeds (graph_id, seed) have depth 0. With `known` (graph_id, id), ids that aren't in it are neither given nor
    followed. A path is the least of the shortest ones, compared as arrays. Cycles end by the visited ids; each level
    is written down before the next, so plans stay small.
    """
    starts = seeds.select("graph_id", "seed").distinct()
    if known is not None:
        ids = known.select("graph_id", "id").distinct()
        steps = steps.join(ids.withColumnRenamed("id", "next"), ["graph_id", "next"], "left_semi")
        starts = starts.join(ids.withColumnRenamed("id", "seed"), ["graph_id", "seed"], "left_semi")
    return _levels(steps.select("graph_id", "id", "next"), starts, depth, [], with_path)


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 10) -> DataFrame:
    """What depends on each seed and what it depends on: depths both ways, their sum `coupling`, and whether direct.

    Both directions go level by level together. Ids without a node count, as they are references too; the seed itself doesn't.
    """
    ways = steps(edges, "down").withColumn("way", F.lit("down")).unionByName(steps(edges, "up").withColumn("way", F.lit("up")))
    starts = seeds.select("graph_id", "seed", F.explode(F.array(F.lit("down"), F.lit("up"))).alias("way"))
    found = _levels(ways, starts, depth, ["way"]).where("id <> seed")
    at = lambda way: F.max(F.when(F.col("way") == way, F.col("depth")))
    both = found.groupBy(*_KEY).agg(at("down").alias("depth_down"), at("up").alias("depth_up"))
    coupling = F.coalesce("depth_down", F.lit(0)) + F.coalesce("depth_up", F.lit(0))
    return both.select(*_KEY, "depth_down", "depth_up", coupling.cast("double").alias("coupling"), (F.coalesce("depth_down", F.lit(0)) == 1).alias("direct"))


def fallback_impact(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Undirected closure; an id's score is the number of neighbours it shares with the seed, plus one."""
    both = steps(edges, "both").where("id <> next")
    closure = reach(both, seeds, depth).where("id <> seed")
    of_seed = both.join(seeds.select("graph_id", F.col("seed").alias("id")).distinct(), ["graph_id", "id"], "left_semi").select("graph_id", F.col("id").alias("seed"), F.col("next").alias("n"))
    shared = of_seed.join(both.select("graph_id", "id", F.col("next").alias("n")), ["graph_id", "n"]).groupBy(*_KEY).agg(F.count(F.lit(1)).alias("shared"))
    return closure.join(shared, _KEY, "left").select(*_KEY, "depth", (F.coalesce("shared", F.lit(0)) + 1).cast("double").alias("score"))


def all_paths(steps: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Every way without a repeated id of up to `depth` steps: ``graph_id, seed, id, path``."""
    front = seeds.select("graph_id", "seed", F.col("seed").alias("id"), F.array("seed").alias("path")).distinct()
    out = None
    with held(steps, "graph_id", "id") as ways:
        for _ in range(depth):
            front = ways.join(front.hint("shuffle_hash"), ["graph_id", "id"]).where(~F.array_contains("path", F.col("next")))
            front = checkpointed(front.select("graph_id", "seed", F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path")))
            out = front if out is None else out.unionByName(front)
            if front.isEmpty():
                break
    return out


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected component of every node, named by its least id: ``graph_id, id, component``.

    Nodes without edges are components of their own; ends without a node belong to one too. A graph that fits a task is
    solved in it, a larger one by rounds over the tables.
    """
    pairs = steps(edges, "down").where("id <> next")
    own = nodes.where(F.col("id").isNotNull()).select("graph_id", "id", F.col("id").alias("next"))
    return whole.solved(pairs.unionByName(own), whole.connected, "component", _connected_by_rounds)


def _connected_by_rounds(links: DataFrame) -> DataFrame:
    """Labels move along links and then along labels, so long chains take logarithmically many rounds."""
    both = steps(links.select("graph_id", F.col("id").alias("source"), F.col("next").alias("target")), "both")
    with held(both, "graph_id", "next") as near_to:
        ids = near_to.select("graph_id", "id").distinct()
        labels = checkpointed(ids.withColumn("component", F.col("id")))
        while True:
            near = near_to.join(labels.select("graph_id", F.col("id").alias("next"), F.col("component").alias("c")).hint("shuffle_hash"), ["graph_id", "next"])
            least = near.groupBy("graph_id", "id").agg(F.min("c").alias("c"))
            moved = labels.join(least, ["graph_id", "id"], "left").select(
                "graph_id", "id", "component", F.least("component", F.coalesce("c", F.col("component"))).alias("new")
            )
            jump = moved.select("graph_id", F.col("id").alias("new"), F.col("new").alias("far"))
            jumped = checkpointed(
                moved.join(jump, ["graph_id", "new"], "left").select(
                    "graph_id", "id", F.least("new", F.coalesce("far", F.col("new"))).alias("to"), "component"
                )
            )
            labels = jumped.select("graph_id", "id", F.col("to").alias("component"))
            if jumped.where("to <> component").isEmpty():
                return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """Strongly connected component of every id, named by its least member: ``graph_id, id, component``.

    A graph that fits a task is solved in it, a larger one by rounds over the tables.
    """
    # an end that is missing leaves the other one by itself
    links = checkpointed(edges.select("graph_id", F.coalesce("source", "target").alias("id"), F.coalesce("target", "source").alias("next")).where("id is not null").distinct())
    return checkpointed(whole.solved(links, whole.strongly_connected, "component", _strong_by_rounds))


def _strong_by_rounds(links: DataFrame) -> DataFrame:
    """Ids without a way in or out are peeled off first; then each id takes the least id that reaches it as its colour, and
    within a colour those that reach the colour's root are a component; the rest goes on. Graphs run side by side.
    """
    edges = links.select("graph_id", F.col("id").alias("source"), F.col("next").alias("target"))
    rest = checkpointed(edges.where("source <> target"))
    ids = edges.select("graph_id", F.col("source").alias("id")).union(edges.select("graph_id", "target")).distinct()
    found = None
    while True:
        while True:  # peel
            ins = rest.select("graph_id", F.col("target").alias("id"))
            outs = rest.select("graph_id", F.col("source").alias("id"))
            live = ins.intersect(outs)
            kept = rest
            for end in ("source", "target"):
                kept = kept.join(live.withColumnRenamed("id", end), ["graph_id", end], "left_semi")
            kept = checkpointed(kept.select("graph_id", "source", "target"))
            same = kept.count() == rest.count()
            rest = kept
            if same:
                break
        if rest.isEmpty():
            break
        colour = checkpointed(rest.select("graph_id", F.col("source").alias("id")).distinct().withColumn("c", F.col("id")))
        while True:  # forward: the least id that reaches it
            got = rest.join(colour.select("graph_id", F.col("id").alias("source"), "c"), ["graph_id", "source"]).groupBy("graph_id", F.col("target").alias("id")).agg(F.min("c").alias("m"))
            new = checkpointed(colour.join(got, ["graph_id", "id"], "left").select("graph_id", "id", F.least("c", F.coalesce("m", F.col("c"))).alias("new"), "c"))
            changed = not new.where("new <> c").isEmpty()
            colour = new.select("graph_id", "id", F.col("new").alias("c"))
            if not changed:
                break
        s = colour.select("graph_id", F.col("id").alias("source"), "c")
        t = colour.select("graph_id", F.col("id").alias("target"), F.col("c").alias("ct"))
        inner = checkpointed(rest.join(s, ["graph_id", "source"]).join(t, ["graph_id", "target"]).where("c = ct").select("graph_id", "source", "target", "c"))
        back = inner.select("graph_id", F.col("target").alias("id"), F.col("source").alias("next"))
        roots = colour.where("id = c").select("graph_id", F.col("c").alias("seed"))
        members = reach(back, roots, 1 << 30).select("graph_id", "id", F.col("seed").alias("component"))
        members = checkpointed(members)
        found = members if found is None else found.unionByName(members)
        for end in ("source", "target"):
            rest = rest.join(members.select("graph_id", F.col("id").alias(end)), ["graph_id", end], "left_anti")
        rest = checkpointed(rest.select("graph_id", "source", "target"))
    if found is None:
        return ids.withColumn("component", F.col("id"))
    single = ids.join(found, ["graph_id", "id"], "left_anti").withColumn("component", F.col("id"))
    return found.unionByName(single)


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Ids within `hops` of each seed, in either direction."""
    return reach(steps(edges, "both"), seeds, hops)


def describe(nodes: DataFrame, edges: DataFrame, neighbours: int = 5) -> DataFrame:
    """A text for each node: its name and kind, its file, and its first neighbours in order of their ids."""
    from pyspark.sql import Window

    pairs = both_ways(edges).select("graph_id", "id", "other").distinct()
    # salted first, as a hub may have a third of all edges
    salt = F.pmod(F.xxhash64("other"), F.lit(32))
    first = pairs.withColumn("salt", salt).withColumn("r", F.row_number().over(Window.partitionBy("graph_id", "id", "salt").orderBy("other"))).where(F.col("r") <= neighbours)
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("graph_id", "id").orderBy("other"))).where(F.col("r") <= neighbours)
    lists = ranked.groupBy("graph_id", "id").agg(F.array_join(F.array_sort(F.collect_list("other")), ", ").alias("near"))
    text = F.concat_ws(
        "\n",
        F.concat_ws(" ", F.coalesce("name", "id"), F.concat(F.lit("["), F.element_at("labels", -1), F.lit("]"))),
        F.concat(F.lit("file: "), F.col("file_path")),
        F.concat(F.lit("near: "), F.col("near")),
    )
    return nodes.join(lists, ["graph_id", "id"], "left").select("graph_id", "id", text.alias("text"))
