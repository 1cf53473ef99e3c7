"""Degrees, centralities, communities and what is reported of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiver.functions import paths
from quiver.operators import whole
from quiver.operators.traverse import steps
from quiver.session import checkpointed_in_loop as checkpointed


def simple(edges: DataFrame) -> DataFrame:
    """Distinct directed pairs, whatever their relation."""
    return edges.select("graph_id", "source", "target").distinct()


def known_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("graph_id", "id")
    for end in ("source", "target"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["graph_id", end], "left_semi")
    return edges


def fan(edges: DataFrame, end: str) -> DataFrame:
    """Number of distinct partners by `source` (fan-out) or `target` (fan-in)."""
    return simple(edges).groupBy("graph_id", F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges in and out of each id, every relation counted, and its distinct neighbours."""
    both = edges.select("graph_id", F.col("source").alias("id"), F.col("target").alias("other"), F.lit(1).alias("out")).union(
        edges.select("graph_id", F.col("target"), F.col("source"), F.lit(0))
    )
    per = both.groupBy("graph_id", "id", "other").agg(F.sum("out").alias("o"), F.sum(1 - F.col("out")).alias("i"))
    return per.groupBy("graph_id", "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("coupling"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Undirected simple degree over n - 1, for every node; a loop counts twice, a lone node of a graph has 1.0."""
    pairs = known_only(simple(edges), nodes)
    both = pairs.select("graph_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    ends = both.select("graph_id", F.col("a").alias("id")).unionByName(both.select("graph_id", F.col("b").alias("id")))
    degree = ends.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    rows = nodes.select("graph_id", "id").join(degree, ["graph_id", "id"], "left").join(size, "graph_id")
    d = F.coalesce("degree", F.lit(0))
    return rows.select("graph_id", "id", F.when(F.col("n") == 1, 1.0).otherwise(F.round(d / (F.col("n") - 1), 6)).alias("centrality"))


def hotspots(scores: DataFrame, nodes: DataFrame, n: int, score: str = "centrality", include_tests: bool = False) -> DataFrame:
    """The `n` nodes of each graph with the highest score; ties go to the lesser id."""
    rows = nodes.select("graph_id", "id", "file_path").join(scores, ["graph_id", "id"])
    if not include_tests:
        rows = rows.where(~F.coalesce(paths.is_peripheral(F.col("file_path")), F.lit(False)))
    # salted first, so that no task ranks a whole graph
    part = lambda *by: Window.partitionBy("graph_id", *by).orderBy(F.desc(score), "id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("place", F.row_number().over(part("salt"))).where(F.col("place") <= n)
    return some.withColumn("place", F.row_number().over(part())).where(F.col("place") <= n).select("graph_id", "id", F.round(score, 6).alias(score), "place")


def hotspot_detail(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """References to each node by where they come from: its own file or others, production or tests."""
    files = nodes.select("graph_id", "id", "file_path")
    t = files.select("graph_id", F.col("id").alias("target"), F.col("file_path").alias("tf"))
    s = files.select("graph_id", F.col("id").alias("source"), F.col("file_path").alias("sf"))
    refs = simple(edges).join(t, ["graph_id", "target"]).join(s, ["graph_id", "source"])
    own = F.coalesce(F.col("sf") == F.col("tf"), F.lit(False))
    test = F.coalesce(paths.is_peripheral(F.col("sf")), F.lit(False))
    # per pair of node and file first, so that a hub's references are combined before the shuffle
    per_file = refs.groupBy("graph_id", "target", "sf", own.alias("own"), test.alias("test")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("graph_id", F.col("target").alias("id")).agg(
        F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("internal_refs"),
        F.sum(F.when(~F.col("own"), F.col("n")).otherwise(0)).alias("external_refs"),
        F.sum(F.when(F.col("test"), F.col("n")).otherwise(0)).alias("test_refs"),
        F.count_if(~F.col("own") & F.col("sf").isNotNull()).alias("importing_files"),
    )


def file_projection(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs of files with an edge between symbols of them; external nodes and pairs within a file drop out."""
    inside = nodes.where(F.col("file_path").isNotNull() & ~F.coalesce("is_external", F.lit(False)))
    s = inside.select("graph_id", F.col("id").alias("source"), F.col("file_path").alias("sf"))
    t = inside.select("graph_id", F.col("id").alias("target"), F.col("file_path").alias("tf"))
    pairs = simple(edges).join(s, ["graph_id", "source"]).join(t, ["graph_id", "target"]).where("sf <> tf")
    return pairs.select("graph_id", F.col("sf").alias("source"), F.col("tf").alias("target")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct unordered pairs of different ids, in both directions."""
    return steps(edges.where("source <> target"), "both")


def betweenness(edges: DataFrame, nodes: DataFrame, pivots: int = 100) -> DataFrame:
    """Betweenness of every node of each graph over shortest undirected paths from at most `pivots` pivots.

    Pivots are the nodes with the least SHA-256 of their id; with no more nodes than pivots it is exact. Scores are
    scaled as if all nodes were pivots and normalised by (n - 1)(n - 2). Levels of all pivots and graphs run side by
    side: forward counts of shortest paths, then dependencies back from the farthest level.
    """
    near = checkpointed(undirected(edges))
    order = Window.partitionBy("graph_id").orderBy(F.sha2("id", 256), "id")
    sub = Window.partitionBy("graph_id", F.substring(F.sha2("id", 256), 1, 2)).orderBy(F.sha2("id", 256), "id")
    some = nodes.select("graph_id", "id").withColumn("k", F.row_number().over(sub)).where(F.col("k") <= pivots)
    chosen = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= pivots)
    front = checkpointed(chosen.select("graph_id", F.col("id").alias("p"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))
    levels = [front]
    seen = front.select("graph_id", "p", "id")
    while True:
        moved = front.join(near, ["graph_id", "id"]).groupBy("graph_id", "p", F.col("next").alias("id")).agg(F.sum("paths").alias("paths"))
        front = checkpointed(
            moved.join(seen, ["graph_id", "p", "id"], "left_anti").select("graph_id", "p", "id", F.lit(len(levels)).alias("depth"), "paths")
        )
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("graph_id", "p", "id"))
    below, total = None, None
    for level in reversed(levels[1:]):
        if below is None:
            here = level.withColumn("delta", F.lit(0.0))
        else:
            share = below.select("graph_id", "p", F.col("id").alias("next"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
            up = level.join(near, ["graph_id", "id"]).join(share, ["graph_id", "p", "next"])
            got = up.groupBy("graph_id", "p", "id").agg(F.sum("share").alias("s"))
            here = level.join(got, ["graph_id", "p", "id"], "left").withColumn("delta", F.col("paths") * F.coalesce("s", F.lit(0.0))).select("graph_id", "p", "id", "depth", "paths", "delta")
        below = checkpointed(here)
        part = below.groupBy("graph_id", "id").agg(F.sum("delta").alias("delta"))
        total = part if total is None else total.unionByName(part)
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    base = nodes.select("graph_id", "id").join(size, "graph_id")
    if total is None:
        return base.select("graph_id", "id", F.lit(0.0).alias("betweenness"))
    sums = total.groupBy("graph_id", "id").agg(F.sum("delta").alias("delta"))
    n = F.col("n")
    scale = F.when(n > 2, n / F.least(n, F.lit(pivots)) / ((n - 1) * (n - 2))).otherwise(0.0)
    return base.join(sums, ["graph_id", "id"], "left").select("graph_id", "id", F.round(F.coalesce("delta", F.lit(0.0)) * scale, 6).alias("betweenness"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a labelling (graph_id, id, community) over distinct undirected pairs; null without edges."""
    pairs = undirected(edges)
    c = labels.select("graph_id", "id", F.col("community").alias("ca"))
    o = labels.select("graph_id", F.col("id").alias("next"), F.col("community").alias("cb"))
    ends = pairs.join(c, ["graph_id", "id"]).join(o, ["graph_id", "next"])
    per = ends.groupBy("graph_id", F.col("ca").alias("community")).agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    m2 = per.groupBy("graph_id").agg(F.sum("d").alias("m2"))
    part = F.col("inside") / F.col("m2") - F.pow(F.col("d") / F.col("m2"), 2)
    graphs = labels.select("graph_id").distinct()
    q = per.join(m2, "graph_id").groupBy("graph_id").agg(F.round(F.sum(part), 6).alias("modularity"))
    return graphs.join(q, "graph_id", "left")


def _moves(weights: DataFrame, label: DataFrame, seed: int) -> DataFrame | None:
    """Moves of units (graph_id, unit, to) that together raise modularity; None if no move of a single unit does.

    Every unit names the community of its neighbours with the greatest gain, the least label among equals, or one of its
    own. Gains are exact: 2 m links - degrees, in whole numbers. A community either gives or takes, by its best move. Of
    the moves left those are made that are the best for both their ends, or gain more than all others at these ends can
    take from them (the product of degrees for each); so the sum of what is made is more than zero, whatever moves at once.
    """
    near = weights.where("id <> next").join(label.select("graph_id", F.col("unit").alias("next"), "c", "tot"), ["graph_id", "next"])
    links = near.groupBy("graph_id", F.col("id").alias("unit"), "c").agg(F.sum("w").alias("links"), F.first("tot").alias("there"))
    own = label.select("graph_id", "unit", "k", "m2", F.col("c").alias("own"), "tot")
    options = own.join(links, ["graph_id", "unit"], "left")
    here = F.col("c") == F.col("own")
    gain = F.col("links") * F.col("m2") - F.when(here, F.col("there") - F.col("k")).otherwise(F.col("there")) * F.col("k")
    best = options.withColumn("gain", gain).groupBy("graph_id", "unit", "own", "k", "tot").agg(
        F.min(F.when(F.col("c").isNotNull(), F.struct((-F.col("gain")).alias("g"), "c"))).alias("b"),
        F.coalesce(F.max(F.when(here, F.col("gain"))), (F.col("k") - F.col("tot")) * F.col("k")).alias("stay"),
    )
    join = F.coalesce(-F.col("b.g"), F.lit(-1))
    turn = F.lit(f"\0{seed}:")  # text, as a number would be compiled into new code each round
    alone = F.concat(turn, "unit")  # a label that no community has
    up = F.greatest(join, F.lit(0)) - F.col("stay")
    priority = F.struct(up.alias("up"), F.xxhash64("unit", turn).alias("h"), "unit")
    wanted = checkpointed(best.where(up > 0).select("graph_id", "unit", "k", "own", F.when(join >= 0, F.col("b.c")).otherwise(alone).alias("to"), priority.alias("p")))
    if wanted.isEmpty():
        return None
    none = F.lit(None).cast(wanted.schema["p"].dataType)
    zero = F.lit(0).cast("bigint")
    ends = wanted.select("graph_id", F.col("own").alias("c"), F.col("p").alias("gives"), none.alias("takes"), F.col("k").alias("out"), zero.alias("in")).union(
        wanted.select("graph_id", "to", none, "p", zero, "k")
    )
    side = ends.groupBy("graph_id", "c").agg(F.max("gives").alias("gives"), F.max("takes").alias("takes"), F.sum("out").alias("out"), F.sum("in").alias("in"))
    giver = side.where("takes is null or gives > takes").select("graph_id", F.col("c").alias("own"), "gives", "out")
    taker = side.where("gives is null or takes > gives").select("graph_id", F.col("c").alias("to"), "takes", "in")
    both = wanted.join(giver, ["graph_id", "own"]).join(taker, ["graph_id", "to"])
    first = (F.col("p") == F.col("gives")) & (F.col("p") == F.col("takes"))
    sure = F.col("p.up") > F.col("k") * (F.col("out") + F.col("in") - 2 * F.col("k"))
    return both.where(first | sure).select("graph_id", "unit", "to")


def _settled(weights: DataFrame, label: DataFrame) -> tuple[DataFrame, bool]:
    """Labels (graph_id, unit, k, m2, c) from which no move of a single unit raises modularity; whether any was made."""
    busy, seed = label, 0
    while True:
        with_sums = busy.join(busy.groupBy("graph_id", "c").agg(F.sum("k").alias("tot")), ["graph_id", "c"])
        moves = _moves(weights, with_sums, seed)
        if moves is None:
            return label, seed > 0
        now = label.join(moves, ["graph_id", "unit"], "left")
        now = checkpointed(now.select("graph_id", "unit", "k", "m2", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
        label, seed = now.drop("moved"), seed + 1
        busy = label.join(now.where("moved").select("graph_id"), "graph_id", "left_semi")  # graphs without a move rest


def louvain(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Communities by moves that raise modularity, then of the communities: ``graph_id, id, community`` (least member).

    A graph that fits a task is solved in it (`whole.communities`), a larger one by rounds over the tables. Both go on until
    no unit wants to move, by levels until no two communities want to merge, and start again from the ids with what was
    found until no id wants to move either; nothing is counted. In the result no move of a single id, to another
    community or to one of its own, and no merger of two communities raises modularity. Every move or round raises it
    (see `_moves`), so there is an end. Deterministic. Nodes of a graph without edges form one community.
    """
    near = checkpointed(undirected(edges))
    found = whole.solved(near, whole.communities, "unit", _communities_by_rounds)
    member = nodes.select("graph_id", "id").join(found, ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("unit", "id").alias("unit"))
    member = checkpointed(member)
    names = member.groupBy("graph_id", "unit").agg(F.min("id").alias("community"))
    out = member.join(names, ["graph_id", "unit"])
    empty = member.select("graph_id", "id").join(near.select("graph_id").distinct(), "graph_id", "left_anti").groupBy("graph_id").agg(F.min("id").alias("only"))
    return out.join(empty, "graph_id", "left").select("graph_id", "id", F.coalesce("only", "community").alias("community"))


def _communities_by_rounds(near: DataFrame) -> DataFrame:
    """``graph_id, id, unit`` of all ids of the links `near`, a label for each community."""
    base = checkpointed(near.withColumn("w", F.lit(1).cast("bigint")))
    m2 = checkpointed(base.groupBy("graph_id").agg(F.sum("w").alias("m2")))
    member = checkpointed(base.select("graph_id", "id").distinct().withColumn("unit", F.col("id")))
    fresh = True
    while True:
        weights, level = base, 0
        while True:
            units = weights.groupBy("graph_id", F.col("id").alias("unit")).agg(F.sum("w").alias("k")).join(m2, "graph_id")
            if level or fresh:
                start = units.withColumn("c", F.col("unit"))
            else:
                start = units.join(member.select("graph_id", F.col("id").alias("unit"), F.col("unit").alias("c")), ["graph_id", "unit"])
            label, moved = _settled(weights, checkpointed(start))
            if not moved and (level or not fresh):
                break
            to = checkpointed(label.select("graph_id", "unit", "c"))
            if level:
                member = member.join(to, ["graph_id", "unit"], "left").select("graph_id", "id", F.coalesce("c", "unit").alias("unit"))
            else:
                member = member.join(to.withColumnRenamed("unit", "id"), ["graph_id", "id"], "left").select("graph_id", "id", F.coalesce("c", "unit").alias("unit"))
            member = checkpointed(member)
            a, b = to.withColumnsRenamed({"unit": "id", "c": "ca"}), to.withColumnsRenamed({"unit": "next", "c": "cb"})
            weights = checkpointed(
                weights.join(a, ["graph_id", "id"]).join(b, ["graph_id", "next"]).groupBy("graph_id", F.col("ca").alias("id"), F.col("cb").alias("next")).agg(F.sum("w").alias("w"))
            )
            level += 1
        if level <= 1:
            break
        fresh = False
    return member


def community_stats(edges: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Per community: members, inner edges, density, edges to and number of other communities, and its commonest organ.

    `nodes` have a `file_path`; density is inner edges over n(n - 1), or over 1 for a single member.
    """
    pairs = simple(edges)
    s = labels.select("graph_id", F.col("id").alias("source"), F.col("community").alias("cs"))
    t = labels.select("graph_id", F.col("id").alias("target"), F.col("community").alias("ct"))
    flows = pairs.join(s, ["graph_id", "source"]).join(t, ["graph_id", "target"]).groupBy("graph_id", "cs", "ct").agg(F.count(F.lit(1)).alias("n"))
    per = flows.groupBy("graph_id", F.col("cs").alias("community")).agg(
        F.sum(F.when(F.col("cs") == F.col("ct"), F.col("n")).otherwise(0)).alias("internal_edges"),
        F.sum(F.when(F.col("cs") != F.col("ct"), F.col("n")).otherwise(0)).alias("external_edges"),
        F.count_if(F.col("cs") != F.col("ct")).alias("coupled_communities"),
    )
    located = labels.join(nodes.select("graph_id", "id", paths.organ(paths.folder(F.col("file_path"))).alias("organ")), ["graph_id", "id"], "left")
    organs = located.groupBy("graph_id", "community", "organ").agg(F.count(F.lit(1)).alias("n"))
    size = organs.groupBy("graph_id", "community").agg(
        F.sum("n").alias("members"),
        F.min(F.when(F.col("organ") != "", F.struct((-F.col("n")).alias("n"), "organ"))).getField("organ").alias("organ"),
    )
    inner = F.coalesce("internal_edges", F.lit(0))
    n = F.col("members")
    return size.join(per, ["graph_id", "community"], "left").select(
        "graph_id", "community", "members", inner.alias("internal_edges"), F.coalesce("external_edges", F.lit(0)).alias("external_edges"),
        F.coalesce("coupled_communities", F.lit(0)).alias("coupled_communities"),
        F.round(inner / F.greatest(n * (n - 1), F.lit(1)), 4).alias("density"), "organ",
    )


def external_coupling(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges from each community to every other one."""
    s = labels.select("graph_id", F.col("id").alias("source"), F.col("community").alias("cs"))
    t = labels.select("graph_id", F.col("id").alias("target"), F.col("community").alias("ct"))
    rows = simple(edges).join(s, ["graph_id", "source"]).join(t, ["graph_id", "target"]).where("cs <> ct")
    return rows.groupBy("graph_id", F.col("cs").alias("community"), F.col("ct").alias("other")).agg(F.count(F.lit(1)).alias("n"))


def representatives(edges: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """The `n` members of each community with the most edges; ties go to the lesser id."""
    ends = simple(edges).select("graph_id", F.col("source").alias("id")).union(simple(edges).select("graph_id", "target"))
    degree = ends.groupBy("graph_id", "id").agg(F.count(F.lit(1)).alias("degree"))
    rows = labels.join(degree, ["graph_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    part = lambda *by: Window.partitionBy("graph_id", "community", *by).orderBy(F.desc("degree"), "id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("place", F.row_number().over(part("salt"))).where(F.col("place") <= n)
    return some.withColumn("place", F.row_number().over(part())).where(F.col("place") <= n).select("graph_id", "community", "id", "degree", "place")


def rank_files(scores: DataFrame, nodes: DataFrame, score: str) -> DataFrame:
    """Files by their best symbol's score, ranked from 1; ties go to the lesser path."""
    best = nodes.where(F.col("file_path").isNotNull()).join(scores, ["graph_id", "id"]).groupBy("graph_id", "file_path").agg(F.max(score).alias(score))
    # rank = files with a better score + files with the same and a lesser path + 1, by counts of score values
    values = best.groupBy("graph_id", score).agg(F.count(F.lit(1)).alias("same"))
    better = values.withColumn("before", F.coalesce(F.sum("same").over(Window.partitionBy("graph_id").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("same")
    within = F.row_number().over(Window.partitionBy("graph_id", score).orderBy("file_path"))
    return best.join(better, ["graph_id", score]).withColumn("rank", F.col("before") + within).drop("before")


def embedding_status(vectors: DataFrame, nodes: DataFrame, config: DataFrame) -> DataFrame:
    """Per graph and model tag: embedded nodes, coverage of the nodes that should be, and whether the tag is stale."""
    eligible = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("eligible"))
    known = vectors.join(nodes.select("graph_id", F.col("id").alias("node_id")), ["graph_id", "node_id"], "left_semi")
    done = known.where(F.size("vector") > 0).groupBy("graph_id", "model").agg(F.count_distinct("node_id").alias("embedded"))
    tag = F.regexp_extract("model", r"#v(\d+)$", 1)
    rows = done.join(eligible, "graph_id").join(config.select("graph_id", "embedding_model"), "graph_id", "left")
    return rows.select(
        "graph_id", "model", "embedded", "eligible", F.round(F.col("embedded") / F.col("eligible"), 3).alias("coverage"),
        F.when(tag == "", None).otherwise(tag.cast("int")).alias("version"),
        (~F.col("model").eqNullSafe(F.col("embedding_model"))).alias("stale"),
    )


def graph_summary(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct files and entities per graph, and communities."""
    n = nodes.groupBy("graph_id").agg(F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("entities"))
    return n.join(labels.groupBy("graph_id").agg(F.count_distinct("community").alias("communities")), "graph_id", "left")
