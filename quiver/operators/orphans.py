"""References to records that do not exist, are deleted or arrive later.

Parent and child keys are brought into one long form and grouped by parent key. Partial aggregation does the work
before the shuffle, so a key that a third of all edges point to costs each task one row. Groups that certainly have a
live parent whenever they are used are dropped, and only the rest meets the edges again. Where parents were deleted
meanwhile, running balances of live rows by key and day, minute and instant decide, so that no key's rows meet in one
task. The uses meet the lacking groups by a join that adaptive execution may split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiver.session import checkpointed

#: Rows without a time count as loaded before every other row.
_NO_TIME = "1900-01-01 00:00:00"

_EDGE = ["graph_id", "source", "target", "rel_type"]


def _time(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(_NO_TIME).cast("timestamp"))


def _children(edges: DataFrame) -> DataFrame:
    """One row per edge row and non-empty end point; an edge's repeated rows are still apart."""
    source, target = F.coalesce("source", F.lit("")), F.coalesce("target", F.lit(""))
    sides = F.array(
        F.struct(F.lit("source").alias("side"), source.alias("key"), target.alias("other")),
        F.struct(F.lit("target").alias("side"), target.alias("key"), source.alias("other")),
    )
    return (
        edges.select("graph_id", "rel_type", F.col("loaded_at").alias("t"), F.explode(sides).alias("end"))
        .select("graph_id", "rel_type", "t", "end.side", "end.key", "end.other")
        .where(F.col("key") != "")
    )


def _edge() -> list[Column]:
    """The edge's own columns, from its two ends."""
    at_source = F.col("side") == "source"
    return [
        F.col("graph_id"),
        F.when(at_source, F.col("key")).otherwise(F.col("other")).alias("source"),
        F.when(at_source, F.col("other")).otherwise(F.col("key")).alias("target"),
        F.col("rel_type"),
        F.col("side"),
    ]


def _events(nodes: DataFrame) -> DataFrame:
    """A parent row as events: loaded (+1 live), and its end (-1 live) if it was ever live."""
    loaded, deleted = _time("loaded_at"), F.col("deleted_at")
    was_live = deleted.isNull() | (deleted > loaded)
    load = F.struct(loaded.alias("at"), F.when(was_live, 1).otherwise(0).alias("live"), F.lit(1).alias("loads"))
    end = F.struct(deleted.alias("at"), F.lit(-1).alias("live"), F.lit(0).alias("loads"))
    both = F.when(deleted.isNotNull() & was_live, F.array(load, end)).otherwise(F.array(load))
    return checkpointed(
        nodes.select("graph_id", "key", F.explode(both).alias("e"))
        .select("graph_id", "key", "e.at", "e.live", "e.loads")
        .groupBy("graph_id", "key", "at")
        .agg(F.sum("live").alias("live"), F.sum("loads").alias("loads"))
        .withColumn("day", F.to_date("at"))
    )


def orphan_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge end points without a live node at the time of the edge.

    Columns: ``graph_id, source, target, rel_type, side, state, t``; `state` is ``missing`` (no node row with
    that graph and id), ``late`` (all node rows loaded after the edge) or ``deleted`` (all rows loaded by then
    were deleted by then). An edge is all rows with the same key, null end points counting as ``''``, and its
    time the earliest ``loaded_at``. A null ``loaded_at`` counts as earlier than every other time, null graph
    ids equal each other, and further columns of the inputs are not read. Empty tables give no rows.
    """
    children = _children(edges)
    uses = children.select("graph_id", "key", F.lit(0).alias("parent"), _time("t").alias("used"))
    parents = nodes.select(
        "graph_id", F.col("id").alias("key"), F.lit(1).alias("parent"), _time("loaded_at").alias("loaded"), "deleted_at"
    )
    lacking = checkpointed(
        uses.unionByName(parents, allowMissingColumns=True)
        .groupBy("graph_id", "key")
        .agg(
            F.max("parent").alias("parent"),
            F.min("used").alias("used"),
            F.min("loaded").alias("loaded"),
            F.max(F.col("deleted_at").isNotNull()).alias("ends"),
        )
        .where(F.col("used").isNotNull() & ((F.col("parent") == 0) | (F.col("loaded") > F.col("used")) | F.col("ends")))
        .drop("used")
    )
    about = ["parent", "loaded", "ends"]
    suspects = checkpointed(
        children.alias("c")
        .join(lacking.alias("g"), _same_key("c", "g"))
        .select("c.*", *[f"g.{c}" for c in about])
        .groupBy(*[c for c in children.columns if c != "t"], *about)
        .agg(F.min("t").alias("t"))  # an edge's time is that of its earliest row
        .withColumn("t", _time("t"))
    )
    # parents that never end: only the first load matters
    lasting = suspects.where(~F.col("ends")).select(
        *_edge(), F.when(F.col("parent") == 0, "missing").when(F.col("loaded") > F.col("t"), "late").alias("state"), "t"
    )
    ending = lacking.where("ends").select("graph_id", "key")
    swept = _sweep(
        suspects.where("ends").select(*children.columns, F.to_date("t").alias("day")),
        _events(nodes.select("graph_id", F.col("id").alias("key"), "loaded_at", "deleted_at").alias("c").join(ending.alias("g"), _same_key("c", "g"), "left_semi")),
    )
    return lasting.unionByName(swept).where(F.col("state").isNotNull())


def _same_key(left: str, right: str, *also: str) -> Column:
    """Same graph (nulls equal each other), key and further columns."""
    same = F.col(f"{left}.graph_id").eqNullSafe(F.col(f"{right}.graph_id"))
    for c in ("key", *also):
        same = same & (F.col(f"{left}.{c}") == F.col(f"{right}.{c}"))
    return same


_KEY = ["graph_id", "key"]


def _balances(children: DataFrame, events: DataFrame, part: list[str], step: str) -> DataFrame:
    """Uses with the parent's balance before their `step` (a column of both), and the parent's changes within it.

    The balances run over the steps of each `part`, not over rows. Uses carry the balance before the part.
    """
    counts = ["live", "loads", "changes", "uses"]
    opening = [F.max(c).alias(c) for c in ("live_before", "loads_before")]
    long = children.select(*part, step, *[F.lit(0).alias(c) for c in counts[:3]], F.lit(1).alias("uses"), "live_before", "loads_before").unionByName(
        events.select(*part, step, "live", "loads", F.lit(1).alias("changes"), F.lit(0).alias("uses")), allowMissingColumns=True
    )
    steps = long.groupBy(*part, step).agg(*[F.sum(c).alias(c) for c in counts], *opening)
    whole = Window.partitionBy(*part)
    before = whole.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    balance = lambda n: (F.coalesce(F.max(f"{n}_before").over(whole), F.lit(0)) + F.coalesce(F.sum(n).over(before), F.lit(0))).alias(f"{n}_before")
    groups = steps.select(*part, step, "changes", "uses", balance("live"), balance("loads")).where((F.col("uses") > 0) & ((F.col("changes") > 0) | (F.col("live_before") == 0)))
    joined = children.drop("live_before", "loads_before").alias("c").join(groups.alias("g"), _same_key("c", "g", *[c for c in (*part, step) if c not in _KEY]))
    return checkpointed(joined.select("c.*", "g.changes", "g.live_before", "g.loads_before"))


def _sweep(children: DataFrame, events: DataFrame) -> DataFrame:
    """State of uses of parents that were deleted at some time, from running balances by key and day, for days with a
    change of the parent by minute, and for minutes with one by instant.

    Windows run over days of a key, minutes of a day and distinct instants of a minute: a parent that is used by a third
    of all edges and sent again every day still is many small partitions.
    """
    zero = F.lit(0).cast("bigint")
    children = children.withColumns({"minute": F.date_trunc("minute", "t"), "live_before": zero, "loads_before": zero})
    events = events.withColumn("minute", F.date_trunc("minute", "at"))
    by_day = _balances(children, events, _KEY, "day")
    by_minute = _balances(by_day.where("changes > 0").drop("changes"), events, [*_KEY, "day"], "minute")
    settled = by_day.where("changes = 0").unionByName(by_minute.where("changes = 0"))
    # minutes with a change: the balance at each distinct instant of them
    rest = by_minute.where("changes > 0").drop("changes")
    upto = Window.partitionBy(*_KEY, "minute").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    instants = (
        rest.groupBy(*_KEY, "minute", F.col("t").alias("at")).agg(zero.alias("live"), zero.alias("loads"), F.max("live_before").alias("live_before"), F.max("loads_before").alias("loads_before"), F.lit(True).alias("use"))
        .unionByName(events.select(*_KEY, "minute", "at", "live", "loads"), allowMissingColumns=True)
        .select(*_KEY, "minute", "at", "use", *[(F.col(f"{n}_before") + F.sum(n).over(upto)).alias(f"{n}_before") for n in ("live", "loads")])
        .where("use")
    )
    moving = rest.drop("live_before", "loads_before").alias("c").join(
        instants.withColumnRenamed("at", "t").alias("g"), _same_key("c", "g", "minute", "t")
    )
    state = F.when(F.col("loads_before") == 0, "late").otherwise("deleted")
    columns = [*children.columns[:6], "t", "live_before", "loads_before"]
    columns = list(dict.fromkeys(columns))
    every = settled.select(*columns).unionByName(moving.select(*[f"c.{c}" for c in columns[:-2]], "g.live_before", "g.loads_before"))
    return every.where("live_before = 0").select(*_edge(), state.alias("state"), "t")


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per graph, relation type, state and month of the edge's first load."""
    return found.groupBy(
        "graph_id", "rel_type", "side", "state", F.date_format("t", "yyyy-MM").alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))
