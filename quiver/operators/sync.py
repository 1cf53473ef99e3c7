"""Keeping a graph current: what changed, how fresh it is, and what a change means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def change_report(stored: DataFrame, current: DataFrame) -> DataFrame:
    """`status` of every file (graph_id, file_path, content_hash): added, modified, deleted or unchanged.

    A null or ``error:`` hash never equals another one. Both sides hold a file once.
    """
    s, c = stored.select("graph_id", "file_path", F.col("content_hash").alias("s")), current.select("graph_id", "file_path", F.col("content_hash").alias("c"))
    there = s.withColumn("in_s", F.lit(True)).join(c.withColumn("in_c", F.lit(True)), ["graph_id", "file_path"], "full_outer")
    same = (F.col("s") == F.col("c")) & ~F.startswith(F.col("c"), F.lit("error:"))
    status = F.when(F.col("in_s").isNull(), "added").when(F.col("in_c").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return there.select("graph_id", "file_path", status.alias("status"))


def dirty_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored files whose current hash differs or is missing."""
    c = current.select("graph_id", "file_path", F.col("content_hash").alias("c"))
    rows = stored.join(c, ["graph_id", "file_path"], "left")
    return rows.where(~F.col("content_hash").eqNullSafe(F.col("c")) | F.col("c").isNull()).select("graph_id", "file_path")


def git_status(tracked: DataFrame, status: DataFrame, stored: DataFrame) -> DataFrame:
    """Changes by git's letters (A, M, D, R with `old_path`, C): a rename is a deletion and an addition; deletions count
    only for stored files; tracked files without a letter are left alone."""
    plain = status.where(F.col("letter").isin("A", "M", "C")).select("graph_id", "file_path", F.when(F.col("letter") == "M", "modified").otherwise("added").alias("status"))
    renamed = status.where("letter = 'R'")
    new = renamed.select("graph_id", "file_path", F.lit("added").alias("status"))
    gone = status.where("letter = 'D'").select("graph_id", "file_path").union(renamed.select("graph_id", "old_path"))
    deleted = gone.join(stored.select("graph_id", "file_path").distinct(), ["graph_id", "file_path"], "left_semi").withColumn("status", F.lit("deleted"))
    known = plain.unionByName(new).join(tracked.select("graph_id", "file_path").distinct(), ["graph_id", "file_path"], "left_semi")
    return known.unionByName(deleted).distinct()


def freshness(projects: DataFrame, dirty: DataFrame, now: Column, max_age: int = 3600) -> DataFrame:
    """Per graph: dirty files, age in seconds, and `stale`: true if anything is dirty, null if never indexed."""
    n = dirty.groupBy("graph_id").agg(F.count(F.lit(1)).alias("dirty"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_indexed")
    d = F.coalesce("dirty", F.lit(0))
    rows = projects.join(n, "graph_id", "left")
    return rows.select(
        "graph_id", d.alias("dirty"), age.alias("age"), (age <= max_age).alias("fresh"),
        F.when(d > 0, True).when(F.col("last_indexed").isNull(), None).otherwise(False).alias("stale"),
        F.col("last_indexed"), F.coalesce("sync_enabled", F.lit(True)).alias("sync_enabled"),
    )


def freshness_rollup(rows: DataFrame) -> DataFrame:
    """Over all graphs: stale if any is, else null if any is unknown, else false; sums, the oldest index, all synced."""
    return rows.agg(
        F.when(F.bool_or("stale"), True).when(F.count_if(F.col("stale").isNull()) > 0, None).otherwise(False).alias("stale"),
        F.sum("dirty").alias("dirty"),
        F.min("last_indexed").alias("last_indexed"),
        F.bool_and("sync_enabled").alias("sync_enabled"),
        F.count(F.lit(1)).alias("graphs"),
    )


def source_fingerprint(hashes: DataFrame) -> DataFrame:
    """One hash per graph over its (file, hash) pairs, whatever their order.

    The pairs' hashes are summed in four 60-bit lanes, so no task holds a graph's files.
    """
    line = F.sha2(F.concat_ws("\n", F.col("file_path"), F.coalesce("content_hash", F.lit(""))), 256)
    lanes = [F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)]
    sums = hashes.groupBy("graph_id").agg(*lanes, F.count(F.lit(1)).alias("files"))
    return sums.select("graph_id", "files", F.sha2(F.concat_ws(":", *[F.col(f"l{i}").cast("string") for i in range(4)]), 256).alias("fingerprint"))


def sessions(events: DataFrame, gap_seconds: int) -> DataFrame:
    """Batches of changes of each key that end after `gap_seconds` of quiet: start, end, and number of changes.

    Gap detection runs in parts of a day: a part's first change looks back to the last change of an earlier part, so
    that a busy key's history isn't one task's.
    """
    day = F.to_date("ts")
    edges = events.groupBy("key", day.alias("day")).agg(F.max("ts").alias("last"))
    before = edges.withColumn("before", F.lag("last").over(Window.partitionBy("key").orderBy("day"))).drop("last")
    rows = events.select("key", "ts", day.alias("day")).join(before, ["key", "day"])
    inside = Window.partitionBy("key", "day").orderBy("ts")
    previous = F.coalesce(F.lag("ts").over(inside), F.col("before"))
    micros = F.unix_micros("ts") - F.unix_micros(previous)
    marked = rows.withColumn("first", F.coalesce((micros > gap_seconds * 1_000_000).cast("int"), F.lit(1)))
    per_day = marked.groupBy("key", "day").agg(F.sum("first").alias("n"))
    base = per_day.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = marked.join(base, ["key", "day"]).withColumn("session", F.col("base") + F.sum("first").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("changes")).drop("session")
