"""Queries of incremental sync and of the change feed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.operators import incremental
from quiver.operators import sync as Y
from quiver.sources import facts
from quiver.sources import script_facts as scripts
from quiver.streaming import debounce
from quiver.session import shared_folder, table


def _stored(spark: SparkSession, d: str) -> DataFrame:
    settled = incremental.settled_hashes(table(spark, d, "sync_runs"), table(spark, d, "sync_log"))
    return settled.select("graph_id", "file_path", F.col("settled").alias("content_hash"))


def _current(spark: SparkSession, d: str) -> DataFrame:
    return incremental.current_hashes(table(spark, d, "file_hashes"))


def change_report(spark: SparkSession, d: str) -> DataFrame:
    return Y.change_report(_stored(spark, d), _current(spark, d))


def added_modified(spark: SparkSession, d: str) -> DataFrame:
    return change_report(spark, d).where("status in ('added', 'modified')").groupBy("graph_id", "status").agg(F.count(F.lit(1)).alias("n"))


def dirty_files(spark: SparkSession, d: str) -> DataFrame:
    return Y.dirty_files(_stored(spark, d), _current(spark, d))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-01-01").cast("timestamp")
    return Y.freshness(table(spark, d, "projects"), dirty_files(spark, d), now, 90 * 86_400)


def freshness_rollup(spark: SparkSession, d: str) -> DataFrame:
    return Y.freshness_rollup(freshness(spark, d))


def source_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return Y.source_fingerprint(_current(spark, d))


def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", Y.content_hash(F.col("text")).alias("content_hash"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))


def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return Y.sessions(_events(spark, d), 1800)


def streaming_debounce(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream over the table as a feed, closed batches only."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _events(spark, d).write.parquet(f"{folder}/feed")
    feed = debounce.change_feed(spark, f"{folder}/feed", "key bigint, ts timestamp", 1000)
    return debounce.run_available(debounce.debounced(feed), f"{folder}/out", f"{folder}/state")


def python_facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.python_facts(table(spark, d, "documents"))


def function_rules(spark: SparkSession, d: str) -> DataFrame:
    return facts.function_diagnostics(facts.python_facts(table(spark, d, "documents")))


def script_facts(spark: SparkSession, d: str) -> DataFrame:
    return scripts.script_facts(table(spark, d, "documents"))


def script_rules(spark: SparkSession, d: str) -> DataFrame:
    return facts.function_diagnostics(scripts.script_facts(table(spark, d, "documents")))


def code_snippets(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "nodes").where("line_start is not null and line_end is not null").select("graph_id", "id", "file_path", "line_start", "line_end").distinct()
    return facts.snippets(table(spark, d, "documents"), spans)


QUERIES = {
    f.__name__: f
    for f in (
        change_report, added_modified, dirty_files, freshness, freshness_rollup, source_fingerprint, content_hashes, debounce_sessions,
        streaming_debounce, python_facts, function_rules, script_facts, script_rules, code_snippets,
    )
}

_C = """WITH c AS (SELECT graph_id, file_path, arg_max(content_hash, (indexed_at, content_hash)) AS ch FROM file_hashes
  WHERE content_hash IS NOT NULL AND content_hash NOT LIKE 'error:%' GROUP BY ALL),
s AS (SELECT g.graph_id, g.file_path, g.content_hash AS sh, true AS stored FROM sync_log g JOIN sync_runs r USING (run_id) WHERE r.status = 'ok'
  QUALIFY row_number() OVER (PARTITION BY g.graph_id, g.file_path ORDER BY r.started_at DESC, r.run_id DESC, g.processed_at DESC, g.content_hash DESC) = 1),
r AS (SELECT graph_id, file_path, CASE WHEN stored IS NULL THEN 'added' WHEN ch IS NULL THEN 'deleted' WHEN sh = ch THEN 'unchanged' ELSE 'modified' END AS status
  FROM c FULL JOIN s USING (graph_id, file_path)),
d AS (SELECT graph_id, file_path FROM r WHERE status IN ('modified', 'deleted')),
f AS (SELECT graph_id, coalesce(k, 0) AS dirty, epoch(TIMESTAMPTZ '2026-01-01 00:00:00+00')::BIGINT - floor(epoch(last_indexed))::BIGINT AS age,
    CASE WHEN coalesce(k, 0) > 0 THEN true WHEN last_indexed IS NULL THEN NULL ELSE false END AS stale, last_indexed, coalesce(sync_enabled, true) AS sync_enabled
  FROM projects LEFT JOIN (SELECT graph_id, count(*) AS k FROM d GROUP BY ALL) USING (graph_id))
"""

SQL = {
    "change_report": _C + "SELECT * FROM r",
    "added_modified": _C + "SELECT graph_id, status, count(*) AS n FROM r WHERE status IN ('added', 'modified') GROUP BY ALL",
    "dirty_files": _C + "SELECT * FROM d",
    "freshness": _C + "SELECT graph_id, dirty, age, age <= 7776000 AS fresh, stale, last_indexed, sync_enabled FROM f",
    "freshness_rollup": _C
    + "SELECT CASE WHEN bool_or(stale) THEN true WHEN count(*) FILTER (stale IS NULL) > 0 THEN NULL ELSE false END AS stale, sum(dirty)::BIGINT AS dirty, min(last_indexed) AS last_indexed, bool_and(sync_enabled) AS sync_enabled, count(*) AS graphs FROM f",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "debounce_sessions": """WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT key, ts, sum(f) OVER (PARTITION BY key ORDER BY ts) AS k FROM e)
SELECT key, min(ts) AT TIME ZONE 'UTC' AS start, max(ts) AT TIME ZONE 'UTC' AS "end", count(*) AS changes FROM s GROUP BY key, k""",
}

SQL["source_fingerprint"] = """WITH c AS (SELECT graph_id, file_path, arg_max(content_hash, (indexed_at, content_hash)) AS ch FROM file_hashes
  WHERE content_hash IS NOT NULL AND content_hash NOT LIKE 'error:%' GROUP BY ALL),
h AS (SELECT graph_id, sha256(file_path || chr(10) || ch) AS h FROM c),
s AS (SELECT graph_id, count(*) AS files, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::HUGEINT)::VARCHAR AS l{i}" for i in range(4)) + """ FROM h GROUP BY ALL)
SELECT graph_id, files, sha256(l0 || ':' || l1 || ':' || l2 || ':' || l3) AS fingerprint FROM s"""
SQL["code_snippets"] = """WITH s AS (SELECT DISTINCT graph_id, id, file_path, line_start, line_end FROM nodes WHERE line_start IS NOT NULL AND line_end IS NOT NULL),
d AS (SELECT graph_id, file_path, string_split_regex(arg_max(text, (crawled_at, doc_id)), '\\r\\n|\\r|\\n') AS l FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT graph_id, id, array_to_string(list_transform(range(greatest(line_start - 2, 1), least(line_end + 2, len(l)) + 1),
  lambda k: CASE WHEN k BETWEEN line_start AND line_end THEN '>>> ' ELSE '    ' END || lpad(k::VARCHAR, 4, ' ') || ' | ' || l[k]), chr(10)) AS snippet FROM s JOIN d USING (graph_id, file_path)"""
SQL["streaming_debounce"] = """WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT key, ts, sum(f) OVER (PARTITION BY key ORDER BY ts) AS k FROM e),
g AS (SELECT key, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS changes FROM s GROUP BY key, k)
SELECT key, a AT TIME ZONE 'UTC' AS start, b AT TIME ZONE 'UTC' AS "end", changes FROM g WHERE b <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
