"""Processing only what is new or changed since the last successful run."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Outputs of single commits that are kept apart before they are merged.
MOST_OUTPUTS = 16


def current_hashes(file_hashes: DataFrame, upper: object = None) -> DataFrame:
    """Latest usable hash of every file, up to and including the fixed limit `upper` of ``indexed_at``.

    Null hashes and ``error:`` texts are passed over, null times count as earliest, and of several hashes at
    the same time the greatest is taken.
    """
    rows = file_hashes.where(F.col("content_hash").isNotNull() & ~F.col("content_hash").startswith("error:"))
    if upper is not None:
        rows = rows.where((F.col("indexed_at") <= F.lit(upper)) | F.col("indexed_at").isNull())
    last = F.max(F.struct("indexed_at", "content_hash"))
    return rows.groupBy("graph_id", "file_path").agg(last.alias("last")).select(
        "graph_id", "file_path", F.col("last.content_hash").alias("content_hash")
    )


def settled_hashes(sync_runs: DataFrame, sync_log: DataFrame) -> DataFrame:
    """Per file the hash logged by the commit with the highest place in the sequence of successful runs.

    The runs of status ``ok`` in order of ``(started_at, run_id)`` are the commit sequence; a run that failed,
    was aborted or is still running never moves a file's watermark. Log rows sent twice change nothing; should
    one run have logged several hashes of a file, the one processed last counts, then the greatest.
    """
    commits = sync_runs.where("status = 'ok'").select("run_id", "started_at").dropDuplicates(["run_id"])
    place = F.max(F.struct("started_at", "run_id", "processed_at", "content_hash"))
    return (
        sync_log.select("run_id", "graph_id", "file_path", "content_hash", "processed_at")
        .join(commits, "run_id")
        .groupBy("graph_id", "file_path")
        .agg(place.alias("w"))
        .select("graph_id", "file_path", F.col("w.content_hash").alias("settled"), F.col("w.run_id").alias("settled_by"))
    )


def pending_files(file_hashes: DataFrame, settled: DataFrame, upper: object = None) -> DataFrame:
    """Work list of the next run: files whose current hash isn't the settled one.

    Columns ``graph_id, file_path, content_hash``; `settled` are (graph_id, file_path, settled). A file nobody has
    settled yet is in it, a file of which there are only null or ``error:`` hashes is not. Hashes compare byte by byte.
    `upper` fixes the end of the input when the run starts; without it all rows are read. Null graph ids or paths equal
    each other.
    """
    now, done = current_hashes(file_hashes, upper).alias("n"), settled.alias("s")
    same_file = F.col("n.graph_id").eqNullSafe(F.col("s.graph_id")) & F.col("n.file_path").eqNullSafe(F.col("s.file_path"))
    return (
        now.join(done, same_file, "left")
        .where(~F.col("n.content_hash").eqNullSafe(F.col("s.settled")))
        .select("n.graph_id", "n.file_path", "n.content_hash")
    )


class IncrementalJob:
    """Exactly-once batches over a table with a rising commit sequence.

    A run reads the rows with ``low < sequence <= high``: `low` is the watermark of the last commit, `high` is fixed
    when the run starts. Its output goes to a folder of its own, and one small manifest, which names all folders that
    count and the new watermark, commits both at once. A run that dies before leaves a folder that nobody reads and is
    repeated from the same `low`; of two runs at once one gets the manifest's name, the other fails and changes nothing.

    The name is taken by a hard link on local disks and by a rename that refuses an existing target elsewhere. That is
    atomic on HDFS; on an object store without conditional writes two runs at once need a lock of their own.

    A row must never come in at or below a watermark that is committed. A sequence that can get rows late needs an
    upper limit under the first place that is still open, as `settled_state` has it.
    """

    def __init__(self, spark: SparkSession, folder: str, sequence: str) -> None:
        self.spark, self.folder, self.sequence = spark, folder.rstrip("/"), sequence
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def last(self) -> dict | None:
        """The manifest of the last commit: ``number, low, high, outputs``."""
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        names = [n for n in names if n.endswith(".json")]
        return json.loads(self._read(f"{self.folder}/commits/{max(names)}")) if names else None

    def _read(self, path: str) -> str:
        jvm = self.spark.sparkContext._jvm
        stream = self._fs.open(self._path(path))
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame], upper: int | None = None, merge: Callable[[DataFrame], DataFrame] | None = None) -> dict | None:
        """Process what came since the last commit up to `upper`; None if there is nothing new.

        Without `upper` the greatest sequence of the source at the start is taken. Null sequences are refused then; with
        `upper` they are never read. With `merge`, outputs of `MOST_OUTPUTS` commits are merged into one.
        """
        done = self.last()
        low = done["high"] if done else None
        high = upper
        if high is None:
            new = source if low is None else source.where((F.col(self.sequence) > F.lit(low)) | F.col(self.sequence).isNull())
            bounds = new.agg(F.max(self.sequence).alias("high"), F.count_if(F.col(self.sequence).isNull()).alias("nulls")).first()
            if bounds["nulls"]:
                raise ValueError(f"{bounds['nulls']} rows have no {self.sequence}")
            high = bounds["high"]
        if high is None or (low is not None and high <= low):
            return None
        rows = source.where(F.col(self.sequence) <= F.lit(high))
        if low is not None:
            rows = rows.where(F.col(self.sequence) > F.lit(low))
        result = process(rows)
        outputs = done["outputs"] if done else []
        if merge is not None and len(outputs) >= MOST_OUTPUTS:
            result, outputs = merge(self.spark.read.parquet(*outputs).unionByName(result)), []
        out = f"{self.folder}/data/{uuid.uuid4().hex}"
        result.write.parquet(out)
        manifest = {"number": done["number"] + 1 if done else 0, "low": low, "high": high, "outputs": [*outputs, out]}
        self._commit(manifest)
        return manifest

    def _commit(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        draft = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}.json")
        final = self._path(f"{self.folder}/commits/{manifest['number']:012d}.json")
        self._fs.mkdirs(final.getParent())
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                self._fs.delete(draft, False)
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, options)
        except Exception as e:
            if self._fs.exists(final):
                raise RuntimeError("another run has committed meanwhile; this run's output is not part of the table") from e
            raise

    def output(self) -> DataFrame | None:
        """All committed output; folders that the last manifest doesn't name are never read."""
        done = self.last()
        return self.spark.read.parquet(*done["outputs"]) if done else None


def commit_sequence(sync_runs: DataFrame, sync_log: DataFrame) -> DataFrame:
    """Log rows of successful runs with `place`, the microsecond at which their run started (0 if that is null)."""
    place = F.coalesce(F.unix_micros("started_at"), F.lit(0).cast("bigint"))
    commits = sync_runs.where("status = 'ok'").groupBy("run_id").agg(F.max(place).alias("place"))
    return sync_log.select("run_id", "graph_id", "file_path", "content_hash", "processed_at").join(commits, "run_id")


def _winners(rows: DataFrame) -> DataFrame:
    """Per file the row with the highest place, then run, then processed last, then the greatest hash."""
    best = F.max(F.struct("place", "run_id", "processed_at", "content_hash")).alias("w")
    return rows.groupBy("graph_id", "file_path").agg(best).select("graph_id", "file_path", "w.*")


def settled_state(job: IncrementalJob, sync_runs: DataFrame, sync_log: DataFrame, upper: int | None = None) -> DataFrame:
    """Settled hashes ``graph_id, file_path, settled``, of which `job` keeps what no later run can change.

    The commit sequence is the runs' start. A run that is still ``running`` may yet succeed, so the limit, fixed when
    this starts, is under the first of those (and at most `upper`). Log rows above the last committed place and up to
    the limit are folded into the kept state and committed together with the limit as the new watermark; rows above the
    limit are read but not committed.
    """
    place = F.unix_micros("started_at")
    # of all runs the last may still get a sibling in the same microsecond
    bounds = sync_runs.agg(F.min(F.when(F.col("status") == "running", place)).alias("open"), F.max(place).alias("last")).first()
    limits = [x - 1 for x in (bounds["open"], bounds["last"]) if x is not None] + ([upper] if upper is not None else [])
    rows = commit_sequence(sync_runs, sync_log)
    if limits:
        job.run(rows, _winners, min(limits), _winners)
    kept, done = job.output(), job.last()
    tail = rows if done is None else rows.where(F.col("place") > F.lit(done["high"]))
    if upper is not None:
        tail = tail.where(F.col("place") <= F.lit(upper))
    every = _winners(tail) if kept is None else _winners(kept.unionByName(tail.select(*kept.columns)))
    return every.select("graph_id", "file_path", F.col("content_hash").alias("settled"))
