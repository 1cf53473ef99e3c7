"""Structured Streaming over a feed of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def change_feed(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """A folder of Parquet files that grows, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def debounced(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Batches of changes (key, ts) that end after `gap` of quiet; changes later than `late` are dropped.

    In append mode a batch comes out when the watermark has passed its end, so the newest stays open.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "key")
        .agg(F.count(F.lit(1)).alias("changes"))
        .select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")
    )


def distinct_changes(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Changes without repetitions within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process what is there, appending to Parquet at `out`, and return the table. Exactly once with the same checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def merge_latest(state_folder: str):
    """A `foreachBatch` function that keeps the last hash of each file: every batch writes a new version of the state.

    A version is named by its batch, so a batch that is repeated after a failure overwrites its own; versions before the
    one it is made from are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(state_folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        versions = sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v")) if fs.exists(path) else []
        older = [v for v in versions if v < number]
        rows = batch if not older else spark.read.parquet(f"{state_folder}/v{older[-1]}").unionByName(batch)
        last = rows.groupBy("graph_id", "file_path").agg(F.max(F.struct("indexed_at", "content_hash")).alias("r"))
        last.select("graph_id", "file_path", "r.indexed_at", "r.content_hash").write.mode("overwrite").parquet(f"{state_folder}/v{number}")
        for v in older[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{state_folder}/v{v}"), True)

    return merge


def latest_state(spark: SparkSession, state_folder: str) -> DataFrame:
    """The state after the last batch of `merge_latest`."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v"))
    return spark.read.parquet(f"{state_folder}/v{last}")


def run_batches(stream: DataFrame, each, checkpoint: str, every: str | None = None) -> None:
    """Run a `foreachBatch` function over what is there, or, with a time like ``10 seconds``, start it at that interval and
    return at once. One run at a time holds a checkpoint; a second one on the same folder fails."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if every is None:
        writer.trigger(availableNow=True).start().awaitTermination()
    else:
        writer.trigger(processingTime=every).start()
